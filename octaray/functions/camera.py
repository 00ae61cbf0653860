"""Camera state: a handful of scalars on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

Vec3 = tuple[float, float, float]


def _sub(a: Vec3, b: Vec3) -> Vec3:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _cross(a: Vec3, b: Vec3) -> Vec3:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a: Vec3, b: Vec3) -> float:
    return sum(x * y for x, y in zip(a, b, strict=True))


def _unit(a: Vec3) -> Vec3:
    n = math.sqrt(_dot(a, a))
    return (a[0] / n, a[1] / n, a[2] / n) if n else a


def _plus(a: Vec3, b: Vec3, k: float = 1.0) -> Vec3:
    return a[0] + k * b[0], a[1] + k * b[1], a[2] + k * b[2]


def _turned(v: Vec3, axis: Vec3, angle: float) -> Vec3:
    c, s = math.cos(angle), math.sin(angle)
    across, along = _cross(axis, v), _dot(axis, v) * (1 - c)
    return tuple(v[i] * c + across[i] * s + axis[i] * along for i in range(3))


@dataclass(frozen=True)
class Camera:
    """Perspective (or orthographic) camera; every move gives a new camera."""

    eye: Vec3 = (0.0, 0.0, -15.0)
    look_at: Vec3 = (0.0, 0.0, 0.0)
    up: Vec3 = (0.0, 1.0, 0.0)
    near: float = 0.05
    far: float = 40.0
    fov_x: float = math.radians(20.0)
    #: Set apart by ``with_fov_y`` only: any other angle follows from ``fov_x`` and the aspect when it was set.
    fov_y_set: float | None = None
    width: int = 32
    height: int = 24
    orthographic: bool = False
    planar: bool = False
    corner_set: tuple[float, float] | None = None
    saved: Camera | None = None

    @property
    def aspect(self) -> float:
        return self.width / self.height

    @property
    def fov_y(self) -> float:
        if self.fov_y_set is not None:
            return self.fov_y_set
        return 2 * math.atan(math.tan(self.fov_x / 2) / self.aspect)

    @property
    def corner(self) -> tuple[float, float]:
        """The lower left corner of an orthographic view."""
        return (-2 * self.aspect, -2.0) if self.corner_set is None else self.corner_set

    def with_fov_x(self, angle: float) -> Camera:
        """The vertical angle follows."""
        return replace(self, fov_x=angle, fov_y_set=None)

    def with_fov_y(self, angle: float) -> Camera:
        """The horizontal angle stays: the two no longer belong together."""
        return replace(self, fov_y_set=angle)

    def with_size(self, width: int, height: int) -> Camera:
        """Another aspect: both angles stay, the corner keeps its height."""
        return replace(self, width=width, height=height, fov_y_set=self.fov_y, corner_set=(self.corner[1] * width / height, self.corner[1]))

    def save(self) -> Camera:
        """This camera, which ``reset`` brings back after any moves."""
        return replace(self, saved=replace(self, saved=None))

    def reset(self) -> Camera:
        """The saved camera, or as it stands if none was saved."""
        return self if self.saved is None else replace(self.saved, saved=self.saved)

    def axes(self) -> tuple[Vec3, Vec3, Vec3]:
        """(u, v, n): right, up, backward; a view along the up vector takes a fixed right axis."""
        n = _unit(_sub(self.eye, self.look_at))
        up = _unit(self.up)
        if abs(abs(_dot(n, up)) - 1) < 1e-9:
            u = _unit(_cross((0.0, 0.0, -1.0 if _dot(n, up) > 0 else 1.0), n))
        else:
            u = _unit(_cross(up, n))
        return u, _unit(_cross(n, u)), n

    def view_matrix(self) -> tuple[tuple[float, ...], ...]:
        rows = [(*a, -_dot(a, self.eye)) for a in self.axes()]
        return (*rows, (0.0, 0.0, 0.0, 1.0))

    def projection_matrix(self) -> tuple[tuple[float, ...], ...]:
        n, f = self.near, self.far
        if self.orthographic:
            w, h = -self.corner[0], -self.corner[1]
            return ((1 / w, 0.0, 0.0, 0.0), (0.0, 1 / h, 0.0, 0.0), (0.0, 0.0, -2 / (f - n), -(f + n) / (f - n)), (0.0, 0.0, 0.0, 1.0))
        t = math.tan(self.fov_y / 2)
        return ((1 / (self.aspect * t), 0.0, 0.0, 0.0), (0.0, 1 / t, 0.0, 0.0), (0.0, 0.0, -(f + n) / (f - n), -2 * f * n / (f - n)), (0.0, 0.0, -1.0, 0.0))

    def _moved(self, by: Vec3) -> Camera:
        return replace(self, eye=_plus(self.eye, by), look_at=_plus(self.look_at, by))

    def boom(self, speed: float) -> Camera:
        return self._moved(_plus((0.0, 0.0, 0.0), self.axes()[1], speed))

    def crane(self, speed: float) -> Camera:
        return self.boom(-speed)

    def truck(self, speed: float) -> Camera:
        return self._moved(_plus((0.0, 0.0, 0.0), self.axes()[0], speed))

    def dolly(self, speed: float) -> Camera:
        if self.planar:
            return self
        n = self.axes()[2]
        flat = _unit((n[0], 0.0, n[2]))
        return self._moved(_plus((0.0, 0.0, 0.0), flat, -speed))

    def _orbit(self, axis: Vec3, angle: float) -> Camera:
        if self.planar:
            return self
        around = _turned(_sub(self.eye, self.look_at), axis, angle)
        return replace(self, eye=_plus(self.look_at, around), up=_turned(self.up, axis, angle))

    def orbit_y(self, angle: float) -> Camera:
        return self._orbit((0.0, 1.0, 0.0), angle)

    def orbit_xz(self, angle: float) -> Camera:
        return self._orbit(self.axes()[0], angle)

    def pan(self, angle: float) -> Camera:
        """Turned about the vertical axis, the up vector too."""
        if self.planar:
            return self
        vertical = (0.0, 1.0, 0.0)
        ahead = _turned(_sub(self.look_at, self.eye), vertical, angle)
        return replace(self, look_at=_plus(self.eye, ahead), up=_turned(self.axes()[1], vertical, angle))

    def tilt(self, angle: float) -> Camera:
        """Turned about the right axis; blocked where that would leave less than the step to a pole."""
        u, v, n = self.axes()
        to_pole = math.acos(max(-1.0, min(1.0, _turned(n, u, angle)[1])))
        if self.planar or min(to_pole, math.pi - to_pole) < angle:
            return self
        return replace(self, look_at=_plus(self.eye, _turned(_sub(self.look_at, self.eye), u, angle)), up=_turned(v, u, angle))

    def zoom(self, speed: float) -> Camera:
        if self.orthographic:
            corner = (self.corner[0] + speed, self.corner[1] + speed / self.aspect)
            return replace(self, corner_set=corner) if corner[0] < 0 and corner[1] < 0 else self
        fov = self.fov_y - speed
        return replace(self, fov_x=2 * math.atan(math.tan(fov / 2) * self.aspect), fov_y_set=None) if 0 < fov < math.pi else self

    def track(self, center: Vec3) -> Camera:
        return replace(self, look_at=center)
