"""Level schedules of hybrid trees, and the registry of node splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import BOX, longest_axis

#: A split maps the node's columns (BOX, and ``plane`` if it asks for one) to an array of (k, box) structs.
SPLITS: dict[str, Callable[[], Column]] = {}
#: Splits that need ``plane``: the larger centroid, on the longest axis, of the two primitives of smallest id.
PLANAR = {"kdtree"}
#: The same splits in arrays, for branches that one task holds: (boxes, planes) -> (parent, k, child boxes). A split
#: without this form runs in DataFrame rounds at every level.
ARRAY_SPLITS: dict[str, Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}


@dataclass(frozen=True)
class LevelConfig:
    kind: str
    levels: int


def register_split(name: str, split: Callable[[], Column], planar: bool = False, arrays: Callable | None = None) -> None:
    SPLITS[name] = split
    (PLANAR.add if planar else PLANAR.discard)(name)
    ARRAY_SPLITS.pop(name, None)
    if arrays is not None:
        ARRAY_SPLITS[name] = arrays


def longest_axes(boxes: np.ndarray) -> np.ndarray:
    """``longest_axis`` in arrays."""
    x, y, z = (boxes[:, 3:] - boxes[:, :3]).T
    return np.where((x > y) & (x > z), 0, np.where(y > z, 1, 2))


def grid_arrays(counts: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """``_grid`` in arrays, with the numbers of cells along the axes from the boxes."""

    def split(boxes: np.ndarray, planes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = counts(boxes)
        size = n.prod(axis=1)
        parent = np.repeat(np.arange(len(boxes)), size)
        k = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size)
        ny, nz = n[parent, 1], n[parent, 2]
        at = np.stack([k // (ny * nz), k // nz % ny, k % nz], axis=1)
        step = ((boxes[:, 3:] - boxes[:, :3]) / n)[parent]
        low = boxes[parent, :3] + step * at
        return parent, k, np.hstack([low, low + step])

    return split


def _only(value: int, other: int) -> Callable[[np.ndarray], np.ndarray]:
    """Numbers of cells: ``value`` along the longest axis, ``other`` along the rest."""
    return lambda boxes: np.where(longest_axes(boxes)[:, None] == np.arange(3), value, other)


def plane_arrays(boxes: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    axis, row = longest_axes(boxes), np.arange(len(boxes))
    both = np.repeat(boxes, 2, axis=0)
    both[2 * row, axis + 3] = both[2 * row + 1, axis] = planes
    return np.repeat(row, 2), np.tile([0, 1], len(boxes)), both


def cumulative(configs: list[LevelConfig]) -> list[int]:
    out, total = [], 0
    for c in configs:
        total += c.levels
        out.append(total)
    return out


def max_levels(configs: list[LevelConfig]) -> int:
    return sum(c.levels for c in configs)


def kind_of_level(configs: list[LevelConfig], level: int) -> str:
    """The first configuration whose cumulative level count reaches the level."""
    return next((c.kind for c, upto in zip(configs, cumulative(configs), strict=True) if upto >= level), configs[-1].kind)


def kinds_by_depth(configs: list[LevelConfig], schedule: str = "compat") -> list[str]:
    """Node kind at each depth. ``compat``: a child gets the kind of its parent's level; ``intuitive``: of its own."""
    if schedule == "intuitive":
        flat = [c.kind for c in configs for _ in range(c.levels)]
        return [*flat, flat[-1]]
    return [kind_of_level(configs, max(0, depth - 1)) for depth in range(max_levels(configs) + 1)]


def child(k: int, low: tuple, high: tuple) -> Column:
    bounds = [v.cast("double").alias(n) for n, v in zip(BOX, (*low, *high), strict=True)]
    return F.struct(F.lit(k).cast("long").alias("k"), *bounds)


def _grid(counts: tuple[int, int, int]) -> Column:
    """nx * ny * nz equal cells, x-major: cell (i, j, k) is child (i ny + j) nz + k."""
    nx, ny, nz = counts
    low, high = [F.col(n) for n in BOX[:3]], [F.col(n) for n in BOX[3:]]
    step = [(b - a) / float(n) for a, b, n in zip(low, high, counts, strict=True)]
    cells = []
    for c in range(nx * ny * nz):
        at = (c // (ny * nz), c // nz % ny, c % nz)
        lo = [a + s * float(i) for a, s, i in zip(low, step, at, strict=True)]
        cells.append(child(c, tuple(lo), tuple(a + s for a, s in zip(lo, step, strict=True))))
    return F.array(*cells)


def _by_axis(make: Callable[[int], Column]) -> Column:
    axis = longest_axis(tuple(F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"))
    return F.when(axis == 0, make(0)).when(axis == 1, make(1)).otherwise(make(2))


def octree_split() -> Column:
    return _grid((2, 2, 2))


def quadtree_split() -> Column:
    """The longest axis stays whole, the two others are halved."""
    return _by_axis(lambda axis: _grid(tuple(1 if i == axis else 2 for i in range(3))))


def midpoint_split() -> Column:
    return _by_axis(lambda axis: _grid(tuple(2 if i == axis else 1 for i in range(3))))


def plane_split() -> Column:
    """Two boxes at ``plane``, which is not clamped to the node's box."""

    def make(axis: int) -> Column:
        low, high = [F.col(n) for n in BOX[:3]], [F.col(n) for n in BOX[3:]]
        below, above = list(high), list(low)
        below[axis] = above[axis] = F.col("plane")
        return F.array(child(0, tuple(low), tuple(below)), child(1, tuple(above), tuple(high)))

    return _by_axis(make)


register_split("octree", octree_split, arrays=grid_arrays(lambda boxes: np.full((len(boxes), 3), 2)))
register_split("quadtree", quadtree_split, arrays=grid_arrays(_only(1, 2)))
register_split("bvh", midpoint_split, arrays=grid_arrays(_only(2, 1)))
register_split("kdtree", plane_split, planar=True, arrays=plane_arrays)
