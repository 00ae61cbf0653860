"""Mesh text, box CSV, images, camera and duration text."""

import math

import pytest
from pyspark.sql import functions as F

from octaray.functions.camera import Camera
from octaray.functions.geometry import BOX
from octaray.operators import boxes, misc, rays
from octaray.operators import triangles as tri_ops
from octaray.sources import tables


def test_obj_fans_weld_and_cache(spark, tmp_path):
    path = str(tmp_path / "quad.obj")
    with open(path, "w") as f:
        f.write("# a square\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 3//1 4//1\n")
    tri = tables.cached_mesh(spark, path, tables.read_obj)
    assert tri.count() == 2 and abs(tri_ops.areas(tri).agg(F.sum("area")).first()[0] - 1) < 1e-12
    assert tables.cached_mesh(spark, path, None).count() == 2
    vertex, index = tables.vertices(tri)
    welded, joined = tables.weld(vertex, index)
    assert welded.count() == 4 and joined.count() == 2
    smooth = tri_ops.vertex_normals(joined, tri).collect()
    assert {(r["nx"], r["ny"], r["nz"]) for r in smooth} == {(0.0, 0.0, 1.0)}


OBJ = """# two parts
mtllib a.mtl
o first part
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 0
vt 0 0
vt 1 0
vt 1 1
vt 0 1
vn 0 0 1
usemtl red
f 1/1/1 2/2/1 3/3/1 4/4/1
g second
v 0 0 5
usemtl glow
f -1 1//-1 2
f 1 2
f 3/3 4/4 5
"""


def test_every_record_of_a_mesh_file(spark, tmp_path):
    path = tmp_path / "two.obj"
    path.write_text(OBJ)
    got = tables.read_obj_tables(spark, str(path))
    rows = [tuple(r) for r in got["triangle"].orderBy("triangle_id").collect()]
    no = (None,) * 3
    assert rows == [
        (0, 0, 1, 2, 0, 1, 2, 0, 0, 0, "first part", "red"), (1, 0, 2, 3, 0, 2, 3, 0, 0, 0, "first part", "red"),
        (2, 4, 0, 1, *no, None, 0, None, "second", "glow"), (3, 2, 3, 4, 2, 3, None, *no, "second", "glow"),
    ]
    assert [tuple(r) for r in got["vertex"].orderBy("vertex_id").collect()][3:] == [(3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 5.0)]
    assert [tuple(r) for r in got["texture"].orderBy("texture_id").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    assert [tuple(r) for r in got["normal"].collect()] == [(0, 0.0, 0.0, 1.0)]
    tri, square = tables.read_obj(spark, str(path)), got["triangle"].filter("triangle_id < 2")
    tangents = tri_ops.vertex_tangents(square, tri, tri_ops.corner_uv(square, got["texture"])).collect()
    assert {(r["tx"], r["ty"], r["tz"]) for r in tangents} == {(1.0, 0.0, 0.0)} and len(tangents) == 4


def test_mesh_file_over_many_splits(spark, tmp_path):
    """Numbers, names and relative indices run on from split to split, without one task for the whole file."""
    lines, n = [], 3000
    for i in range(n):
        lines += [f"v {i} 0 0", f"v {i} 1 0", f"v {i} 0 1"] + ([f"g part {i // 1000}"] if i % 1000 == 0 else []) + ["f -3 -2 -1"]
    path = tmp_path / "long.obj"
    path.write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = tables.read_obj_tables(spark, str(path))
        got = [tuple(r) for r in parts["triangle"].orderBy("triangle_id").select("triangle_id", "i0", "i1", "i2", "group").collect()]
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{k}", v)
    assert got == [(i, 3 * i, 3 * i + 1, 3 * i + 2, f"part {i // 1000}") for i in range(n)]
    assert parts["vertex"].filter("vertex_id = 3 * x").count() == n


def test_material_file(spark, tmp_path):
    path = tmp_path / "a.mtl"
    path.write_text("newmtl red\nKd 1 0 0\nKa 0.5 0 0\nNs 250\nKe 0 0 0\nmap_Kd wood old.png\n\nnewmtl glow\nKe 2 4 1\nNs 10\n")
    got = {r["name"]: r for r in tables.read_mtl(spark, str(path)).collect()}
    assert got["red"]["diffuse_texture"] == "wood old.png" and got["red"]["dr"] == 1.0 and got["glow"]["dr"] is None
    rows = tables.read_mtl(spark, str(path)).withColumn("mesh_id", F.col("material_id"))
    told = {r["mesh_id"]: tuple(r)[1:] for r in tri_ops.material(rows).collect()}
    assert told[0] == (0.0, 0.0, 0.0, 0.0, 0.25, 0.5) and told[1][:5] == (4.0, 8.0, 16.0, 4.0, 0.01)


def test_flatten_runs_no_job(spark):
    vertex, index = tables.vertices(tables.triangles(spark, "/root/testdata/sf0.001"))
    jobs = spark._jsparkSession.sparkContext().dagScheduler().numTotalJobs
    before = jobs()
    tri_ops.flatten([(vertex, index, ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0)))] * 3)
    assert jobs() == before


def test_box_csv_round_trip(spark, tmp_path):
    rows = [(0.0, 1.0, 2.0, 3.0, 4.0, 5.5)]
    tables.write_boxes_csv(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in BOX)), str(tmp_path / "nodes"))
    assert [tuple(r) for r in tables.read_boxes_csv(spark, str(tmp_path / "nodes")).collect()] == rows


def test_spatial_join_equals_cross_join(spark):
    rows = [(i, float(i * 7 % 23) / 2, float(i * 5 % 11) / 2, float(i * 3 % 7) / 2) for i in range(120)]
    df = spark.createDataFrame(rows, "prim_id long, min_x double, min_y double, min_z double")
    df = df.select("*", (F.col("min_x") + 0.5).alias("max_x"), (F.col("min_y") + 1).alias("max_y"), F.col("min_z").alias("max_z"))
    got = boxes.spatial_join(df, df, 1.0, (0.0, 0.0, 0.0, 8.0, 8.0, 4.0)).collect()
    want = [(a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) <= 0.5 and abs(a[2] - b[2]) <= 1 and a[3] == b[3]]
    assert sorted(map(tuple, got)) == sorted(want)


def test_touching_pairs_equal_cross_join(spark, monkeypatch):
    rows = [(i, float(i * 7 % 23) / 2, float(i * 5 % 3) / 2, 0.0 if i % 2 else -0.0) for i in range(150)]
    rows += [(200 + i, 3.0, 0.5, 0.0) for i in range(400)] + [(1, 3.0, 0.5, 0.0), (999, None, 0.5, 0.0)]  # many copies, an id twice, no bounds
    df = spark.createDataFrame(rows, "prim_id long, min_x double, min_y double, min_z double")
    df = df.select("*", (F.col("min_x") + 0.5).alias("max_x"), (F.col("min_y") + 1).alias("max_y"), F.col("min_z").alias("max_z"))
    rows = [r for r in rows if r[1] is not None]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 0.5 and abs(a[2] - b[2]) <= 1 and a[3] == b[3])
    for copies in (boxes.COPIES, 8):
        monkeypatch.setattr(boxes, "COPIES", copies)
        got = boxes.touching_pairs(df, 1.0, (0.0, 0.0, 0.0, 8.0, 8.0, 4.0)).collect()
        assert sorted(map(tuple, got)) == want


def test_equal_boxes_are_compared_once(spark, monkeypatch):
    """40 copies of 600 boxes are 600 rows, of which none lists more than about COPIES ids."""
    df = spark.range(24_000).selectExpr("id AS prim_id", *[f"CAST(id % 600 AS DOUBLE) AS {n}" for n in BOX])
    for copies, least, most in ((boxes.COPIES, 600, 600), (8, 600 * 4, 600 * 5)):
        monkeypatch.setattr(boxes, "COPIES", copies)
        rows = boxes.equal_boxes(df)
        assert least <= rows.count() <= most and rows.selectExpr("max(size(ids))").first()[0] <= 4 * min(copies, 10)
        assert sorted(r[0] for r in rows.selectExpr("explode(ids)").collect()) == list(range(24_000))


@pytest.mark.parametrize(
    "nanos, said",
    [(0.001, "1ps"), (1.5, "1.500ns"), (100000.5, "100.000us"), (2050020.5, "2.050ms"), (3450050020.5, "3.450s"), (303450050020.5, "5:03.450"), (25503450050020.5, "7:05:03"), (198303450050020.5, "2 days, 7:05:03"), (0.0, None)],
)
def test_format_duration(spark, nanos, said):
    assert spark.range(1).select(misc.format_duration(F.lit(nanos))).first()[0] == said


def test_camera():
    c = Camera()
    u, v, n = c.axes()
    assert n == (0.0, 0.0, -1.0) and u == (-1.0, 0.0, 0.0) and v == (0.0, 1.0, 0.0)
    assert math.isclose(c.fov_y, 2 * math.atan(math.tan(math.radians(10)) / (32 / 24)))
    assert c.boom(1.0).crane(1.0) == c and c.zoom(10.0) == c
    assert Camera(planar=True).dolly(3.0).orbit_y(1.0) == Camera(planar=True)
    assert math.isclose(math.dist(c.orbit_y(0.7).eye, c.look_at), 15.0)


def test_projection():
    c = Camera()
    t = math.tan(c.fov_y / 2)
    p = c.projection_matrix()
    assert p[0][0] == pytest.approx(1 / (t * 4 / 3)) and p[1][1] == pytest.approx(1 / t) and p[3] == (0.0, 0.0, -1.0, 0.0)

    def depth(z, m):
        return (m[2][2] * z + m[2][3]) / (m[3][2] * z + m[3][3])

    assert depth(-c.near, p) == pytest.approx(-1) and depth(-c.far, p) == pytest.approx(1)
    flat = Camera(orthographic=True)
    q = flat.projection_matrix()
    assert flat.corner == (-2 * 32 / 24, -2.0) and q[0][0] == pytest.approx(24 / 64) and q[1][1] == 0.5
    assert depth(-c.near, q) == pytest.approx(-1) and depth(-c.far, q) == pytest.approx(1)
    near = flat.zoom(0.4)
    assert near.corner == pytest.approx((-2 * 32 / 24 + 0.4, -2 + 0.3)) and flat.zoom(5.0) == flat
    assert c.zoom(0.1).fov_y == pytest.approx(c.fov_y - 0.1)
    eye = c.view_matrix()
    assert [sum(r[i] * v for i, v in enumerate((*c.eye, 1.0))) for r in eye] == pytest.approx([0, 0, 0, 1])
    assert c.truck(2.0).eye == (-2.0, 0.0, -15.0) and c.truck(2.0).axes() == c.axes()


def test_camera_state():
    c = Camera().save()
    moved = c.truck(1.0).orbit_y(0.3).zoom(0.05)
    assert moved != c and moved.reset() == c and moved.reset().truck(3.0).reset() == c
    assert Camera().boom(1.0).reset() == Camera().boom(1.0)
    tall = c.with_fov_y(1.0)
    assert tall.fov_x == c.fov_x and tall.fov_y == 1.0 and tall.with_fov_x(0.5).fov_y == pytest.approx(Camera(fov_x=0.5).fov_y)
    wide = c.with_size(64, 24)
    assert wide.fov_y == pytest.approx(c.fov_y) and wide.fov_x == c.fov_x and wide.corner == pytest.approx((-2 * 64 / 24, -2.0))


def test_image_of_misses_is_black(spark, tmp_path):
    c = Camera(width=4, height=3)
    r = rays.camera_rays(spark, c, 4)
    none = spark.createDataFrame([], "ray_id long, t double, triangle_id long")
    image = rays.quantize_image(rays.normalize_image(rays.depth_image(none, r)), 3)
    assert {tuple(x)[2:] for x in image.collect()} == {(0, 0, 0, 255)}
    rays.save_png(image, 4, 3, str(tmp_path / "a.png"))
    assert (tmp_path / "a.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"


def test_inverted_box_of_a_rotation(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "prim_id long, " + ", ".join(f"{n} double" for n in BOX))
    turn = ((0.0, -1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))
    assert tuple(boxes.transform(box, turn).first())[1:] == (0.0, 0.0, 0.0, -2.0, 1.0, 3.0)
    assert tuple(boxes.transform(box, turn, exact=True).first())[1:] == (-2.0, 0.0, 0.0, 0.0, 1.0, 3.0)


def test_camera_pan_and_tilt():
    c = Camera().orbit_xz(0.4)
    u, v, n = c.axes()
    panned = c.pan(0.3)
    assert panned.eye == c.eye and panned.axes()[1][1] == pytest.approx(v[1]) and panned.axes()[2][1] == pytest.approx(n[1])
    tilted = Camera().tilt(0.2)
    assert tilted.axes()[0] == pytest.approx(Camera().axes()[0]) and abs(tilted.axes()[2][1]) == pytest.approx(math.sin(0.2))
    assert Camera().tilt(0.9) == Camera() and Camera().tilt(0.7) != Camera()  # 0.67 are left to the pole, then 0.87
    assert Camera().tilt(-0.9) != Camera() and Camera(planar=True).pan(1.0).tilt(0.1) == Camera(planar=True)


def test_flatten_takes_any_matrix(spark):
    vertex = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "vertex_id long, x double, y double, z double")
    index = spark.createDataFrame([(0, 0, 0, 0)], "triangle_id long, i0 long, i1 long, i2 long")
    turn = ((0.0, -1.0, 0.0, 5.0), (1.0, 0.0, 0.5, 0.0), (0.0, 0.0, 0.0, -7.0))
    v, i = tri_ops.flatten([(vertex, index, turn), (vertex, index, turn)])
    assert [tuple(r) for r in v.orderBy("vertex_id").collect()] == [(0, 0, 3.0, 2.5, -7.0), (1, 1, 3.0, 2.5, -7.0)]
    assert [tuple(r) for r in i.orderBy("triangle_id").collect()] == [(0, 0, 0, 0), (1, 1, 1, 1)]
