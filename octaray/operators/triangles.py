"""Triangle, mesh and scene operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX, center, corners, length, morton, triangle_bounds, triangle_cross
from .scans import global_rank, running_sum, sorted_position


def bounds(tri: DataFrame) -> DataFrame:
    lo, hi = triangle_bounds()
    return tri.select("triangle_id", *[v.alias(n) for n, v in zip(BOX, (*lo, *hi), strict=True)])


def areas(tri: DataFrame) -> DataFrame:
    return tri.select("triangle_id", (length(triangle_cross()) / 2).alias("area"))


def normals(tri: DataFrame) -> DataFrame:
    """Unit normals; degenerate triangles have none (null)."""
    n = triangle_cross()
    size = F.nullif(length(n), F.lit(0.0))
    return tri.select("triangle_id", *[(v / size).alias(f"n{x}") for x, v in zip("xyz", n, strict=True)])


def assemble(index: DataFrame, vertex: DataFrame) -> DataFrame:
    """Triangles from an index and a vertex table: one exploded equi-join and one regrouping by triangle."""
    corner = F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "vertex_id")
    points = index.select("triangle_id", corner).join(vertex, "vertex_id")
    names = ("ax", "ay", "az"), ("bx", "b_y", "bz"), ("cx", "cy", "cz")
    picks = [F.max(F.when(F.col("corner") == i, F.col(x))).alias(n) for i, group in enumerate(names) for x, n in zip("xyz", group, strict=True)]
    return points.groupBy("triangle_id").agg(*picks)


def with_mesh(tri: DataFrame, mesh: DataFrame, granule: int = 300) -> DataFrame:
    """The first mesh whose index range holds the triangle's first index, else mesh 0.

    Ranges are listed under the granules of index space that they touch, so the range join is an equi-join.
    """
    ranges = mesh.select("mesh_id", "start_index", (F.col("start_index") + F.col("length")).alias("stop"))
    ranges = ranges.filter("stop > start_index").withColumn("g", F.explode(F.sequence(F.floor(F.col("start_index") / granule), F.floor((F.col("stop") - 1) / granule))))
    at = tri.select("triangle_id", (F.col("triangle_id") * 3).alias("at")).withColumn("g", F.floor(F.col("at") / granule))
    held = at.join(ranges, "g").filter("start_index <= at AND at < stop").groupBy("triangle_id").agg(F.min("mesh_id").alias("mesh_id"))
    return tri.join(held, "triangle_id", "left").withColumn("mesh_id", F.coalesce("mesh_id", F.lit(0)).cast("long"))


def mesh_bounds(vertex: DataFrame, by: str) -> DataFrame:
    return vertex.groupBy(by).agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in "xyz"])


def scene_bounds(boxes: DataFrame) -> DataFrame:
    """Union of boxes; empty boxes are null and change nothing."""
    return boxes.agg(*[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in BOX])


def mesh_areas(tri: DataFrame) -> DataFrame:
    return tri.groupBy("mesh_id").agg(F.round(F.sum(length(triangle_cross()) / 2), 6).alias("area"))


def mesh_stats(tri: DataFrame) -> DataFrame:
    return tri.groupBy("mesh_id").agg(F.count("*").alias("n_triangles"), (F.count("*") * 3).alias("n_vertices"))


def area_cdf(tri: DataFrame) -> DataFrame:
    """Inclusive running share of the total area, in order of triangle_id."""
    area = areas(tri)
    total = area.agg(F.sum("area").alias("total"))
    run = running_sum(area, "triangle_id", "area")
    return run.join(F.broadcast(total)).select("triangle_id", F.round(F.col("running") / F.nullif("total", F.lit(0.0)), 6).alias("cdf"))  # one row


def _affine(row: tuple[float, float, float, float]) -> Column:
    """One coordinate of a point times a matrix row; zero coefficients are left out."""
    terms = [F.col(x) * k for x, k in zip("xyz", row, strict=False) if k]
    return reduce(lambda a, b: a + b, [*terms, F.lit(float(row[3]))])


def flatten(models: list[tuple[DataFrame, DataFrame, tuple]]) -> tuple[DataFrame, DataFrame]:
    """(vertex, tri_index) of all models' (vertex, index, matrix) in one id space.

    Positions go through the model's matrix, its three rows of four (normals are not touched); each model's ids move behind those before it.
    """
    rows = [[F.lit(k).alias("model_id"), *[_affine(row).alias(x) for x, row in zip("xyz", matrix, strict=True)]] for k, (_, _, matrix) in enumerate(models)]
    vertex = reduce(DataFrame.unionByName, [v.select("vertex_id", *r) for (v, _, _), r in zip(models, rows, strict=True)])
    index = reduce(DataFrame.unionByName, [i.select("triangle_id", "i0", "i1", "i2", F.lit(k).alias("model_id")) for k, (_, i, _) in enumerate(models)])
    base_v, base_t = (F.broadcast(_offsets([m[j] for m in models], n)) for j, n in ((0, "_v"), (1, "_t")))  # one row for each model
    vertex = vertex.join(base_v, "model_id").select((F.col("vertex_id") + F.col("_v")).alias("vertex_id"), "model_id", "x", "y", "z")
    index = index.join(base_v, "model_id").join(base_t, "model_id")
    return vertex, index.select((F.col("triangle_id") + F.col("_t")).alias("triangle_id"), *[(F.col(c) + F.col("_v")).alias(c) for c in ("i0", "i1", "i2")])


def _offsets(frames: list[DataFrame], name: str) -> DataFrame:
    """model_id and the number of rows of the frames before it: counted where the rows are read, by no action."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).withColumn("model_id", F.lit(k)) for k, df in enumerate(frames)])
    before = Window.orderBy("model_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("model_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))


def recenter(vertex: DataFrame, max_scale: float | None) -> DataFrame:
    """Points moved so that the scene's center is the origin, then scaled by min(1, max_scale / largest half extent)."""
    ext = vertex.agg(*[f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in "xyz"])
    lo, hi = [F.col(f"min_{x}") for x in "xyz"], [F.col(f"max_{x}") for x in "xyz"]
    mid = center(tuple(lo), tuple(hi))
    half = F.greatest(*[b - m for b, m in zip(hi, mid, strict=True)])
    scale = F.lit(1.0) if max_scale is None else F.least(F.lit(1.0), F.lit(float(max_scale)) / F.nullif(half, F.lit(0.0)))
    one = ext.select(*[m.alias(f"mid_{x}") for x, m in zip("xyz", mid, strict=True)], F.coalesce(scale, F.lit(1.0)).alias("scale"))
    return vertex.join(F.broadcast(one)).select("vertex_id", *[((F.col(x) - F.col(f"mid_{x}")) * F.col("scale")).alias(x) for x in "xyz"])  # one row


def name_components(components: DataFrame, class_name: str, key: str, used: DataFrame | None = None) -> DataFrame:
    """'<class> <n>' in order of key, skipping used names."""
    ranked = global_rank(components, key, 4096)
    if used is None:
        return ranked.select(key, F.concat_ws(" ", F.lit(class_name), F.col("rank").cast("string")).alias("name"))
    taken = used.select(F.regexp_extract("name", rf"^{class_name} (\d+)$", 1).alias("n")).filter("n <> ''").select(F.col("n").cast("long")).distinct()
    total = components.count() + taken.count()
    free = components.sparkSession.range(total).join(taken, F.col("id") == F.col("n"), "left_anti")
    free = global_rank(free, "id", 4096).withColumnRenamed("id", "number")
    return ranked.join(free, "rank").select(key, F.concat_ws(" ", F.lit(class_name), F.col("number").cast("string")).alias("name"))


def material(df: DataFrame) -> DataFrame:
    """Emission strength is the largest channel; the colour is multiplied by it only above 1; smoothness is shininess / 1000."""
    strength = F.greatest("er", "eg", "eb")
    factor = F.when(strength > 1, strength).otherwise(1.0)
    return df.select("mesh_id", strength.alias("strength"), *[(F.col(c) * factor).alias(c) for c in ("er", "eg", "eb")], (F.col("shininess") / 1000).alias("smoothness"), F.col("ambient_r").alias("metallic"))


def vertex_normals(index: DataFrame, tri: DataFrame) -> DataFrame:
    """Smooth normals: the normalised sum of the unit normals of the triangles at a vertex."""
    n = normals(tri).join(index, "triangle_id")
    n = n.select(F.explode(F.array("i0", "i1", "i2")).alias("vertex_id"), "nx", "ny", "nz").groupBy("vertex_id").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"])
    size = F.nullif(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.lit(0.0))
    return n.select("vertex_id", *[(F.col(f"n{x}") / size).alias(f"n{x}") for x in "xyz"])


def vertex_tangents(index: DataFrame, tri: DataFrame, corners_uv: DataFrame) -> DataFrame:
    """vertex_id and the normalised sum of its triangles' tangents: the directions in which u grows.

    corners_uv: triangle_id and u0, v0 .. u2, v2. Triangles whose texture points lie on one line add nothing.
    """
    a, b, c = corners()
    e1, e2 = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    du1, dv1, du2, dv2 = (F.col(f"{n}{i}") - F.col(f"{n}0") for i in (1, 2) for n in "uv")
    det = F.nullif(du1 * dv2 - du2 * dv1, F.lit(0.0))
    each = tri.join(corners_uv, "triangle_id").select("triangle_id", *[((p * dv2 - q * dv1) / det).alias(f"t{x}") for x, p, q in zip("xyz", e1, e2, strict=True)])
    at = each.filter("tx IS NOT NULL").join(index, "triangle_id").select(F.explode(F.array("i0", "i1", "i2")).alias("vertex_id"), "tx", "ty", "tz")
    summed = at.groupBy("vertex_id").agg(*[F.sum(f"t{x}").alias(f"t{x}") for x in "xyz"])
    size = F.nullif(F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz")), F.lit(0.0))
    return summed.select("vertex_id", *[(F.col(f"t{x}") / size).alias(f"t{x}") for x in "xyz"])


def corner_uv(triangle: DataFrame, texture: DataFrame) -> DataFrame:
    """triangle_id and the texture points u0, v0 .. u2, v2 of its corners, from t0 .. t2."""
    at = triangle.select("triangle_id", F.posexplode(F.array("t0", "t1", "t2")).alias("corner", "texture_id")).join(texture, "texture_id")
    return at.groupBy("triangle_id").agg(*[F.max(F.when(F.col("corner") == i, F.col(n))).alias(f"{n}{i}") for i in range(3) for n in "uv"])


def morton_codes(tri: DataFrame) -> DataFrame:
    """30-bit codes of the centers of the triangles' bounds within the box of all triangles."""
    b = bounds(tri)
    scene = scene_bounds(b).select(*[F.col(n).alias(f"s_{n}") for n in BOX])
    lo, hi = tuple(F.col(n) for n in BOX[:3]), tuple(F.col(n) for n in BOX[3:])
    code = morton(center(lo, hi), tuple(F.col(f"s_{n}") for n in BOX[:3]), tuple(F.col(f"s_{n}") for n in BOX[3:]))
    return b.join(F.broadcast(scene)).select("triangle_id", *BOX, code.alias("morton"))  # one row


def morton_order(tri: DataFrame) -> DataFrame:
    """position: the rank by (morton, triangle_id)."""
    return sorted_position(morton_codes(tri), ["morton", "triangle_id"])
