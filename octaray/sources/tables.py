"""Sources and sinks: mesh text, box CSV, Parquet caches, and geometry derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import BOX
from .scratch import settle

BOX_CSV = T.StructType([T.StructField(f"{a}_{e}", T.DoubleType()) for e in ("min", "max") for a in "xyz"])
#: The scenes that trees and joins over the derived tables use: dyadic, so that splits are exact.
BOX_SCENE = (0.0, 0.0, 0.0, 64.0, 16.0, 16.0)
TRIANGLE_SCENE = (0.0, 0.0, -16.0, 64.0, 128.0, 112.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triangle_id, ax .. cz from part: integer coordinates, none degenerate."""
    k = F.col("p_partkey")
    a = (F.col("p_size"), k * 37 % 101, k * 61 % 97)
    b = (a[0] + 2 + k % 5, a[1] + k % 3, a[2] - 1)
    c = (a[0] - 1, a[1] + 3, a[2] + 2 + k % 4)
    cols = [v.cast("double").alias(n) for n, v in zip(("ax", "ay", "az", "bx", "b_y", "bz", "cx", "cy", "cz"), (*a, *b, *c), strict=True)]
    return table(spark, sf_dir, "part").select(k.alias("triangle_id"), *cols)


def vertices(tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex, tri_index) tables: three vertices a triangle."""
    names = (("ax", "ay", "az"), ("bx", "b_y", "bz"), ("cx", "cy", "cz"))
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")) for x, y, z in names])
    vertex = tri.select("triangle_id", F.posexplode(corners).alias("corner", "p"))
    vertex = vertex.select((F.col("triangle_id") * 3 + F.col("corner")).alias("vertex_id"), "p.x", "p.y", "p.z")
    index = tri.select("triangle_id", *[(F.col("triangle_id") * 3 + i).alias(f"i{i}") for i in range(3)])
    return vertex, index


def meshes(tri: DataFrame, size: int = 100) -> DataFrame:
    """mesh_id, start_index, length in index units: mesh k owns the triangles [size k, size k + size)."""
    mesh = F.floor(F.col("triangle_id") / size)
    return tri.groupBy(mesh.alias("mesh_id")).agg(F.count("*").alias("n")).select("mesh_id", (F.col("mesh_id") * 3 * size).alias("start_index"), F.lit(3 * size).cast("long").alias("length"))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ray_id, origin and direction from customer; some direction components are zero on purpose."""
    k = F.col("c_custkey")
    cols = {"ox": F.lit(120.0), "oy": k * 13 % 101, "oz": k * 29 % 97, "dx": F.lit(-1.0), "dy": (k % 11 - 5) / F.lit(32.0), "dz": (k % 7 - 3) / F.lit(32.0)}
    return table(spark, sf_dir, "customer").select(k.alias("ray_id"), *[v.cast("double").alias(n) for n, v in cols.items()])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prim_id and bounds from orders: quarter-unit coordinates, some without thickness, some outside the scene."""
    k = F.col("o_orderkey")
    low = (k * 37 % 261 / F.lit(4.0), k * 13 % 67 / F.lit(4.0), k * 29 % 65 / F.lit(4.0))
    size = (k % 3 / F.lit(4.0), k % 5 / F.lit(4.0), k % 2 / F.lit(4.0))
    bounds = [c.alias(n) for n, c in zip(BOX, (*low, *(a + b for a, b in zip(low, size, strict=True))), strict=True)]
    return table(spark, sf_dir, "orders").select(k.alias("prim_id"), *bounds)


def read_boxes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of an exported CSV, with the library's column names."""
    raw = spark.read.schema(BOX_CSV).csv(path, header=True)
    return raw.select(*[F.col(f"{n[4:]}_{n[:3]}").alias(n) for n in BOX])


def write_boxes_csv(nodes: DataFrame, path: str) -> None:
    """Nodes in the given order as x_min,y_min,z_min,x_max,y_max,z_max with a header."""
    nodes.select(*[F.col(f"{f.name[2:]}_{f.name[0]}").alias(f.name) for f in BOX_CSV]).write.csv(path, header=True, mode="overwrite")


def cached_mesh(spark: SparkSession, path: str, importer) -> DataFrame:
    """The Parquet cache beside a mesh file if it exists; else the import, written there first."""
    cache = f"{path}.parquet"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        importer(spark, path).write.parquet(cache)
    return spark.read.parquet(cache)


#: Where a line of a text file stands: its file, the split that read it, and the order inside the split.
SPLIT = ["file", "block"]


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """SPLIT, at and the words of every line. ``at`` is an order inside a split only."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = raw.select(*SPLIT, "at", F.split(F.trim("value"), r"\s+").alias("w"))
    return lines.withColumn("kind", F.get("w", F.lit(0)))


def _in_file_order(lines: DataFrame, counts: dict[str, Column], names: dict[str, Column]) -> DataFrame:
    """``lines`` with running sums of ``counts``, their own included, and the latest non-null of ``names``, in file order.

    Both run inside each split, and what the splits before it add comes from one row for each split.
    """
    lines = settle(lines.select("*", *[c.cast("long").alias(f"_{n}") for n, c in counts.items()], *[c.alias(f"_{n}") for n, c in names.items()]))
    each = [F.sum(f"_{n}").alias(n) for n in counts] + [F.max(F.when(F.col(f"_{n}").isNotNull(), F.struct("at", F.col(f"_{n}").alias("s")))).alias(n) for n in names]
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the splits of a file
    files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    splits = settle(lines.groupBy(*SPLIT).agg(*each))
    whole = splits.groupBy("file").agg(*[F.sum(n).alias(n) for n in counts])
    whole = whole.select("file", *[F.coalesce(F.sum(n).over(files), F.lit(0)).alias(f"_f_{n}") for n in counts])
    base = splits.select(*SPLIT, *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_b_{n}") for n in counts], *[F.last(F.col(f"{n}.s"), ignorenulls=True).over(ahead).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.select("*", *[F.sum(f"_{n}").over(inside).alias(f"_r_{n}") for n in counts], *[F.last(f"_{n}", ignorenulls=True).over(inside).alias(f"_r_{n}") for n in names])
    run = run.join(F.broadcast(base), SPLIT).join(F.broadcast(whole), "file")  # a row for each split, and for each file
    return run.select(*lines.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}") + F.col(f"_f_{n}")).alias(n) for n in counts], *[F.coalesce(f"_r_{n}", f"_b_{n}").alias(n) for n in names])


def read_obj_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of Wavefront text: vertex, texture (u, v), normal and triangle, numbered in file order from 0.

    triangle: triangle_id, the corners' vertices i0 .. i2, texture points t0 .. t2 and normals n0 .. n2 (null where a
    corner names none), group ('o' or 'g') and material ('usemtl') in force. Polygons become fans. Negative numbers count
    back from the line where they stand. Other records are left out.
    """
    lines = _text_lines(spark, path).filter(F.col("kind").isin("v", "vt", "vn", "f", "o", "g", "usemtl"))
    counts = {"n_v": F.col("kind") == "v", "n_vt": F.col("kind") == "vt", "n_vn": F.col("kind") == "vn", "n_t": F.when(F.col("kind") == "f", F.greatest(F.lit(0), F.size("w") - 3)).otherwise(0)}
    said = F.concat_ws(" ", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))))
    names = {"group": F.when(F.col("kind").isin("o", "g"), said), "material": F.when(F.col("kind") == "usemtl", said)}
    lines = settle(_in_file_order(lines, counts, names))

    def numbers(kind: str, count: str, key: str, *columns: str) -> DataFrame:
        some = lines.filter(F.col("kind") == kind)
        return some.select((F.col(count) - 1).alias(key), *[F.get("w", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns, 1)])

    corner = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda c: F.split(c, "/"))
    face = lines.filter("kind = 'f' AND size(w) > 3").select(corner.alias("c"), (F.col("n_t") - F.col("_n_t") - 1).alias("base"), "n_v", "n_vt", "n_vn", "group", "material")
    fans = face.select("*", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))

    def index(place: Column, part: int, count: str) -> Column:
        i = F.get(F.get("c", place), F.lit(part)).try_cast("long")
        return F.when(i < 0, F.col(count) + i).otherwise(i - 1)

    places = (F.lit(0), F.col("k"), F.col("k") + 1)
    triangle = fans.select(
        (F.col("base") + F.col("k")).alias("triangle_id"),
        *[index(p, part, count).alias(f"{n}{j}") for part, (n, count) in enumerate((("i", "n_v"), ("t", "n_vt"), ("n", "n_vn"))) for j, p in enumerate(places)], "group", "material",
    )
    return {"vertex": numbers("v", "n_v", "vertex_id", "x", "y", "z"), "texture": numbers("vt", "n_vt", "texture_id", "u", "v"), "normal": numbers("vn", "n_vn", "normal_id", "nx", "ny", "nz"), "triangle": triangle}


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (triangle_id, ax .. cz) of Wavefront text, in file order."""
    from ..operators.triangles import assemble

    parts = read_obj_tables(spark, path)
    return assemble(parts["triangle"].select("triangle_id", "i0", "i1", "i2"), parts["vertex"])


def read_mtl(spark: SparkSession, path: str) -> DataFrame:
    """One row for each material of a Wavefront material file: name, colours, shininess and the diffuse texture's path.

    Columns fit ``triangles.material`` once a mesh_id is joined by name: er, eg, eb (Ke), shininess (Ns), ambient_r (Ka).
    """
    said = F.concat_ws(" ", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))))
    lines = _in_file_order(_text_lines(spark, path), {"n": F.col("kind") == "newmtl"}, {"name": F.when(F.col("kind") == "newmtl", said)})

    def value(kind: str, i: int) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.get("w", F.lit(i)).try_cast("double")))

    colours = [value(k, i).alias(n) for k, names in (("Kd", ("dr", "dg", "db")), ("Ke", ("er", "eg", "eb"))) for i, n in enumerate(names, 1)]
    return lines.filter("n > 0").groupBy((F.col("n") - 1).alias("material_id"), "name").agg(*colours, value("Ka", 1).alias("ambient_r"), value("Ns", 1).alias("shininess"), F.max(F.when(F.col("kind") == "map_Kd", said)).alias("diffuse_texture"))


def weld(vertex: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of equal position become the one of smallest id; the index follows."""
    kept = vertex.groupBy("x", "y", "z").agg(F.min("vertex_id").alias("kept"))
    to = vertex.join(kept, ["x", "y", "z"]).select("vertex_id", "kept")
    for i in ("i0", "i1", "i2"):
        index = index.join(to.select(F.col("vertex_id").alias(i), F.col("kept").alias("k")), i).drop(i).withColumnRenamed("k", i)
    return kept.select(F.col("kept").alias("vertex_id"), "x", "y", "z"), index.select("triangle_id", "i0", "i1", "i2")
