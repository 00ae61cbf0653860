"""Nearest hits through trees and hierarchies: rays descend in rounds of joins to treelets, and search those in arrays.

An index is a table of treelets, one row of arrays for each (``trees.INSIDE`` primitives at most), and a small table of the
links above them, some for each treelet. Rays descend the links in the tasks that hold the rays, and are then grouped
with the treelets that they enter, hot treelets copied to several blocks of rays, nearest treelets first: the best hit
so far bounds what a later round still has to search. Index and query are apart, so one index serves many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX, spread_bits, triangle_bounds
from ..plans import schedule as plan
from ..plans.schedule import LevelConfig
from ..sources.scratch import settle
from . import trees
from .rays import CORNER, HIT, RAY, _coefficients, _entered, _meet, _spread, nearest
from .treelets import EPSILON, RAYS, Treelet, _turns, every_hit, grow, layered, leaves, linked, packed, search

NODE = ["depth", "path"]
KEY = [*NODE, "chunk"]
#: Arrays of a treelet, in the order of their columns.
ARRAYS = ("boxes", "first", "kids", "start", "count", "held")
ROW = "depth int, path long, chunk long, boxes array<double>, " + ", ".join(f"{n} array<int>" for n in ARRAYS[1:]) + ", ids array<long>, corners array<double>"
#: Rays of one block that meets a treelet, at least and at most, and treelets that a ray searches in the first rounds.
BLOCKS, TURNS = (1 << 8, 1 << 13), (1, 4)
#: Links that every task holds as arrays; with more of them, rays and links are joined level by level.
LINKS = 1 << 20
#: Rays and triangles of one task that finds all hits.
ALL_RAYS, ALL_HELD = 1 << 11, 1 << 12
#: Triangles of a treelet of a hierarchy.
HELD = 1 << 15
#: Ids of equal rays that one row lists, and rows of their hits.
COPIES = 1 << 10
LISTED = "ids array<struct<ray_id: long>>, hits array<struct<triangle_id: long, t: double>>"
HITS_OF_COPIES = pa.schema({"ids": pa.list_(pa.struct({"ray_id": pa.int64()})), "hits": pa.list_(pa.struct({"triangle_id": pa.int64(), "t": pa.float64()}))})
#: Levels of the pyramid of grids: 2^10 cells along each axis.
LEVELS = 10


@dataclass
class Index:
    """scene: the box of everything; links: KEY, BOX and ``inner`` of every node above the treelets and of the treelets
    themselves (not inner), with up_depth and up_path; what hangs below nothing has the up_depth -1."""

    scene: tuple[float, ...]
    links: DataFrame
    treelets: DataFrame
    pad: list[float]


LINK = [*KEY, *BOX, "inner", "up_depth", "up_path"]


def _bounds() -> list[Column]:
    return [(F.min if n.startswith("min") else F.max)(n).alias(n) for n in BOX]


def _up(depth: str = "depth", path: str = "path") -> list[Column]:
    return [(F.col(depth) - 1).cast("int").alias("up_depth"), F.shiftright(path, 3).alias("up_path")]


def _row(depth: int, path: int, chunk: int, tree: Treelet, ids: np.ndarray, corners: np.ndarray) -> pa.Table:
    lists = [tree.boxes.reshape(-1), *(getattr(tree, n).astype(np.int32) for n in ARRAYS[1:]), ids, corners.reshape(-1)]
    arrays = [pa.ListArray.from_arrays([0, len(v)], pa.array(v)) for v in lists]
    return pa.Table.from_arrays([pa.array([depth], pa.int32()), pa.array([path], pa.int64()), pa.array([chunk], pa.int64()), *arrays], names=[*KEY, *ARRAYS, "ids", "corners"])


def _corners(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in CORNER], axis=1).reshape(-1, 9)


def _padding(scene: tuple[float, ...]) -> list[float]:
    return [EPSILON * (abs(scene[i]) + abs(scene[i + 3]) + 1) for i in range(3)]


def tree_index(prims: DataFrame, scene: tuple[float, ...], configs: list[LevelConfig], schedule: str = "compat", inside: int = trees.INSIDE) -> Index:
    """A hybrid tree over (prim_id, box, triangle_id, corners); primitives without a triangle shape the tree and are never hit."""
    kinds = plan.kinds_by_depth(configs, schedule)
    top, cut, pairs = trees.build_top(prims, scene, configs, schedule, inside)
    none = F.lit(0).cast("long").alias("chunk")
    cut = cut.select(*NODE, *BOX, none, F.lit(True).alias("splits"))
    held = pairs.select(*NODE, "prim_id", *trees.PRIM, none)
    links = cut.select(*KEY, *BOX, F.lit(False).alias("inner"), *_up())
    if top is not None:
        # Leaves at the deepest level may hold any number: they are dealt into chunks of neighbours with boxes of their own.
        nodes, ends = top
        full = nodes.filter("is_leaf AND n_reach > 0").select(*NODE, *BOX, F.ceil(F.col("n_reach") / inside).cast("int").alias("parts"))
        box = prims.select("prim_id", *[F.col(n).alias(p) for n, p in zip(BOX, trees.PRIM, strict=True)])
        ends = ends.join(F.broadcast(full), NODE).join(box, "prim_id")  # leaves above the cut: few
        ends = settle(ends.select(*NODE, "prim_id", *trees.PRIM, _cell().alias("cell")))
        parts = ends.groupBy(*NODE, "cell").agg(F.ceil(F.count("*") / inside).cast("int").alias("parts"))
        ends = ends.join(F.broadcast(parts), [*NODE, "cell"])
        ends = settle(ends.select(*NODE, "prim_id", *trees.PRIM, (F.shiftleft(F.col("cell"), 32) + F.pmod(F.xxhash64("prim_id"), F.col("parts"))).alias("chunk")))
        held = held.unionByName(ends)
        own = ends.select(*KEY, *[F.col(p).alias(n) for n, p in zip(BOX, trees.PRIM, strict=True)]).groupBy(*KEY).agg(*_bounds())
        inner = nodes.filter("NOT is_leaf AND n_reach > 0").select(*NODE, none, *BOX, F.lit(True).alias("inner"), *_up())
        links = links.unionByName(own.select(*KEY, *BOX, F.lit(False).alias("inner"), *_up())).unionByName(inner)
        cut = cut.unionByName(own.select(*NODE, *BOX, "chunk", F.lit(False).alias("splits")))
    triangle = prims.filter("triangle_id IS NOT NULL").select("prim_id", "triangle_id", *CORNER)
    held = held.join(triangle, "prim_id", "left").select(*KEY, F.col("prim_id").cast("long").alias("prim_id"), F.col("triangle_id").cast("long").alias("triangle_id"), *trees.PRIM, *CORNER)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        depth, path, chunk = (left.column(c)[0].as_py() for c in KEY)
        right = right.sort_by("prim_id")
        boxes = np.stack([right.column(c).to_numpy() for c in trees.PRIM], axis=1).reshape(-1, 6)
        root = np.array([left.column(c)[0].as_py() for c in BOX], dtype=np.float64)
        tree = grow(boxes, root, depth, path, kinds if left.column("splits")[0].as_py() else kinds[: depth + 1])
        # What is no triangle goes from the leaves, and the rest is numbered anew.
        real = right.column("triangle_id").is_valid().to_numpy()
        place = np.cumsum(real) - 1
        kept = real[tree.held]
        before = np.concatenate([[0], np.cumsum(kept)])
        start = before[tree.start]
        count = before[tree.start + tree.count] - start
        slim = packed(Treelet(tree.boxes, tree.first, tree.kids, start, count, place[tree.held[kept]], tree.depth, tree.path, tree.reach), boxes[real])
        right = right.filter(pa.array(real))
        return _row(depth, path, chunk, slim, right.column("triangle_id").to_numpy(), _corners(right))

    rows = cut.groupBy(*KEY).cogroup(held.groupBy(*KEY)).applyInArrow(work, ROW)
    return Index(scene, settle(links.select(*LINK)), settle(rows), _padding(scene))


def _cell() -> Column:
    """The cell of a primitive's center in its leaf's box, in a grid with about ``parts`` cells: neighbours share one."""
    bits = F.ceil(F.log2(F.col("parts")) / 3).cast("int")
    code = F.lit(0).cast("long")
    for x in "xyz":
        low, size = F.least(f"min_{x}", f"max_{x}"), F.abs(F.col(f"max_{x}") - F.col(f"min_{x}"))
        unit = ((F.col(f"p_min_{x}") + F.col(f"p_max_{x}")) / 2 - low) / F.nullif(size, F.lit(0.0))
        code = code * F.pow(F.lit(2), bits) + F.greatest(F.lit(0), F.least(F.floor(F.coalesce(unit, F.lit(0.0)) * F.pow(F.lit(2), bits)), F.pow(F.lit(2), bits) - 1))
    return code.cast("long")


def hierarchy_index(nodes: DataFrame, tri: DataFrame, inside: int = HELD) -> Index:
    """Treelets of an agglomerative hierarchy: the largest branches of at most ``inside`` triangles, links above them."""
    top = nodes.agg(F.max(F.struct("n_tri", "node_id", *BOX)).alias("r")).select("r.*").first()
    scene = (0.0,) * 6 if top["node_id"] is None else tuple(top[n] for n in BOX)
    small = nodes.filter(F.col("n_tri") <= inside)
    large = (F.col("n_tri") > inside).alias("inner")
    plain = [F.lit(0).alias("depth"), F.col("node_id").alias("path"), F.lit(0).cast("long").alias("chunk"), *BOX, "inner"]
    links = nodes.filter(F.col("node_id") == F.lit(top["node_id"])).select("node_id", *BOX, large)
    links = links.select(*plain, F.lit(-1).alias("up_depth"), F.lit(0).cast("long").alias("up_path"))
    if top["node_id"] is None or top["n_tri"] <= inside:
        owned = small.withColumn("owner", F.lit(top["node_id"]).cast("long"))
    else:
        child = F.explode(F.array("left_id", "right_id"))
        up = nodes.filter("left_id IS NOT NULL").select(F.col("node_id").alias("up_path"), (F.col("n_tri") > inside).alias("large"), child.alias("node_id"))
        up = settle(up)
        below = up.filter("large").select("up_path", "node_id").join(nodes.select("node_id", *BOX, large), "node_id")
        links = links.unionByName(below.select(*plain, F.lit(0).alias("up_depth"), "up_path"))
        owner = settle(up.join(small.select("node_id"), "node_id", "left_semi").select("node_id", F.when(F.col("large"), F.col("node_id")).otherwise(F.col("up_path")).alias("owner")))
        while True:  # every pointer jumps to where its target points, until all stand on the branches' tops
            to = owner.select(F.col("node_id").alias("owner"), F.col("owner").alias("next"))
            after = settle(owner.join(to, "owner").select("node_id", F.col("next").alias("owner"), (F.col("next") != F.col("owner")).alias("moved")))
            owner = after.select("node_id", "owner")
            if after.filter("moved").isEmpty():
                break
        owned = small.join(owner, "node_id")
    corners = tri.select("triangle_id", *CORNER)
    whole = owned.join(corners, "triangle_id", "left").select("owner", "node_id", *BOX, F.col("triangle_id").cast("long").alias("triangle_id"), "left_id", "right_id", *CORNER)

    def work(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        left, right = (table.column(c).fill_null(-1).to_numpy() for c in ("left_id", "right_id"))
        boxes = np.stack([table.column(c).to_numpy() for c in BOX], axis=1).reshape(-1, 6)
        tree, leaves = linked(table.column("node_id").to_numpy(), boxes, left, right, owner)
        held = table.take(pa.array(leaves))
        return _row(0, owner, 0, tree, held.column("triangle_id").to_numpy(), _corners(held))

    return Index(scene, settle(links.select(*LINK)), settle(whole.groupBy("owner").applyInArrow(work, ROW)), _padding(scene))


def grid_index(tri: DataFrame, inside: int = trees.INSIDE) -> Index:
    """A pyramid of grids in which every triangle has one place: the cell of its center, at the level of its own size.

    Cells are cubes; a triangle stands at the finest level whose cells are no smaller than its bounds. So the rows
    are as many as the triangles, however large these are. Cells with at most ``inside`` triangles in and below them, under
    a cell with more, are the treelets; what a larger cell holds itself is dealt into treelets of its own.
    """
    prims = _prims(tri)
    scene = _scene(prims)
    side = max(*[scene[i + 3] - scene[i] for i in range(3)], 1e-300)
    extent = F.greatest(*[F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"])
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(side) / F.nullif(extent, F.lit(0.0)))))).cast("int")
    cells = 1 << LEVELS
    place = [F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(((F.col(f"min_{x}") + F.col(f"max_{x}")) / 2 - scene[i]) / (side / cells)))).cast("long") for i, x in enumerate("xyz")]
    code = spread_bits(place[0]) * 4 + spread_bits(place[1]) * 2 + spread_bits(place[2])
    placed = prims.select(F.coalesce(level, F.lit(LEVELS)).alias("depth"), code.alias("path"), *BOX, F.col("triangle_id").cast("long").alias("triangle_id"), *CORNER)
    placed = placed.withColumn("path", F.expr(f"shiftright(path, 3 * ({LEVELS} - depth))"))
    own = settle(placed.groupBy(*NODE).agg(F.count("*").alias("own"), *_bounds()))
    up = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    up = up.select((F.col("depth") - F.col("k")).alias("depth"), F.expr("shiftright(path, 3 * k)").alias("path"), F.when(F.col("k") == 0, F.col("own")).otherwise(0).alias("here"), "own", *BOX)
    every = settle(up.groupBy(*NODE).agg(F.sum("own").alias("total"), F.sum("here").alias("own"), *_bounds()).withColumn("inner", F.col("total") > inside))
    state, none = [*NODE, *BOX, "inner"], F.lit(0).cast("long").alias("chunk")
    links = every.filter("depth = 0").select(*state, none, *_up())
    large = every.filter("inner")
    if large.isEmpty():
        placed = placed.select(F.lit(0).alias("at"), F.lit(0).cast("long").alias("owner"), none, "*")
    else:
        parent = large.select(F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        below = every.filter("depth > 0").select(*state, none, *_up()).join(F.broadcast(parent), ["up_depth", "up_path"])  # few: each has many below it
        held = large.filter("own > 0")
        parts = held.select(*NODE, F.ceil(F.col("own") / inside).cast("int").alias("parts"))
        itself = held.join(parts, NODE).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        itself = itself.select(*NODE, *BOX, F.lit(False).alias("inner"), "chunk", F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        links = settle(links.unionByName(below.select(*links.columns)).unionByName(itself.select(*links.columns)))
        tops = links.filter("NOT inner").select("depth", "path").distinct()
        lines = own.select(F.col("depth").alias("d"), F.col("path").alias("p"), "depth", "path", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("k"))
        lines = lines.select("d", "p", (F.col("depth") - F.col("k")).alias("depth"), F.expr("shiftright(path, 3 * k)").alias("path"))
        # Of the treelets' tops above a cell the deepest is its own; a large cell's own treelet lies above those below it.
        owner = lines.join(tops, NODE).groupBy("d", "p").agg(F.max(F.struct("depth", "path")).alias("o"))
        owner = owner.select(F.col("d").alias("depth"), F.col("p").alias("path"), F.col("o.depth").alias("at"), F.col("o.path").alias("owner"))
        parts = parts.withColumnRenamed("depth", "at").withColumnRenamed("path", "owner")
        placed = placed.join(owner, NODE).join(parts, ["at", "owner"], "left")
        placed = placed.withColumn("chunk", F.pmod(F.xxhash64("triangle_id"), F.coalesce("parts", F.lit(1))).cast("long")).drop("parts")

    def work(table: pa.Table) -> pa.Table:
        depth, path, chunk = (table.column(c)[0].as_py() for c in ("at", "owner", "chunk"))
        boxes = np.stack([table.column(c).to_numpy() for c in BOX], axis=1).reshape(-1, 6)
        tree, order = layered(table.column("depth").to_numpy().astype(np.int64), table.column("path").to_numpy(), boxes, depth)
        held, tree = table.take(pa.array(order)), packed(tree, boxes[order])
        return _row(depth, path, chunk, tree, held.column("triangle_id").to_numpy(), _corners(held))

    rows = placed.groupBy("at", "owner", "chunk").applyInArrow(work, ROW)
    return Index(scene, settle(links.select(*LINK)), settle(rows), _padding(scene))


def nearest_indexed(rays: DataFrame, tri: DataFrame, inside: int = trees.INSIDE) -> DataFrame:
    """The rows of brute force, through a pyramid of grids."""
    return through(rays, grid_index(tri, inside))


def _above(links: pa.Table, scene: tuple[float, ...]) -> tuple[Treelet, list[np.ndarray]]:
    """The links as one tree whose leaves are the treelets, and KEY by node; node 0 is the scene."""
    inner = links.column("inner").to_numpy()
    names = {(d, p): i for i, (d, p) in enumerate(zip(*(links.column(c).filter(links.column("inner")).to_pylist() for c in NODE), strict=True), 1)}
    number = np.zeros(len(inner), np.int64)
    number[inner] = np.arange(1, len(names) + 1)
    up = np.fromiter((names.get(u, 0) for u in zip(links.column("up_depth").to_pylist(), links.column("up_path").to_pylist(), strict=True)), np.int64, len(inner))
    order = np.argsort(up, kind="stable")
    place = np.concatenate([[0], np.argsort(order) + 1])  # of the scene, then of every link
    mine = np.concatenate([[0], place[1:][inner]])  # by the parents' numbers
    boxes = np.vstack([np.array(scene).reshape(1, 6), np.stack([links.column(n).to_numpy() for n in BOX], axis=1).reshape(-1, 6)[order]])
    first, kids = np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
    n = np.bincount(up, minlength=len(mine))
    first[mine], kids[mine] = 1 + np.cumsum(n) - n, n
    none = np.zeros(len(boxes), np.int64)
    tree = Treelet(boxes, first, kids, none, np.concatenate([[0], ~inner[order]]).astype(np.int64), none, none, none, none)
    return tree, [np.concatenate([[0], links.column(c).to_numpy()[order]]) for c in KEY]


SEARCH = ["ray_id", *RAY, "best"]


def visits(rays: DataFrame, index: Index, after: int = 0, upto: int | None = None) -> DataFrame:
    """(SEARCH, KEY): the treelets that rays enter no farther than their ``best``, from number ``after`` to ``upto`` on the ray."""
    if index.links.count() > LINKS:
        return _joined_visits(rays, index, after, upto)
    above = rays.sparkSession.sparkContext.broadcast(_above(index.links.toArrow(), index.scene))  # LINKS rows at most
    pad = np.array(index.pad)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key = above.value
        for batch in batches:
            for at in range(0, batch.num_rows, RAYS):
                part = batch.slice(at, RAYS)
                o, d = (np.stack([np.asarray(part.column(f"{p}{x}"), dtype=np.float64) for x in "xyz"], axis=1) for p in "od")
                ray, leaf, near = leaves(tree, o, d, part.column("best").fill_null(np.inf).to_numpy(), pad)
                order = np.lexsort((leaf, near, ray))
                ray, leaf = ray[order], leaf[order]
                turn = _turns(ray)
                now = turn >= after if upto is None else (turn >= after) & (turn < upto)
                held = part.take(pa.array(ray[now]))
                yield pa.RecordBatch.from_arrays([*held.columns, *(pa.array(k[leaf[now]]).cast(t) for k, t in zip(key, (pa.int32(), pa.int64(), pa.int64()), strict=True))], names=[*SEARCH, *KEY])

    return rays.select(*SEARCH).mapInArrow(work, "ray_id long, " + ", ".join(f"{n} double" for n in (*RAY, "best")) + ", depth int, path long, chunk long")


def _joined_visits(rays: DataFrame, index: Index, after: int, upto: int | None) -> DataFrame:
    """``visits`` by rounds of joins with the links, for more links than a task should hold."""
    at = rays.select(*SEARCH, F.lit(-1).alias("up_depth"), F.lit(0).cast("long").alias("up_path"))
    seen = []
    while True:
        at = settle(_entered(at.join(index.links, ["up_depth", "up_path"]), [*KEY, "inner", "best"], index.pad))
        seen.append(at.filter("NOT inner").drop("inner"))
        at = at.filter("inner").select(*SEARCH, F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        if at.isEmpty():
            break
    order = Window.partitionBy("ray_id").orderBy("t_near", *KEY)  # the treelets on one ray
    found = reduce(DataFrame.unionByName, seen).withColumn("turn", F.row_number().over(order))
    found = found.filter((F.col("turn") > after) & (F.col("best").isNull() | (F.col("t_near") <= F.col("best"))))
    return (found if upto is None else found.filter(F.col("turn") <= upto)).select(*SEARCH, *KEY)


def _searched(some: DataFrame, treelets: DataFrame, blocks: DataFrame, every: str | None = None) -> DataFrame:
    """HIT rows: the nearest triangle of each treelet that a ray searches, no farther than its ``best``.

    ``every``: all triangles that a ray can meet are compared, and the 'nearest' of a treelet or 'all' hits are given, these
    in LISTED rows: the hits of a ray in a treelet beside the ``ids`` of its copies.
    """
    blocks = F.broadcast(blocks) if blocks.count() <= 4096 else blocks  # a small table of counted rows
    left = some.join(blocks, KEY).withColumn("block", F.pmod(F.xxhash64("ray_id"), F.col("blocks")).cast("int")).drop("blocks")
    right = treelets.join(blocks, KEY).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = [*KEY, "block"]
    nothing = HITS_OF_COPIES.empty_table() if every == "all" else pa.schema({"ray_id": pa.int64(), "triangle_id": pa.int64(), "t": pa.float64()}).empty_table()

    def work(rays: pa.Table, rows: pa.Table) -> pa.Table:
        if not rays.num_rows or not rows.num_rows:
            return nothing
        part = {n: rows.column(n).combine_chunks().flatten().to_numpy() for n in (*ARRAYS, "ids", "corners")}
        none = np.zeros(len(part["first"]), np.int64)
        tree = Treelet(part["boxes"].reshape(-1, 6), *(part[n].astype(np.int64) for n in ARRAYS[1:]), none, none, none)
        corner = part["corners"].reshape(-1, 9)
        k = _coefficients({c: corner[:, i] for i, c in enumerate(CORNER)})
        stacked = np.stack([*k["a"], *k["e1"], *k["e2"], *k["n"], k["d00"], k["d01"], k["d11"]], axis=1)
        o, d = (np.stack([rays.column(f"{p}{x}").to_numpy() for x in "xyz"], axis=1) for p in "od")

        def meet(r: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c = np.moveaxis(stacked[held], -1, 0)  # pairs, or a block of rays by triangles
            own = {f"{p}{x}": v[r, i] for p, v in (("o", o), ("d", d)) for i, x in enumerate("xyz")}
            return _meet(own, {"a": c[:3], "e1": c[3:6], "e2": c[6:9], "n": c[9:12], "d00": c[12], "d01": c[13], "d11": c[14]})

        if every:
            r, held, t = every_hit(tree, o, d, meet)
            name = part["ids"][held]
            order = np.lexsort((name, t, r))
            if every == "nearest":
                order = order[_turns(r[order]) == 0]
            r, name, t = r[order], name[order], t[order]
            if every == "all":
                some, start = np.unique(r, return_index=True)
                hits = pa.StructArray.from_arrays([pa.array(name), pa.array(t)], names=["triangle_id", "t"])
                return pa.table({"ids": rays.column("ids").combine_chunks().take(pa.array(some)), "hits": pa.ListArray.from_arrays(pa.array(np.append(start, len(r)), pa.int32()), hits)})
            return pa.table({"ray_id": rays.column("ray_id").to_numpy()[r], "triangle_id": name, "t": t})
        bound = rays.column("best").fill_null(np.inf).to_numpy()
        hit, t, name = search(tree, part["ids"], o, d, bound, meet)
        return pa.table({"ray_id": rays.column("ray_id").to_numpy()[hit], "triangle_id": name, "t": t})

    columns = [F.col("ray_id").cast("long").alias("ray_id"), *RAY, F.col("best").cast("double").alias("best"), *key, *(["ids"] if every == "all" else [])]
    # Few heavy groups: more partitions than that, or the runtime puts them into one task for their few bytes.
    spark = some.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = (df.repartition(parts, *key).groupBy(*key) for df in (left.select(*columns), right))
    return left.cogroup(right).applyInArrow(work, LISTED if every == "all" else HIT)


def through(rays: DataFrame, index: Index) -> DataFrame:
    """(ray_id, t, triangle_id) of the nearest hits of all rays that hit something."""
    rays = settle(_spread(rays))
    best = None
    turns = TURNS if index.links.filter("NOT inner").limit(2).count() > 1 else ()
    for after, upto in zip((0, *turns), (*turns, None), strict=True):
        if best is None:
            state = rays.withColumn("best", F.lit(None).cast("double"))
        else:
            state = rays.join(best.select("ray_id", F.col("t").alias("best")), "ray_id", "left")
        some = settle(visits(state, index, after, upto))
        if best is not None and some.isEmpty():
            break
        hits = _searched(some, index.treelets, _blocks(some))
        best = settle(nearest(hits if best is None else hits.unionByName(best.select("ray_id", "triangle_id", "t"))))
    return best


def _once(rays: DataFrame) -> DataFrame:
    """(ray_id, RAY, ids): equal rays in one row under a number of its own, beyond COPIES of them in several of about so many ids."""
    every = rays.select(F.col("ray_id").cast("long").alias("ray_id"), *[F.col(c).cast("double").alias(c) for c in RAY])
    many = settle(every.groupBy(*RAY).agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select(*RAY, F.ceil(F.col("n") / COPIES).alias("parts")))
    part = F.lit(0).cast("long")
    if not many.isEmpty():
        every = every.join(many, list(RAY), "left")
        part = F.pmod(F.xxhash64("ray_id"), F.coalesce("parts", F.lit(1)))
    listed = every.groupBy(*RAY, part.alias("part")).agg(F.collect_list(F.struct("ray_id")).alias("ids"))  # structs: null ids stay
    return settle(listed.select(F.monotonically_increasing_id().alias("ray_id"), *RAY, "ids"))  # numbers are fixed once they are written


def all_hits(rays: DataFrame, tri: DataFrame, every: str = "all", ray_block: int = ALL_RAYS, inside: int = ALL_HELD) -> DataFrame:
    """HIT rows of every hit, or of the nearest in each treelet. Each triangle has one place in the pyramid, so none is found twice.

    Equal rays are compared once; only the result has a row for each of them.
    """
    index, once = grid_index(tri, inside), _once(rays)
    some = visits(_spread(once).withColumn("best", F.lit(None).cast("double")), index)
    if every == "nearest":
        some = settle(some)
        found = nearest(_searched(some, index.treelets, _blocks(some, ray_block), every))
        return found.join(once.select("ray_id", "ids"), "ray_id").select(F.inline("ids"), "triangle_id", "t")
    some = settle(some.join(once.select("ray_id", "ids"), "ray_id"))
    found = _searched(some, index.treelets, _blocks(some, ray_block), every)
    return found.select(F.inline("ids"), "hits").select("ray_id", F.inline("hits"))


def _blocks(some: DataFrame, most: int | None = None) -> DataFrame:
    """KEY and in how many blocks its rays come: enough for all cores, and ``most`` rays a block at most."""
    if most is None:
        most = min(BLOCKS[1], max(BLOCKS[0], some.count() // (4 * some.sparkSession.sparkContext.defaultParallelism)))
    return settle(some.groupBy(*KEY).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")))


def _prims(tri: DataFrame) -> DataFrame:
    lo, hi = triangle_bounds()
    return tri.select(F.col("triangle_id").alias("prim_id"), *[v.alias(n) for n, v in zip(BOX, (*lo, *hi), strict=True)], "triangle_id", *CORNER)


def _scene(prims: DataFrame) -> tuple[float, ...]:
    row = prims.agg(*[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in BOX]).first()
    return tuple(0.0 if v is None else v for v in row)


def through_tree(rays: DataFrame, tri: DataFrame, configs: list[LevelConfig], scene: tuple[float, ...] | None = None, schedule: str = "compat", inside: int = trees.INSIDE) -> DataFrame:
    """The rows of brute force, through a hybrid tree over the triangles' bounds.

    Hits outside ``scene`` (by default the box of all triangles) are not found.
    """
    prims = _prims(tri)
    return through(rays, tree_index(prims, scene or _scene(prims), configs, schedule, inside))


def through_hierarchy(rays: DataFrame, tri: DataFrame, nodes: DataFrame, inside: int = HELD) -> DataFrame:
    """The rows of brute force, through an agglomerative hierarchy over the triangles (``bvh.build``)."""
    return through(rays, hierarchy_index(nodes, tri, inside))


def node_prims(nodes: DataFrame, tri: DataFrame) -> DataFrame:
    """All nodes of a hierarchy as primitives of a hybrid tree: inner nodes carry no triangle, and rays skip them."""
    corners = tri.select("triangle_id", *CORNER)
    return nodes.select(F.col("node_id").alias("prim_id"), *BOX, "triangle_id").join(corners, "triangle_id", "left").select("prim_id", *BOX, "triangle_id", *CORNER)


def through_node_tree(rays: DataFrame, tri: DataFrame, nodes: DataFrame, configs: list[LevelConfig], schedule: str = "compat", inside: int = trees.INSIDE) -> DataFrame:
    """The rows of brute force, through a hybrid tree over the nodes of a hierarchy."""
    prims = node_prims(nodes, tri)
    return through(rays, tree_index(prims, _scene(nodes), configs, schedule, inside))
