"""Agglomerative bounding-volume hierarchy over Morton-ordered triangles.

Each round pairs clusters that are each other's nearest within a window of positions, by surface area of the union, and
merges them. While there are many clusters, a round deals spans of positions to tasks (``step`` is the same round as
joins); once at most ``FINISH`` are left, one task ends the tree: that bound does not grow with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX, surface
from ..sources.scratch import settle
from .scans import global_rank
from .triangles import morton_order

#: Positions of the neighbour search, clusters that one task ends the tree with, positions of one task of a round.
RADIUS, FINISH, SPAN = 128, 1 << 14, 4096
NODE = "node_id long, " + ", ".join(f"{n} double" for n in BOX) + ", triangle_id long, n_tri long, left_id long, right_id long"


def leaves(tri: DataFrame) -> DataFrame:
    """One leaf per triangle; node_id is its position in Morton order."""
    null = F.lit(None).cast("long")
    return morton_order(tri).select(F.col("position").cast("long").alias("node_id"), *BOX, "triangle_id", F.lit(1).cast("long").alias("n_tri"), null.alias("left_id"), null.alias("right_id"))


def clusters_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("pos"), "node_id", "n_tri", *BOX)


def nearest_cluster(clusters: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(pos, nn, area): the cluster within ``radius`` positions whose union has the least area, lowest position first."""
    left = clusters.select("pos", *[F.col(n).alias(f"a_{n}") for n in BOX], F.floor(F.col("pos") / radius).alias("b"))
    right = clusters.select(F.col("pos").alias("q"), *[F.col(n).alias(f"b_{n}") for n in BOX], F.explode(F.sequence(F.floor(F.col("pos") / radius) - 1, F.floor(F.col("pos") / radius) + 1)).alias("b"))
    size = tuple(F.greatest(f"a_max_{x}", f"b_max_{x}") - F.least(f"a_min_{x}", f"b_min_{x}") for x in "xyz")
    pairs = left.join(right, "b").filter((F.col("q") != F.col("pos")) & (F.abs(F.col("q") - F.col("pos")) <= radius))
    best = pairs.select("pos", "q", surface(size).alias("area")).groupBy("pos").agg(F.min(F.struct("area", "q")).alias("m"))
    return best.select("pos", F.col("m.q").alias("nn"), F.col("m.area").alias("area"))


def mutual_pairs(nearest: DataFrame) -> DataFrame:
    """(i, j, area) with i < j, each the other's nearest."""
    other = nearest.select(F.col("pos").alias("j"), F.col("nn").alias("back"))
    found = nearest.join(other, (F.col("nn") == F.col("j")) & (F.col("pos") == F.col("back")))
    return found.filter("pos < j").select(F.col("pos").alias("i"), "j", "area")


def step(clusters: DataFrame, next_id: int, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(merged nodes, clusters of the next round). A merged cluster stays at its lower position; positions close up."""
    pairs = settle(mutual_pairs(nearest_cluster(clusters, radius)))
    numbered = global_rank(pairs, "i", 4096).withColumn("new_id", F.col("rank") + next_id)
    a = clusters.select(F.col("pos").alias("i"), F.col("node_id").alias("left_id"), F.col("n_tri").alias("an"), *[F.col(n).alias(f"a_{n}") for n in BOX])
    b = clusters.select(F.col("pos").alias("j"), F.col("node_id").alias("right_id"), F.col("n_tri").alias("bn"), *[F.col(n).alias(f"b_{n}") for n in BOX])
    box = [(F.least if n.startswith("min") else F.greatest)(f"a_{n}", f"b_{n}").alias(n) for n in BOX]
    merged = settle(numbered.join(a, "i").join(b, "j").select("i", "j", F.col("new_id").cast("long").alias("node_id"), *box, (F.col("an") + F.col("bn")).alias("n_tri"), "left_id", "right_id"))
    gone = merged.select(F.col("i").alias("pos")).unionByName(merged.select(F.col("j").alias("pos")))
    left = clusters.join(gone, "pos", "left_anti").select("pos", "node_id", "n_tri", *BOX)
    left = left.unionByName(merged.select(F.col("i").alias("pos"), "node_id", "n_tri", *BOX))
    after = global_rank(left, "pos", 4096).drop("pos").withColumnRenamed("rank", "pos")
    nodes = merged.select("node_id", *BOX, F.lit(None).cast("long").alias("triangle_id"), "n_tri", "left_id", "right_id")
    return nodes, settle(after.select("pos", "node_id", "n_tri", *BOX))


def _nearest(boxes: np.ndarray, radius: int) -> np.ndarray:
    """For every box in order the position of its nearest within the radius, the lowest among equals; -1 alone."""
    m = len(boxes)
    low, high = (np.ascontiguousarray(boxes[:, k : k + 3].T) for k in (0, 3))
    ahead, behind = np.full(m, np.inf), np.full(m, np.inf)
    to, back = np.full(m, -1), np.full(m, -1)
    at = np.arange(m)
    for shift in range(1, min(radius, m - 1) + 1):
        # One area serves both of a pair: it is the same whichever comes first.
        x, y, z = np.maximum(high[:, :-shift], high[:, shift:]) - np.minimum(low[:, :-shift], low[:, shift:])
        area = 2.0 * x * y + 2.0 * z * y + 2.0 * x * z
        less = np.flatnonzero(area < ahead[:-shift])  # shifts go up: among equals the first is the lowest ahead,
        ahead[less], to[less] = area[less], at[less] + shift
        less = np.flatnonzero(area <= behind[shift:])  # and the last is the lowest behind
        behind[less + shift], back[less + shift] = area[less], at[less]
    return np.where((back >= 0) & (behind <= ahead), back, to)


ROUND = "span long, k long, m long, node_id long, " + ", ".join(f"{n} double" for n in BOX) + ", n_tri long, left_id long, right_id long"


def _round(clusters: DataFrame, n: int, next_id: int, radius: int, span: int) -> tuple[DataFrame, int]:
    """(the clusters of the next round by pos, how many of them are new): one shuffle, and one task for each span of positions.

    A task sees two radii beyond its span on both sides: within one it knows the nearest of every cluster, so it knows
    which of its own are mutual. It counts what it keeps and merges; sums over the spans turn these counts into
    positions and ids. New clusters have links.
    """
    last = (n - 1) // span

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        own, pos = table.column("span")[0].as_py(), table.column("pos").to_numpy()
        boxes = np.stack([table.column(c).to_numpy() for c in BOX], axis=1).reshape(-1, 6)
        ids, n_tri = table.column("node_id").to_numpy(), table.column("n_tri").to_numpy()
        nn, at = _nearest(boxes, radius), np.arange(len(pos))
        mutual = (nn >= 0) & (nn[nn] == at)
        mine = (pos >= own * span) & (pos < (own + 1) * span) & ~(mutual & (nn < at))
        i = at[mine]
        new = mutual[i]
        j = np.where(new, nn[i], i)
        box = np.hstack([np.minimum(boxes[i, :3], boxes[j, :3]), np.maximum(boxes[i, 3:], boxes[j, 3:])])
        old = pa.array(~new)
        empty = pa.scalar(None, pa.int64())
        return pa.table({
            "span": np.full(len(i), own), "k": np.arange(len(i)), "m": pc.if_else(old, empty, pa.array(np.cumsum(new) - 1)), "node_id": pc.if_else(old, pa.array(ids[i]), empty),
            **{c: box[:, x] for x, c in enumerate(BOX)}, "n_tri": np.where(new, n_tri[i] + n_tri[j], n_tri[i]),
            "left_id": pc.if_else(old, empty, pa.array(ids[i])), "right_id": pc.if_else(old, empty, pa.array(ids[j])),
        })

    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - 2 * radius) / span)), F.least(F.lit(last), F.floor((F.col("pos") + 2 * radius) / span)))
    seen = clusters.select("pos", "node_id", "n_tri", *BOX, F.explode(near).alias("span"))
    after = settle(seen.groupBy("span").applyInArrow(work, ROUND))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row for each span
    sums = after.groupBy("span").agg(F.count("*").alias("rows"), F.count("m").alias("made"))
    sums = settle(sums.select("span", "made", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "made")]))
    made = sums.agg(F.sum("made")).first()[0]
    named = F.coalesce("node_id", F.col("m") + F.col("made_before") + next_id)
    out = after.join(sums, "span").select((F.col("k") + F.col("rows_before")).alias("pos"), named.alias("node_id"), *BOX, "n_tri", "left_id", "right_id")
    return out, made


def _finish(pdf: pd.DataFrame, next_id: int, radius: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    boxes, ids, n_tri = pdf[list(BOX)].to_numpy(), pdf["node_id"].to_numpy(), pdf["n_tri"].to_numpy()
    rows = []
    while len(ids) > 1:
        nn, at = _nearest(boxes, radius), np.arange(len(ids))
        first = at[(nn[nn] == at) & (at < nn)]
        second = nn[first]
        new = next_id + np.arange(len(first))
        next_id += len(first)
        low, high = np.minimum(boxes[first, :3], boxes[second, :3]), np.maximum(boxes[first, 3:], boxes[second, 3:])
        total = n_tri[first] + n_tri[second]
        rows.append(pd.DataFrame(np.hstack([low, high]), columns=list(BOX)).assign(node_id=new, n_tri=total, left_id=ids[first], right_id=ids[second]))
        boxes[first], ids[first], n_tri[first] = np.hstack([low, high]), new, total
        keep = np.ones(len(ids), bool)
        keep[second] = False
        boxes, ids, n_tri = boxes[keep], ids[keep], n_tri[keep]
    out = pd.concat(rows) if rows else pd.DataFrame(columns=["node_id", *BOX, "n_tri", "left_id", "right_id"])
    return out.assign(triangle_id=pd.array([None] * len(out), dtype="Int64"))[["node_id", *BOX, "triangle_id", "n_tri", "left_id", "right_id"]]


def build(tri: DataFrame, radius: int = RADIUS, finish: int = FINISH, span: int = SPAN) -> DataFrame:
    """All 2 n - 1 nodes (none for an empty table)."""
    first = settle(leaves(tri))
    clusters = clusters_of(first)
    n = next_id = first.count()
    nodes = first
    while n > finish:
        clusters, made = _round(clusters, n, next_id, radius, span)
        merged = clusters.filter(F.col("node_id") >= next_id).select("node_id", *BOX, F.lit(None).cast("long").alias("triangle_id"), "n_tri", "left_id", "right_id")
        nodes, next_id, n = nodes.unionByName(merged), next_id + made, n - made
    if n > 1:
        at = next_id
        last = clusters.select("pos", "node_id", "n_tri", *BOX).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: _finish(pdf, at, radius), NODE)
        nodes = nodes.unionByName(settle(last))
    return nodes


def depths(nodes: DataFrame) -> DataFrame:
    """(node_id, depth) by pointers that jump twice as far each round, so that rounds follow the logarithm of the depth."""
    links = nodes.select(F.col("node_id").alias("up"), F.explode(F.array_compact(F.array("left_id", "right_id"))).alias("node_id"))
    links = settle(links.select("node_id", "up", F.lit(1).alias("depth")))
    root = nodes.join(links.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(0).alias("depth"))
    while not links.filter("up IS NOT NULL").isEmpty():
        # What points to a root has arrived, and so has what points to a node that has: its pointer is null.
        to = links.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        links = settle(links.join(to, "up", "left").select("node_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return root.unionByName(links.select("node_id", "depth"))


def stats(nodes: DataFrame, traverse: float = 1.0, intersect: float = 1.0) -> DataFrame:
    """One row: nodes, leaves, triangles, and the surface-area cost relative to the root's area."""
    area = surface(tuple(F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"))
    cost = F.sum(area * F.when(F.col("left_id").isNull(), F.col("n_tri") * intersect).otherwise(F.lit(traverse)))
    out = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("left_id").isNull()).alias("n_leaves"), F.max("n_tri").alias("n_triangles"), cost.alias("cost"), F.max_by(area, "n_tri").alias("root_area"))
    return out.select("n_nodes", "n_leaves", "n_triangles", F.round(F.col("cost") / F.nullif("root_area", F.lit(0.0)), 6).alias("sah"))
