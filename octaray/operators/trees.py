"""Hybrid trees, built level by level: which primitives reach a node is decided by its parent's pairs only.

The levels near the root are DataFrame rounds, for as long as a branch has more primitives than one task should hold
(``inside``); below, each branch is grown in arrays in one task.

A node is internal if its depth is below the maximum and two or more primitives reach it; its children replicate every
primitive whose box touches theirs (closed). Nodes are named by depth and a path of base-8 digits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, longest_axis, overlap, overlap_values
from ..plans import schedule as plan
from ..sources.scratch import settle
from .scans import sorted_position
from .treelets import Treelet, grow, runs

PRIM = [f"p_{n}" for n in BOX]
#: Primitives of a branch that one task grows.
INSIDE = 1 << 15


#: Rows of nodes that a round sends to all tasks.
FEW = 1 << 17


def few(nodes: DataFrame) -> DataFrame:
    """A settled table of one row (or a few) for each node of a round, broadcast unless there are many nodes.

    While nodes are few each has many pairs, and a join by path would read all pairs of a node in one task.
    """
    return F.broadcast(nodes) if nodes.count() <= FEW else nodes


def build(prims: DataFrame, scene: tuple[float, ...], configs: list[plan.LevelConfig], schedule: str = "compat", inside: int = INSIDE) -> tuple[DataFrame, DataFrame]:
    """(nodes, node_prims) from (prim_id, box) rows. Primitives that miss the scene box are not admitted.

    nodes: depth, path, cls, box, n_prims (leaves; 0 for internal nodes), n_reach, is_leaf. node_prims: depth, path, prim_id.
    """
    top, cut, pairs = build_top(prims, scene, configs, schedule, inside)
    kinds = plan.kinds_by_depth(configs, schedule)
    grown = settle(_grown(cut, pairs, kinds))
    nodes = _named(grown.filter("prim_id IS NULL"), kinds)
    held = grown.filter("prim_id IS NOT NULL").select("depth", "path", "prim_id")
    if top is None:
        return nodes, held
    return top[0].unionByName(nodes), top[1].unionByName(held)


def build_nodes(prims: DataFrame, scene: tuple[float, ...], configs: list[plan.LevelConfig], schedule: str = "compat", inside: int = INSIDE) -> DataFrame:
    """The nodes of ``build`` alone: what leaves hold is neither listed nor written."""
    top, cut, pairs = build_top(prims, scene, configs, schedule, inside)
    kinds = plan.kinds_by_depth(configs, schedule)
    nodes = _named(settle(_grown(cut, pairs, kinds, listed=False)), kinds)
    return nodes if top is None else top[0].unionByName(nodes)


def _named(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    names = F.element_at(F.lit(kinds), F.col("depth") + 1)
    return nodes.select("depth", "path", names.alias("cls"), *BOX, F.when(F.col("is_leaf"), F.col("n_reach")).otherwise(0).alias("n_prims"), "n_reach", "is_leaf")


def build_top(prims: DataFrame, scene: tuple[float, ...], configs: list[plan.LevelConfig], schedule: str = "compat", inside: int = INSIDE) -> tuple[tuple[DataFrame, DataFrame] | None, DataFrame, DataFrame]:
    """The levels above the branches that are small enough for one task: (top, cut, pairs).

    top: (nodes, node_prims) of finished nodes (None where nothing had to be split); cut: the branches' roots (depth,
    path, box); pairs: the primitives that reach them (depth, path, prim_id, box with the prefix p_).
    """
    spark = prims.sparkSession
    kinds, deepest = plan.kinds_by_depth(configs, schedule), plan.max_levels(configs)
    admitted = prims.filter(overlap_values(scene))
    pairs = admitted.select(F.lit(0).cast("long").alias("path"), "prim_id", *[F.col(n).alias(p) for n, p in zip(BOX, PRIM, strict=True)])
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("path"), *[F.lit(v).alias(n) for n, v in zip(BOX, scene, strict=True)])
    done_nodes, done_prims, cut_nodes, cut_prims = [], [], [], []
    for depth in range(deepest + 1):
        if depth:
            pairs = settle(pairs)
        in_arrays = all(k in plan.ARRAY_SPLITS for k in kinds[depth:deepest])
        reach = pairs.groupBy("path").agg(F.count("*").alias("n_reach"))
        here = nodes.join(reach, "path", "left").withColumn("n_reach", F.coalesce("n_reach", F.lit(0)).cast("long"))
        small = F.lit(in_arrays) & (F.col("n_reach") <= inside)
        here = here.withColumn("is_leaf", ~small & (F.lit(depth == deepest) | (F.col("n_reach") < 2))).withColumn("is_cut", small)
        here = settle(here.select(F.lit(depth).alias("depth"), "path", F.lit(kinds[depth]).alias("cls"), *BOX, F.when(F.col("is_leaf"), F.col("n_reach")).otherwise(0).alias("n_prims"), "n_reach", "is_leaf", "is_cut"))
        states = {(r["is_leaf"], r["is_cut"]) for r in here.select("is_leaf", "is_cut").distinct().collect()}  # at most three
        done_nodes.append(here.filter("NOT is_cut").drop("is_cut"))
        cut_nodes.append(here.filter("is_cut").select("depth", "path", *BOX))
        whole = states == {(False, True)}
        marked = pairs.withColumn("is_cut", F.lit(True)).withColumn("is_leaf", F.lit(False)) if whole else pairs.join(few(here.select("path", "is_leaf", "is_cut")), "path")
        cut_prims.append(marked.filter("is_cut").select(F.lit(depth).alias("depth"), "path", "prim_id", *PRIM))
        if not whole:
            done_prims.append(marked.filter("is_leaf").select(F.lit(depth).alias("depth"), "path", "prim_id"))
        if (False, False) not in states:
            break
        inner = here.filter("NOT is_leaf AND NOT is_cut").select("path", *BOX)
        if kinds[depth] in plan.PLANAR:
            inner = inner.join(split_planes(pairs, inner), "path")
        children = inner.select(F.col("path").alias("parent"), F.explode(plan.SPLITS[kinds[depth]]()).alias("c"))
        children = children.select("parent", (F.col("parent") * 8 + F.col("c.k")).alias("child"), *[f"c.{n}" for n in BOX])
        children = few(settle(children))
        reached = pairs.join(children, F.col("path") == F.col("parent")).filter(overlap("p_", ""))
        pairs = reached.select(F.col("child").alias("path"), "prim_id", *PRIM)
        nodes = children.select(F.col("child").alias("path"), *BOX)
    top = (reduce(DataFrame.unionByName, done_nodes), reduce(DataFrame.unionByName, done_prims)) if done_prims else None
    return top, reduce(DataFrame.unionByName, cut_nodes), reduce(DataFrame.unionByName, cut_prims)


GROWN = "depth int, path long, " + ", ".join(f"{n} double" for n in BOX) + ", n_reach long, is_leaf boolean, prim_id long"


def grow_group(cut: pa.Table, pairs: pa.Table, kinds: list[str]) -> tuple[Treelet, np.ndarray]:
    """The branch below the one row of ``cut`` over its pairs, and the ids of its primitives in order."""
    ids = pairs.column("prim_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    boxes = np.stack([pairs.column(c).to_numpy() for c in PRIM], axis=1).reshape(-1, 6)[order]
    root = np.array([cut.column(c)[0].as_py() for c in BOX], dtype=np.float64)
    return grow(boxes, root, cut.column("depth")[0].as_py(), cut.column("path")[0].as_py(), kinds), ids[order]


def _grown(cut: DataFrame, pairs: DataFrame, kinds: list[str], listed: bool = True) -> DataFrame:
    """Nodes (prim_id is null) and, if ``listed``, held primitives (n_reach is null) of the branches, each grown in one task."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, ids = grow_group(left, right, kinds)
        leaf, m = tree.kids == 0, len(tree.first)
        of, place = runs(tree.start, tree.count if listed else np.zeros_like(tree.count))
        n = len(of)
        none = pa.nulls(n, pa.float64())
        return pa.table({
            "depth": pa.array(np.concatenate([tree.depth, tree.depth[of]]), pa.int32()),
            "path": np.concatenate([tree.path, tree.path[of]]),
            **{c: pa.chunked_array([pa.array(tree.boxes[:, i]), none]) for i, c in enumerate(BOX)},
            "n_reach": pa.chunked_array([pa.array(tree.reach), pa.nulls(n, pa.int64())]),
            "is_leaf": pa.chunked_array([pa.array(leaf), pa.nulls(n, pa.bool_())]),
            "prim_id": pa.chunked_array([pa.nulls(m, pa.int64()), pa.array(ids[tree.held[place]])]),
        })

    held = pairs.select("depth", "path", F.col("prim_id").cast("long").alias("prim_id"), *PRIM)
    return cut.groupBy("depth", "path").cogroup(held.groupBy("depth", "path")).applyInArrow(work, GROWN)


def split_planes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, plane): the larger centroid, on the node's longest axis, of the two primitives of smallest id.

    The two come from two rounds of a minimum, which is aggregated before the shuffle, and not from a sorted window.
    """
    item = F.struct("prim_id", *PRIM)
    first = settle(pairs.groupBy("path").agg(F.min(item).alias("a")))
    second = pairs.join(few(first), "path").filter(F.col("prim_id") > F.col("a.prim_id")).groupBy("path").agg(F.min(item).alias("b"))
    two = nodes.join(first, "path").join(second, "path", "left")
    axis = longest_axis(tuple(F.col(f"max_{x}") - F.col(f"min_{x}") for x in "xyz"))

    def centroid(side: str):
        each = [(F.col(f"{side}.p_min_{x}") + F.col(f"{side}.p_max_{x}")) / 2 for x in "xyz"]
        return F.when(axis == 0, each[0]).when(axis == 1, each[1]).otherwise(each[2])

    return two.select("path", F.greatest(centroid("a"), centroid("b")).alias("plane"))


def remove_empty(nodes: DataFrame) -> DataFrame:
    """Nodes without empty leaves (the root stays): one pass."""
    return nodes.filter(~(F.col("is_leaf") & (F.col("n_prims") == 0)) | (F.col("depth") == 0))


def removed_count(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes ``remove_empty`` takes away, and how many stay."""
    gone = F.col("is_leaf") & (F.col("n_prims") == 0) & (F.col("depth") > 0)
    return nodes.agg(F.count_if(gone).alias("n_removed"), F.count_if(~gone).alias("n_left"))


def child_counts(nodes: DataFrame) -> DataFrame:
    below = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.shiftright("path", 3).alias("path"))
    return below.groupBy("depth", "path").agg(F.count("*").alias("n_children"))


def collapse_once(nodes: DataFrame) -> DataFrame:
    """Single-child nodes give way to their child, from the top down; what a promoted child holds is not visited.

    So the highest single-child node of every branch goes, and all below it moves up by one level (``level``).
    """
    single = child_counts(nodes).filter("n_children = 1").select("depth", "path")
    up = F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("k")
    lines = nodes.select(F.col("depth").alias("d"), F.col("path").alias("p"), "depth", "path", up)
    lines = lines.select("d", "p", (F.col("depth") - F.col("k")).alias("depth"), F.expr("shiftright(path, cast(3 * k as int))").alias("path"))
    top = lines.join(single, ["depth", "path"]).groupBy("d", "p").agg(F.min("depth").alias("top"))
    out = nodes.join(top, (F.col("depth") == F.col("d")) & (F.col("path") == F.col("p")), "left").drop("d", "p")
    out = out.filter(F.col("top").isNull() | (F.col("top") < F.col("depth")))
    return out.withColumn("level", F.col("depth") - F.col("top").isNotNull().cast("int")).drop("top")


def collapse(nodes: DataFrame) -> DataFrame:
    """All single-child nodes give way at once: the fixpoint of ``collapse_once``."""
    single = child_counts(nodes).filter("n_children = 1").select("depth", "path")
    return nodes.join(single, ["depth", "path"], "left_anti")


def sanity_violations(nodes: DataFrame, deepest: int) -> DataFrame:
    """One row: nodes that have both or neither of children and primitives, leaves that should have split, levels too deep."""
    n = nodes.join(child_counts(nodes), ["depth", "path"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return n.agg(
        F.count_if((F.col("n_children") > 0) == (F.col("n_prims") > 0)).alias("both_or_neither"),
        F.count_if(F.col("is_leaf") & (F.col("n_prims") > 1) & (F.col("depth") < deepest)).alias("unsplit"),
        F.count_if(F.col("depth") > deepest).alias("too_deep"),
    )


def stats(nodes: DataFrame, node_prims: DataFrame, deepest: int) -> DataFrame:
    """One row of true counts; ``reported_leaves`` and ``reported_avg`` count every leaf twice, as the printed report does."""
    distinct = node_prims.agg(F.count_distinct("prim_id").alias("n_distinct"))
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.sum("n_prims").alias("n_refs"))
    row = n.join(F.broadcast(distinct))  # two rows of one
    leaves = F.col("n_leaves")
    return row.select(
        F.lit(deepest).alias("levels"), "n_nodes", "n_leaves", "n_refs", "n_distinct", (F.col("n_refs") / leaves).alias("avg_prims"),
        (leaves * 2).alias("reported_leaves"), (F.col("n_refs") / (leaves * 2)).alias("reported_avg"),
    )


def preorder_key(deepest: int):
    """Sorts nodes in pre-order: the path's digits behind a leading 1, padded to the deepest level."""
    digits = F.lpad(F.conv(F.col("path").cast("string"), 10, 8), 21, "0")
    own = F.expr("substring(lpad(conv(cast(path as string), 10, 8), 21, '0'), 22 - depth, depth)")
    return F.when(F.col("depth") == 0, F.lit("")).otherwise(F.when(digits.isNotNull(), own))


def preorder(nodes: DataFrame, deepest: int) -> DataFrame:
    """Nodes with ``position`` in pre-order from 0."""
    return sorted_position(nodes.withColumn("pre", preorder_key(deepest)), ["pre"]).drop("pre")


def empty_cells(nodes: DataFrame, node_prims: DataFrame) -> DataFrame:
    """Leaves that hold nothing. Each node that holds something comes once, however much it holds."""
    return nodes.filter("is_leaf").join(node_prims.select("depth", "path").distinct(), ["depth", "path"], "left_anti")
