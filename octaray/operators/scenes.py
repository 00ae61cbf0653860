"""Scene graphs and scenes that grow: matrices along paths, pre-order numbers, boxes kept by increments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX
from ..sources.scratch import settle

#: Rows of one window of siblings or events.
ROWS = 4096
MATRIX = [f"m{r}{c}" for r in range(3) for c in range(4)]


def _composed(parent: str, own: str) -> list[Column]:
    """The twelve numbers of parent * own, both affine."""
    out = []
    for r in range(3):
        for c in range(4):
            terms = [F.col(f"{parent}m{r}{k}") * F.col(f"{own}m{k}{c}") for k in range(3)]
            if c == 3:
                terms.append(F.col(f"{parent}m{r}3"))
            out.append(reduce(lambda a, b: a + b, terms).alias(f"m{r}{c}"))
    return out


def world_matrices(nodes: DataFrame) -> DataFrame:
    """node_id, parent_id, ord, depth and the matrix from the root, of (node_id, parent_id, ord, MATRIX), level by level.

    A node whose parent is null is a root. One equi-join a level: the rounds follow the depth. A node that no root
    reaches (a cycle, a missing parent) is left out.
    """
    own = settle(nodes.select("node_id", "parent_id", "ord", *MATRIX))
    level = own.filter("parent_id IS NULL").withColumn("depth", F.lit(0))
    seen, depth = [], 0
    while True:
        level = settle(level)
        if level.isEmpty():
            break
        seen.append(level)
        depth += 1
        above = level.select(F.col("node_id").alias("parent_id"), *[F.col(m).alias(f"p_{m}") for m in MATRIX])
        below = own.select("node_id", "parent_id", "ord", *[F.col(m).alias(f"o_{m}") for m in MATRIX]).join(above, "parent_id")
        level = below.select("node_id", "parent_id", "ord", *_composed("p_", "o_"), F.lit(depth).alias("depth"))
    return reduce(DataFrame.unionByName, seen) if seen else level


def _before(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the group that an integer ``order`` puts first.

    Two levels: sums of ranges of ``order``, then windows inside them, so a large group is many windows.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / ROWS))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = settle(sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base")))
    inside = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_range") == F.col("_r"))
    return ranged.join(base, same).withColumn("before", F.col("_base") + F.col("_in")).drop("_range", "_r", "_base", "_in", *[f"_{g}" for g in group])


def pre_order(world: DataFrame) -> DataFrame:
    """``world`` with size (nodes in the subtree) and position in pre-order from 0; siblings, and roots, by ``ord``.

    Sizes rise from the deepest level, positions sink from the roots: a node stands behind its parent and the whole
    subtrees of its earlier siblings. ``ord`` is an integer that tells siblings apart.
    """
    world = settle(world)
    deepest = world.agg(F.max("depth")).first()[0]
    if deepest is None:
        return world.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("position"))
    sized, below = [], None
    for depth in range(deepest, -1, -1):
        here = world.filter(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.groupBy(F.col("parent_id").alias("node_id")).agg(F.sum("size").alias("_s"))
            here = here.join(sums, "node_id", "left").withColumn("size", F.coalesce("_s", F.lit(0)) + 1).drop("_s")
        below = settle(here)
        sized.append(below)
    out, above = [], None
    for level in reversed(sized):
        placed = _before(level, ["parent_id"], "ord", "size")
        if above is None:
            placed = placed.withColumn("position", F.col("before"))
        else:
            up = above.select(F.col("node_id").alias("parent_id"), F.col("position").alias("_p"))
            placed = placed.join(up, "parent_id").withColumn("position", F.col("_p") + 1 + F.col("before")).drop("_p")
        above = settle(placed.drop("before").select(*world.columns, "size", F.col("position").cast("long").alias("position")))
        out.append(above)
    return reduce(DataFrame.unionByName, out)


def placed_box(box: list[Column], matrix: list[Column]) -> list[Column]:
    """Bounds of a box's eight corners through an affine matrix of twelve columns."""
    every = []
    for c in range(8):
        p = [box[i + 3] if c >> i & 1 else box[i] for i in range(3)]
        every.append([matrix[4 * r] * p[0] + matrix[4 * r + 1] * p[1] + matrix[4 * r + 2] * p[2] + matrix[4 * r + 3] for r in range(3)])
    return [F.least(*[e[r] for e in every]) for r in range(3)] + [F.greatest(*[e[r] for e in every]) for r in range(3)]


def scene_snapshots(events: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each event (seq, model_id, kind, MATRIX): models in the scene, the scene's box, the event's own box.

    An 'add' widens the scene's box by the model's box as its matrix places it then. A 'move' gives the model another
    matrix, which the scene's box does not see; ``own_*`` shows where the model is now. Running bounds go over ranges
    of ``seq`` first, so the log may be long.
    """
    box = models.select("model_id", *[F.col(n).alias(f"l_{n}") for n in BOX])
    here = events.join(box, "model_id")
    own = placed_box([F.col(f"l_{n}") for n in BOX], [F.col(m) for m in MATRIX])
    here = here.select("seq", "model_id", "kind", *[v.alias(f"own_{n}") for n, v in zip(BOX, own, strict=True)])
    added = F.col("kind") == "add"
    here = settle(here.withColumn("_range", F.floor(F.col("seq") / ROWS)).withColumn("_one", added.cast("long")).select("*", *[F.when(added, F.col(f"own_{n}")).alias(f"_{n}") for n in BOX]))
    folds = [(F.sum, "_one", "n_models"), *[((F.min if n.startswith("min") else F.max), f"_{n}", n) for n in BOX]]
    ranges = here.groupBy("_range").agg(*[f(c).alias(n) for f, c, n in folds])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranges.select("_range", *[f(n).over(ahead).alias(f"_b_{n}") for f, _, n in folds])
    inside = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = here.select("*", *[f(c).over(inside).alias(n) for f, c, n in folds]).join(base, "_range")
    joint = [(F.coalesce(F.col("_b_n_models"), F.lit(0)) + F.col("n_models")).alias("n_models")]
    joint += [(F.least if n.startswith("min") else F.greatest)(F.col(n), F.col(f"_b_{n}")).alias(n) for n in BOX]
    return run.select("seq", "model_id", "kind", *joint, *[f"own_{n}" for n in BOX])
