"""Connected components of an edge table, by propagating the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_result, settle, spread_join


@only_result
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id on an edge the smallest id it reaches.

    Every round takes the least label among an id's neighbours (a partial aggregate) and then jumps to the label's
    label, so that the rounds follow the logarithm of the longest path. The edges of a hub, and the members of a giant
    component, which share one label, are dealt over several tasks (``spread_join``).
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("id")).filter("x <> id")
    both = settle(both.unionByName(both.select(F.col("id").alias("x"), F.col("x").alias("id"))).distinct())
    labels = settle(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min(both["id"]), F.col("x")).alias("c")))
    while True:
        told = spread_join(both, labels, ["id"]).groupBy(F.col("x").alias("id")).agg(F.min("c").alias("near"))
        near = settle(labels.join(told, "id").select("id", "c", F.least("c", "near").alias("n")))
        up = near.select(F.col("id").alias("n"), F.col("n").alias("top"))
        after = settle(spread_join(near, up, ["n"]).select("id", F.col("c").alias("old"), F.least("n", "top").alias("c")))
        changed = not after.filter("old <> c").isEmpty()
        labels = after.select("id", "c")
        if not changed:
            return labels.select("id", F.col("c").alias("component"))
