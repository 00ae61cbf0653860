"""Prefix scans over integer keys without a single-partition window: sums of key ranges first, then windows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

ROWS = 4096


def running_sum(df: DataFrame, key: str, value: str, rows: int = ROWS, inclusive: bool = True) -> DataFrame:
    """``df`` with ``running``: the sum of ``value`` up to the row in order of an integer ``key``."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / rows))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.join(base, "_range").withColumn("running", F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_range", "_base")


def global_rank(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``rank`` from 0 in order of an integer ``key``."""
    ranked = running_sum(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", rows, inclusive=False)
    return ranked.withColumnRenamed("running", "rank").drop("_one")


def sorted_position(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """``df`` with the row's number from 0 in order of any keys that tell rows apart.

    Ranges of a global sort, each about as many rows however the keys lie, are numbered inside and moved by the sizes of
    those before them. The ranges are settled, so that both steps see the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*keys)
    out = ranged.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_base") + F.row_number().over(inside) - 1)
    return out.drop("_range", "_base")
