"""Shared helpers: table access, scratch tables in the shared folder, text conventions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that a join leaves together.
SPREAD = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """A folder that all executors share: in ``spark.checkpoint.dir``, or, in local mode only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.gettempdir()
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: the cluster's machines need a shared folder for intermediate tables")
    return f"{folder.rstrip('/')}/octaray-{spark.sparkContext.applicationId}"


#: Paths of the tables settled inside each open ``only_result``.
_OPEN: list[list[str]] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    It cuts the lineage like checkpoint(), survives the loss of any executor, and later reads prune columns.
    """
    return settled_at(df)[0]


def settled_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The table of ``settle``, and its path."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def only_result(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``make`` with its result settled, after which every other table that it settled is deleted."""

    @wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        _OPEN.append([])
        try:
            made = make(*args, **kwargs)
            spark, before = made.sparkSession, list(_OPEN[-1])
            out = settle(made)
            kept = _OPEN[-1][-1]
            for path in before:
                _delete(spark, path)
        finally:
            _OPEN.pop()
        if _OPEN:
            _OPEN[-1].append(kept)
        return out

    return run


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application, once the results that read them are written."""
    _delete(spark, scratch_root(spark))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on equal names, where one key may hold a great part of ``left``.

    The rows of a key with more than SPREAD are dealt over several tasks by a hash of the row, and the key's rows of
    ``right`` are copied to each. Such keys are at most a SPREAD-th of the rows; Spark broadcasts their table only if it
    is small by its file size. ``rows``: what to count the keys in, if not ``left`` itself (which is read twice);
    ``counts``: the keys with their numbers of rows as ``_n``, where they are known. A hint on ``right`` is kept.
    """
    if counts is None:
        counts = (left if rows is None else rows).groupBy(*on).agg(F.count("*").alias("_n"))
    heavy = settle(counts.filter(F.col("_n") > SPREAD).select(*on, F.ceil(F.col("_n") / SPREAD).cast("int").alias("_parts")))
    if heavy.isEmpty():
        return left.join(right, on, how)
    one = F.coalesce("_parts", F.lit(1))
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    dealt = left.join(heavy, on, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.when(some_null, SPREAD).otherwise(one)).cast("int"))
    copied = right.join(heavy, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1)))
    return dealt.drop("_parts").join(copied.drop("_parts"), [*on, "_part"], how).drop("_part")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def byte_slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Row slices of about so many bytes of the second column each: bounds the memory that a batch needs."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to
