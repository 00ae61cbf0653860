"""Line de-duplication over levelled sorted runs of line hashes.

A run is a Parquet table of line hashes, bucketed and sorted by them: for each hash the number of documents that hold
the line and the largest id among them. Documents come in batches. A batch's lines are counted before they are shuffled,
merge-anti-joined with every run, which takes away the lines that a run has settled (enough documents already, and none
of the batch's ids is larger), and what is left becomes a run of level 0. When a level has ``fanout`` runs, they are
merged into one run of the next level. Runs share their buckets, so the joins do not shuffle them; compaction does.

At the end the runs say which lines are common and which document keeps each; the documents' lines, settled as hashes and
positions, meet that table, common lines dealt over many tasks, and each document drops the positions found.

Lines are told apart by 96 bits of two hash functions, which at 10^12 lines makes one false match unlikely (10^-5).

Cases: a null or empty text is one empty line. Every row is a document of its own for the count, repeated rows included;
all rows of the largest id keep their lines, all repeats inside a row too. A null id is smaller than any other. Lines
shorter than ``least`` code points always stay. An empty table gives no rows. Extra columns stay, and those that clash
with ``n_lines`` or ``n_dropped`` are kept: the new ones get underscores.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, free_name, lower_ascii, read_table, scratch_root, settle, spread_join

#: Lines of so many code points, in so many documents, are common.
LEAST, DOCUMENTS = 20, 3
#: Batches that a whole table is dealt into, and runs of one level that are merged.
BATCHES, FANOUT = 4, 3
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
KEY = ["h", "g"]
#: What a null id counts as: below every other.
NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, least: int = LEAST) -> Column:
    """Sorted (h, g, pos) of the lines whose key has at least ``least`` code points."""
    keys = F.transform(lines_of(lower_ascii(text)), lambda x, i: F.struct(F.trim(x, F.lit(SPACE)).alias("key"), i.cast("int").alias("pos")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= least)
    return F.array_sort(F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h"), F.hash(x["key"]).alias("g"), x["pos"].alias("pos"))))


def once_each(hashes: str) -> Column:
    """The first of each run of equal hashes: a document's different lines."""
    s = F.col(hashes)

    def first(x: Column, i: Column) -> Column:
        before = F.element_at(s, F.greatest(i, F.lit(1)).cast("int"))
        return (i == 0) | (before["h"] != x["h"]) | (before["g"] != x["g"])

    return F.filter(s, first)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared scratch folder."""

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.documents, self.fanout = spark, documents, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.option("path", f"{scratch_root(self.spark)}/{name}").option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        _delete(self.spark, f"{scratch_root(self.spark)}/{name}")

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """``lines`` (h, g, n, last) that no run makes needless, by one merge anti-join for each run."""
        for name in self.names:
            run = self.spark.table(name).filter(F.col("n") >= self.documents).select(*KEY, F.col("last").alias("known")).hint("merge")
            same = reduce(lambda a, b: a & b, [lines[c] == run[c] for c in KEY])
            lines = lines.join(run, same & (run["known"] >= lines["last"]), "left_anti")
        return lines

    def add(self, held: DataFrame) -> None:
        """Take in a batch of (h, g, id): each document's different lines."""
        lines = held.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("last"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.unsettled(lines)))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self._write(self._merged(self.levels[at])))
            for name in self.levels[at]:
                self._drop(name)
            self.levels[at] = []
            at += 1

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: a union of bucketed scans passes for partitioned by the buckets without being so.
        files = [f"{scratch_root(self.spark)}/{n}" for n in names]
        every = self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*files)
        return every.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def common(self) -> DataFrame:
        """(h, g, n, last) of the common lines; n may leave out what came after a line was settled."""
        names = self.names
        if not names:
            return self.spark.createDataFrame([], "h long, g int, n long, last long")
        every = self._merged(names) if len(names) > 1 else self.spark.table(names[0])
        return every.filter(F.col("n") >= self.documents)

    def drop(self) -> None:
        for name in self.names:
            self._drop(name)
        self.levels = []


def _batch(ids: DataFrame, batches: int) -> Column:
    """The number of a row's batch, larger ids first: bounds from the ids' approximate quantiles."""
    cuts = ids.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10000).alias("q")).first()["q"] or []
    return reduce(lambda a, b: a + b, [(F.col("id") < F.lit(q)).cast("int") for q in cuts], F.lit(0))


def common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(hashed, common): each row's id, mark and line hashes, and the common lines, both settled."""
    spark = docs.sparkSession
    known = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    batch = _batch(known.select("id"), batches)
    hashed = settle(known.select("id", F.xxhash64("text").alias("mark"), line_hashes(F.col("text"), least).alias("lines"), batch.alias("batch")).filter(F.size("lines") > 0))
    runs = LineRuns(spark, documents, fanout)
    for b in range(batches):
        mine = hashed.filter(F.col("batch") == b).select("id", F.explode(once_each("lines")).alias("x"))
        runs.add(mine.select("x.h", "x.g", "id"))
    common = settle(runs.common())
    runs.drop()
    return hashed, common


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, documents: int = DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the common lines gone from the text but in the largest id that holds them, and n_lines and n_dropped."""
    hashed, common = common_lines(docs, doc_id, text, least, documents, batches, fanout)
    held = hashed.select("id", "mark", F.inline("lines"))
    found = spread_join(held, common.select(*KEY, "last"), KEY, counts=common.select(*KEY, F.col("n").alias("_n")))
    # Rows equal in id and text find the same positions: one set of them serves all.
    gone = settle(found.filter("id < last").groupBy("id", "mark").agg(F.collect_set("pos").alias("gone")))
    own_id, own_mark, own_gone, lines = (free_name(docs, n) for n in ("line_id", "line_mark", "line_gone", "line_list"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    marked = docs.withColumn(own_id, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).withColumn(own_mark, F.xxhash64(F.col(text)))
    # One shuffle of the texts at every size: the table of positions grows with the documents.
    told = gone.select(F.col("id").alias(own_id), F.col("mark").alias(own_mark), F.col("gone").alias(own_gone)).hint("merge")
    out = marked.join(told, [own_id, own_mark], "left")
    out = out.withColumn(lines, lines_of(F.col(text))).withColumn(n_lines, F.size(lines).cast("long"))
    out = out.withColumn(n_dropped, F.coalesce(F.size(own_gone), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own_gone))
    short = F.array_join(F.transform(kept, lambda i: F.element_at(F.col(lines), i + 1)), "\n")
    out = out.withColumn(text, F.when(F.col(own_gone).isNull(), F.col(text)).otherwise(short))
    return out.select(*docs.columns, n_lines, n_dropped)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), cut AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT n) >= 3
), told AS (
  SELECT n, keyed.doc_id, line, pos, common.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY n, doc_id
"""
