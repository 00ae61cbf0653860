"""Mixing sources to target weights by weighted fair queueing.

Sources by code point, null last, weigh 1, 2, 3, 1, ...; they share 100 % of all words, no source gets more than
``max_epochs`` times its own words, and what that frees is shared again by weight. Documents of a source are shuffled
by a keyed hash; epoch e of a document has the virtual finish time (e * source words + words up to its own end) /
target. All copies are ordered by that time over all sources, and the order is cut where the budget is spent.

Running sums are taken in two levels: buckets of the shuffle key (their number follows each source's row count) are
summed first, and a window runs only inside a bucket, so that a hot source is spread over as many tasks as it has
buckets. The cut is found through a histogram of finish times whose number of cells follows the row count.

Cases: a null text is empty and has size 0; documents of size 0 take nothing; a null source is a source of its own;
a null id is ordered first; repeated rows are mixed as separate documents; an empty table gives no rows; extra columns
are not read (``take`` keeps them). Equal finish times are ordered by source, shuffle key and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, read_table, settle

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 4096
SEED = "mix-1"
_SPAN = float(1 << 52)


def shuffle_key(doc_id: Column, seed: str = SEED) -> Column:
    """52 bits of an md5 of seed and id: the same order in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, rows, rank and target, from a table of one row per source.

    Water filling in closed form: in the order of cap / weight, the sources below the level are held at their caps.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    every = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    level = level.withColumn("ahead", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # The first source whose cap is above the level of the rest, and all after it, get their share of that rest.
    free = F.col("rest") * F.col("w") <= F.col("cap") * F.col("ahead")
    place = F.struct((F.col("cap") / F.col("w")).alias("level"), F.col("rank").alias("rank"))
    level = level.withColumn("place", place)
    level = level.withColumn("first", F.min(F.when(free, F.struct("place", "rest", "ahead"))).over(every))
    free = F.col("first").isNotNull() & (F.col("place") >= F.col("first.place"))
    share = F.col("first.rest").cast("double") * F.col("w") / F.nullif(F.col("first.ahead"), F.lit(0))
    target = F.when(free, share).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", "rows", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, source, size, h (shuffle key), source_size, target, copies and taken, one row per document."""
    sized = settle(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), shuffle_key(F.col(doc_id), seed).alias("h")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = settle(source_targets(per_source, weights, max_epochs))
    placed = sized.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.withColumn("bucket", F.floor(F.col("h") / _SPAN * F.ceil(F.col("rows") / rows_per_bucket)))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.join(sums, ["rank", "bucket"]).withColumn("end", F.col("base") + F.sum("size").over(inside))
    ended = settle(ended.select("doc_id", "source", "size", "source_size", "target", "rank", "h", "end"))

    total, rows = ended.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cells = max(1, -(-rows // rows_per_bucket))
    epochs = F.array(*[_copy(e, cells) for e in range(max_epochs)])
    copies = ended.filter(F.col("size") > 0).select("size", F.inline(epochs))
    cell_sums = copies.groupBy("cell").agg(F.sum("size").alias("n"))
    running = cell_sums.withColumn("upto", F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    over = running.filter(F.col("upto") > total).orderBy("cell").limit(1).collect()
    if not over:
        taken = F.lit(max_epochs)
    else:
        cell, spent = over[0]["cell"], over[0]["upto"] - over[0]["n"]
        edge = copies.filter(F.col("cell") == cell)
        order = Window.orderBy("finish", "rank", "h", "id").rowsBetween(Window.unboundedPreceding, 0)
        edge = edge.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= total - spent)
        last = edge.orderBy(*[F.desc(c) for c in ("finish", "rank", "h", "id")]).limit(1).collect()
        taken = F.lit(0)
        for e in range(max_epochs):
            one = _copy(e, cells)
            fits = one["cell"] < cell
            if last:
                fits = fits | (one["cell"] == cell) & (_key(one) <= _key({k: F.lit(last[0][k]) for k in ("finish", "rank", "h", "id")}))
            taken = taken + fits.cast("int")
    out = ended.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))
    return out.select("doc_id", "source", "size", "h", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with the number of copies that the mix takes of each in ``out``, without a shuffle of the texts.

    In a source's shuffled order, the documents up to some point are taken once more than those after it: that point,
    one row for each source, is all that the documents are joined with. Rows of one id and size that lie on the point
    together are all taken the smaller number of times.
    """
    key = F.struct(F.col("h").alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size").alias("size"))
    mixed = mix(docs, doc_id, text, source, seed=seed).filter("size > 0")
    points = mixed.groupBy("source").agg(F.max(F.struct("copies", key.alias("key"))).alias("most"), F.min(F.struct("copies", key.alias("key"))).alias("fewest"))
    point, from_ = free_name(docs, "point"), free_name(docs, "point_source")
    points = settle(points.select(F.col("source").alias(from_), F.struct("most", "fewest").alias(point)))
    joined = docs.join(points, F.col(source).eqNullSafe(F.col(from_)), "left")
    own = F.struct(shuffle_key(F.col(doc_id), seed).alias("h"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), words(F.col(text)).alias("size"))
    most, fewest = F.col(point)["most"], F.col(point)["fewest"]
    early = (most["copies"] == fewest["copies"]) | (own < most["key"]) | (own == most["key"]) & (most["key"] != fewest["key"])
    copies = F.when(words(F.col(text)) == 0, 0).when(early, most["copies"]).otherwise(fewest["copies"])
    return joined.withColumn(out, F.coalesce(copies, F.lit(0))).drop(point, from_)


def _copy(epoch: int, cells: int) -> Column:
    """Finish time and order of one copy. Times past 4 share the last cell: the budget is spent by about 1."""
    finish = (F.col("source_size") * epoch + F.col("end")).cast("double") / F.nullif(F.col("target"), F.lit(0.0))
    cell = F.least(F.floor(finish * cells), F.lit(4 * cells))
    return F.struct(finish.alias("finish"), cell.alias("cell"), F.col("rank").alias("rank"), F.col("h").alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))


def _key(x) -> Column:
    kinds = {"finish": "double", "rank": "int", "h": "bigint", "id": "bigint"}
    return F.struct(*[x[k].cast(t).alias(k) for k, t in kinds.items()])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1 AS rnk FROM sized GROUP BY source
), caps AS (
  SELECT *, (rnk % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM per
), lvl AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS ahead,
         row_number() OVER (ORDER BY cap / w, rnk) AS ord
  FROM caps
), first_free AS (
  SELECT min(ord) AS ord FROM lvl WHERE rest * w <= cap * ahead
), targets AS (
  SELECT l.source, l.source_size, l.rnk,
         coalesce(CASE WHEN l.ord >= f.ord THEN s.rest::DOUBLE * l.w / nullif(s.ahead, 0) ELSE l.cap::DOUBLE END, 0) AS target
  FROM lvl l CROSS JOIN first_free f LEFT JOIN lvl s ON s.ord = f.ord
), ended AS (
  SELECT row_number() OVER () AS n, d.doc_id, d.size, t.source_size, t.target, t.rnk, d.h,
         sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT n, size, sum(size) OVER (ORDER BY (source_size * epoch + e)::DOUBLE / nullif(target, 0), rnk, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ended CROSS JOIN (VALUES (0), (1), (2)) AS k(epoch) WHERE size > 0
), taken AS (
  SELECT n, count(*)::BIGINT AS c FROM copies WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY n
)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * coalesce(t.c, 0))::BIGINT AS taken
FROM ended d LEFT JOIN taken t ON t.n = d.n
"""
