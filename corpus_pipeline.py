"""The corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are masked, sources are
mixed to their target weights, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns of
``docs``. ``run`` writes each stage's result in the shared scratch folder and reads it again.
"""

from __future__ import annotations

from octaray.llm import common, mixing, neardup, packing, secrets, toxicity
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. Null and empty texts stay."""
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text"), labels, fold=lambda doc_id: common.crc_mod(doc_id, 3) != 1)
    score = common.free_name(docs, "toxicity_score")
    return toxicity.score_texts(docs, model, out=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of its smallest id, the text of smallest hash. Texts without words and rows with a null id stay.

    Rows equal in id and text are one document, of which one row stays.
    """
    mark = F.xxhash64("text")
    judged = neardup.near_duplicates(docs, mark=mark.cast("string")).filter("doc_id IS NOT NULL")
    own, hashed = common.free_name(docs, "judged_id"), common.free_name(docs, "text_hash")
    judged = judged.groupBy(F.col("doc_id").alias(own), F.col("mark").cast("long").alias(hashed)).agg(F.bool_and("first").alias("first"), F.count("*").alias("_n"))
    told = common.settle(judged.filter("NOT first OR _n > 1"))
    rows = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(hashed, mark)
    # One shuffle of the texts at every size: the table of decisions grows with the documents.
    left = common.spread_join(rows, told.select(own, hashed).hint("merge"), [own, hashed], "left_anti", counts=told)
    several = told.filter("first").select(own, hashed)
    if not several.isEmpty():
        left = left.unionByName(rows.join(several, [own, hashed], "left_semi").dropDuplicates([own, hashed]))
    return left.select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask; n_chars follows."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times). Documents without words are not taken."""
    many = common.free_name(docs, "copies")
    taken = mixing.take(docs, many).filter(F.col(many) > 0)
    return taken.withColumn(many, F.explode(F.sequence(F.lit(1), many))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The stages rest on a learnt model, sketches and an evolved packing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
