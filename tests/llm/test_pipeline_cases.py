"""Repeated ids, ties, nulls and clashing columns in the pipeline's stages."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from octaray.llm import mixing


def test_copies_follow_the_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(None, None, "a"), (7, None, None), (None, "x y", None), (7, "z " * 5000, "a")], "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", "source").unionByName(extra).withColumn("point", F.lit(1)).withColumn("Copies", F.lit("c"))
    want = sorted(map(repr, map(tuple, mixing.mix(docs).select("doc_id", "size", "copies").collect())))
    got = mixing.take(docs, "k").select("doc_id", mixing.words(F.col("text")), "k")
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    out = p.mix_sources(spark, docs, small)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_one_row_of_each_group_stays(spark, small):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, text), (3, text), (3, text), (3, other), (9, other.upper()), (None, text), (None, None), (4, ""), (4, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, judged_id int, text_hash string")
    got = p.drop_near_duplicates(spark, docs, small)
    assert got.columns == docs.columns
    left = sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect())))
    assert left == sorted(map(repr, [(3, text), (3, other), (None, text), (None, None), (4, ""), (6, None)]))
