"""Stages in turn: what they drop, keep and change."""

import corpus_pipeline as p
from octaray.llm import neardup, secrets


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        stage(spark, seen[-1], small).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        assert seen[-1].columns == docs.columns
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in seen]
    kept = {r["doc_id"] for r in neardup.near_duplicates(seen[1]).filter("kept").collect()}
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) >= 0.8 * len(ids[0])
    assert sorted(ids[2]) == sorted(kept) and sorted(ids[3]) == sorted(ids[2])
    left = secrets.secret_digest(secrets.find_secrets(seen[3])).selectExpr("sum(n_assign + n_access + n_hex) AS n").first()["n"]
    assert left == 0 and set(ids[4]) <= set(ids[3])
    assert max(ids[4].count(i) for i in set(ids[4])) <= 3
    packed = p.STAGES[-1][1](spark, seen[4], small).toPandas()
    assert len(packed.groupby("doc_id")) == len(set(ids[4])) and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_empty_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, small).count() == 0
