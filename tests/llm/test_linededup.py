"""Line de-duplication against brute force, run by run and in edge cases."""

import hashlib
import random

from octaray.llm import linededup as L
from pyspark.sql import functions as F

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines string, line_id string"


def by_hand(rows, least=20, documents=3):
    def key(line):
        return line.strip(L.SPACE).translate(UPPER)

    holders = {}
    for n, (i, text) in enumerate(rows):
        for line in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(line, []).append((-(1 << 63) if i is None else i, n))
    keeper = {k: max(i for i, _ in v) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if keeper.get(key(x), own) == own]
        out.append((i, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    common = [f"This LINE number {i} is in many documents" for i in range(12)] + ["ÄÖ" * 10, "x" * 19, "y" * 20]
    rows = []
    for i in range(n):
        lines = [draw.choice(common) if draw.random() < 0.4 else f"own line {draw.random()} of document {i}" for _ in range(draw.randrange(9))]
        lines = [draw.choice(["", " ", "\t"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", "\r", " \x0b"]) for x in lines]
        rows.append((draw.choice([i, i, i, None, 7]), draw.choice(["\n".join(lines)] * 9 + [None, ""])))
    hot = ("the line of all documents, at the head of each", "a second line that stands in a third of them")
    rows += [(1000 + i, "\n".join(hot[: 1 + (i % 3 == 0)])) for i in range(1500)]
    return rows + rows[:5] + [(3, "\n".join([common[0]] * 20_000 + ["end"])), (4, "z" * 300_000)]


def test_lines_against_brute_force(spark):
    rows = corpus(11, 300)
    df = spark.createDataFrame([(*r, "kept", "clash") for r in rows], SCHEMA)
    out = L.drop_common_lines(df, batches=5, fanout=2)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped"]
    got = out.collect()
    assert {(r["n_lines"], r["line_id"]) for r in got} == {("kept", "clash")}
    assert sorted(((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in got), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert L.drop_common_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_are_compacted_and_settled_lines_are_left_out(spark):
    runs = L.LineRuns(spark, documents=3, fanout=3)
    batch = spark.createDataFrame([(h, 1, i) for h in range(20) for i in (50, 51, 52)], "h long, g int, id long")
    runs.add(batch)
    sizes = [spark.table(n).count() for n in runs.names]
    assert sizes == [20]
    runs.add(batch.withColumn("id", F.col("id") - 40).unionByName(spark.createDataFrame([(99, 1, 3), (0, 1, 77)], "h long, g int, id long")))
    # Settled lines add nothing, unless a larger id holds one.
    assert [spark.table(n).count() for n in runs.names] == [20, 2]
    runs.add(spark.createDataFrame([(99, 1, 4), (99, 1, 5)], "h long, g int, id long"))
    assert [len(level) for level in runs.levels] == [0, 1]
    found = {r["h"]: (r["n"] >= 3, r["last"]) for r in runs.common().collect()}
    assert found == {**{h: (True, 52) for h in range(1, 20)}, 0: (True, 77), 99: (True, 5)}
    runs.drop()
    assert runs.names == []


def test_the_runs_are_read_without_a_shuffle(spark):
    runs = L.LineRuns(spark)
    lines = spark.createDataFrame([(h, 1, h) for h in range(50)], "h long, g int, id long")
    runs.add(lines)
    plan = runs.unsettled(lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("last")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    runs.drop()


def test_hash_of_kept_text(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, d in by_hand(rows))
    assert sorted(map(tuple, L.op11_line_dedup(spark, small).collect())) == want
