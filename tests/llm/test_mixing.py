from pyspark.sql import functions as F

from octaray.llm.mixing import mix, source_targets

SCHEMA = "doc_id long, text string, source string, rank string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def filled(sizes):
    """Targets by iteration."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free, rest, out = set(sizes), float(sum(sizes.values())), {}
    while free:
        level = rest / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weights[s] for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        free -= full
    return out


def test_targets_and_shares(spark):
    words = {"a": 4000, "b": 90, "c": 700, None: 2500, "é": 0}
    rows, n = [], 0
    for s, total in words.items():
        while total > 0:
            k = min(total, 7 + n % 11)
            rows.append((n, " ".join(["w"] * k), s))
            n, total = n + 1, total - k
    rows.append((n, " \t\n", "é"))
    got = mix(docs(spark, rows), rows_per_bucket=16).toPandas()
    want = filled(words)
    by = dict(zip((i for i, _, _ in rows), (s for _, _, s in rows), strict=True))
    for s, target in want.items():
        mine = got[[by[i] == s for i in got["doc_id"]]]
        assert mine["source_size"].iloc[0] == words[s] and abs(mine["target"].iloc[0] - target) < 1e-6
        assert abs(mine["taken"].sum() - target) <= 20
    assert (got["taken"] <= 3 * got["size"]).all() and got["taken"].sum() <= got["size"].sum()
    again = mix(docs(spark, rows).repartition(7)).toPandas()
    assert dict(zip(got["doc_id"], got["taken"], strict=True)) == dict(zip(again["doc_id"], again["taken"], strict=True))


def test_edges(spark):
    assert mix(docs(spark, [])).count() == 0
    rows = [(None, None, None), (1, "", "a"), (2, "one two", "a"), (2, "one two", "a")]
    got = sorted(map(tuple, mix(docs(spark, rows)).select("size", "taken").collect()))
    assert got == [(0, 0), (0, 0), (2, 2), (2, 2)]


def test_one_source_is_its_own_target(spark):
    one = spark.createDataFrame([("a", 10, 1)], "source string, source_size long, rows long")
    assert source_targets(one).first()["target"] == 10.0
    assert source_targets(one.withColumn("source_size", F.lit(0).cast("long"))).first()["target"] == 0.0
