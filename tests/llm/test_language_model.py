import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octaray.llm import suffix_tree
from octaray.llm.common import crc_mod, read_table


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def test_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "ÉCOLE école Z\x1cz"), (9005, "a b " * 30_000), (0, "repeated row")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
    got = suffix_tree.score_documents(df, train=crc_mod(F.col("doc_id"), 5) != 1, block_bytes=50_000).toPandas()
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    count = Counter(w for (_, t), k in zip(rows, train, strict=True) if k for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = {}
    for i, t in rows:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.setdefault(i, []).append((len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(base, 4)))
    assert len(got) == len(rows) and (got["train_tokens"] == n).all()
    for i, part in got.groupby("doc_id"):
        assert sorted(zip(part["n_tokens"], part["n_known"], part["base_score"].round(4), strict=True)) == sorted(want[i])
    assert (got["score"] < 0).all()


def test_held_out_documents_score_better_than_by_words(spark, small):
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/documents.parquet")
    got = suffix_tree.score_documents(docs, train=crc_mod(F.col("doc_id"), 5) != 1).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 1 for i in got["doc_id"]]]
    assert held["score"].sum() > 0.97 * held["base_score"].sum()


def score_by_hand(train, texts, depth, least, smoothing):
    """log10 probabilities by dictionaries: counts, retained contexts, smoothing towards the longest proper suffix."""

    def symbols(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.split(r"[\x20\x09-\x0D]+", low.strip(" \t\n\r\x0b\x0c"))
        return bytes([255] * depth) + b"".join(w.encode() + b" " for w in words if w) + b"\xff"

    count = [Counter() for _ in range(depth + 1)]
    for t in train:
        s = symbols(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                count[k][s[i - k : i + 1]] += 1
    count = [Counter({g: n for g, n in c.items() if n >= least}) for c in count]
    root = {b: 0.5 + count[0][bytes([b])] for b in range(256)}
    root = {b: n / sum(root.values()) for b, n in root.items()}
    below = [{} for _ in range(depth + 1)]
    for k in range(depth + 1):
        for g, n in count[k].items():
            below[k].setdefault(g[:-1], {})[g[-1:]] = n
    retained = set()
    for k in range(1, depth + 1):
        for ctx, table in below[k].items():
            total, shorter = sum(table.values()), below[k - 1][ctx[1:]]
            gain = sum(n * math.log(n / total / (shorter[b] / sum(shorter.values()))) for b, n in table.items())
            if gain > len(table) + 3:
                retained |= {ctx[i:] for i in range(k)}

    def p(ctx, b):
        value = root[b[0]]
        for k in range(1, depth + 1):
            state = ctx[depth - k :]
            if state in retained:
                table = below[k][state]
                full, free = count[k - 1].get(state, len(train)), smoothing * len(table)
                value = (table.get(b, 0) + (full - sum(table.values()) + free) * value) / (full + free)
        return value

    out = []
    for t in texts:
        s = symbols(t)
        out.append(sum(math.log10(p(s[i - depth : i], s[i : i + 1])) for i in range(depth, len(s))))
    return out


def test_scores_equal_a_tree_by_hand(spark):
    texts = ["the cat sat on the mat", "The dog sat.", "a cat on a mat", None, "é the  cat"] * 6 + ["zebra"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = F.col("doc_id") % 3 != 0
    got = [r["score"] for r in suffix_tree.score_documents(df, train=train, depth=3).orderBy("doc_id").collect()]
    want = score_by_hand([t for i, t in enumerate(texts) if i % 3], texts, 3, 1, suffix_tree.SMOOTHING)
    assert np.allclose(got, want, atol=1e-4)


def test_distributions_sum_to_one(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = suffix_tree.grow(suffix_tree.count_grams(df, 4), len(texts), 4, least_share=0.005)
    assert any(len(level[0]) for level in tree.levels)
    for history in (b"\xff\xff\xff\xff", b"the ", b"zzzz", b" cat", b"at s"):
        keys = np.array([sum(c << 8 * (j + 1) for j, c in enumerate(history)) + b for b in range(256)], dtype=np.uint64)
        assert abs(tree.probabilities(keys).sum() - 1) < 1e-9


def test_grams_by_hand():
    symbols, scored, upto = suffix_tree.normalised(["A  b\n", None, "é"], 2)
    assert bytes(symbols).replace(b"\xff", b"#").decode("utf-8") == "##a b ####é ##" and upto.tolist() == [5, 6, 10]
    g = suffix_tree.grams(symbols, scored, 2)
    assert [bytes([int(x) & 255]) for x in g[:5]] == [b"a", b" ", b"b", b" ", b"\xff"] and int(g[1]) >> 8 == ord("a") + 0xFF00


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = suffix_tree.score_documents(df, train=F.lit(False)).toPandas()
    assert (got["train_tokens"] == 0).all() and (got["n_known"] == 0).all() and np.isfinite(got[["score", "base_score"]].to_numpy()).all()
    assert suffix_tree.score_documents(df.limit(0)).count() == 0


def test_a_tree_beyond_the_bound_is_kept_whole(spark, small):
    docs = read_table(spark, small, "documents")
    train = crc_mod(F.col("doc_id"), 5) != 1
    for depth in (2, 4):
        whole, table = ([tuple(r) for r in suffix_tree.score_documents(docs, train=train, depth=depth, block_bytes=100_000, **most).orderBy("doc_id").collect()] for most in ({}, {"max_entries": 50}))
        assert len(whole) == len(table) > 0
        assert all(a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9) for a, b in zip(whole, table, strict=True))


class OneTask:
    """Stands for a table of which one task gets all the batches."""

    def mapInArrow(self, work, schema):
        self.work = work
        return self

    def groupBy(self, *names):
        return self

    def agg(self, *columns):
        return self


def test_memory_of_a_counting_task_is_bounded(spark):
    random = np.random.default_rng(3)
    texts = [bytes(random.integers(97, 123, 100_000, dtype=np.uint8)).decode() for _ in range(120)]  # nearly every gram is another one
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[at : at + 20])], names=["text"]) for at in range(0, 120, 20)]
    task, out, total = suffix_tree.count_grams(OneTask(), 6), 0, 0
    tracemalloc.start()
    try:
        for batch in task.work(iter(batches)):
            total += sum(batch.column("n").to_pylist())
            out += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == sum(len(t) + 2 for t in texts) and out > 10_000_000
    assert peak < 250e6


def test_counts_that_are_passed_on_add_up(spark, monkeypatch):
    texts = ["the cat sat on the mat", "The dog sat.", None, "", "the  cat"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want = sorted(map(tuple, suffix_tree.count_grams(df, 4).collect()))
    monkeypatch.setattr(suffix_tree, "HELD_GRAMS", 5)
    monkeypatch.setattr(suffix_tree, "SLICE_BYTES", 40)
    symbols, scored, _ = suffix_tree.normalised(texts, 4)
    by_hand = Counter(sum(int(symbols[i - j]) << 8 * j for j in range(5)) for i in np.flatnonzero(scored))
    task = suffix_tree.count_grams(OneTask(), 4)
    got = Counter()
    for batch in task.work(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        for gram, n in zip(batch.column("gram").to_pylist(), batch.column("n").to_pylist(), strict=True):
            got[gram] += n
    assert want == sorted(got.items()) == sorted(by_hand.items())
