import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from octaray.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    return t


def test_encoding_equals_the_tokenizer(tokenizer):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "’", "\x1c", "\x85", "é", "1", "!", "<|endoftext|>", "\u2003", "中", "\r\n", " \n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + ["", None, " ", "a ", " a"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert packing.encode_texts(texts, packing.default_vocabulary()) == want
    assert packing.byte_ranks({"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]]}) is None


def test_other_files_run_as_they_are(tmp_path):
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "Ġ": 2}, "merges": []}}
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    assert np.frombuffer(packing.encode_texts(["A b"], str(path))[0], "<u4").tolist() == [0, 2, 1]


def test_pack(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma\n", "δ"]) for _ in range(rng.randint(1, 700))), "x") for i in range(160)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 9000, "x"), (rows[0][0], rows[0][1], "x"), (None, "null id", "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string")).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows if i is not None}
    for r in got[got["doc_id"].notna()].itertuples():
        part = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
    named = got[got["doc_id"].notna()]
    twice = [rows[0][0]]
    for i, pieces in named[~named["doc_id"].isin(twice)].groupby("doc_id"):
        pieces = pieces.sort_values("piece")
        assert pieces["piece"].tolist() == list(range(len(pieces))) and pieces["length"].sum() == len(ids[int(i)])
        assert (pieces["length"].iloc[1:] == 1024).all() and (len(pieces) > 1) == (len(ids[int(i)]) > 1024)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def valid(bins, lengths, capacity=1024):
    return sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in bins)


def test_evolution_saves_bins():
    """Triples that fill a bin each: best fit and the packings that evolution starts from need more bins than evolution."""
    rng = np.random.default_rng(0)
    lengths = []
    for _ in range(600):
        a, b = int(rng.integers(390, 513)), int(rng.integers(200, 300))
        lengths += [a, b, 1024 - a - b]
    lengths.sort(reverse=True)
    start = packing.evolve(lengths, 1024, [], 0, 4, 1)
    plain = packing.best_fit(lengths, 1024, [], range(len(lengths)))
    few, many = (packing.evolve(lengths, 1024, [], n, 4, 1)[0] for n in (packing.GENERATIONS, 60))
    assert all(valid(b, lengths) for b in (*start, plain, few, many))
    assert 600 <= len(many) <= len(few) < len(plain) and len(many) < min(map(len, start)) and len(plain) - len(many) >= 0.8 * (len(plain) - 600)


@pytest.mark.parametrize("low, high, n", [(1, 1024, 400), (200, 600, 90), (1, 3, 50), (1023, 1024, 5), (512, 513, 7), (1, 2, 0), (1, 2, 1)])
def test_evolution_never_worsens_and_keeps_every_piece(low, high, n):
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(low, high, n).tolist(), reverse=True)
    start = packing.best_fit(lengths, 1024, [], range(n))
    best = packing.evolve(lengths, 1024, [], 30, 6, 1)
    assert all(valid(b, lengths) for b in best) and packing.fitness(best[0], lengths, 1024) >= packing.fitness(start, lengths, 1024)
    assert packing.evolve(lengths, 1024, [], 30, 6, 1) == best
    bins, displaced = packing.crossover(start, packing.tight_fit(lengths, 1024, rng, 3), lengths, 1024, rng)
    assert sorted([*displaced, *(i for b in bins for i in b)]) == list(range(n))
    bins, displaced = packing.mutate(start, lengths, rng, 0.1)
    assert sorted([*displaced, *(i for b in bins for i in b)]) == list(range(n))


def test_fewest_bins_by_trying_all():
    """Small cases against the least number of bins, found by trying every assignment."""

    def least(lengths, capacity, spaces=()):
        if not lengths:
            return len(spaces)
        first, rest = lengths[0], lengths[1:]
        tries = [least(rest, capacity, (*spaces, capacity - first))]
        for s in {s for s in spaces if s >= first}:
            k = spaces.index(s)
            tries.append(least(rest, capacity, (*spaces[:k], s - first, *spaces[k + 1 :])))
        return min(tries)

    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = sorted(rng.integers(3, 12, 8).tolist(), reverse=True)
        assert len(packing.evolve(lengths, 20, [], 30, 6, 1)[0]) == least(lengths, 20)


def test_reruns_agree_and_shards_evolve_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate([*rng.integers(200, 600, 900), 1024, 1024])]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").repartition(3)
    one, two = (sorted(map(tuple, packing.pack_pieces(pieces, shard_rows=300).collect())) for _ in range(2))
    assert one == two and len(one) == len(rows)
    assert len({r[2] for r in one}) < len(packing.best_fit([n for _, n in rows], 1024, [], sorted(range(len(rows)), key=lambda i: -rows[i][1])))
