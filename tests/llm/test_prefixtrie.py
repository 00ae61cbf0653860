"""The conversation trie against brute force."""

import hashlib
import random
import re
import zlib

from octaray.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, a string"


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def by_hand(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, mark(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(turns)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    kids, leaves, saved = {}, {}, {}
    for name in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", name[-1][1])) if name else 0
        saved[name] = saved.get(name, 0) + (len(nodes[name]) - 1) * words
        leaves[name] = leaves.get(name, 0) or 1
        if name:
            up = name[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[name]
            saved[up] = saved.get(up, 0) + saved[name]
    for name, held in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(convs[c]) == len(name)))
        out.append((min(held), len(name), min(nodes[name[:-1]]) if name else None, len(held), kids.get(name, 0), leaves[name], saved[name], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in range(260):
        n = draw.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["hello there", "two  words", "", None, "a\nb c", "É" * 3])) for t in range(n)]
    rows += [(1000 + c, t, "user", f"shared turn {t}") for c in range(40) for t in range(c // 2 + 1)]  # a long common path, left one by one
    rows += [(2000 + 20 * c, t, "user", f"exact copy {t}") for c in range(700) for t in range(2)]
    rows += [(7, 3, "user", "same turn"), (7, 3, "user", "same turn"), (None, 1, "user", "no conversation"), (-41, 0, "user", "negative")]
    rows += [(40_001, t, "user", "w " * (t % 7)) for t in range(900)]  # a conversation over several ranges
    return rows + rows[:3] + [(50_000, 0, "user", "x" * 200_000)]


def test_trie_against_brute_force(spark):
    rows = conversations(12)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = P.prefix_trie(df)
    assert got.columns == P.RESULT
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_long_lists_of_ends_are_joined_in_pieces(spark):
    rows = [(20 * c, 0, "user", "the same") for c in range(3 * P.PIECE + 5)]
    got = P.prefix_trie(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_smallest_tables(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, P.op12_prefix_trie(spark, small).collect()), key=repr) == by_hand(rows)
