import random
from collections import Counter

import numpy as np

from octaray.llm import neardup
from octaray.llm.components import connected_components


def shingles(text):
    words, seen, out = (text or "").lower().split(), Counter(), set()
    for i in range(max(1, len(words) - 4)) if words else []:
        g = tuple(words[i : i + 5])
        seen[g] += 1
        out.add((g, seen[g]))
    return out


def brute_force(rows):
    """Components of in-order documents by the set similarity of occurrence-labelled five-word runs."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    rows = []
    passage = " ".join(rng.choice(words) for _ in range(60))
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 260))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                del copy[rng.randrange(len(copy))]
            rows.append(" ".join(copy))
        rows.append(" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) + " " + passage)
    rows += ["same", "Same", "one two three four", "one two three five", "x " * 3000, "x " * 3000 + "y"]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    want = brute_force(rows)
    assert {i: r["component"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == set(want.values())


def test_edges(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "A  b"), (6, "w " * 200_000)]
    got = sorted(map(repr, map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect())))
    want = [(1, 1, 1, True), (2, 2, 2, True), (3, 3, 3, True), (None, 4, 4, True), (4, 4, 4, True), (4, 4, 4, True), (5, 4, 4, False), (6, 6, 6, True)]
    assert len(got) == len(want) and {repr(w) for w in want if w[0] is not None} <= set(got)


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return int(table[-1, -1])


def test_alignment_is_exact_where_it_matters():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint32)
        b = a.copy()
        for _ in range(rng.integers(0, 12)):
            at = rng.integers(0, len(b))
            b = np.insert(b, at, rng.integers(0, 30)) if rng.random() < 0.5 or len(b) == 1 else np.delete(b, at)
        m = longest_common(a, b)
        true = m / (len(a) + len(b) - m)
        got = neardup.similarity(a, b, 0.8)
        assert (got >= 0.8) == (true >= 0.8) and got <= true + 1e-12
        if true >= 0.8:
            assert abs(got - true) < 1e-12


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(200, 300), (300, 100), (5, 5), (400, 400)] + [(500, 500 + i) for i in range(1, 30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 71)} | dict.fromkeys((100, 200, 300), 100) | {500 + i: 500 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited_copies(rng, words, n):
    """Chains in which each text is the one before it with two words changed, with gaps; and one group of copies of a
    base that is not among them, with two to five changes each."""
    rows = []
    for _ in range(4):
        text = [rng.choice(words) for _ in range(300)]
        for _ in range(n // 8):
            for _ in range(2):
                text[rng.randrange(300)] = rng.choice(words)
            if rng.random() < 0.5:
                rows.append(" ".join(text))
    base = [rng.choice(words) for _ in range(300)]
    for _ in range(n // 2):
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(2, 5)):
            copy[at] = rng.choice(words)
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return rows


def test_edited_copies_without_a_common_original_lose_no_link(spark):
    """Links close to the threshold in large groups; each component must be that of all pairs."""
    rng = random.Random(11)
    rows = edited_copies(rng, [f"w{k}" for k in range(20_000)], 1000)
    sets = [shingles(t) for t in rows]
    number = {g: k for k, g in enumerate({g for s in sets for g in s})}
    held = np.zeros((len(rows), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    top = np.arange(len(rows))
    while True:
        after = np.array([top[near[i]].min() for i in range(len(rows))])
        if (after == top).all():
            break
        top = after
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component"] for r in got.collect()} == dict(enumerate(top.tolist()))
    assert 20 < len(set(top.tolist())) < len(rows) / 2


def test_order_counts(spark):
    """Two texts of the same paragraphs in another order share nearly all word runs, but only half of them in order."""
    rng = random.Random(5)
    paragraphs = [" ".join(f"t{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    one, other = "\n".join(paragraphs), "\n".join(paragraphs[3:] + paragraphs[:3])
    assert len(shingles(one) & shingles(other)) >= 0.9 * len(shingles(one) | shingles(other))
    rows = [(1, one), (2, other), (3, one.replace(paragraphs[0][:4], "xx", 1)), (4, other + " end")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}
