"""Sort-means against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
from octaray.llm import sortmeans as S

SCHEMA = "vec_id long, embedding array<double>, cluster string, units string"


def by_hand(rows, size, k=8, rounds=10):
    kept = [(i, [min(max(math.floor(1024 * x), -S.BOUND), S.BOUND) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(held[n]) for c in zip(*held[n], strict=True)] if n in held else c for n, c in enumerate(centroids)]
    told = [(i, *nearest(v)) for i, v in kept]
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = {n: sum(d for _, d, m in told if m == n) for n in range(len(centroids))}
    return sorted([(i, n, d, own[n], sum(own.values()), said[n]) for i, d, n in told], key=repr)


def vectors(seed, n, size):
    draw = random.Random(seed)
    heart = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = [(draw.choice([i, i, i, 5, None]), [x + draw.gauss(0, 0.3) for x in draw.choice(heart)]) for i in range(n)]
    rows += [(900 + i, [float(i % 3), *[0.0] * (size - 1)]) for i in range(40)]  # ties
    rows += [(1, None), (2, []), (3, [1.0] * (size - 1)), (4, [None, *[1.0] * (size - 1)]), (6, [float("nan")] * size), (7, [float("inf")] * size), (8, [1e300] * size), (9, [-0.0] * size)]
    return rows + rows[:4]


def test_against_brute_force(spark):
    for seed, size in ((1, 4), (2, 3)):
        rows = vectors(seed, 200, size)
        df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
        assert sorted(map(tuple, S.cluster(df, size=size).collect()), key=repr) == by_hand(rows, size)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert sorted(map(tuple, S.cluster(df, size=2).collect()), key=repr) == by_hand(rows, 2)
    assert S.cluster(df.limit(0), size=2).collect() == []


def test_sorting_spares_distances_and_tries_ties():
    draw = np.random.default_rng(3)
    centroids = draw.integers(-5000, 5000, (8, 4))
    x = np.vstack([centroids[draw.integers(0, 8, 500)] + draw.integers(-200, 200, (500, 4)), (centroids[:1] + centroids[1:2]) // 2])
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    nearest = far.argmin(axis=1)
    for last in (np.zeros(len(x), np.int64), nearest):
        cluster, distance, tried = S.assign(x, last, centroids)
        assert (cluster == nearest).all() and (distance == far.min(axis=1)).all()
    assert tried < 3 * len(x)
    # A centroid at exactly twice the distance ties, and its smaller number wins.
    cluster, _, _ = S.assign(np.array([[1, 0]]), np.array([1]), np.array([[2, 0], [0, 0]]))
    assert cluster.tolist() == [0]
