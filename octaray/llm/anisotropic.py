"""Approximate maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors are cut into subspaces of two dimensions with 16 centres each: four bits a subspace, two codes a byte. Centres
and codes minimise |r|^2 + (eta - 1) (r . x/|x|)^2, so that a residual r along the vector costs eta times one across
it. The centres are fitted on a bounded sample (``fit_rows``, expected size, drawn by a hash of the id); every row is
encoded. Queries scan the codes of every block by table lookups (one table of 256 sums per byte and query), and the
``rerank`` best of each block are scored exactly in double precision on the original vectors. That gives a k-th score
T. Then every other vector whose code score does not rule T out is scored exactly too, so the result is that of brute
force. Write x' for the coded x, a for the part of x' along x, b for the length of the rest, Q = |q| and s = q . x/|x|:
q . x' >= a s - b sqrt(Q^2 - s^2), which is convex in s, and q . x >= T means s >= T / |x|.

Equal vectors of a block are scanned once and stand for all their ids, so that a very common vector neither fills the
candidates nor hides others. Ties go to the smaller id.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries and as
candidates; vectors are compared only with those of their own length; fewer than ``k`` candidates are all returned; a
query's own row is no candidate, while other rows of its id are; several rows under one id that is asked for have a list
each, under that id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, settle
from .mixing import shuffle_key
from .vectors import matrix, usable

K, RERANK, FIT_ROWS, THRESHOLD = 20, 160, 16_384, 0.2
WIDTH, CENTRES = 2, 16
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual, for inner products above ``threshold`` times the largest."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def padded(x: np.ndarray) -> np.ndarray:
    """[row, subspace, 2]; odd lengths get a zero, and the subspaces an even number."""
    more = -x.shape[1] % (2 * WIDTH)
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, WIDTH)


def assign(x: np.ndarray, centres: np.ndarray, weight: float, codes: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """Codes by coordinate descent over the subspaces: each takes the centre of least loss given the others."""
    length = np.sqrt((x * x).sum(axis=(1, 2)))
    along = x / np.where(length > 0, length, 1)[:, None, None]
    if codes is None:
        codes = np.stack([((x[:, j, None, :] - centres[j]) ** 2).sum(axis=2).argmin(axis=1) for j in range(x.shape[1])], axis=1)
    part = np.stack([((x[:, j] - centres[j][codes[:, j]]) * along[:, j]).sum(axis=1) for j in range(x.shape[1])], axis=1)
    total = part.sum(axis=1)
    for _ in range(rounds):
        before = codes.copy()
        for j in range(x.shape[1]):
            r = x[:, j, None, :] - centres[j]
            p = np.einsum("ncd,nd->nc", r, along[:, j])
            rest = total - part[:, j]
            codes[:, j] = ((r * r).sum(axis=2) + (weight - 1) * (rest[:, None] + p) ** 2).argmin(axis=1)
            part[:, j] = np.take_along_axis(p, codes[:, j : j + 1], axis=1)[:, 0]
            total = rest + part[:, j]
        if (before == codes).all():
            break
    return codes


def fit(x: np.ndarray, weight: float, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """[subspace, centre, 2]: plain k-means first, then alternating codes and weighted least squares."""
    rng = np.random.default_rng(seed)
    n, m, d = x.shape
    centres = np.stack([x[rng.choice(n, CENTRES, replace=n < CENTRES), j] for j in range(m)])
    for _ in range(8):
        for j in range(m):
            code = ((x[:, j, None, :] - centres[j]) ** 2).sum(axis=2).argmin(axis=1)
            count = np.bincount(code, minlength=CENTRES)
            for i in range(d):
                centres[j, :, i] = np.where(count > 0, np.bincount(code, x[:, j, i], CENTRES) / np.maximum(count, 1), centres[j, :, i])
    length = np.sqrt((x * x).sum(axis=(1, 2)))
    along = x / np.where(length > 0, length, 1)[:, None, None]
    codes = None
    for _ in range(rounds):
        codes = assign(x, centres, weight, codes, 1)
        residual = np.stack([((x[:, j] - centres[j][codes[:, j]]) * along[:, j]).sum(axis=1) for j in range(m)], axis=1)
        total = residual.sum(axis=1)
        for j in range(m):
            u, code = along[:, j], codes[:, j]
            aim = total - residual[:, j] + (x[:, j] * u).sum(axis=1)
            for c in np.unique(code):
                at = code == c
                left = at.sum() * np.eye(d) + (weight - 1) * u[at].T @ u[at]
                centres[j, c] = np.linalg.solve(left, x[at, j].sum(axis=0) + (weight - 1) * (aim[at, None] * u[at]).sum(axis=0))
            fresh = ((x[:, j] - centres[j][code]) * u).sum(axis=1)
            total += fresh - residual[:, j]
            residual[:, j] = fresh
    return centres


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[query, byte, 256]: the sum of a byte's two subspaces' inner products."""
    each = np.einsum("qjd,jcd->qjc", queries, centres)
    both = each[:, ::2, None, :] + each[:, 1::2, :, None]
    return both.reshape(len(queries), both.shape[1], CENTRES * CENTRES).astype(np.float32)


def decode(codes: np.ndarray, centres: np.ndarray, dims: int) -> np.ndarray:
    """[row, dim] of codes as [byte, row]; what padding added is cut off, which only brings it closer to the vectors."""
    each = np.stack([codes & 15, codes >> 4], axis=1).reshape(-1, codes.shape[1])
    return np.concatenate([c[e] for c, e in zip(centres, each, strict=True)], axis=1)[:, :dims]


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores of all codes ([byte, row]) for one query's tables."""
    out = table[0].take(codes[0])
    for b in range(1, len(codes)):
        out += table[b].take(codes[b])
    return out


def least_code_score(reach: np.ndarray | float, along: np.ndarray, across: np.ndarray, lengths: np.ndarray, query_length: float) -> np.ndarray:
    """The least code score that each vector can have if its inner product with the query is ``reach`` or more."""
    coded = np.hypot(along, across)
    lowest = -query_length * np.divide(along, coded, out=np.ones_like(coded), where=coded > 0)
    s = np.clip(np.maximum(reach / lengths, lowest), -query_length, query_length)
    bound = along * s - across * np.sqrt(np.maximum((query_length - s) * (query_length + s), 0))
    # The rounding of the tables and their sums, in single precision.
    return bound - 1e-5 * query_length * (lengths + coded) - 1e-36


CODED = "dim int, row long, vec_id long, vector array<double>, code binary"
HITS = "query_row long, query_id long, vec_id long, score double"


def search(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, rerank: int = RERANK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``is_query`` marks, its k nearest by inner product."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = usable(rows.filter("vec_id IS NOT NULL"), "vector").withColumn("dim", F.size("vector"))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    books = {}
    for dim, n in sizes.items():
        drawn = shuffle_key(F.col("vec_id"), "fit") / float(1 << 52) < min(1.0, fit_rows / n)
        sample = rows.filter((F.col("dim") == dim) & drawn).select("vec_id", "vector").toPandas().sort_values("vec_id")
        if not len(sample):
            sample = rows.filter(F.col("dim") == dim).orderBy("vec_id").limit(1).select("vec_id", "vector").toPandas()
        books[dim] = fit(padded(matrix(sample["vector"])), eta(dim))
    shared = spark.sparkContext.broadcast(books)

    def encode(batches):
        for pdf in batches:
            out = np.empty(len(pdf), dtype=object)
            for dim in pdf["dim"].unique():
                at = np.flatnonzero(pdf["dim"].to_numpy() == dim)
                codes = pack_codes(assign(padded(matrix(pdf["vector"].iloc[at])), shared.value[dim], eta(int(dim))))
                out[at] = [c.tobytes() for c in codes]
            yield pdf.assign(code=out)[["dim", "row", "vec_id", "vector", "code"]]

    # A row is known by a number of its own, written with the index: ids may repeat.
    numbered = rows.select("dim", F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    index = settle(numbered.mapInPandas(encode, CODED))
    total = sum(sizes.values())
    blocks = max(1, -(-total // BLOCK_ROWS))
    queries = index.filter(is_query(F.col("vec_id"))).select("dim", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"))
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    # Equal vectors meet in one block, by a hash of the vector, unless there are many: 64 salts by id spread those.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    placed = index.withColumn("block", F.pmod(F.xxhash64("vector", salt), F.lit(blocks)))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_row"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(key, data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(wanted):
            return pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        data = data.sort_values(["vec_id", "row"])
        whole = matrix(data["vector"])
        _, first, group = np.unique(whole.view([("", whole.dtype)] * whole.shape[1]).ravel(), return_index=True, return_inverse=True)
        ids, own_rows = data["vec_id"].to_numpy(), data["row"].to_numpy()
        order = np.argsort(group, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(group))])
        vectors = whole[first]
        codes = np.ascontiguousarray(np.frombuffer(b"".join(data["code"].iloc[first]), dtype=np.uint8).reshape(len(first), -1).T)
        queries, asked_ids, asked_rows = matrix(wanted["asked"]), wanted["query_id"].to_numpy(), wanted["query_row"].to_numpy()
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        coded = decode(codes, shared.value[int(key[0])], vectors.shape[1])
        along = (coded * vectors).sum(axis=1) / lengths
        across = np.sqrt(np.maximum((coded * coded).sum(axis=1) - along * along, 0))
        del coded

        def listed(near, exact, me):
            """The hits of the scored groups, best first: whole groups down to the score of the (k + 1)-th."""
            least = np.partition(exact, -(k + 1))[-(k + 1)] if len(exact) > k else -np.inf
            hits = []
            for g, value in zip(near[exact >= least].tolist(), exact[exact >= least].tolist(), strict=True):
                at = order[start[g] : start[g] + min(k + 1, start[g + 1] - start[g])]
                hits += [(value, v) for v, r in zip(ids[at], own_rows[at], strict=True) if r != me]
            hits.sort(key=lambda h: (-h[0], h[1]))
            return hits[:k]

        n = min(rerank, len(first))
        out = []
        for at in range(0, len(queries), 64):
            table = tables(padded(queries[at : at + 64]), shared.value[int(key[0])])
            for i, t in enumerate(table):
                score, q, me = scan(t, codes), queries[at + i], asked_rows[at + i]
                near = np.argpartition(-score, n - 1)[:n] if n < len(score) else np.arange(n)
                exact = vectors[near] @ q
                hits = listed(near, exact, me)
                if n < len(score):
                    reach = hits[-1][0] if len(hits) == k else -np.inf
                    out_of_reach = np.isfinite(score) & (score < least_code_score(reach, along, across, lengths, np.sqrt(q @ q)))
                    out_of_reach[near] = True
                    more = np.flatnonzero(~out_of_reach)
                    if len(more):
                        near, exact = np.concatenate([near, more]), np.concatenate([exact, vectors[more] @ q])
                        hits = listed(near, exact, me)
                out += [(me, asked_ids[at + i], v, s) for s, v in hits]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])

    keys = ["dim", "block", "part"]
    found = placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(look, HITS)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_inner_product_search(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
