"""Clustering around centroids by sort-means, in whole numbers.

Every component x becomes floor(1024 x). A round sorts, for each centroid, the others by their distance from it. A vector
starts from the centroid that it was assigned to last and tries the others in that order; once one is strictly beyond
twice the vector's current distance, it and all after it are farther than the current one and are left out. Distances
are squared, so "beyond twice" compares with four times. Ties go to the smaller number, for which a centroid at exactly
twice the distance is still tried. Then each centroid that has vectors moves to floor(sum / count) of them.

A round is one pass that writes the vectors with their assignment to the shared folder, and one aggregation with
partial sums in each task; only the centroids, k rows, pass through the driver. The table of the round before goes once
the next is written, so at most two copies exist.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out. A null id counts as
empty text where the start is drawn, and its row stays. Repeated rows are vectors of their own; of equal ids the vector
that sorts first comes first. Fewer vectors than centroids: as many centroids as vectors. An empty table gives no rows.
Components beyond 2^27 units are held at that bound, so that squared distances fit 64 bits. Columns other than the id and
the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, read_table, settled_at

SIZE, CENTROIDS, ROUNDS, SEED = 64, 8, 10, "3"
UNITS, BOUND = 1024, 1 << 27


def whole(vector: Column) -> Column:
    """The vector in whole units."""

    def unit(x: Column) -> Column:
        scaled = F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x.cast("double") * UNITS))
        return F.floor(scaled).cast("long")

    return F.transform(vector, unit)


def is_kept(vector: str, size: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.when(F.size(vector) == size, ~bad), F.lit(False))


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all by squared distance from it (itself first), and those distances."""
    gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    rank = gap.copy()
    np.fill_diagonal(rank, -1)
    order = np.argsort(rank, axis=1, kind="stable")
    return order, np.take_along_axis(gap, order, axis=1)


def assign(x: np.ndarray, last: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of the rows of x, and how many distances were worked out."""
    order, gaps = orders(centroids)
    cluster, best, tried = last.copy(), ((x - centroids[last]) ** 2).sum(axis=1), len(x)
    current = best.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero(last == c)
        for other, gap in zip(order[c, 1:], gaps[c, 1:], strict=True):
            rows = rows[gap <= 4 * current[rows]]  # gaps only grow: what stops here has stopped
            if not len(rows):
                break
            far = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
            tried += len(rows)
            nearer = (far < best[rows]) | (far == best[rows]) & (other < cluster[rows])
            best[rows[nearer]], cluster[rows[nearer]] = far[nearer], other
    return cluster, best, tried


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    size = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("units").flatten().to_numpy().reshape(-1, size)
            cluster, distance, _ = assign(x, batch.column("cluster").to_numpy().astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("units"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "units", "cluster", "distance"])

    return vectors.select("vec_id", "units", "cluster").mapInArrow(work, "vec_id long, units array<long>, cluster int, distance long")


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids hash smallest: a top-k, of which the driver gets k rows."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(drawn.alias("drawn"), "units").orderBy("drawn", "units").limit(k).collect()
    return np.array([r["units"] for r in rows], dtype=np.int64)


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floor of each component's mean; empty ones stay."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("units")[i]) for i in range(centroids.shape[1])]).alias("sums"))
    out = centroids.copy()
    for r in sums.collect():  # one row for each centroid
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    kept = vectors.filter(is_kept(vector, size)).select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("units"))
    at, path = settled_at(kept.withColumn("cluster", F.lit(0)))
    centroids = start(at, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for r in range(rounds + 1):
        before = path
        at, path = settled_at(_assigned(at, centroids))
        _delete(spark, before)
        if r < rounds:
            centroids = moved(at, centroids)
    held = {r["cluster"]: r["s"] for r in at.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    said = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = F.element_at(F.array(*[F.lit(held.get(c, 0)).cast("long") for c in range(len(centroids))]), F.col("cluster") + 1)
    name = F.element_at(F.array(*[F.lit(s) for s in said]), F.col("cluster") + 1)
    return at.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(held.values())).cast("long").alias("inertia"), name.alias("centroid_sha256"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as common table expressions: plain nearest centroids, in exact numbers."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT n, arg_min(c, d * 8 + c)::INT AS cluster, min(d)::BIGINT AS distance
  FROM (SELECT n, c, list_sum(list_transform(range(64), lambda i: (x[i + 1] - y[i + 1]) * (x[i + 1] - y[i + 1]))) AS d FROM v CROSS JOIN c{r}) GROUP BY n
)"""
    moves = """c{s} AS MATERIALIZED (
  SELECT c, coalesce(y2, y) AS y FROM c{r} LEFT JOIN (
    SELECT cluster, list(((t - ((t % m) + m) % m) // m)::BIGINT ORDER BY i) AS y2
    FROM (SELECT cluster, i, sum(x[i + 1])::BIGINT AS t, count(*)::BIGINT AS m FROM a{r} JOIN v USING (n), range(64) AS u(i) GROUP BY cluster, i)
    GROUP BY cluster) ON cluster = c
)"""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(nearest.format(r=r))
        if r < ROUNDS:
            steps.append(moves.format(r=r, s=r + 1))
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY drawn, x) - 1 AS c, x AS y FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS drawn, x FROM v ORDER BY drawn, x LIMIT 8)
), {', '.join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (n) JOIN c{ROUNDS} ON c = cluster"""


OP13_SQL = _sql()
