"""Centroid clustering in exact integers, with block-norm screening.

1. One narrow pass turns each vector into integers floor(scale * x) and gives it the norms of its SEGMENTS segments: a compressed vector. Both
   are written once, so that the rounds read neither floats nor columns that they don't need.
2. In a round each task screens its vectors. By Cauchy and Schwarz the squared distance of two vectors is at least the sum, over the
   segments, of the squared difference of their norms. The centroid with the least bound is measured first, exactly; of the others only
   those whose bound isn't above the best distance so far. Bounds are floats with a margin wider than their rounding errors, distances are
   integers, so results are those of measuring everything.
3. A task gives one row per centroid (count and sums by component), Spark adds them, and the driver gets one row per centroid.

Rows are never shuffled: assignments and inertias come from two more narrow passes.

Cases: a vector is kept if it has exactly `size` components, all of them finite numbers, of which none is beyond +-2**27 once scaled (a
squared distance would not fit a long); other rows, null vectors too, give no row. First centroids are the vectors with the least SHA-256 of
`<seed>:<id>`; of rows with one id that with the least components comes first, and a null id counts as the text `null`. With fewer kept vectors than centroids there are as many
centroids as vectors; repeated vectors can make equal centroids, of which the one with the smaller number gets all. An empty table gives none.
Ties go to the smaller number. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import reliable

SEGMENTS = 8
#: Scaled components beyond it are refused.
MOST = 1 << 27


@dataclass(frozen=True)
class Clusters:
    """Final centroids (integers), and of each its number of vectors and its inertia."""

    centroids: list[list[int]]
    counts: list[int]
    inertias: list[int]

    def digest(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[k])).encode()).hexdigest()


def norms(vectors: np.ndarray) -> np.ndarray:
    """The norm of each segment of each vector."""
    edges = np.linspace(0, vectors.shape[1], min(SEGMENTS, vectors.shape[1]) + 1).astype(int)
    return np.sqrt(np.add.reduceat(vectors.astype(np.float64) ** 2, edges[:-1], axis=1))


def prepared(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (little-endian 32-bit integers), n (the segments' norms as doubles): one row per kept vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            long_enough = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
            values = column.take(pa.array(long_enough)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls are NaN
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * values)
                good = (np.abs(scaled) <= MOST).all(axis=1)
            whole = scaled[good].astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(long_enough[good])), pa.array([x.tobytes() for x in whole], pa.binary()), pa.array([x.tobytes() for x in norms(whole)], pa.binary())], ["id", "v", "n"]
            )

    read = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return read.mapInArrow(run, "id long, v binary, n binary")


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def nearest(v: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its nearest centroid (the smallest number of equals), their squared distance, and how many distances were measured."""
    v, own = v.astype(np.int64), norms(centroids)
    bound = np.zeros((len(v), len(centroids)))
    for s in range(own.shape[1]):
        bound += (norm[:, s, None] - own[None, :, s]) ** 2
    # Norms are right to 1e-15 of themselves; (a - b)**2 may be off by that part of a*a + b*b.
    bound -= 1e-12 * ((norm**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :]) + 1e-6

    def measured(rows: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return ((v[rows] - centroids[k]) ** 2).sum(axis=1)

    every = np.arange(len(v))
    cluster = bound.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
    first = cluster.copy()
    best = measured(every, first)
    count = len(v)
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= best) & (first != k))
        if len(rows):
            d = measured(rows, k)
            better = (d < best[rows]) | (d == best[rows]) & (k < cluster[rows])
            best[rows[better]], cluster[rows[better]] = d[better], k
            count += len(rows)
    return cluster, best, count


def _rows(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(b.column("v"), "<i4", size), _matrix(b.column("n"), "<f8", min(SEGMENTS, size))


def _summed(ready: DataFrame, centroids: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
    """Of each centroid the count of its vectors, their summed distance, and their sums by component."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, total = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, size), object)
        for b in batches:
            if not b.num_rows:
                continue
            v, norm = _rows(b, size)
            cluster, distance, _ = nearest(v, norm, centroids)
            for c in np.unique(cluster):
                mine = cluster == c
                count[c] += mine.sum()
                inertia[c] += sum(distance[mine].tolist())  # integers of any length
                total[c] += v[mine].sum(axis=0, dtype=np.int64)
        table = np.column_stack([count.astype(object), inertia, total])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), size + 2)), pa.array(np.tile(np.arange(size + 2, dtype=np.int32), k)), pa.array([str(x) for x in table.ravel()])], ["k", "j", "s"]
        )

    partial = ready.select("v", "n").mapInArrow(run, "k int, j int, s string")
    table = [[0] * (size + 2) for _ in range(k)]
    for r in partial.groupBy("k", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * (size + 2) rows
        table[r["k"]][r["j"]] = int(r["s"])
    return [x[0] for x in table], [x[1] for x in table], [x[2:] for x in table]


def first_centroids(ready: DataFrame, size: int, k: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    # Rows of one id have one hash; those with the least components come first, as arrays compare.
    numbers = F.udf(lambda v: np.frombuffer(bytes(v), "<i4").tolist(), "array<int>")
    edge = ready.select(key.alias("h")).orderBy("h").limit(k).agg(F.max("h")).first()[0]
    rows = ready.select(key.alias("h"), "v").where(F.col("h") <= F.lit(edge)).select("h", numbers("v").alias("v")).orderBy("h", "v").limit(k)
    return [list(r["v"]) for r in rows.collect()]


def fit(ready: DataFrame, size: int, k: int = 8, rounds: int = 10, seed: int = 3) -> Clusters:
    """Centroids after `rounds` rounds of assignment and exact floor means; `ready` comes from `prepared`."""
    centroids = first_centroids(ready, size, k, seed)
    if not centroids:
        return Clusters([], [], [])
    for _ in range(rounds):
        counts, _, sums = _summed(ready, np.array(centroids, np.int64))
        centroids = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
    counts, inertias, _ = _summed(ready, np.array(centroids, np.int64))
    return Clusters(centroids, counts, inertias)


def assigned(ready: DataFrame, clusters: Clusters, size: int) -> DataFrame:
    """id, cluster, distance: one row per kept vector."""
    centroids = np.array(clusters.centroids, np.int64).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance, _ = nearest(*_rows(b, size), centroids)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return ready.select("id", "v", "n").mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia (decimals), centroid_sha256: one row per kept vector."""
    ready = reliable(prepared(vectors, size, scale, id_col, vector_col))
    found = fit(ready, size, k, rounds, seed)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(str(x)) for x in values] or [F.lit(None).cast("string")]), F.col("cluster") + 1).cast(kind)
    return assigned(ready, found, size).select(
        "id", "cluster", "distance", of(found.inertias, "decimal(38,0)").alias("cluster_inertia"), F.lit(str(sum(found.inertias))).cast("decimal(38,0)").alias("inertia"),
        of([found.digest(c) for c in range(len(found.centroids))], "string").alias("centroid_sha256"),
    )


def oracle(table: str = "embeddings", size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """The same in DuckDB's SQL: every distance measured, one table for each round."""
    measured = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM v) QUALIFY k < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, vec_id, v, k, {measured} AS d FROM v, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
s{n} AS (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {size + 1})) AS j FROM a{n}) GROUP BY k, j),
m{n} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{n} GROUP BY k),
c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.k = m{n}.k)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, a{rounds}.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.k = c{rounds}.k
"""
