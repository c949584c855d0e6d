"""Centroid clustering of integer vectors, exact to the last digit.

Components are floored multiples, so squared distances are integers. Within blocks of rows they come from one matrix product,
|x|^2 - 2 x.c + |c|^2, in float64. That is exact as long as no partial sum can pass 2^53, which a bound on the largest component
of every row and centroid proves beforehand; pairs that it doesn't cover are computed in Python's unbounded integers. Sums per
cluster are taken likewise and combined by ``treeAggregate``; what meets in one place is one row a centroid.

Vectors of another length, with a null or non-finite component or null altogether aren't kept and have no row; nor are those with a multiple beyond the doubles. A null vec_id is hashed as
an empty one. Equal hashes are settled by the components. Repeated rows are vectors of their own. With fewer vectors than centroids,
every vector starts one. An empty table gives an empty result. Distances and inertias beyond a long are null. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirewise.llm.common import materialize

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Rows of a block, and the bound below which float64 holds every integer.
BLOCK, EXACT = 4096, 2.0**53

#: Per centroid: the sums of components, how many vectors, the sum of squared distances.
Totals = tuple[list[list[int]], list[int], list[int]]


def kept_vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the multiples as doubles, of every vector of the right length whose components are all finite; they're floored in ``blocks``."""
    x = F.transform(F.col("embedding"), lambda v: F.lit(float(scale)) * v.cast("double"))
    good = (F.size("embedding") == dimensions) & F.forall("embedding", lambda v: F.coalesce(F.abs(F.lit(float(scale)) * v.cast("double")) < float("inf"), F.lit(False)))
    return table.where(F.coalesce(good, F.lit(False))).select("vec_id", x.alias("x"))


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: their ids, and their floored components as one string of doubles."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False)).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return vectors.mapInArrow(rows, f"ids array<{id_type}>, x binary")


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least hashes of their ids; a bounded number."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[math.floor(v) for v in r["x"]] for r in vectors.select(h.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()]


def _integers(x: np.ndarray) -> np.ndarray:
    """Unbounded integers of whole doubles."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of every row, the first of ties, and its squared distance."""
    n, k = len(x), len(centroids)
    wide = x.shape[1]
    high = np.abs(x).max(axis=1, initial=0.0)
    tops = [max(map(abs, c), default=0) for c in centroids]
    small = [j for j in range(k) if wide * tops[j] ** 2 < 2**50]
    low = high * high * wide < 2.0**50  # with centroids alike: |x|^2 + 2|x||c| + |c|^2 is at most 4 * 2^50, below 2^53
    best, found = np.zeros(n, np.int64), np.full(n, -1, object)
    if small:
        c = np.array([centroids[j] for j in small], np.float64).reshape(len(small), wide)
        own = x[low]
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + (c * c).sum(axis=1)[None, :]
        at = d.argmin(axis=1)
        best[low] = np.array(small)[at]
        found[low] = d[np.arange(len(own)), at].astype(np.int64).astype(object)
    others = [(np.flatnonzero(~low), range(k)), (np.flatnonzero(low), [j for j in range(k) if j not in small])]
    for at, which in others:
        if len(at):
            whole = _integers(x[at])
            for j in which:
                away = whole - np.array(centroids[j], object)[None, :]
                d = (away * away).sum(axis=1)
                for i, v in zip(at, d, strict=True):
                    if found[i] < 0 or v < found[i] or (v == found[i] and j < best[i]):
                        best[i], found[i] = j, v
    return best, [int(v) for v in found]


def _zero(k: int, wide: int) -> Totals:
    return [[0] * wide for _ in range(k)], [0] * k, [0] * k


def _added(a: Totals, b: Totals) -> Totals:
    plus = lambda p, q: [x + y for x, y in zip(p, q, strict=True)]
    return [plus(p, q) for p, q in zip(a[0], b[0], strict=True)], plus(a[1], b[1]), plus(a[2], b[2])


def block_totals(x: np.ndarray, centroids: list[list[int]]) -> Totals:
    """What one block adds."""
    k, wide = len(centroids), x.shape[1]
    best, far = nearest(x, centroids)
    inertia = [0] * k
    for j, d in zip(best.tolist(), far, strict=True):
        inertia[j] += d
    picked = (best[None, :] == np.arange(k)[:, None]).astype(np.float64)
    if len(x) * np.abs(x).max(initial=0.0) < EXACT:
        sums = [[int(v) for v in row] for row in picked @ x]
    else:
        sums = [[sum(int(v) for v in column) for column in x[best == j].T] for j in range(k)]
    return sums, [int(v) for v in picked.sum(axis=1)], inertia


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    vectors = kept_vectors(table, dimensions, scale)
    centroids = starts(vectors, clusters, seed)
    packed = materialize(blocks(vectors, dimensions), "vectors")
    k = len(centroids)
    unpacked = lambda data: np.frombuffer(data, np.float64).reshape(-1, dimensions)

    def totals(now: list[list[int]]) -> Totals:
        of = lambda total, row: _added(total, block_totals(unpacked(row[0]), now))
        return packed.select("x").rdd.treeAggregate(_zero(k, dimensions), of, _added)

    inertia = [0] * k
    for _ in range(rounds if k else 0):
        sums, counts, _ = totals(centroids)
        centroids = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
    if k:
        inertia = totals(centroids)[2]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    as_long = lambda v: v if v < 2**63 else None
    all_inertia = as_long(sum(inertia))
    id_type = table.schema["vec_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                ids = batch.column(0).slice(i, 1).flatten()
                best, far = nearest(unpacked(data), centroids)
                each = best.tolist()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(best.astype(np.int32)), pa.array(map(as_long, far), pa.int64()), pa.array([as_long(inertia[j]) for j in each], pa.int64()), pa.array([all_inertia] * len(each), pa.int64()), pa.array([digests[j] for j in each])],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return packed.mapInArrow(rows, f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _round_sql(before: str, after: str) -> str:
    """Assignment to the centroids of ``before``, then the centroids ``after``."""
    return f"""
near_{before} AS MATERIALIZED (
  SELECT vec_id, x, arg_min(cluster, d) AS cluster, CAST(min(d)[1] AS BIGINT) AS distance
  FROM (SELECT v.vec_id, v.x, c.cluster, [CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT), c.cluster] AS d FROM v, {before} c) GROUP BY vec_id, x),
sums_{before} AS MATERIALIZED (
  SELECT cluster, i, floor(sum(CAST(x[i] AS BIGINT)) / count(*)) AS m FROM near_{before}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY cluster, i),
{after} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM {before} c LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS x FROM sums_{before} GROUP BY cluster) m USING (cluster))"""


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) <= {CLUSTERS}),{_round_sql("c0", "c1")},{_round_sql("c1", "c2")},{_round_sql("c2", "c3")},{_round_sql("c3", "c4")}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c3.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM near_c3 JOIN c3 USING (cluster)
"""
