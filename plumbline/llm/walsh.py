"""Exact centroid clustering with a progressive search in the Walsh-Hadamard domain.

Vectors of 64 integers and the centroids are transformed exactly (64 times the squared distance is the squared distance of
the transforms). Smooth differences show in the first coefficients of sequency order, so differences are added up coarse
to fine, in blocks; a centroid whose partial sum already exceeds the whole distance of another is strictly worse and is
left. What stays is summed over all 64 coefficients, and the smallest distance, then the smallest number, wins.

Each round is a scan of the stored vectors with the centroids (COUNT of them at most) told to all tasks; a task adds up
its vectors by centroid, Spark adds the tasks' sums, and the driver sees one row for each centroid's component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

DIM, SCALE, COUNT, ROUNDS = 64, 256, 40, 5
#: Where the blocks of coefficients end.
BLOCKS = (2, 4, 8, 16, 32, 64)
#: Vectors compared at once.
AT_ONCE = 2048
#: Components up to this size keep the transform's squared distance (64 * (2 * 64 * x) ** 2 at most) within 63 bits.
EXACT = 1 << 21
#: Bits of a limb in which sums travel.
LIMB = 24
MOST = 2**63 - 1


def sequency() -> np.ndarray:
    """The rows of the transform by their number of sign changes, coarse to fine."""
    h = np.array([[1]], np.int64)
    while len(h) < DIM:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


ORDER = sequency()


def transform(x: np.ndarray) -> np.ndarray:
    """The exact Walsh-Hadamard transform of rows of 64 integers, coarse coefficients first."""
    n, half = len(x), 1
    while half < DIM:
        pairs = x.reshape(n, DIM // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, DIM)
        half *= 2
    return x[:, ORDER]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number and squared distance of each row's nearest centroid, and how many coefficient differences were taken.

    Rows and centroids are transforms. The first block is taken of all centroids; the one that leads after it is summed to
    its end, which bounds the best distance from above.
    """
    n, k = len(x), len(centroids)
    start = BLOCKS[0]
    near = ((x[:, None, :start] - centroids[None, :, :start]) ** 2).sum(2)
    lead = near.argmin(1)
    bound = ((x - centroids[lead]) ** 2).sum(1)
    row, number = np.nonzero(near <= bound[:, None])
    part, taken = near[row, number], n * k * start + n * DIM
    for end in BLOCKS[1:]:
        part = part + ((x[row, start:end] - centroids[number, start:end]) ** 2).sum(1)
        taken += len(row) * (end - start)
        stay = part <= bound[row]
        row, number, part, start = row[stay], number[stay], part[stay], end
    # rows come in order, and numbers within a row, so the first least one of a row is that of the smaller number
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(part, starts) if n else part
    first = np.full(n, k, np.int64)
    hit = np.flatnonzero(part == least[row])
    np.minimum.at(first, row[hit], number[hit])
    return first, least, taken


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles: as int64, or as Python integers where squares would not fit."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    if not len(x) or np.abs(x).max() <= EXACT:
        return x.astype(np.int64).reshape(-1, DIM)
    out = np.empty(len(x), object)
    out[:] = [int(v) for v in x.tolist()]
    return out.reshape(-1, DIM)


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and exact squared distance to the nearest centroid of rows of integers."""
    own = np.array(centroids, object)
    if x.dtype != object and max(abs(v) for c in centroids for v in c) <= EXACT:
        own = own.astype(np.int64)
    else:
        x = x.astype(object)
    own = transform(own)
    found = [nearest(transform(x[at : at + AT_ONCE]), own)[:2] for at in range(0, len(x), AT_ONCE)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] // DIM for f in found])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors of exactly 64 components, none null or non-finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter(F.size("e") == DIM)
    scaled = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf"))
    return v.filter(~F.exists("e", scaled))


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of `seed:vec_id`; ties by vec_id, then by components; rows without vec_id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(key), "e").limit(count).select("e").collect()  # count rows
    return [integers(np.array(r.e)).tolist()[0] for r in rows]


def summed(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums of each centroid that has any."""

    def run(batches):
        for batch in batches:
            x = integers(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            if not len(x):
                continue
            to, _ = assigned(x, centroids)
            out = []
            for c in np.unique(to).tolist():
                own = x[to == c]
                out.append((c, DIM, 0, len(own)))
                for j, v in enumerate(own.sum(0).tolist()):
                    limb = 0
                    while not -(1 << LIMB) < v < 1 << LIMB:  # the last limb carries the sign
                        out.append((c, j, limb, v & (1 << LIMB) - 1))
                        v, limb = v >> LIMB, limb + 1
                    out.append((c, j, limb, v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["c", "j", "limb", "v"])

    parts = vectors.select("e").mapInArrow(run, "c long, j long, limb long, v long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("c", "j", "limb").agg(F.sum("v").alias("v")).collect():  # a few rows for each centroid's component
        found.setdefault(r.c, [0] * (DIM + 1))[r.j] += r.v << LIMB * r.limb
    return {c: (v[DIM], v[:DIM]) for c, v in found.items()}


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floored means of their vectors; one without vectors stays."""
    sums = summed(vectors, centroids)
    return [[s // sums[k][0] for s in sums[k][1]] if k in sums else c for k, c in enumerate(centroids)]


def cluster(vectors: DataFrame, count: int = COUNT, rounds: int = ROUNDS, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of 64 finite components.

    Other vectors (null, of another size, with null or non-finite components, or so large that 256 * x is not finite) are
    left out. Rows count as often as they repeat. With fewer vectors than `count` there are fewer centroids; an empty
    table gives no rows. Ties go to the centroid of the smaller number. Arithmetic is exact at any size; distances and
    inertias beyond 64 bits saturate. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = written(usable(vectors), "vectors")
    centroids = first_centroids(kept, count, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)

    def run(batches):
        for batch in batches:
            x = integers(batch.column(1).flatten().to_numpy(zero_copy_only=False))
            if len(x):
                to, d = assigned(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int32()), pa.array([min(MOST, v) for v in d.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    final = written(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(exact.alias("s")).collect()}  # a row for each centroid
    every = min(MOST, sum(totals.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(k, min(MOST, s), every, names[k]) for k, s in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    d = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    a = f"SELECT rid, vec_id, k, d, e FROM (SELECT v.rid, v.vec_id, v.e, c.k, {d} d, row_number() OVER (PARTITION BY v.rid ORDER BY {d}, c.k) r FROM v, {{}} c) WHERE r = 1"
    rounds = ",\n".join(
        f"a{i} AS ({a.format(f'c{i}')}), s{i} AS (SELECT k, j, sum(e[j]) s, count(*) n FROM a{i}, range(1, 65) t(j) GROUP BY k, j),\n"
        f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) e FROM s{i} GROUP BY k), c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.e, c{i}.e) e FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)"
        for i in range(ROUNDS)
    )
    return f"""
WITH v AS (SELECT row_number() OVER () rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 k, e FROM v QUALIFY k < {COUNT}),
{rounds},
z AS ({a.format(f"c{ROUNDS}")})
SELECT z.vec_id, CAST(z.k AS INTEGER) "cluster", CAST(z.d AS BIGINT) distance, CAST(sum(z.d) OVER (PARTITION BY z.k) AS BIGINT) cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) inertia,
  sha256(array_to_string(c{ROUNDS}.e, ',')) centroid_sha256 FROM z JOIN c{ROUNDS} ON c{ROUNDS}.k = z.k
"""


ORACLE_SQL = _oracle()
