"""Exact top-k search by inner product with a vector-approximation file.

The file is two tables over chunks of some distinct vectors each: one has a byte for every component (the cell it lies in,
of equal width over all components), the other the exact integers and the smallest ids. Queries come in groups of
bounded size, each told to all tasks. A first pass reads the cells alone: a score lies within a slack of that of the
cells' middles, and whatever has an upper bound below the k best lower bounds is out. The second pass reads exact chunks
of what is left, of each query in the order of upper bounds and so many at a time, until no other can change its k best.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, shared_dir, small_batches, written

SCALE, K, CELLS = 256, 5, 256
#: Bytes of a group of queries (told to the driver and all tasks), queries bounded at once, vectors looked at together for
#: copies and bounds, vectors in a chunk, candidates of a query read at first.
GROUP_BYTES, AT_ONCE, BLOCK, CHUNK, READ = 8 << 20, 256, 4096, 32, 16
#: Chunks that are looked for by a list in the scan of the exact table; more of them meet it in a join alone.
LISTED = 5000
EXACT, FAR = 2.0**53, 2.0**63
CHUNKS = "key long, dim int, ids binary, copies binary, vectors binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the scaled components (as double) of the vectors without null or non-finite components."""
    v = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() on double would give a bigint and fail on large values; rounding down in double keeps them
    return v.filter(~bad & (F.size("e") > 0)).select("vec_id", F.transform("e", lambda x: x * SCALE).alias("e"))


def by_dimension(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers) of a batch, one pair for each number of dimensions."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    return [(ids[own], flat[starts[own][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist() for own in [np.flatnonzero(sizes == d)]]


def distinct(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of x, the k + 1 smallest distinct ids of each (one may be the query's own), and their numbers."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    copies: list[list[int]] = [[] for _ in first]
    for i, g in zip(ids.tolist(), inverse.tolist(), strict=True):
        if len(copies[g]) <= k and (not copies[g] or copies[g][-1] != i):
            copies[g].append(i)
    return x[first], np.array([i for c in copies for i in c], np.int64), np.array([len(c) for c in copies], np.int64)


def chunks_of(vectors: DataFrame, k: int) -> DataFrame:
    """The exact table (CHUNKS) of usable vectors. Keys rise within a file, and pages are small, so that a scan for a few keys
    skips what lies between them."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = []
                for ids, x in by_dimension(batch.slice(at, BLOCK)):
                    x, own, copies = distinct(ids, x, k)
                    ends = np.concatenate([[0], np.cumsum(copies)])
                    for i in range(0, len(x), CHUNK):
                        j = min(i + CHUNK, len(x))
                        rows.append((first + n, x.shape[1], own[ends[i] : ends[j]].tobytes(), copies[i:j].tobytes(), x[i:j].tobytes()))
                        n += 1
                if rows:
                    types = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "dim", "ids", "copies", "vectors"])

    path = shared_dir(vectors.sparkSession, "exact")
    out = vectors.mapInArrow(run, CHUNKS)
    out.write.option("parquet.page.size", 64 << 10).option("parquet.block.size", 4 << 20).parquet(path)
    return vectors.sparkSession.read.schema(out.schema).parquet(path)


def cells_of(chunks: DataFrame, low: float, width: float) -> DataFrame:
    """key, dim and cells (a byte for each component) of every chunk."""

    def run(batches):
        for batch in batches:
            cells = [np.clip(np.floor((np.frombuffer(v.as_py()) - low) / width), 0, CELLS - 1).astype(np.uint8).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["key", "dim", "cells"])

    return written(chunks.select("key", "dim", "vectors").mapInArrow(run, "key long, dim int, cells binary"), "cells")


def exact(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products as Python integers."""
    most = float(np.abs(vectors).max(initial=0.0)) * float(np.abs(query).max(initial=0.0)) * len(query)
    if most < EXACT:
        return (vectors @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in vectors]


def bounds(cells: np.ndarray, queries: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries (rows) with all vectors, given by their cells.

    A component in cell c lies in [low + c * width, low + (c + 1) * width), so a score lies within half a width times
    the query's absolute sum of the score of the cells' middles: as cells are equally wide, the sums of the middles'
    products are one matrix product over bytes. The slack takes the rounding of single precision, too. Bounds end at
    64 bits, where scores saturate; what overflows bounds nothing.
    """
    kind = np.float32 if float(np.abs(queries).max(initial=0.0)) < 1e30 else np.float64
    middle = (cells.astype(kind) + kind(0.5)).T  # in units of cells
    with np.errstate(all="ignore"):
        near = (queries.astype(kind) @ middle).astype(np.float64) * width + queries.sum(1)[:, None] * low
        total = np.abs(queries).sum(1)
        slack = total * (width / 2) + total * (CELLS * width + abs(low)) * (cells.shape[1] + 4) * 2.0**-23 + 1e-6
        lower, upper = near - slack[:, None], near + slack[:, None]
    bad = ~(np.isfinite(lower) & np.isfinite(upper))
    lower[bad], upper[bad] = -np.inf, np.inf
    return np.minimum(lower, FAR), np.minimum(upper, FAR)


def candidates(cells: DataFrame, sent, low: float, width: float, k: int) -> DataFrame:
    """query_id, key, row, lower and upper of the vectors that may be among a query's k best, by their cells alone.

    A task keeps the k + 1 best lower bounds of every query (one may be of the query's own row) and reports what reaches
    them at that moment.
    """

    def run(batches):
        by_dim = {d: (ids, v, np.full((len(ids), k + 1), -np.inf)) for d, ids, v in grouped(sent.value)}
        for batch in batches:
            keys, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in by_dim:
                    continue
                ids, v, tops = by_dim[d]
                own = np.flatnonzero(dims == d)
                for at in range(0, len(own), BLOCK // CHUNK):
                    some = own[at : at + BLOCK // CHUNK]
                    each = [np.frombuffer(batch.column(2)[int(i)].as_py(), np.uint8).reshape(-1, d) for i in some]
                    place = np.repeat(keys[some], [len(e) for e in each]), np.concatenate([np.arange(len(e)) for e in each])
                    yield from reports(np.concatenate(each), place, ids, v, tops)

    def reports(cells, place, ids, v, tops):
        for at in range(0, len(ids), AT_ONCE):
            q = slice(at, at + AT_ONCE)
            lower, upper = bounds(cells, v[q], low, width)
            best = np.concatenate([tops[q], np.partition(lower, -min(k + 1, lower.shape[1]), axis=1)[:, -(k + 1) :]], axis=1)
            tops[q] = np.sort(best, axis=1)[:, -(k + 1) :]
            r, c = np.nonzero(upper >= tops[q][:, :1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (ids[q][r], place[0][c], place[1][c].astype(np.int32), lower[r, c], upper[r, c])], names=["query_id", "key", "row", "lower", "upper"]
            )

    return cells.mapInArrow(run, "query_id long, key long, row int, lower double, upper double")


def grouped(batches: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, vectors) of a group of queries."""
    dims = sorted({v.shape[1] for _, v in batches})
    of = lambda d, i: np.concatenate([b[i] for b in batches if b[1].shape[1] == d])
    return [(d, of(d, 0), of(d, 1)) for d in dims]


def exact_scores(wanted: DataFrame, chunks: DataFrame, sent) -> DataFrame:
    """query_id, vec_id and score of wanted (query_id, key, row), from the exact chunks of their keys."""
    asked = written(wanted.groupBy("key").agg(F.collect_list("query_id").alias("queries"), F.collect_list("row").alias("rows")), "asked")
    keys = [r.key for r in asked.select("key").limit(LISTED + 1).collect()]  # at most LISTED numbers and one
    read = chunks.filter(F.col("key").isin(keys)) if len(keys) <= LISTED else chunks

    def run(batches):
        told = {int(i): x for _, ids, v in grouped(sent.value) for i, x in zip(ids, v, strict=True)}
        for batch in batches:
            out = []
            for queries, rows, dim, ids, copies, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(vectors).reshape(-1, dim)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(copies, np.int64))])
                ids = np.frombuffer(ids, np.int64)
                by: dict[int, list[int]] = {}
                for q, r in zip(queries, rows, strict=True):
                    by.setdefault(q, []).append(r)
                for q, own in by.items():
                    for r, s in zip(own, exact(x[own], told[q]), strict=True):
                        out += [(q, int(v), max(-(2**63), min(2**63 - 1, s))) for v in ids[ends[r] : ends[r + 1]] if v != q]
            for at in range(0, len(out), 65_536):
                cols = zip(*out[at : at + 65_536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = join_small(read, asked, "key", "inner").select("queries", "rows", "dim", "ids", "copies", "vectors")
    scores = found.mapInArrow(run, "query_id long, vec_id long, score long")
    return scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def k_best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_of(cells: DataFrame, chunks: DataFrame, asked: DataFrame, low: float, width: float, k: int) -> DataFrame:
    """query_id, vec_id, score and rank of the k best candidates of one group of queries."""
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast([b for batch in asked.select("vec_id", "e").toArrow().to_batches() for b in by_dimension(batch)])  # about GROUP_BYTES
    may = written(candidates(cells, sent, low, width, k), "bounded")
    lowest = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floors = may.select("query_id", "lower").withColumn("r", F.row_number().over(lowest)).filter(F.col("r") == k + 1).select("query_id", F.col("lower").alias("floor"))
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key", "row")
    left = may.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    left = written(left.select("query_id", "key", "row", "upper", F.row_number().over(order).alias("place")), "candidates")
    best, done, size = None, 0, READ
    while True:
        found = exact_scores(left.filter((F.col("place") > done) & (F.col("place") <= done + size)), chunks, sent)
        found = found if best is None else found.unionByName(best.select(*found.columns)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = written(k_best(found, k), "best")
        done, size = done + size, size * 8
        # a query is certain if its k-th best reaches all upper bounds that are left (a bit more, for doubles are rounded)
        kth = best.filter(F.col("rank") == k).select("query_id", (F.col("score").cast("double") * (1 - F.signum(F.col("score").cast("double")) * 1e-12) - 1).alias("kth"))
        rest = left.filter(F.col("place") > done).join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
        left = written(rest.select(*left.columns), "candidates")
        if not left.limit(1).count():
            return best


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of `vectors` for each row of `queries` (vec_id, embedding).

    Scores are inner products of floor(256 * x); ties go to the smaller vec_id; a query's own vec_id is no candidate.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without a vec_id or
    candidates of another dimension. Rows that repeat a vec_id count once (the best of them as a candidate, the least
    vector as a query). Scores beyond 64 bits saturate. Empty tables give no rows; other columns are ignored.
    """
    spark, all_rows = vectors.sparkSession, usable(vectors)
    small_batches(spark)
    span = all_rows.select(F.min(F.array_min("e")).alias("low"), F.max(F.array_max("e")).alias("high")).first()
    asked = usable(queries).groupBy("vec_id").agg(F.min("e").alias("e"))
    size = asked.agg(F.sum(8 * F.size("e") + 8).alias("bytes")).first().bytes
    if not size or span.low is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = -(-size // GROUP_BYTES)
    low = float(np.floor(span.low))
    width = max(1.0, float(np.ceil((np.floor(span.high) - low + 1) / CELLS)))
    chunks = chunks_of(all_rows, k)
    cells = cells_of(chunks, low, width)
    stored = shared_dir(spark, f"queries-{uuid.uuid4().hex}")
    asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).write.partitionBy("part").parquet(stored)
    # one group after the other: each is held in memory by all tasks
    parts = [best_of(cells, chunks, spark.read.parquet(f"{stored}/part={g}"), low, width, k) for g in sorted(present(spark, stored))]
    return reduce(DataFrame.unionByName, parts).select("query_id", "rank", "vec_id", "score")


def present(spark: SparkSession, stored: str) -> set[int]:
    """The numbers of the groups that hold a query."""
    return {r.part for r in spark.read.parquet(stored).select("part").distinct().collect()}


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) score FROM v q, v c
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score FROM r WHERE rank <= 5
"""
