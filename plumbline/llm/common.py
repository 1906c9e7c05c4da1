"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space; a word is a maximal run of anything else.
SPACE = r"\x20\x09-\x0D"
#: Bytes of a slice that a Python task holds as objects at once.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to a Python task.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share (spark.checkpoint.dir).

    Where that setting is missing, a local master gets a temporary folder; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Spark passes to Python tasks in bytes, unless the session sets a bound; results stay the same."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, BATCH_BYTES)


def slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in order, in slices of at most `rows` rows and about `most` bytes (a longer row is a slice of its own)."""
    at = 0
    while at < batch.num_rows:
        own = batch.slice(at, rows)
        while own.num_rows > 1 and own.nbytes > most:
            own = own.slice(0, own.num_rows // 2)
        yield own
        at += own.num_rows


def map_slices(
    df: DataFrame, fn: Callable[..., dict], schema: str, rows: int = 256, once: Callable[[], object] | None = None, most: int = SLICE_BYTES
) -> DataFrame:
    """Call fn on slices of df's columns as Python lists; fn returns a list or array for each output column.

    once, when given, builds per-task state that fn gets as its first argument. A slice has at most `rows` rows and about
    `most` bytes.
    """
    out = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        state = (once(),) if once else ()
        for batch in batches:
            for own in slices(batch, rows, most):
                got = fn(*state, *(c.to_pylist() for c in own.columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, keep: Callable[[list], list], rows: int = 256) -> DataFrame:
    """The rows of df, in all its columns, for whose value of `column` keep returns true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for own in slices(batch, rows):
                yield own.filter(pa.array(keep(own.column(at).to_pylist()), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def replace_text(df: DataFrame, column: str, fn: Callable[[list], list], rows: int = 256) -> DataFrame:
    """df with the string column replaced by what fn makes of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for own in slices(batch, rows):
                columns = [pa.array(fn(c.to_pylist()), c.type) if i == at else c for i, c in enumerate(own.columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=own.schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def about(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """A random sample of about `most` rows (all, if fewer), the same on every run: rows are chosen by a hash of columns."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(most / n * (1 << 30)))


#: Rows of a narrow table (a few numbers each) up to which a join may broadcast it.
BROADCAST_ROWS = 500_000


def join_small(df: DataFrame, other: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    """Join with a narrow stored table, broadcast only if its counted rows are few; a shuffled join otherwise."""
    few = other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(other) if few else other.hint("merge"), on, how)
