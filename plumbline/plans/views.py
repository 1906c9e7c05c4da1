"""The tables of a folder, and the views that stand for positioned words, tokens, lines, claims, boards and boxes."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUT = "1998-06-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """P points, T tokens, L lines, C claims and truth, B boards, R boxes, and every table by its name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def P(self) -> DataFrame:  # noqa: N802
        seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / F.lit(1_000_000.0)
        return self.events.select(
            F.col("user_id").alias("doc_id"), F.col("event_id").alias("word_id"), F.col("event_type").alias("text"),
            seconds.alias("x"), (seconds / 3600).alias("h"), F.col("value").alias("y"),
        )

    @cached_property
    def T(self) -> DataFrame:  # noqa: N802
        return self.documents.select("doc_id", F.posexplode(F.split("text", r"[ \t\n\f\r]+")).alias("pos", "token")).filter("token <> ''")

    @property
    def all_tokens(self) -> Column:
        """A document's tokens as an array, empty ones at its ends included, so that places count as in T."""
        return F.split("text", r"[ \t\n\f\r]+")

    @property
    def tokens(self) -> Column:
        """The tokens of T within the row, for what needs no shuffle."""
        return F.filter(self.all_tokens, lambda t: t != "")

    @cached_property
    def L(self) -> DataFrame:  # noqa: N802
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    def claims(self, truth: bool) -> DataFrame:
        rows = self.lineitem.filter((F.col("l_shipdate") >= CUT) if truth else (F.col("l_shipdate") < CUT))
        return rows.groupBy(F.col("l_partkey").alias("pin"), F.col("l_suppkey").alias("signal")).agg(F.min("l_linenumber").alias("af"))

    @cached_property
    def B(self) -> DataFrame:  # noqa: N802
        return self.boards()

    def boards(self, *more: Column) -> DataFrame:
        """B with more columns of its table."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("pin"), F.col("l_suppkey").alias("dev"),
            F.concat("l_returnflag", "l_linestatus").alias("net"), F.col("l_quantity").alias("qty"), *more,
        )

    @cached_property
    def R(self) -> DataFrame:  # noqa: N802
        h, y = F.col("h"), F.col("y")
        return self.P.filter("text = 'signup'").select("doc_id", F.col("word_id").alias("box_id"), (h - 12).alias("x0"), (h + 12).alias("x1"), (y - 20).alias("y0"), (y + 20).alias("y1"))


VIEWS_SQL = r"""WITH RECURSIVE pts AS (SELECT user_id doc_id, event_id word_id, event_type text, epoch_us(ts) / 1000000.0::DOUBLE x, epoch_us(ts) / 1000000.0::DOUBLE / 3600 h, value y FROM events),
toks AS (SELECT * FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) pos, unnest(a) token FROM (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\f\r]+') a FROM documents)) WHERE token <> ''),
lns AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) line_no, unnest(a) line FROM (SELECT doc_id, string_split(text, chr(10)) a FROM documents)),
CLAIMS AS (SELECT l_partkey pin, l_suppkey signal, min(l_linenumber) af FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY ALL),
TRUTH AS (SELECT l_partkey pin, l_suppkey signal, min(l_linenumber) af FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY ALL),
boards AS (SELECT l_orderkey doc_id, l_linenumber seq, l_partkey pin, l_suppkey dev, l_returnflag || l_linestatus net, l_quantity qty FROM lineitem),
boxes AS (SELECT doc_id, word_id box_id, h - 12 x0, h + 12 x1, y - 20 y0, y + 20 y1 FROM pts WHERE text = 'signup')
"""


def query(name: str, sql: str | None) -> Callable:
    """Register a function of Views as a query, with its SQL over the same views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = VIEWS_SQL + sql
        return f

    return add
