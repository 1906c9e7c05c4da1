"""Incremental queries, whose tables arrive as streams and are drained once, and the round trip of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import shared_folder
from ..sources.markup import report_sink
from ..streaming import incremental, ingest
from .views import Views, query


@query("J1_incremental_ingest", r"""SELECT doc_id, digest, CAST(len(w) AS INTEGER) words, CAST(len(list_distinct(w)) AS INTEGER) distinct_words, CAST(len(string_split(text, chr(10))) AS INTEGER) lines, CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS INTEGER) longest
FROM (SELECT min(doc_id) doc_id, text, sha256(text) digest, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def j1(v: Views) -> DataFrame:
    """The metric row of every distinct text of the documents that have arrived."""
    docs = incremental.arriving(v.spark, f"{v.sf_dir}/documents.parquet").select("doc_id", "text")
    return incremental.drained(docs, "ingest", ingest.keep_new, ingest.metrics(docs).schema)


@query("J2_stream_sessions", """, d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END n FROM events),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) s FROM d), g AS (SELECT user_id, min(ts) a, max(ts) + INTERVAL 6 HOUR b, count(*) n FROM k GROUP BY user_id, s)
SELECT user_id, epoch_us(a) "start", epoch_us(b) "end", n FROM g WHERE b <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def j2(v: Views) -> DataFrame:
    """Sessions of a user's events that are closed a day before the last event."""
    events = incremental.arriving(v.spark, f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.drained(incremental.sessions(events, "user_id", "ts", "6 hours", "1 day"), "sessions")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("J3_first_seen", """, f(user_id, event_type, ts) AS (SELECT user_id, event_type, min(ts) FROM events GROUP BY ALL UNION ALL SELECT * FROM (SELECT user_id, event_type, (SELECT min(e.ts) FROM events e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts >= f.ts + INTERVAL 7 DAY) ts FROM f) WHERE ts IS NOT NULL)
SELECT user_id, event_type, epoch_us(ts) seen FROM f""")
def j3(v: Views) -> DataFrame:
    """Kinds of event of each user, told once in every seven days from when they were told last."""
    events = incremental.arriving(v.spark, f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.drained(incremental.first_seen(events, ["user_id", "event_type"], "ts", 7, "1 day"), "seen")
    return out.select("user_id", "event_type", F.unix_micros("ts").alias("seen"))


@query("J4_running_agreement", "SELECT epoch_us(date_trunc('day', ts)) \"start\", count(*) n, count(*) FILTER (event_type = 'purchase') hits FROM events GROUP BY 1")
def j4(v: Views) -> DataFrame:
    """Events and purchases of every day, as they stand after all that has arrived."""
    events = incremental.arriving(v.spark, f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.monitored(incremental.ratio_by_window(events, "ts", "1 day", "1 day", F.col("event_type") == "purchase"), "agreement", ["start"])
    return out.select(F.unix_micros("start").alias("start"), "n", "hits")


@query("A11_report_sink", "SELECT o_orderstatus, o_orderpriority, o_orderkey, o_custkey FROM orders")
def a11(v: Views) -> DataFrame:
    """Every order through a report with one folder for each status and priority, read back."""
    columns = ["o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"]
    orders = v.orders.select(*columns)
    path = shared_folder(v.spark, "report")
    report_sink(orders, path, columns[:2], order=["o_orderkey"])
    return v.spark.read.schema(orders.schema).json(path).select(*columns)
