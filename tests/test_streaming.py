"""Incremental operators over tables that arrive in several batches."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.streaming import incremental, ingest

DAY = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def ingested(spark, path, name, files=None):
    docs = incremental.arriving(spark, path, files).select("doc_id", "text")
    return incremental.drained(docs, name, ingest.keep_new, ingest.metrics(docs).schema)


def test_two_batches_equal_one(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for rows in ([(3, "a b"), (4, "c"), (5, None)], [(1, "a b"), (2, "d  e f"), (6, "d  e f"), (6, "d  e f")]):
        put(spark, path, rows, "doc_id long, text string")
    one, two = ingested(spark, path, "one").collect(), ingested(spark, path, "two", 1).collect()
    assert sorted((r.digest, r.words, r.lines) for r in one) == sorted((r.digest, r.words, r.lines) for r in two)
    assert sorted(r.words for r in one) == [1, 2, 3]
    assert {r.doc_id for r in one} == {1, 2, 4}  # the least of those that arrive together


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    first, second = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "a b"), (2, None)], [(3, "a b"), (4, "c d e"), (5, "")]))
    for number, batch in ((0, first), (1, second), (1, second)):
        ingest.keep_new(batch, f"{tmp_path}/out/batch={number}")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.words, r.distinct_words, r.longest, r.batch) for r in rows) == [(1, 2, 2, 1, 0), (4, 3, 3, 1, 1), (5, 0, 0, 0, 1)]
    words = spark.read.parquet(f"{tmp_path}/words").collect()
    assert sorted((r.doc_id, r.pos, r.token) for r in words) == [(1, 0, "a"), (1, 1, "b"), (4, 0, "c"), (4, 1, "d"), (4, 2, "e")]


def test_a_batch_does_not_read_its_past(spark, tmp_path, monkeypatch):
    """Ten batches of new texts: which buckets of digests each one reads, and how many digests they hold."""
    read = []
    kept = ingest.earlier

    def counted(spark, base, batch, buckets):
        got = kept(spark, base, batch, buckets)
        read.append(got.count() if got is not None else 0)
        return got

    monkeypatch.setattr(ingest, "earlier", counted)
    for k in range(10):
        rows = [(1000 * k + i, f"text {k} {i}") for i in range(200)] + [(1000 * k + 900, "text 0 5")]
        ingest.keep_new(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/out/batch={k}")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2000
    assert max(read) < 60 and len(read) == 9  # of up to 1,801 digests: the bucket of the one that comes again


def test_a_filter_knows_all_that_it_covers(spark):
    digests = spark.range(3000).selectExpr("sha2(string(id), 256) AS digest")
    half = digests.limit(1500)
    known = ingest.set_bits(half)
    assert ingest.maybe_known(half, known).count() == 1500
    assert ingest.maybe_known(digests.subtract(half), known).count() < 15


def test_late_rows_are_dropped_from_sessions(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[(1, at(0)), (1, at(1)), (1, at(100))], [(1, at(200))], [(1, at(2)), (1, at(300))]]  # a batch is held against the watermark of the one before
    for rows in batches:
        put(spark, path, rows, "user_id long, ts timestamp")
    events = incremental.arriving(spark, path, 1)
    got = incremental.drained(incremental.sessions(events, "user_id", "ts", "6 hours", "1 day"), "late").orderBy("start").collect()
    first = got[0]
    assert (first.start, first.end, first.n) == (at(0), at(7), 2)  # hour 2 came too late
    assert [r.n for r in got] == [2, 1, 1]


def walk(rows, days):
    """(user, kind, time) that are told: each at least so many days from the one told before."""
    last, out = {}, []
    for u, k, t in sorted(rows, key=lambda r: r[2]):
        if (u, k) not in last or t - last[u, k] >= dt.timedelta(days=days):
            last[u, k] = t
            out.append((u, k, t))
    return sorted(out)


def told(spark, path, name, files=1, late="1 day"):
    got = incremental.drained(incremental.first_seen(incremental.arriving(spark, path, files), ["user_id", "kind"], "ts", 7, late), name)
    return sorted(map(tuple, got.select("user_id", "kind", "ts").collect()))


def test_a_key_on_both_sides_of_a_week_is_told_once(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    at = lambda d: DAY + dt.timedelta(days=d)
    rows = [(1, "a", at(6.5)), (1, "a", at(7.5)), (1, "a", at(13.4)), (1, "a", at(13.5)), (2, "a", at(0)), (2, "b", at(3)), (2, "a", at(30)), (2, "a", at(36.9)), (2, "b", at(40))]
    for r in sorted(rows, key=lambda r: r[2]):
        put(spark, path, [r], "user_id long, kind string, ts timestamp")
    want = walk(rows, 7)
    assert [r for r in want if r[0] == 1] == [(1, "a", at(6.5)), (1, "a", at(13.5))]
    assert told(spark, path, "weeks") == want == told(spark, path, "weeks-at-once", None)


def test_rows_that_come_late_do_not_tell_again(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    at = lambda d: DAY + dt.timedelta(days=d)
    for r in [(1, "a", at(3)), (1, "a", at(1)), (1, "a", at(9)), (1, "a", at(11))]:
        put(spark, path, [r], "user_id long, kind string, ts timestamp")
    assert told(spark, path, "late", 1, "5 days") == [(1, "a", at(3)), (1, "a", at(11))]


def test_late_rows_change_a_window_that_was_written(spark, tmp_path):
    path, base = str(tmp_path / "events.parquet"), str(tmp_path / "monitor")
    at = lambda h: DAY + dt.timedelta(hours=h)
    monitor = lambda: incremental.ratio_by_window(incremental.arriving(spark, path), "ts", "1 day", "2 days", F.col("kind") == "a")
    seen = []
    for rows in ([("a", at(1)), ("b", at(2))], [("b", at(30))], [("a", at(3)), ("a", at(31))], [("b", at(200))], [("a", at(4)), ("a", at(201))]):
        put(spark, path, rows, "kind string, ts timestamp")
        incremental.run_updates(monitor(), base)
        seen.append({r.start.day: (r.n, r.hits) for r in incremental.latest_rows(spark, base, monitor().schema, ["start"]).collect()})
    assert seen[0] == {1: (2, 1)} and seen[1] == {1: (2, 1), 2: (1, 0)}
    assert seen[2] == {1: (3, 2), 2: (2, 1)}  # the first day was written before
    assert seen[4] == {1: (3, 2), 2: (2, 1), 9: (2, 1)}  # and is closed by now


def test_keys_of_a_bucket_are_told_apart_and_called_together(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    at = lambda d: DAY + dt.timedelta(days=d)
    big = 2**60
    rows = [(u, k, at(d + u % 5 / 4)) for u in [*range(300), big, big + 1] for k in ("a", "b", None) for d in (0, 3, 7.5, 20)]
    rows += [(None, k, at(d)) for k in ("a", None) for d in (0, 6, 8)]
    for day in (0, 3, 6, 7.5, 8, 20):
        put(spark, path, [r for r in rows if day <= (r[2] - DAY).total_seconds() / 86400 - (r[0] or 0) % 5 / 4 < day + 0.4], "user_id long, kind string, ts timestamp")
    order = lambda rows: sorted(rows, key=repr)
    for files in (1, None):
        df = incremental.first_seen(incremental.arriving(spark, path, files), ["user_id", "kind"], "ts", 7, "3 days", 8)
        got = incremental.drained(df, "buckets").select("user_id", "kind", "ts").collect()
        last, want = {}, []
        for u, k, t in sorted(rows, key=lambda r: r[2]):
            if (u, k) not in last or t - last[u, k] >= dt.timedelta(days=7):
                last[u, k] = t
                want.append((u, k, t))
        assert order(map(tuple, got)) == order(want)
    query = df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8 * 4  # not one for each of 900 keys
