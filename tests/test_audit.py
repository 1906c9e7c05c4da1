"""The audit's scope, its summary, drift, streams and lacking members on planted rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit


@pytest.fixture(scope="module")
def rows(spark):
    claims = [("A1", "U1_TX", 7), ("A2", "U1_TX", 8), ("A3", "U1_TX", None), ("A4", "U1_TX", 7), ("Z1", "U1_TX", 7), ("X1", "U1_TX", 7), ("A1", "U9_TX", 7), ("A2", "U2_RX", 1), ("A5", "U3_RX", 4)]
    truth = [("A1", "U1_TX", 7), ("A2", "U1_TX", 7), ("A3", "U1_TX", 7), ("A4", "U4_CK", 1), ("A5", "U1_TX", 9), ("Z2", "U1_TX", 9), ("A6", "U2_RX", 2), ("A6", "U4_CK", 3), ("A5", "U3_RX", None), ("A6", "U3_RX", 4), ("A2", "U2_RX", 1)]
    scope = [(f"A{k}",) for k in range(1, 7)] + [("X1",), ("A1",)]
    frame = lambda x, s: spark.createDataFrame(x, s)
    unit, interest = F.substring("signal", 1, 2), F.col("signal").endswith("TX") | F.col("signal").endswith("CK")
    return audit.scoped(frame(claims, "pin string, signal string, af int"), frame(truth, "pin string, signal string, af int"), frame(scope, "pin string"), "pin", "signal", "af", unit, interest)


def test_only_what_both_sides_could_know_is_judged(rows):
    got = {(r.pin, r.signal): (r.kind, r.claimed, r.true_value) for r in rows.collect()}
    assert got == {
        ("A1", "U1_TX"): ("exact", 7, 7), ("A2", "U1_TX"): ("wrong value", 8, 7), ("A3", "U1_TX"): ("unknown", None, 7), ("A4", "U1_TX"): ("not in truth", 7, None),
        ("X1", "U1_TX"): ("off package", 7, None), ("A1", "U9_TX"): ("absent unit", 7, None), ("A2", "U2_RX"): ("exact", 1, 1), ("A5", "U3_RX"): ("unknown", 4, None),
        ("A5", "U1_TX"): ("missing", None, 9),  # claimed and of interest; Z2 is out of scope, U4_CK is not claimed, U2_RX and U3_RX not of interest
    }
    assert rows.count() == len(got)


def test_the_summary_counts_each_verdict(rows):
    out = {r.family: r for r in audit.summary(rows.withColumn("family", F.right("signal", F.lit(2))), "family", "pin", F.substring("signal", 1, 2), 90.0).collect()}
    a = out["all"]
    assert (a.checked, a.corroborated, a.exact, a.unknown, a.wrong, a.unsupported, a.missing, a.off_package, a.absent_units) == (6, 5, 2, 2, 1, 1, 1, 1, 1)
    assert a.percent == 83.3333 and a.warning and not out["RX"].warning and out["RX"].percent == 100.0 and set(out) == {"all", "TX", "RX"}
    nothing = audit.summary(rows.filter("kind = 'missing'").withColumn("family", F.lit("x")), "family", "pin", F.lit(1), 90.0).collect()
    assert {(r.family, r.checked, r.percent, r.warning) for r in nothing} == {("all", 0, None, False), ("x", 0, None, False)}


def test_drift_tells_added_removed_and_changed_groups(spark):
    old = spark.createDataFrame([("same", 1), ("same", 2), ("less", 1), ("less", 2), ("gone", 1), ("swap", 1)], "g string, v int")
    new = spark.createDataFrame([("same", 2), ("same", 1), ("less", 1), ("new", 7), ("new", 8), ("swap", 2)], "g string, v int")
    got = {r.g: (r.state, r.old_n, r.new_n) for r in audit.drift(old, new, ["g"], [F.col("v")], 4).collect()}
    assert got == {"less": ("changed", 2, 1), "gone": ("removed", 1, None), "new": ("added", None, 2), "swap": ("changed", 1, 1)}


def test_streams_of_the_fixed_style(spark):
    first = spark.createDataFrame([(1, "S1", 1), (1, "S1", 3), (1, "S2", 2), (1, None, 4), (2, "S3", 1)], "d int, stream string, seq int")
    later = spark.createDataFrame([(1, "S1", 9), (1, "S3", 10), (1, None, 11), (2, "S1", 5), (3, None, 6)], "d int, stream string, seq int")
    got = {r.seq: (r.problem, r.holder) for r in audit.stream_conflicts(first, later, "d", "stream", "seq").collect()}
    assert got == {9: ("stream is taken", 3), 11: ("not an option", None), 6: ("not an option", None)}


def test_lacking_members(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "o int")
    have = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (9, "c")], "o int, m string")
    members = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "m string")
    got = audit.lacking_members(owners, have, members, "o", "m")
    assert sorted(map(tuple, got.collect())) == [(1, "c"), (2, "a"), (2, "c"), (3, "a"), (3, "b"), (3, "c")]
    with pytest.raises(ValueError, match="more than 2"):
        audit.lacking_members(owners, have, members, "o", "m", 2)
    assert audit.lacking_members(owners, have, members.limit(0), "o", "m").count() == 0


def test_waivers_meet_findings_once(spark):
    found = spark.createDataFrame([(1, 1, "red hat"), (1, 1, "red hat"), (1, 2, "blue hat"), (2, 1, None), (3, 1, "hat"), (None, 1, "red hat")], "pin int, signal int, source string")
    waivers = spark.createDataFrame([(1, 1, "hat"), (1, 1, "red"), (1, 2, "hat"), (2, 1, "red"), (3, 1, None), (4, 1, "red"), (None, 1, "red")], "pin int, signal int, scope string")
    state = audit.waived(found, waivers, ["pin", "signal"], "source", "scope")
    assert sorted(map(repr, map(tuple, state.select("pin", "signal", "state").collect()))) == sorted(map(repr, [(1, 1, "waived"), (1, 1, "waived"), (1, 2, "open"), (2, 1, "open"), (3, 1, "open"), (None, 1, "open")]))
    left = audit.stale(waivers, found, ["pin", "signal"], "scope", "source")
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(2, 1, "red"), (3, 1, None), (4, 1, "red"), (None, 1, "red")]))
    assert state._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # found is not joined back to itself
