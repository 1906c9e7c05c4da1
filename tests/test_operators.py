"""Operators on small tables with known answers."""

import difflib
import itertools
import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import assign, audit, near, ordered, resolve
from plumbline.sources import markup


def test_gap_clusters_keep_equal_gaps_together(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([10.0, 10.4, 11.4, 40.0])], "g int, id int, x double")
    got = {r.id: r.cluster for r in ordered.gap_clusters(df, ["g"], "x", "id", 1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}


def test_thinning_anchors_on_what_is_kept(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(4)], "g int, x double")
    assert sorted(r.x for r in ordered.thinned(df, ["g"], "x", 1.5).collect()) == [0.0, 2.0]


def test_hole_slots_are_empty_without_holes(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 4.0)], "g int, x double")
    assert sorted(r.slot for r in ordered.hole_slots(df, ["g"], "x", 1.0).collect()) == [2.0, 3.0]


def test_nearness_joins_equal_brute_force(spark):
    rng = random.Random(7)
    a = [(g, i, rng.uniform(0, 50), rng.uniform(0, 50)) for g in (1, 2) for i in range(60)]
    left = spark.createDataFrame(a, "g int, a int, x double, y double")
    right = left.select("g", F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    got = {(r.g, r.a, r.b) for r in near.radius_join(left, right, ["g"], ("x", "y"), ("bx", "by"), 6.0).collect()}
    assert got == {(g, i, j) for g, i, x, y in a for h, j, u, w in a if g == h and math.hypot(x - u, y - w) <= 6.0}
    band = [(r.g, r.a, r.b) for r in near.band_join(left, right, ["g"], "x", "bx", 2.0).collect()]
    assert len(band) == len(set(band))
    assert set(band) == {(g, i, j) for g, i, x, _ in a for h, j, u, _ in a if g == h and abs(x - u) <= 2.0}


def test_hamming_and_rules(spark):
    df = spark.createDataFrame([("SPI1",), ("SPI3",), ("I2C1",)], "a string")
    got = {(r.a, r.b) for r in resolve.hamming_one(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {("SPI1", "SPI3"), ("SPI3", "SPI1")}
    role = resolve.first_match(F.col("a"), [("^SPI", "spi"), ("1$", "one")])
    assert [r.role for r in df.select("a", role.alias("role")).orderBy("a").collect()] == ["one", "spi", "spi"]


def test_values(spark):
    df = spark.createDataFrame([("4K7",), ("13.7K",), ("100R",), ("x",), ("10k",), ("100kΩ",), ("22 ohm",), ("22",)], "v string")
    assert [r.o for r in df.select(resolve.ohms(F.col("v")).alias("o")).collect()] == [4700.0, 13700.0, 100.0, None, 10000.0, 100000.0, 22.0, None]


def test_audit_is_three_valued(spark):
    claims = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("z", 1, 1)], "pin string, signal int, af int")
    truth = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "pin string, signal int, af int")
    assert {(r.pin, r.signal): r.ok for r in audit.supported(claims, truth, ["pin", "signal"]).collect()} == {("a", 1): True, ("a", 2): False, ("z", 1): None}
    kinds = {(r.pin, r.signal): r.kind for r in audit.two_way(claims, truth, ["pin", "signal"], "af").collect()}
    assert kinds == {("a", 1): "exact", ("a", 2): "not in truth", ("z", 1): "not in truth", ("b", 1): "missing"}


def test_greedy_takes_the_first_free_option(spark):
    df = spark.createDataFrame([(1, 1, 10, [5, 6], [9]), (1, 2, 11, [5, 6], [9]), (1, 3, 12, [5, 9], [9]), (1, 4, 13, [], [9])], "g int, o int, item long, options array<long>, gone array<long>")
    got = {r.item: (r.free, r.pick, r.owners) for r in assign.greedy(df, ["g"], F.col("o"), "item", "options", "gone").collect()}
    assert got == {10: (True, 5, []), 11: (True, 6, []), 12: (False, 5, [10]), 13: (False, None, [])}


def brute_assignment(options):
    return next((list(p) for p in itertools.product(*options) if len(set(p)) == len(p)), None)


def test_conflict_free_on_known_instances(spark):
    # contention: one group only fits 1, the other 1 or 3; shared: one group; impossible: both need 2
    rows = [("contention", "a", [1]), ("contention", "b", [1, 3]), ("shared", "a", [2, 4]), ("impossible", "a", [2]), ("impossible", "b", [2]), ("none", "a", [])]
    rng = random.Random(2)
    wide = {f"w{i}": {g: sorted(rng.sample(range(20), rng.randint(1, 9))) for g in "abcd"} for i in range(40)}
    rows += [(d, g, o) for d, own in wide.items() for g, o in own.items()]
    got = assign.conflict_free(spark.createDataFrame(rows, "d string, g string, o array<long>"), "d", "g", "o").collect()
    by = {(r.d, r.g): (r.pick, r.solved) for r in got}
    assert by["contention", "a"] == (1, True) and by["contention", "b"] == (3, True) and by["shared", "a"] == (2, True)
    assert by["impossible", "a"] == by["impossible", "b"] == (2, False) and by["none", "a"] == (None, False)
    # six groups that want the same six options, and seven for which six are too few
    many = {"full": {f"g{k}": list(range(6)) for k in range(6)}, "short": {f"g{k}": list(range(6)) for k in range(7)}}
    rows = [(d, g, o) for d, own in many.items() for g, o in own.items()]
    by |= {(r.d, r.g): (r.pick, r.solved) for r in assign.conflict_free(spark.createDataFrame(rows, "d string, g string, o array<long>"), "d", "g", "o").collect()}
    assert not by["short", "g0"][1]
    for d, own in (wide | many).items():
        order = sorted(own, key=lambda g: (len(own[g]), g))
        want = brute_assignment([own[g] for g in order])
        assert [by[d, g][0] for g in order] == (want or [own[g][0] for g in order])


def test_conflict_free_looks_ahead_where_the_first_free_option_leads_nowhere(spark):
    rng = random.Random(11)
    own = {f"d{i}": {f"g{k}": rng.sample(range(6), rng.choice([2, 2, 2, 3, 6])) for k in range(rng.randint(2, 6))} for i in range(150)}
    own["hall"] = {f"g{k}": list(range(40)) for k in range(60)}  # fewer options than groups: no state is made
    own["many"] = {f"g{k:02d}": list(range(k, 60)) for k in range(40)}
    own["beyond"] = {"a": [7], "b": [7, 8], "c": [9, 8, 7], "d": [9, 8, 7, 2**40]}
    rows = [(d, g, o) for d, groups in own.items() for g, o in groups.items()]
    got = {(r.d, r.g): (r.pick, r.solved) for r in assign.conflict_free(spark.createDataFrame(rows, "d string, g string, o array<long>"), "d", "g", "o").collect()}
    ahead = 0
    for d, groups in own.items():
        order = sorted(groups, key=lambda g: (len(groups[g]), g))
        first: list = []
        for g in order:
            first.append(min(set(groups[g]) - set(first), default=None))
        want = None if d == "hall" else first if None not in first else brute_assignment([sorted(groups[g]) for g in order])
        ahead += want is not None and want != first
        assert [got[d, g] for g in order] == [(x, True) for x in want] if want else [(min(groups[g]), False) for g in order]
    assert ahead > 5 and len(got) == len(rows) and got["beyond", "d"] == (2**40, True)


def test_owners_on_the_same_wires_share_a_unit(spark):
    owners = [("contention", "a", w) for w in ("A5", "A6")] + [("contention", "b", w) for w in ("B3", "B4")]
    owners += [("shared", o, w) for o in ("osd", "baro") for w in ("B13", "B14")] + [("impossible", "a", "B13"), ("impossible", "b", "B14"), ("lost", "a", "Z9")]
    able = [("A5", 1), ("A6", 1), ("B3", 1), ("B3", 3), ("B4", 1), ("B4", 3), ("B4", 5), ("B13", 2), ("B14", 2)]
    got = assign.owners_served(spark.createDataFrame(owners, "d string, o string, w string"), spark.createDataFrame(able, "w string, u long"), "d", "o", "w", "u")
    assert {(r.d, r.o): (r.pick, r.solved, r.shares) for r in got.collect()} == {
        ("contention", "a"): (1, True, 1), ("contention", "b"): (3, True, 1), ("shared", "osd"): (2, True, 2), ("shared", "baro"): (2, True, 2),
        ("impossible", "a"): (2, False, 1), ("impossible", "b"): (2, False, 1), ("lost", "a"): (None, False, 1),
    }
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_clash_repair_moves_one_row_a_round_and_never_the_protected(spark):
    rows = spark.createDataFrame([(1, 1, 7, "T1", "motor"), (1, 2, 8, "T1", "led"), (1, 3, 9, "T2", "led"), (2, 1, 7, "T1", "motor"), (2, 2, 9, "T1", "camera")], "d int, i int, pin int, unit string, kind string")
    options = spark.createDataFrame([(7, 1, "T3"), (8, 1, "T1"), (8, 2, "T2"), (8, 3, "T4"), (9, 1, "T1")], "pin int, place int, option string")
    got = {(r.d, r.i): r.now for r in assign.repaired(rows, options, "d", "i", "pin", "unit", "kind", "motor").collect()}
    assert got == {(1, 1): "T1", (1, 2): "T2", (1, 3): "T2", (2, 1): "T1", (2, 2): "T1"}  # the camera has nowhere to go


def test_clash_repair_goes_on_until_nothing_moves(spark):
    """An order that needs five moves: five lines of kinds of their own stand in the motor's unit."""
    rows = [(1, 0, 0, "T0", "motor")] + [(1, k, k, "T0", f"k{k}") for k in range(1, 6)] + [(2, 1, 9, "T0", "a"), (3, 1, 9, "T0", "a"), (3, 2, 8, "T0", "b")]
    options = [(k, j, f"T{j}") for k in range(1, 6) for j in range(1, k + 1)] + [(8, 1, "T1")]
    frame = spark.createDataFrame(rows, "d int, i int, pin int, unit string, kind string")
    got = {(r.d, r.i): r.now for r in assign.repaired(frame, spark.createDataFrame(options, "pin int, place int, option string"), "d", "i", "pin", "unit", "kind", "motor").collect()}
    assert got == {(1, 0): "T0", **{(1, k): f"T{k}" for k in range(1, 6)}, (2, 1): "T0", (3, 1): "T0", (3, 2): "T1"}
    none = assign.repaired(frame.filter("d = 2"), spark.createDataFrame(options, "pin int, place int, option string"), "d", "i", "pin", "unit", "kind", "motor")
    assert [r.now for r in none.collect()] == ["T0"]


def test_division_by_the_rarest_item(spark):
    rng = random.Random(6)
    have = {(o, i) for o in range(30) for i in range(12) if rng.random() < 0.5}
    need = {(g, i) for g in range(40) for i in rng.sample(range(13), rng.randint(1, 4))}
    h, n = spark.createDataFrame(sorted(have) * 2, "owner int, item int"), spark.createDataFrame(sorted(need) * 2, "g int, item int")
    want = {(g, o) for g in range(40) for o in range(30) if all((o, i) in have for j, i in need if j == g)}
    assert {tuple(r) for r in audit.covering(h, n, ["g"], "owner", "item").collect()} == want and want


def test_wildcards_anywhere_lose_no_pair(spark):
    rng = random.Random(3)
    code = lambda: "".join(rng.choice("ab12x") for _ in range(rng.randint(1, 5)))
    a, b = {code() for _ in range(120)}, {code() for _ in range(120)}
    got = resolve.wildcard(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in a for y in b if len(x) == len(y) and all(p == q or "x" in (p, q) for p, q in zip(x, y, strict=True)))
    one = resolve.wildcard(spark.createDataFrame([("STMx2F4051",)], "a string"), spark.createDataFrame([("STM32F4051",)], "b string"), "a", "b")
    assert one.count() == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_names_lose_no_pair(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)} | {"abcdef", "abxdey"}
    a, b = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c in "ab")
    close = lambda df: {(r.a, r.b) for r in df.collect()}
    want = {(x, y) for x in names for y in names if 1 - edits(x, y) / max(len(x), len(y)) >= 0.5}
    assert close(resolve.close_names(a, b, "a", "b", 0.5, 10**6)) == want and ("abxdey", "abcdef") in want
    alike = {(x, y) for x in names for y in names if difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.6}
    assert close(resolve.alike(a, b, "a", "b", 0.6, 10**6)) == alike


def test_a_ladder_takes_the_first_rung(spark):
    codes = spark.createDataFrame([(c,) for c in ("F405", "F7x2", "F411", "G473", "F7x9", "H743")], "code string")
    names = spark.createDataFrame([(n,) for n in ("F405", "F722", "F745", "F765", "G474")], "name string")
    got = {r.code: (r.target, r.rung) for r in resolve.laddered(codes, names, "code", "name", 2, "x").collect()}
    assert got == {"F405": ("F405", 1), "F411": ("F405", 2), "F7x2": ("F722", 3), "G473": ("G474", 2)}  # F7x9 fits none, H743 has no family


def test_rules_are_validated(spark):
    for bad in ([("(", "a")], [("a", "")], [("a", "x"), ("a", "y")]):
        with pytest.raises(ValueError):
            resolve.classified(F.lit("a"), bad)
    df = spark.createDataFrame([("SPI1",), ("MISO2_A",), ("?",)], "v string")
    rule = resolve.classified(F.col("v"), [("^SPI([0-9]+)$", "bus"), ("^MISO([0-9]*)_?([A-Z]*)$", "data")], {"A": "first"})
    assert [tuple(r.c) for r in df.select(rule.alias("c")).collect()] == [("bus", "1", None), ("data", "2", "first"), (None, None, None)]


def test_required_fields_fail_the_load(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, " ", 3), (3, None, None)], "k int, s string, n int")
    with pytest.raises(ValueError, match="2: s; 3: s,n"):
        audit.required(df, "k", ["s", "n"])
    assert audit.required(df.filter("k = 1"), "k", ["s", "n"]).count() == 1


def test_split_digests_tell_multisets_apart(spark):
    rows = [("a", i) for i in range(100)] + [("b", i) for i in reversed(range(100))] + [("c", i) for i in range(99)] + [("c", 98)]
    got = {r.g: r.digest for r in audit.split_digest(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")], 8).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_a_walk_stops_at_the_first_break_on_either_side(spark):
    df = spark.createDataFrame([(1, x) for x in (0.0, 50.0, 56.0, 60.0, 66.0, 80.0)], "g int, x double")
    assert sorted(r.x for r in ordered.run_to_break(df, ["g"], ["x"], "x", F.col("x") == 60.0, 6.0).collect()) == [50.0, 56.0, 60.0, 66.0]


def test_thinning_equals_a_fold(spark):
    rng = random.Random(5)
    rows = [(g, rng.uniform(0, 60)) for g in range(4) for _ in range(80)]
    want = set()
    for g in range(4):
        last = None
        for x in sorted({x for h, x in rows if h == g}):
            if last is None or x - last >= 1.5:
                want.add((g, x))
                last = x
    df = spark.createDataFrame([*rows, *rows[:9], (1, None)], "g int, x double")
    assert {tuple(r) for r in ordered.thinned(df, ["g"], "x", 1.5).collect()} == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # clusters that go on in the next batch
    try:
        assert {tuple(r) for r in ordered.thinned(df, ["g"], "x", 1.5).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_thinning_gathers_no_group(spark):
    """One group of 300,000 positions without a gap: a fold over its array would copy it at each step."""
    df = spark.range(300_000).selectExpr("1 AS g", "id * 0.5D AS x")
    thin = ordered.thinned(df, ["g"], "x", 1.0)
    plan = thin._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert thin.count() == 150_000


def test_holes_take_the_nearest_spare_once(spark):
    edge = spark.createDataFrame([(1, i, x, 5.0) for i, x in enumerate((0.0, 4.0, 8.0, 16.0))], "g int, id int, x double, y double")
    spare = spark.createDataFrame([(1, 10, 11.5, 5.2), (1, 11, 12.2, 5.1), (1, 12, 12.0, 9.0), (1, 13, 2.0, 5.0)], "g int, id int, x double, y double")
    assert [tuple(r) for r in ordered.adopted(edge, spare, ["g"], "x", "y", "id", 0.5, 1.0, 1 / 3).collect()] == [(1, 12.0, 11)]


def test_markup_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, '<a href="x?a&amp;b">T</a><a href="y">U</a>')], "id int, html string")
    got = markup.elements(df, "id", "html", '<a href="([^"]*)">([^<]*)</a>', ["href", "text"])
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(1, 0, "x?a&b", "T"), (1, 1, "y", "U")]
    markup.report_sink(got, str(tmp_path / "out"), ["id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    markup.report_sink(got.coalesce(1), str(tmp_path / "sorted"), ["id"], order=["text"], stamped=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "sorted").rglob("part-*")) for x in f.read_text().splitlines()]
    assert [x["text"] for x in lines] == ["T", "U"] and all(re.fullmatch(r"\d{4}-\d\d-\d\d", x["stamp"]) for x in lines)
    assert markup.whole_files(spark, str(tmp_path / "out"), "*.json").count() >= 1


def test_greedy_stays_quick_where_items_share_many_options(spark):
    n = 600
    rows = spark.range(n).selectExpr("1 AS g", "id AS o", "id AS item", f"sequence(0L, {n - 2}L) AS options")
    assign.greedy(rows.limit(3), ["g"], F.col("o"), "item", "options").collect()
    begin = time.monotonic()
    got = sorted(map(tuple, assign.greedy(rows, ["g"], F.col("o"), "item", "options").select("item", "free", "pick", "owners").collect()))
    took = time.monotonic() - begin
    assert got == [(i, True, i, []) for i in range(n - 1)] + [(n - 1, False, 0, list(range(n - 1)))]
    assert took < 10  # every option was held against all earlier picks several times


def test_a_set_of_wires_is_looked_up_once_for_all_documents(spark, monkeypatch):
    owners = [(d, o, w) for d in range(40) for o, w in ((1, "a"), (2, "a+b"), (3, "a"), (3, "b"), (4, "a"))]
    able = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("a+b", 3)], "w string, u long")
    asked, covering = [], assign.covering

    def counted(have, need, *rest):
        asked.append(need.count())
        return covering(have, need, *rest)

    monkeypatch.setattr(assign, "covering", counted)
    got = assign.owners_served(spark.createDataFrame(owners, "d int, o int, w string"), able, "d", "o", "w", "u").collect()
    assert sorted(map(tuple, got)) == sorted(r for d in range(40) for r in ((d, 1, 1, True, 2), (d, 2, 3, True, 1), (d, 3, 2, True, 1), (d, 4, 1, True, 2)))
    assert asked == [4]  # a, a+b, and the two wires of {a, b}: not 4 for each document
