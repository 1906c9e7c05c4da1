"""Queries on rows at the edges of their rules, against their SQL in DuckDB."""

import random
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from plumbline.operators import audit, readings, resolve
from plumbline.plans.catalogue import ORACLE_SQL, QUERIES


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the given tables (rows and their schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        path = str(tmp_path / f"{t}.parquet")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'").fetchall()
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect()))), sorted(map(repr, want.fetchall()))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_shipdate timestamp_ntz"


def line(order, number, part, supplier, flag="A", date="1998-01-01", quantity=1.0):
    return order, number, part, supplier, flag, "F", quantity, datetime.fromisoformat(date)


def test_gutters_hold_points_whose_distance_rounds_to_their_width(spark, tmp_path):
    at = [x / 100 for x in range(4500, 10000)]
    rounded = [(x, y) for x in at for y in (round(x - 44, 2),) if x - 20 - y <= 24 and y < x - 20 - 24][:5]
    assert rounded
    rows = [r for k, (x, y) in enumerate(rounded) for r in ((2 * k, datetime(2024, 1, 1), k, "signup", x, None), (2 * k + 1, datetime(2024, 1, 1), k, "click", y, None))]
    got, want = both(spark, tmp_path, "C4_owner_assignment", events=(rows, EVENTS))
    assert got == want and len(got) == len(rounded)


def test_word_bounds_are_those_of_sql(spark, tmp_path):
    texts = ["Der Berühmte schrieb an er.49@mail9.example", "Schöne Grüße +1(325)555-8094", "éTom ab.c@mail and thless", "Tom_ x@y1", "üBer alles and mehr", "Ann x@y Bob z@y"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got, want = both(spark, tmp_path, "D13_pattern_components", documents=(rows, "doc_id long, text string"))
    assert got == want and len(got) > 5


def test_last_words_before_a_keyword_have_the_bounds_of_sql(spark, tmp_path):
    rows = [(1, "üBer alles and mehr"), (2, "Ann and Bob"), (3, "éTom and more"), (4, "xTom and more")]
    got, want = both(spark, tmp_path, "C12_nearest_left", documents=(rows, "doc_id long, text string"))
    assert got == want and len(got) == 3


def test_first_parts_by_line_and_part_numbers_beyond_a_million(spark, tmp_path):
    rows = [line(1, 1, 3_000_000, 1), line(1, 2, 7, 1), line(1, 3, 8, 1, "R"), line(2, 1, 5, 1), line(2, 2, 4, 1), line(3, 1, 999_999, 1), line(3, 2, 1, 1)]
    got, want = both(spark, tmp_path, "D15_category_pivot", lineitem=(rows, LINES))
    assert got == want and len(got) == 3


def test_of_first_parts_with_equal_sums_the_row_that_stands_first_counts(spark, tmp_path):
    tied = [line(o, *x) for o in range(1, 41) for x in (((1, 1_000_007, 1), (2, 7, 1)) if o % 3 else ((2, 7, 1), (1, 1_000_007, 1)))]
    rows = [*tied, line(41, 1, None, 1), line(41, 2, 5, 1), line(42, None, 3, 1), line(43, 1, 2_000_000, 1, "R"), line(43, 2, 1_000_000, 1, "R"), line(43, 3, 0, 1, "R")]
    got, want = both(spark, tmp_path, "D15_category_pivot", lineitem=(rows, LINES))
    assert got == want and len(got) == 43
    # of several files the first by name counts, though Spark reads larger ones before it
    folder = tmp_path / "two" / "lineitem.parquet"
    for name, part in (("a", tied[1::2]), ("b", [*tied[::2], *(line(o, 7, 9, 1, "N") for o in range(1000, 9000))])):
        spark.createDataFrame(part, LINES).coalesce(1).write.parquet(str(tmp_path / name))
        folder.mkdir(parents=True, exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    firsts = {r.doc_id: r.a_first for r in QUERIES["D15_category_pivot"](spark, str(tmp_path / "two")).filter("doc_id < 100").collect()}
    assert firsts == {r[0]: r[2] for r in tied[1::2]}


def test_pieces_of_names_are_never_broadcast(spark):
    names = spark.createDataFrame([(f"Name#{k:09d}",) for k in range(50)], "a string")
    close = resolve.within_edits(names, names.withColumnRenamed("a", "b"), "a", "b", 0.7)
    assert "Broadcast" not in close._jdf.queryExecution().executedPlan().toString()
    distance = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    assert close.count() >= sum(distance(f"{i:02d}", f"{j:02d}") <= 2 for i in range(50) for j in range(50)) == 2500


def test_division_holds_owners_of_both_rarest_items_against_the_rest(spark):
    rng = random.Random(3)
    have = sorted({(s, p) for p in range(12) for s in range(40) if rng.random() < 0.15 + p / 15} - {(s, 3) for s in range(40)})
    need = [(g, p) for g in range(80) for p in rng.sample(range(12), 1 + g % 5)]
    h, n = spark.createDataFrame(have, "owner int, item int"), spark.createDataFrame(need, "g int, item int")
    owners, items = ({k: {x[1] for x in rows if x[0] == k} for k in {x[0] for x in rows}} for rows in ([(p, s) for s, p in have], need))
    want = {(g, s) for g, ps in items.items() for s in set.intersection(*(owners.get(p, set()) for p in ps))}
    got = list(map(tuple, audit.covering(h, n, ["g"], "owner", "item").collect()))
    assert set(got) == want and len(got) == len(want) > 50
    two = {(g, s) for g, ps in items.items() for s in set.intersection(*(owners.get(p, set()) for p in sorted(ps, key=lambda p: (len(owners.get(p, ())), p))[:2]))}
    asked = audit.of_two_rarest(h, audit.by_rarity(h, n, ["g"], "item"), ["g"], "owner", "item").collect()
    assert {(r.g, r.owner) for r in asked} == two and len(asked) == len(two)


def test_suggestions_hold_the_least_items_of_a_label_against_names(spark):
    rng = random.Random(5)
    labels = ["red ring", "red rod", "blue ring", "big blue rod", "7 bolt"]
    offered = [(k, rng.choice(labels)) for k in range(60)]
    capable = sorted({(k, rng.randrange(3)) for k in range(60) for _ in range(2)})
    missing, taken = [("red rinG", None), ("red rinG", 1), ("blue rad", 2), ("bolt", 0)], [(k,) for k in range(0, 60, 7)]
    frames = [spark.createDataFrame(r, s) for r, s in ((missing, "name string, need long"), (offered, "pin long, label string"), (capable, "pin long, need long"), (taken, "pin long"))]
    out = resolve.suggested(*frames, "name", "need", "pin", "label", 0.5, 3)
    got = {}
    for r in out.collect():
        got.setdefault((r.name, r.need), {})[r.rank] = r.pin
    for name, need in missing:
        score = {}
        for pin, label in offered:
            a, b = name.upper(), label.upper()
            shared = len({w for w in a.split() if not w.isdigit()} & {w for w in b.split() if not w.isdigit()})
            ratio = round(1 - edits(a, b) / max(len(a), len(b)), 6)
            if pin % 7 and (need is None or (pin, need) in capable) and (shared or ratio >= 0.5):
                score[pin] = round(shared + ratio, 3)
        assert got.get((name, need), {}) == dict(enumerate(sorted(score, key=lambda p: (-score[p], p))[:3], 1))
    assert "WindowGroupLimit [_label" in out._jdf.queryExecution().executedPlan().toString()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_pairs_of_a_sweep_are_reduced_where_they_meet(spark):
    left = spark.createDataFrame([(1, k, float(k), k) for k in range(40)], "g int, a int, x double, v int")
    right = spark.createDataFrame([(1, k, k * 1.5, k) for k in range(40)], "g int, b int, z double, u int").hint("merge")
    out = readings.swept(left, right, ["g"], "x", "z", 5, 2.0, "a", "b", F.col("v") > 0, F.col("v") == F.col("u"), F.col("u") < 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3  # two of the join, one of the scores
    assert out.filter("o = 0").first().pairs == sum(any(abs(i - 1.5 * j) <= 2 for j in range(40)) for i in range(40))


def test_metric_rows_shuffle_each_line_once_for_distinct_counts(spark, tmp_path):
    rows = [line(o, k, (o * k) % 3, k % 2, "ANR"[k % 3], quantity=float(5 * k)) for o in range(1, 6) for k in range(1, 8)]
    orders = [(o, "F", 10.0 * o) for o in range(1, 5)]
    got, want = both(spark, tmp_path, "D26_metric_row", lineitem=(rows, LINES), orders=(orders, "o_orderkey long, o_orderstatus string, o_totalprice double"))
    assert got == want and len(got) == 5
    plan = QUERIES["D26_metric_row"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "gid" not in plan
