"""Similarity joins against all pairs, and how many pairs they look at."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plumbline.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def generated(n, seed, low=1, high=14, letters="etaoinshrdlucm"):
    rng = random.Random(seed)
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    for x in rng.sample(sorted(names), n // 4):  # near ones
        i = rng.randrange(len(x))
        names.add(rng.choice([x[:i] + x[i + 1 :], x[:i] + "z" + x[i + 1 :], x[:i] + "q" + x[i:], x[i:] + x[:i]]))
    return sorted(names - {""})


@pytest.mark.parametrize("least", [0.34, 0.6, 0.9])
def test_no_close_name_is_missing(spark, least):
    one, two = generated(90, 1), generated(90, 2) + generated(90, 1)[:40]
    left = spark.createDataFrame([(x, "k") for x in [*one, "", None]], "a string, extra string")
    right = spark.createDataFrame([(x, "k") for x in [*two, *two[:5], "", None]], "b string, extra string")
    got = {tuple(r) for r in resolve.within_edits(left, right, "a", "b", least).collect()}
    want = {(x, y) for x in one for y in set(two) if 1 - edits(x, y) / max(len(x), len(y)) >= least - 1e-12}
    assert want <= got and want
    n = 400
    listed = {(r.a, r.b, r["rank"]) for r in resolve.close_names(left, right, "a", "b", least, n).select("a", "b", "rank").collect()}
    assert {(x, y) for x, y, _ in listed} == {(x, y) for x, y in want if round(1 - edits(x, y) / max(len(x), len(y)), 6) >= least}


def test_names_meet_within_their_block_only(spark):
    rows = [(d, x) for d, x in ((1, "alpha"), (1, "alphb"), (2, "alphc"), (2, "beta"))]
    left, right = (spark.createDataFrame(rows, f"doc int, {c} string") for c in "ab")
    got = {tuple(r) for r in resolve.close_names(left, right, "a", "b", 0.8, 3, ["doc"]).select("doc", "a", "b").collect()}
    assert got == {(1, "alpha", "alpha"), (1, "alpha", "alphb"), (1, "alphb", "alpha"), (1, "alphb", "alphb"), (2, "alphc", "alphc"), (2, "beta", "beta")}


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_no_alike_name_is_missing(spark, least):
    one, two = generated(80, 3), generated(80, 4) + generated(80, 3)[:30]
    left, right = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c, names in (("a", one), ("b", two)))
    got = {tuple(r) for r in resolve.sharing_letters(left, right, "a", "b", least).collect()}
    want = {(x, y) for x in one for y in set(two) if SequenceMatcher(None, x, y, autojunk=False).ratio() >= least}
    assert want <= got and want


def test_few_of_all_pairs_are_looked_at(spark):
    """5,000 names: the pairs that the segment index lets meet, and those whose ratio is taken."""
    names = generated(4000, 5, 6, 16, "etaoinshrdlucmfwypvbgk")[:5000]
    left, right = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c in "ab")
    every = len(names) ** 2
    assert every > 2e7
    assert resolve.within_edits(left, right, "a", "b", 0.6).count() < 0.05 * every
    few = spark.createDataFrame([(x,) for x in names[::4]], "a string"), spark.createDataFrame([(x,) for x in names[::4]], "b string")
    assert resolve.sharing_letters(*few, "a", "b", 0.6).count() < 0.2 * every / 16


def test_ids_that_differ_in_a_digit_do_not_all_meet(spark):
    ids = [f"CUSTOMER#{k:09d}" for k in range(0, 40_000, 7)]
    left, right = (spark.createDataFrame([(x,) for x in ids], f"{c} string") for c in "ab")
    pairs = resolve.within_edits(left, right, "a", "b", 0.9)
    assert pairs.count() < 40 * len(ids)
    known = set(ids)
    near = sum(x[:i] + d + x[i + 1 :] in known for x in ids for i in range(9, 18) for d in "0123456789" if d != x[i])
    assert pairs.filter(F.levenshtein("a", "b") <= 1).count() == near + len(ids)


def test_suggestions(spark):
    missing = spark.createDataFrame([("LED_STRIP", None), ("ADC_CURR", "adc"), ("MOTOR6", "timer"), ("NOTHING_LIKE", None)], "fn string, need string")
    offered = spark.createDataFrame([("PA1", "LED_TRIP"), ("PA2", "CURR_DET"), ("PA3", "curr-sense"), ("PA4", "LED_STRIP"), ("PB1", "MOTOR5"), ("PB2", "MOTOR_6"), ("PC1", "ADC_CURR"), ("PC2", "42"), ("PC3", None)], "pin string, net string")
    capable = spark.createDataFrame([("PA2", "adc"), ("PA3", "adc"), ("PB1", "timer"), ("PC1", "timer")], "pin string, need string")
    taken = spark.createDataFrame([("PA4",)], "pin string")
    got = resolve.suggested(missing, offered, capable, taken, "fn", "need", "pin", "net", 0.5, 2).orderBy("fn", "rank").collect()
    assert [(r.fn, r.pin, r["rank"]) for r in got] == [("ADC_CURR", "PA2", 1), ("ADC_CURR", "PA3", 2), ("LED_STRIP", "PA1", 1), ("MOTOR6", "PB1", 1)]
    assert {r.fn: r.score for r in got if r["rank"] == 1} == {"ADC_CURR": 1.0, "LED_STRIP": 1.889, "MOTOR6": 0.833}


def test_ids_are_checked_and_never_lost(spark):
    ids = spark.createDataFrame([(1, "ABCD"), (2, ""), (3, None), (4, "a?"), (5, "ABCE"), (6, "ZZZZ"), (7, "RSVD")], "k int, id string")
    registry = spark.createDataFrame([("ABCD", False), ("ABCF", False), ("RSVD", True)], "id string, reserved boolean")
    got = {r.k: (r.status, r.reserved, r.near) for r in resolve.checked_ids(ids, registry, "id", "reserved", "^[A-Z]+$", 0.7, 3).collect()}
    assert got == {1: ("ok", False, None), 2: ("empty", False, None), 3: ("empty", False, None), 4: ("malformed", False, None), 5: ("unregistered", False, "ABCD,ABCF"), 6: ("unregistered", False, None), 7: ("ok", True, None)}


def test_tokens_are_served_in_order(spark):
    """Rounds over all groups end in what serving the tokens one after the other gives."""
    rng = random.Random(11)
    rows, want = [], set()
    for g in range(12):
        taken = set()
        for t in range(25):
            own = rng.sample([f"d{k}" for k in range(18)], rng.randint(0, 6))
            rows += [(g, f"t{t:02d}", d, k) for k, d in enumerate(own, 1)]
            pick = next((d for d in own if d not in taken), None)
            if pick:
                taken.add(pick)
                want.add((g, f"t{t:02d}", pick))
    rng.shuffle(rows)
    options = spark.createDataFrame(rows, "g int, token string, driver string, rank int")
    assert {tuple(r) for r in resolve.served_in_order(options, ["g"], "token", "driver").collect()} == want
    # a chain: each refusal pushes the next token on
    chain = [(f"t{k}", f"d{j}", j + 1) for k in range(6) for j in range(6)]
    got = resolve.served_in_order(spark.createDataFrame(chain, "token string, driver string, rank int"), [], "token", "driver")
    assert {tuple(r) for r in got.collect()} == {(f"t{k}", f"d{k}") for k in range(6)}
    assert resolve.served_in_order(options.limit(0), ["g"], "token", "driver").count() == 0


def test_containing_names_lose_no_pair(spark):
    rng = random.Random(12)
    names = {(b, "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))) for b in (1, 2) for _ in range(60)}
    got = resolve.containing(spark.createDataFrame(sorted(names), "b int, n string"), "b", "n").collect()
    assert sorted((r.b, r.n, r["_host"]) for r in got) == sorted((b, x, y) for b, x in names for c, y in names if b == c and len(y) > len(x) and x in y)
    long = spark.createDataFrame([(1, "x" * 5000 + "tail"), (1, "tail"), (1, "xx")], "b int, n string")
    assert resolve.containing(long, "b", "n").count() == 2


def test_votes_and_sub_index(spark):
    rows = [(1, "gyro", "a", 1, 2), (1, "gyro", "b", 2, 1), (1, "gyro", "b", 3, 1), (1, "osd", "a", 4, 2), (2, "gyro", "a", 1, None), (2, "osd", "b", 2, None), (3, "osd", "a", 1, 7), (3, "osd", "a", 2, None)]
    df = spark.createDataFrame(rows, "g int, kind string, token string, t int, idx int")
    from plumbline.operators import ordered

    got = {r.g: (r.winner, r.votes, r.idx) for r in ordered.voted(df, ["g"], "kind", "token", "idx", ["t"], 2).collect()}
    assert got == {1: ("gyro", 2, 2), 2: (None, None, None), 3: (None, None, 7)}  # 2 is stated as often as 1, and first
