"""Peeling, merging and reading of parts against plain folds and planted drawings."""

import random

from pyspark.sql import functions as F

from plumbline.operators import parts, readings


def clusters(values, tolerance):
    out = []
    for p, k in sorted(values):
        if out and p - out[-1][-1][0] <= tolerance:
            out[-1].append((p, k))
        else:
            out.append([(p, k)])
    return out


def plain_peel(boxes, tolerance, least, most=6):
    """{item: (round, side)} of one drawing."""
    left = dict(boxes)
    frame, out = None, {}
    box = [min(b[0] for b in left.values()), max(b[1] for b in left.values()), min(b[2] for b in left.values()), max(b[3] for b in left.values())]
    for turn in range(1, most + 1):
        if not left:
            break
        best = [{k for _, k in max(clusters([(b[c], k) for k, b in left.items()], tolerance[c > 1]), key=len)} for c in range(4)]
        l, r, t, b = best
        if l == r:
            r = set()
        elif len(r) >= len(l):
            l = l - r
        else:
            r = r - l
        row = b if len(b) > len(t) else t
        if len(row) > len(l) + len(r):
            if len(row) < least:
                break
            f = frame or box
            side = "T" if sum(left[k][2] for k in row) / len(row) < (f[2] + f[3]) / 2 else "B"
            used = {k: side for k in row}
            edges = [min(left[k][0] for k in row), max(left[k][1] for k in row)]
        else:
            if len(l) + len(r) < least:
                break
            used = {k: "L" for k in l} | {k: "R" for k in r}
            edges = [min(left[k][0] for k in (l or r)), max(left[k][1] for k in (r or l))]
        edges += [min(left[k][2] for k in used), max(left[k][3] for k in used)]
        frame = edges if frame is None else [min(frame[0], edges[0]), max(frame[1], edges[1]), min(frame[2], edges[2]), max(frame[3], edges[3])]
        out |= {k: (turn, s) for k, s in used.items()}
        left = {k: v for k, v in left.items() if k not in used}
    return out


def test_peeling_equals_a_plain_loop(spark):
    rng = random.Random(7)
    drawings = {}
    for d in range(25):
        n = rng.randint(1, 40)
        own = {k: (x := rng.choice([0, 10, 30, 50]) + rng.choice([0, 0, 0.4]), x + rng.randint(1, 6), y := rng.randint(0, 15) * 4.0, y + rng.choice([1, 1, 3])) for k in range(n)}
        drawings[d] = {k: (*b[2:], *b[:2]) if d % 2 else b for k, b in own.items()}
    rows = [(d, k, *map(float, b)) for d, own in drawings.items() for k, b in own.items()]
    got = parts.peeled(spark.createDataFrame(rows, "d int, k int, x0 double, x1 double, y0 double, y1 double"), ["d"], "k", (1.0, 1.0), 3).collect()
    want = {(d, k): v for d, own in drawings.items() for k, v in plain_peel(own, (1.0, 1.0), 3).items()}
    assert {(r.d, r.k): (r["round"], r.side) for r in got} == want and len(got) == len(want)
    assert {s for _, s in want.values()} == {"L", "R", "T", "B"} and max(t for t, _ in want.values()) > 3


def test_the_four_sides_of_a_drawing(spark):
    """Names down both sides of one box, and along its top and bottom; the bottom is told by the frame, not by what is left."""
    rows = [("L", 10, 10 + 2 * (k % 3 + 1), 100 + 4 * k, 103 + 4 * k) for k in range(12)] + [("R", 96 - 2 * (k % 3), 100, 100 + 4 * k, 103 + 4 * k) for k in range(12)]
    rows += [("T", 20 + 7 * k, 22 + 7 * k, 90, 90 + 3 * (k % 3 + 1)) for k in range(10)] + [("B", 20 + 7 * k, 22 + 7 * k, 160 - 3 * (k % 3), 165) for k in range(9)]
    df = spark.createDataFrame([(1, i, r[0], *map(float, r[1:])) for i, r in enumerate(rows)], "d int, i int, want string, x0 double, x1 double, y0 double, y1 double")
    got = parts.peeled(df, ["d"], "i", (1.0, 1.0), 5).collect()
    assert {r.i: r.side for r in got} == {i: r[0] for i, r in enumerate(rows)}
    assert {r.side: r["round"] for r in got} == {"L": 1, "R": 1, "T": 2, "B": 3}
    assert parts.peeled(df.limit(0), ["d"], "i", (1.0, 1.0), 5).count() == 0


def merged(spark, rows):
    df = spark.createDataFrame(rows, "d string, k int, pins array<int>, pitch double, page int, x0 double, x1 double, y0 double, y1 double, upright boolean")
    out = parts.merged(df, "d", [F.desc(F.size("pins")), F.col("k")], "k", "pins", "pitch", "page", "upright")
    return {r.k: r.accepted for r in out.collect()}


def test_parts_of_one_whole(spark):
    first = ("s", 1, list(range(40)), 4.0, 1, 0.0, 50.0, 0.0, 100.0, True)
    far = (1, 500.0, 550.0, 500.0, 600.0, True)
    rows = [
        first,
        ("s", 2, list(range(100, 114)), 4.1, 2, 0.0, 9.0, 0.0, 9.0, True),  # large, on another page
        ("s", 3, list(range(200, 211)), 4.0, *far),  # small and far
        ("s", 4, list(range(300, 310)), 4.0, 1, 57.0, 90.0, 200.0, 300.0, True),  # near along one axis only
        ("s", 5, list(range(400, 409)), 4.0, 1, 10.0, 40.0, 107.5, 120.0, False),  # touches below
        ("s", 6, [*range(500, 508), 5], 4.0, 1, 10.0, 40.0, 101.0, 107.0, False),  # has a pin of the first
        ("s", 7, list(range(600, 607)), 4.5, 1, 10.0, 40.0, 101.0, 107.0, False),  # another pitch
        ("s", 8, list(range(700, 706)), 4.0, 1, 95.0, 120.0, 60.0, 90.0, True),  # beside: its whole span overlaps
        ("s", 9, list(range(800, 805)), 4.0, 2, 20.0, 30.0, 7.0, 30.0, True),  # beside the second on page 2, by less than half; adjacent by reach
        ("s", 10, [], 4.0, 1, 0.0, 50.0, 0.0, 100.0, True),
        ("s", 11, [901, 300], 4.0, 1, 10.0, 40.0, 108.0, 120.0, False),  # its pin is of a part that was refused
    ]
    assert merged(spark, rows) == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 9: False, 10: False, 11: True}
    assert merged(spark, [("t", 1, [], 4.0, 1, 0.0, 1.0, 0.0, 1.0, True)]) == {1: True}


def drawn(spark, views, clicks):
    """Best reading, from rows (part, side, id, position, value) and items (id, position, value)."""
    rows = spark.createDataFrame([("d", *map(float, v[:1]), *v[1:]) for v in views], "d string, part double, side int, b int, bp double, ry double")
    items = spark.createDataFrame([("d", *c) for c in clicks], "d string, a int, h double, y double")
    turned = readings.both_readings(rows, ["d"], "part", "bp", "side")
    items = items.join(turned.select("d", "reading").distinct(), "d")
    scores = readings.swept(items, turned, ["d", "reading"], "h", "bp", 8, 1.0, "a", "b", F.col("a") > 0, F.col("y") == F.col("ry"), F.col("b") < 0)
    best = readings.best_shift(scores, ["d", "reading"])
    return {r.reading: (r.o, r.sat, r.chk) for r in best.collect()}, readings.arbitrated(best, ["d"]).first()


def test_a_part_is_turned_only_if_that_fits_strictly_better(spark):
    views = [(1, 0, k, 10.0 * k, float(k)) for k in range(6)]
    mirrored = [(k + 1, 50.0 - 10.0 * k + 2, float(k)) for k in range(6)]
    best, won = drawn(spark, views, mirrored)
    assert won.reading == 1 and best[1] == (-1, 6, 6) and best[0][1] < 6
    upright = [(k + 1, 10.0 * k - 3, float(k)) for k in range(6)]
    assert drawn(spark, views, upright)[1].reading == 0
    # a tie: values that are the same both ways round
    even = [(1, 0, k, 10.0 * k, float(min(k, 5 - k))) for k in range(6)]
    best, won = drawn(spark, even, [(k + 1, 10.0 * k, float(min(k, 5 - k))) for k in range(6)])
    assert best[0] == best[1] == (0, 6, 6) and won.reading == 0


def test_only_parts_with_one_side_have_a_second_reading(spark):
    both = [(1, k % 2, k, 10.0 * k, float(k)) for k in range(4)]
    best, won = drawn(spark, both, [(k + 1, 10.0 * k, float(k)) for k in range(4)])
    assert set(best) == {0} and won.sat == 4
    # the second part turns in itself, the first stays
    mixed = both + [(2, 1, 10 + k, 100.0 + 10.0 * k, 10.0 + k) for k in range(5)]
    items = [(k + 1, 10.0 * k, float(k)) for k in range(4)] + [(20 + k, 140.0 - 10.0 * k, 10.0 + k) for k in range(5)]
    best, won = drawn(spark, mixed, items)
    assert won.reading == 1 and best[1] == (0, 9, 9) and best[0][1] == 5


def test_hypotheses_that_check_nothing_are_dropped(spark):
    rows = [(1, "b", 3, 4), (1, "a", 6, 8), (1, "c", 6, 8), (1, "none", 0, 0), (1, "all", 1, 1), (1, "nil", 0, 9)]
    got = readings.ranked_fits(spark.createDataFrame(rows, "d int, hyp string, sat int, chk int"), ["d"], "hyp").orderBy("rank").collect()
    assert [r.hyp for r in got] == ["all", "a", "c", "b", "nil"]


def test_a_task_of_peeling_takes_a_set_number_of_rows(spark):
    rows = spark.range(3000).selectExpr("id % 300 d", "id k", "0.5 * (id % 7) x0", "1D + id % 5 x1", "3D * id y0", "3D * id + 1 y1")
    few = parts.dealt_by(rows, ["d"], 100)
    assert few.rdd.getNumPartitions() == 30 and parts.dealt_by(rows, ["d"], 10_000).rdd.getNumPartitions() == 4
    assert {r.n for r in few.withColumn("p", F.spark_partition_id()).groupBy("d").agg(F.count_distinct("p").alias("n")).collect()} == {1}
    peel = lambda n: sorted(map(tuple, parts.peeled(rows, ["d"], "k", (1.0, 1.0), 2, rows=n).select("d", "k", "round", "side").collect()))
    assert peel(100) == peel(10_000) != []
