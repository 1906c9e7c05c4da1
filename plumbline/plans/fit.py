"""Queries that score readings against each other, decide between them and share out what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit, near, ordered, parts, readings
from .layout import SWEEP, aligned, sides
from .views import Views, query

KEY = ["pin", "signal"]
ANCHORED = """, p AS (SELECT a.doc_id, a.word_id, a.text, a.y, b.word_id anchor, b.y vy, abs(a.h - b.h) d FROM pts a JOIN pts b ON a.doc_id = b.doc_id AND a.text <> 'view' AND b.text = 'view' AND abs(a.h - b.h) <= 12),
r AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY d, anchor) r FROM p), k AS (SELECT * FROM r WHERE r = 1) """


def anchored(v: Views) -> DataFrame:
    """Every event that is no view, with the nearest view of its user, if one lies within 12 hours."""
    items = v.P.filter("text <> 'view'").select("doc_id", "word_id", "text", "h", "y")
    views = v.P.filter("text = 'view'").select("doc_id", F.col("word_id").alias("anchor"), F.col("h").alias("bh"), F.col("y").alias("by"))
    return near.nearest_within(items, views, ["doc_id"], "h", "bh", 12.0, ["word_id"], ["anchor"])


@query("C11_nearest_anchor", ANCHORED + "SELECT doc_id, word_id, anchor, round(d, 6) distance FROM k")
def c11(v: Views) -> DataFrame:
    return anchored(v).select("doc_id", "word_id", "anchor", F.round("distance", 6).alias("distance"))


@query("E2_claim_per_row", ANCHORED + """, o AS (SELECT *, row_number() OVER w n, first_value(text) OVER w won FROM k WINDOW w AS (PARTITION BY anchor ORDER BY text <> 'click', round_even(d, 0), abs(y - vy), word_id))
SELECT word_id, anchor, CASE WHEN n = 1 THEN 'link' WHEN text = won THEN 'echo' ELSE 'orphan' END state FROM o""")
def e2(v: Views) -> DataFrame:
    """One item for each anchor: vocabulary first, then the rounded distance, then the alignment; losers are echoes or orphans."""
    w = Window.partitionBy("anchor").orderBy(F.col("text") != "click", F.bround("distance", 0), F.abs(F.col("y") - F.col("by")), "word_id")
    rows = anchored(v).withColumn("n", F.row_number().over(w)).withColumn("won", F.first("text").over(w))
    return rows.select("word_id", "anchor", F.when(F.col("n") == 1, "link").when(F.col("text") == F.col("won"), "echo").otherwise("orphan").alias("state"))


@query("C27_shared_evidence", """, c AS (SELECT c.word_id a, p.word_id p FROM pts c JOIN pts p ON c.doc_id = p.doc_id AND c.text = 'click' AND p.text = 'purchase' AND abs(c.h - p.h) <= 12),
w AS (SELECT w.word_id b, p.word_id p FROM pts w JOIN pts p ON w.doc_id = p.doc_id AND w.text = 'view' AND p.text = 'purchase' AND abs(w.h - p.h) <= 12)
SELECT a, count(DISTINCT b) links, CASE WHEN count(DISTINCT b) = 1 THEN min(b) END link FROM c JOIN w ON c.p = w.p GROUP BY a""")
def c27(v: Views) -> DataFrame:
    """Clicks and views that lie near the same purchase; exactly one such view decides."""
    pairs = lambda text, to: near.band_join(*sides(v, text, "purchase"), ["doc_id"], "h", "bh", 12.0).select(F.col("a").alias(to), F.col("b").alias("p"))
    one, two = pairs("click", "a"), pairs("view", "w")
    rows = one.join(two, "p").groupBy("a").agg(F.countDistinct("w").alias("links"), F.min("w").alias("w"))
    return rows.select("a", "links", F.when(F.col("links") == 1, F.col("w")).alias("link"))


@query("E3_runner_up_ratio", """, p AS (SELECT a.word_id a, b.word_id b, abs(a.h - b.h) d FROM pts a JOIN pts b ON a.doc_id = b.doc_id AND a.text = 'click' AND b.text = 'purchase' AND abs(a.h - b.h) <= 48),
r AS (SELECT *, row_number() OVER w r, lead(d) OVER w nxt FROM p WINDOW w AS (PARTITION BY a ORDER BY d, b)) SELECT a, b, nxt IS NULL OR nxt >= 3 * d decided FROM r WHERE r = 1""")
def e3(v: Views) -> DataFrame:
    pairs = near.band_join(*sides(v, "click", "purchase"), ["doc_id"], "h", "bh", 48.0).withColumn("distance", F.abs(F.col("h") - F.col("bh")))
    return ordered.runner_up(pairs, ["a"], "distance", "b", 3.0).select("a", "b", "decided")


@query("D4_alignment_score", SWEEP + "SELECT doc_id, axis, CAST(o AS INTEGER) o, pairs, chk, sat, chk - sat unsat, reserved FROM s")
def d4(v: Views) -> DataFrame:
    """Pairs, claims, claims that agree or don't, and reserved rows, for every shift."""
    return aligned(v).withColumn("unsat", F.col("chk") - F.col("sat"))


FITS = """, o AS (SELECT unnest(range(-18, 19)) o), w AS (SELECT doc_id, text hyp, word_id b, h, y, floor(h / 84) part, word_id % 4 < 3 side FROM pts WHERE text <> 'click'), g AS (SELECT *, min(side) OVER p = max(side) OVER p one, min(h) OVER p + max(h) OVER p - h turned FROM w WINDOW p AS (PARTITION BY doc_id, hyp, part)),
f AS (SELECT *, max(one) OVER (PARTITION BY doc_id, hyp) flips FROM g), rd AS (SELECT doc_id, hyp, b, y, 0 reading, h bp FROM f UNION ALL SELECT doc_id, hyp, b, y, 1, CASE WHEN one THEN turned ELSE h END FROM f WHERE flips),
c AS (SELECT rd.doc_id, hyp, reading, o, word_id a, b, pts.y, rd.y ry, abs(pts.h + o - bp) d FROM pts JOIN rd ON rd.doc_id = pts.doc_id AND pts.text = 'click' AND abs(pts.h - bp) <= 24 CROSS JOIN o WHERE abs(pts.h + o - bp) <= 6),
n AS (SELECT *, row_number() OVER (PARTITION BY hyp, reading, o, a ORDER BY d, b) r FROM c),
s AS (SELECT doc_id, hyp, reading, o, count(*) pairs, count(*) FILTER (a % 3 <> 0) chk, count(*) FILTER (a % 3 <> 0 AND abs(y - ry) <= 30) sat, count(*) FILTER (b % 5 = 0) reserved FROM n WHERE r = 1 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hyp, reading ORDER BY sat DESC, chk - sat, reserved, pairs DESC, abs(o), o) q FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hyp ORDER BY sat DESC, sat - chk DESC, reading) best FROM t WHERE q = 1) """


def fits(v: Views) -> DataFrame:
    """For each user and hypothesis (which kind of event clicks go with) the reading that fits better, at its best shift.

    The rows of a hypothesis are the events of its kind; a part of them are those of half a week. A part is one-sided if
    all of its ids, or none, leave 3 when divided by 4; its order may be turned. Each reading has a sweep of its own.
    """
    rows = v.P.filter("text <> 'click'").select("doc_id", F.col("text").alias("hyp"), F.col("word_id").alias("b"), F.col("h").alias("bp"), F.col("y").alias("ry"), F.floor(F.col("h") / 84).alias("part"), (F.col("word_id") % 4 < 3).cast("int").alias("side"))
    turned = readings.both_readings(rows, ["doc_id", "hyp"], "part", "bp", "side").drop("part", "side")
    clicks = v.P.filter("text = 'click'").select("doc_id", F.col("word_id").alias("a"), "h", "y")
    # a click is held against every reading of its user's rows: the readings are in the group, and the join is by user
    clicks = clicks.join(turned.select("doc_id", "hyp", "reading").distinct(), "doc_id")
    scores = readings.swept(clicks, turned, ["doc_id", "hyp", "reading"], "h", "bp", 18, 6.0, "a", "b", F.col("a") % 3 != 0, F.abs(F.col("y") - F.col("ry")) <= 30, F.col("b") % 5 == 0)
    return readings.arbitrated(readings.best_shift(scores, ["doc_id", "hyp", "reading"]), ["doc_id", "hyp"])


@query("F5_candidate_fit", FITS + "SELECT doc_id, hyp, reading, CAST(o AS INTEGER) o, sat, chk, row_number() OVER (PARTITION BY doc_id ORDER BY sat::DOUBLE / chk DESC, chk DESC, hyp) rank FROM k WHERE best = 1 AND chk > 0")
def f5(v: Views) -> DataFrame:
    """Hypotheses ranked by what they explain, each by the better of its readings."""
    return readings.ranked_fits(fits(v), ["doc_id"], "hyp").select("doc_id", "hyp", "reading", "o", "sat", "chk", "rank")


@query("I8_two_readings", FITS + "SELECT doc_id, hyp, reading, CAST(o AS INTEGER) o, sat, chk FROM k WHERE best = 1")
def i8(v: Views) -> DataFrame:
    """Whether a user's one-sided parts are better read the other way round, for each kind of event."""
    return fits(v).select("doc_id", "hyp", "reading", "o", "sat", "chk")


TOLERANCE, LEAST = (4.0, 2.0), 3


def _peel_sql() -> str:
    """Six rounds as the operator has them: r items left, v flags, u their sums, t what is taken, f the frame."""
    out = ", r1 AS (SELECT doc_id, word_id, h x0, h + length(text) x1, y y0, y + length(text) y1 FROM pts), f1 AS (SELECT doc_id, min(x0) fx0, max(x1) fx1, min(y0) fy0, max(y1) fy1 FROM r1 GROUP BY doc_id)"
    for k in range(1, 7):
        anchors = " UNION ALL ".join(f"SELECT doc_id, word_id, '{c}' anchor, {c} / {TOLERANCE[c[0] == 'y']} p FROM r{k}" for c in ("x0", "x1", "y0", "y1"))
        flags = ", ".join(f"coalesce(bool_or(b.anchor = '{c}'), false) {n}" for c, n in (("x0", "l"), ("x1", "rr"), ("y0", "t"), ("y1", "b")))
        grown = ", ".join(f"{'least' if c.endswith('0') else 'greatest'}(f{c}, e{c}) f{c}" if k > 1 else f"e{c} f{c}" for c in ("x0", "x1", "y0", "y1"))
        out += f""",
a{k} AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, anchor ORDER BY p, word_id) > 1 THEN 1 ELSE 0 END n FROM ({anchors})), c{k} AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, anchor ORDER BY p, word_id) c FROM a{k}),
b{k} AS (SELECT * FROM (SELECT doc_id, anchor, c, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY count(*) DESC, c) q FROM c{k} GROUP BY doc_id, anchor, c) WHERE q = 1),
v{k} AS (SELECT r.doc_id, r.word_id, any_value(r.x0) x0, any_value(r.x1) x1, any_value(r.y0) y0, any_value(r.y1) y1, {flags} FROM r{k} r LEFT JOIN (SELECT c.* FROM c{k} c JOIN b{k} b ON b.doc_id = c.doc_id AND b.anchor = c.anchor AND b.c = c.c) b ON b.doc_id = r.doc_id AND b.word_id = r.word_id GROUP BY r.doc_id, r.word_id),
u{k} AS (SELECT *, nl = nlr AND nr = nlr same, NOT (nl = nlr AND nr = nlr) AND nr >= nl to_right, CASE WHEN nl = nlr AND nr = nlr THEN nl ELSE nl + nr - nlr END cols FROM (SELECT doc_id, count(*) FILTER (l) nl, count(*) FILTER (rr) nr, count(*) FILTER (l AND rr) nlr, count(*) FILTER (t) nt, count(*) FILTER (b) nb FROM v{k} GROUP BY doc_id)),
s{k} AS (SELECT v.*, CASE WHEN greatest(nt, nb) > cols THEN CASE WHEN CASE WHEN nb > nt THEN b ELSE t END THEN 'H' END WHEN l AND NOT (rr AND to_right) THEN 'L' WHEN rr AND NOT same AND NOT (l AND NOT to_right) THEN 'R' END side FROM v{k} v JOIN u{k} u ON u.doc_id = v.doc_id WHERE greatest(nt, nb, cols) >= {LEAST}),
e{k} AS (SELECT doc_id, coalesce(min(x0) FILTER (side <> 'R'), min(x0)) ex0, coalesce(max(x1) FILTER (side <> 'L'), max(x1)) ex1, min(y0) ey0, max(y1) ey1, avg(y0) mid FROM s{k} WHERE side IS NOT NULL GROUP BY doc_id),
t{k} AS (SELECT s.doc_id, s.word_id, {k} "round", CASE WHEN side = 'H' THEN CASE WHEN mid < (fy0 + fy1) / 2 THEN 'T' ELSE 'B' END ELSE side END side, s.x0, s.y1 FROM s{k} s JOIN e{k} e ON e.doc_id = s.doc_id JOIN f{k} f ON f.doc_id = s.doc_id WHERE side IS NOT NULL),
f{k + 1} AS (SELECT f.doc_id, {grown} FROM f{k} f JOIN e{k} e ON e.doc_id = f.doc_id), r{k + 1} AS (SELECT doc_id, word_id, x0, x1, y0, y1 FROM s{k} WHERE side IS NULL)"""
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, 7))
    return f'{out} SELECT doc_id, CAST("round" AS INTEGER) "round", side, count(*) n, round(min(x0), 4) x0, round(max(y1), 4) y1 FROM ({every}) GROUP BY doc_id, "round", side'


@query("F6_iterated_peel", _peel_sql())
def f6(v: Views) -> DataFrame:
    """The edges of a user's events, drawn as boxes as wide as their names: up to six rounds, strongest first, along all four sides."""
    boxes = v.P.select("doc_id", "word_id", F.col("h").alias("x0"), (F.col("h") + F.length("text")).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.length("text")).alias("y1"))
    out = parts.peeled(boxes, ["doc_id"], "word_id", TOLERANCE, LEAST)
    return out.groupBy("doc_id", "round", "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x0"), 4).alias("x0"), F.round(F.max("y1"), 4).alias("y1"))


@query("D20_straddling_pair", """, i AS (SELECT c.doc_id, c.word_id, c.h, c.y, p.y val, row_number() OVER (PARTITION BY c.word_id ORDER BY abs(c.h - p.h) + abs(c.y - p.y), p.word_id) r FROM pts c JOIN pts p ON p.doc_id = c.doc_id AND c.text = 'click' AND p.text = 'purchase' AND abs(c.h - p.h) + abs(c.y - p.y) <= 60),
p AS (SELECT s.word_id node, CAST(round_even(i.y / 25, 0) AS BIGINT) leg, i.h - s.h dx, i.val FROM pts s JOIN i ON s.doc_id = i.doc_id AND s.text = 'signup' AND abs(s.h - i.h) <= 72 WHERE i.r = 1),
g AS (SELECT node, leg, min(dx) lo, max(dx) hi, arg_min(val, dx) lo_val, arg_max(val, dx) hi_val FROM p GROUP BY ALL HAVING count(*) = 2 AND min(dx) < 0 AND max(dx) > 0)
SELECT node, min(leg) leg, round(-min(lo) / (max(hi) - min(lo)), 6) ratio, min(lo_val) <= min(hi_val) upright FROM g GROUP BY node HAVING count(*) = 1""")
def d20(v: Views) -> DataFrame:
    """Signups that divide a leg: exactly one leg of items with exactly two, one on either side; the ratio, and whether the
    values rise. An item is a click with its nearest purchase (Manhattan distance)."""
    clicks = v.P.filter("text = 'click'").select("doc_id", "word_id", "h", "y")
    values = v.P.filter("text = 'purchase'").select("doc_id", F.col("word_id").alias("value_id"), F.col("h").alias("ph"), F.col("y").alias("val"))
    apart = F.abs(F.col("h") - F.col("ph")) + F.abs(F.col("y") - F.col("val"))
    dealt = near.nearest(near.band_join(clicks, values, ["doc_id"], "h", "ph", 60.0).filter(apart <= 60), ["word_id"], apart, ["value_id"])
    items = dealt.select("doc_id", F.bround(F.col("y") / 25, 0).cast("long").alias("leg"), F.col("h").alias("bh"), "val")
    nodes = v.P.filter("text = 'signup'").select("doc_id", F.col("word_id").alias("node"), "h")
    dx = F.col("bh") - F.col("h")
    legs = near.band_join(nodes, items, ["doc_id"], "h", "bh", 72.0).groupBy("node", "leg").agg(F.count(F.lit(1)).alias("n"), F.min(dx).alias("lo"), F.max(dx).alias("hi"), F.min_by("val", dx).alias("lo_val"), F.max_by("val", dx).alias("hi_val")).filter("n = 2 AND lo < 0 AND hi > 0")
    one = legs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("leg").alias("leg"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.min("lo_val") <= F.min("hi_val")).alias("upright")).filter("n = 1")
    return one.select("node", "leg", F.round(-F.col("lo") / (F.col("hi") - F.col("lo")), 6).alias("ratio"), "upright")


@query("D7_role_resolution", """, cap AS (SELECT DISTINCT pin, dev, net FROM boards WHERE qty <= 40), k AS (SELECT pin, dev, count(*) n, min(net) sole FROM cap GROUP BY pin, dev), l AS (SELECT DISTINCT doc_id, dev, pin, net label FROM boards),
r AS (SELECT l.*, CASE WHEN k.n = 1 THEN sole WHEN c.pin IS NOT NULL THEN label END role, k.n = 1 AND sole <> label mislabelled FROM l LEFT JOIN k ON k.pin = l.pin AND k.dev = l.dev LEFT JOIN cap c ON c.pin = l.pin AND c.dev = l.dev AND c.net = l.label),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dev, role ORDER BY label, pin) r, min(pin) OVER (PARTITION BY doc_id, dev, role) lo, max(pin) OVER (PARTITION BY doc_id, dev, role) hi FROM r)
SELECT doc_id, dev, pin, label, role, CASE WHEN role IS NULL THEN 'no role' WHEN r > 1 AND lo <> hi THEN 'claimed twice' WHEN mislabelled THEN 'mislabelled' END note FROM o""")
def d7(v: Views) -> DataFrame:
    """The role of a part at a supplier within an order: the capability's only one whatever the line says, else the line's own if the capability has it."""
    cap = v.B.filter("qty <= 40").select("pin", "dev", "net").distinct()
    only = cap.groupBy("pin", "dev").agg(F.count(F.lit(1)).alias("n"), F.min("net").alias("only"))
    lines = v.B.select("doc_id", "dev", "pin", F.col("net").alias("label")).distinct()
    rows = lines.join(only, ["pin", "dev"], "left").join(cap.select("pin", "dev", F.col("net").alias("label"), F.lit(True).alias("has")), ["pin", "dev", "label"], "left")
    rows = rows.withColumn("role", F.when(F.col("n") == 1, F.col("only")).when(F.col("has"), F.col("label")))
    same = Window.partitionBy("doc_id", "dev", "role")
    rows = rows.withColumn("r", F.row_number().over(same.orderBy("label", "pin"))).withColumn("lo", F.min("pin").over(same)).withColumn("hi", F.max("pin").over(same))
    note = F.when(F.col("role").isNull(), "no role").when(F.expr("r > 1 AND lo <> hi"), "claimed twice").when((F.col("n") == 1) & (F.col("only") != F.col("label")), "mislabelled")
    return rows.select("doc_id", "dev", "pin", "label", "role", note.alias("note"))


@query("I4_shared_plan", """, b AS (SELECT DISTINCT doc_id, pin FROM boards), m AS (SELECT doc_id, count(*) want FROM b GROUP BY 1), c AS (SELECT b.doc_id, signal, count(*) have FROM b JOIN claims ON claims.pin = b.pin GROUP BY ALL),
t AS (SELECT c.doc_id, arg_min(signal, (signal % 2) * 1000000000 + signal) pick FROM c JOIN m ON m.doc_id = c.doc_id AND have = want GROUP BY 1), o AS (SELECT pin, arg_min(signal, (signal % 2) * 1000000000 + signal) own FROM claims GROUP BY 1)
SELECT b.doc_id, b.pin, coalesce(pick, own) pick, pick IS NOT NULL shared FROM b LEFT JOIN t ON t.doc_id = b.doc_id LEFT JOIN o ON o.pin = b.pin""")
def i4(v: Views) -> DataFrame:
    """A supplier for every part of an order: one that has them all (even numbers preferred, then the least), else each part's own best."""
    parts, claims = v.B.select("doc_id", "pin").distinct(), v.claims(False).select(*KEY)
    best = F.min(F.struct((F.col("signal") % 2).alias("odd"), "signal"))
    all_of = audit.covering(claims, parts, ["doc_id"], "signal", "pin").groupBy("doc_id").agg(best.alias("t"))
    own = claims.groupBy("pin").agg(best.alias("o"))
    rows = parts.join(all_of, "doc_id", "left").join(own, "pin", "left")
    return rows.select("doc_id", "pin", F.coalesce("t.signal", "o.signal").alias("pick"), F.col("t").isNotNull().alias("shared"))


@query("B7_proportional_trim", """SELECT word_id, regexp_replace(text, '(up|se)$', '') text, round(h + 12.0 * length(regexp_replace(text, '(up|se)$', '')) / length(text), 6) x1 FROM pts""")
def b7(v: Views) -> DataFrame:
    """Cut a suffix and shrink the box by its share of the characters."""
    short = F.regexp_replace("text", "(up|se)$", "")
    return v.P.select("word_id", short.alias("text"), F.round(F.col("h") + 12.0 * F.length(short) / F.length("text"), 6).alias("x1"))


@query("B8_answerability", """, t AS (SELECT * FROM truth WHERE af > 3), k AS (SELECT DISTINCT pin FROM t) SELECT c.pin, c.signal, CASE WHEN k.pin IS NULL THEN 'cannot say' WHEN t.pin IS NULL THEN 'no' ELSE 'yes' END answer
FROM claims c LEFT JOIN k ON k.pin = c.pin LEFT JOIN t ON t.pin = c.pin AND t.signal = c.signal""")
def b8(v: Views) -> DataFrame:
    """Tell no from cannot say: a claim about a part of which the truth has no row at all is not refuted."""
    truth = v.claims(True).filter("af > 3").select("pin", F.col("signal").alias("known"))
    by_pin = F.when(F.count("known") == 0, "cannot say").when(F.max((F.col("known") == F.col("signal")).cast("int")) == 1, "yes").otherwise("no")
    return v.claims(False).select(*KEY).join(truth, "pin", "left").groupBy(*KEY).agg(by_pin.alias("answer"))


@query("C19_spelling_variants", """SELECT c.pin, c.signal, CASE WHEN a.pin IS NOT NULL THEN 0 WHEN b.pin IS NOT NULL THEN 1 END spelling FROM claims c LEFT JOIN truth a ON a.pin = c.pin AND a.signal = c.signal LEFT JOIN truth b ON b.pin = c.pin AND b.signal = c.signal + 1""")
def c19(v: Views) -> DataFrame:
    """Which of two spellings of a claim the truth has; the first wins."""
    spelt = v.claims(False).select(*KEY, F.posexplode(F.array("signal", F.col("signal") + 1)).alias("spelling", "as"))
    hit = v.claims(True).select("pin", F.col("signal").alias("as"), F.lit(True).alias("hit"))
    return spelt.join(hit, ["pin", "as"], "left").groupBy(*KEY).agg(F.min(F.when(F.col("hit"), F.col("spelling"))).alias("spelling"))


@query("C30_restated_demotion", "SELECT c.pin, c.signal, t.pin IS NOT NULL restates, row_number() OVER (PARTITION BY c.pin ORDER BY t.pin IS NOT NULL, c.signal) rank FROM claims c LEFT JOIN truth t ON t.pin = c.pin AND t.signal = c.signal AND t.af = c.af")
def c30(v: Views) -> DataFrame:
    """Claims that only restate the truth rank behind the others of their part."""
    said = v.claims(True).withColumn("restates", F.lit(True))
    rows = v.claims(False).join(said, [*KEY, "af"], "left").withColumn("restates", F.coalesce("restates", F.lit(False)))
    return ordered.ranked(rows, ["pin"], ["restates", "signal"]).select(*KEY, "restates", "rank")


@query("C31_corroborated_adoption", """, v AS (SELECT * FROM pts WHERE text <> 'click'), k AS (SELECT DISTINCT c.doc_id, c.word_id, floor(c.y) nm FROM pts c JOIN v ON v.doc_id = c.doc_id AND c.text = 'click' AND v.text = 'view' AND abs(c.h - v.h) <= 12),
c AS (SELECT p.* FROM pts p WHERE text = 'click' AND floor(y) % 3 <> 0 AND word_id NOT IN (SELECT word_id FROM k)), n AS (SELECT c.doc_id, c.word_id, c.h, c.y, v.word_id row_id, v.h rh, v.y ry, row_number() OVER (PARTITION BY c.word_id ORDER BY abs(c.y - v.y), v.word_id) r FROM c JOIN v ON v.doc_id = c.doc_id AND abs(c.y - v.y) <= 12),
m AS (SELECT doc_id, max(h) zone FROM pts WHERE text = 'view' GROUP BY doc_id), a AS (SELECT n.* FROM n JOIN m ON m.doc_id = n.doc_id WHERE r = 1 AND abs(zone - h) <= 192 AND floor(y) % 2 = floor(ry) % 2
AND NOT EXISTS (SELECT 1 FROM k JOIN pts x ON x.word_id = k.word_id WHERE k.doc_id = n.doc_id AND (k.nm = floor(n.y) OR abs(x.y - n.ry) <= 2))),
o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY h, word_id) a, row_number() OVER (PARTITION BY doc_id, floor(y) ORDER BY h, word_id) b FROM a) SELECT doc_id, word_id, row_id FROM o WHERE a = 1 AND b = 1""")
def c31(v: Views) -> DataFrame:
    """Clicks beyond the views' zone, adopted where the row they land on vouches for them.

    A click is in the zone if a view lies within 12 hours. One outside claims something unless its whole value is a
    multiple of 3. It is adopted if its nearest other event by value is within 12 (its row), it lies no more than 192
    hours from the user's last view, the row agrees (values alike in parity), no click of the zone has its name (whole
    value) or stands on its row (within 2), and no earlier adopted click has its row or name.
    """
    name = F.floor("y")
    clicks, others = v.P.filter("text = 'click'").select("doc_id", "word_id", "h", "y"), v.P.filter("text <> 'click'")
    views = others.filter("text = 'view'").select("doc_id", F.col("h").alias("vh"))
    inside = near.band_join(clicks, views, ["doc_id"], "h", "vh", 12.0).select("doc_id", "word_id", "y").distinct()
    outside = clicks.join(inside.select("word_id"), "word_id", "left_anti").filter(name % 3 != 0)
    rows = others.select("doc_id", F.col("word_id").alias("row_id"), F.col("y").alias("ry"))
    landed = near.nearest_within(outside, rows, ["doc_id"], "y", "ry", 12.0, ["word_id"], ["row_id"])
    zone = views.groupBy("doc_id").agg(F.max("vh").alias("zone"))
    fits = landed.join(zone, "doc_id").filter((F.abs(F.col("zone") - F.col("h")) <= 192) & (name % 2 == F.floor("ry") % 2)).withColumn("name", name)
    fits = fits.join(inside.select("doc_id", name.alias("name")).distinct(), ["doc_id", "name"], "left_anti")
    held = near.band_join(fits.select("doc_id", "word_id", "ry"), inside.select("doc_id", F.col("y").alias("ky")), ["doc_id"], "ry", "ky", 2.0).select("word_id").distinct()
    free = fits.join(held, "word_id", "left_anti")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "word_id"))
    return free.withColumn("a", first("row_id")).withColumn("b", first("doc_id", "name")).filter("a = 1 AND b = 1").select("doc_id", "word_id", "row_id")


@query("I10_label_columns", """, w AS (SELECT doc_id, word_id, text, h, unnest([{'anchor': 0, 'p': y}, {'anchor': 1, 'p': y + length(text)}]) a FROM pts WHERE text <> 'signup'), v AS (SELECT doc_id, word_id, h, a.anchor anchor, a.p p, text IN ('click', 'purchase') hit FROM w),
g AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, anchor ORDER BY p, word_id) > 1 THEN 1 ELSE 0 END n FROM v), k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, anchor ORDER BY p, word_id) c FROM g),
c AS (SELECT doc_id, anchor, c, count(*) FILTER (hit) hits, max(h) edge FROM k GROUP BY ALL HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, edge DESC, anchor, c) r FROM c), b AS (SELECT doc_id, edge best FROM r WHERE r = 1 AND hits > 0),
e AS (SELECT DISTINCT r.doc_id, edge, best FROM r JOIN b ON b.doc_id = r.doc_id WHERE hits > 0 AND edge <= best), s AS (SELECT *, CASE WHEN lag(edge) OVER (PARTITION BY doc_id ORDER BY edge DESC) - edge > 72 THEN 1 ELSE 0 END n FROM e),
z AS (SELECT doc_id, min(edge) zone FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY edge DESC) q FROM s) WHERE q = 0 GROUP BY doc_id)
SELECT DISTINCT k.doc_id, k.word_id FROM k JOIN z ON z.doc_id = k.doc_id LEFT JOIN r ON r.doc_id = k.doc_id AND r.anchor = k.anchor AND r.c = k.c
WHERE r.r = 1 OR (k.hit AND r.hits > 0 AND r.edge >= zone) OR (k.hit AND k.h > zone)""")
def i10(v: Views) -> DataFrame:
    """The words of a user's label columns.

    Columns are gap clusters (tolerance 1) of three words or more along either edge of the words. The best has the most
    words of the vocabulary (clicks and purchases), then the latest edge; without a vocabulary word there is none. The
    zone runs outward from its edge over columns with vocabulary words to the first step above 72 hours. The best column
    counts whole, other columns inside the zone with their vocabulary words, and so do lone vocabulary words inside it.
    """
    edges = F.explode(F.array(F.struct(F.lit(0).alias("anchor"), F.col("y").alias("p")), F.struct(F.lit(1).alias("anchor"), (F.col("y") + F.length("text")).alias("p"))))
    words = v.P.filter("text <> 'signup'").select("doc_id", "word_id", "h", F.col("text").isin("click", "purchase").alias("hit"), edges.alias("a")).select("doc_id", "word_id", "h", "hit", "a.*")
    grouped = ordered.gap_clusters(words, ["doc_id", "anchor"], "p", "word_id", 1.0, "c")
    columns = grouped.groupBy("doc_id", "anchor", "c").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.max("h").alias("edge")).filter("n >= 3 AND hits > 0")
    ranked = ordered.ranked(columns, ["doc_id"], [F.desc("hits"), F.desc("edge"), "anchor", "c"])
    best = ranked.filter("rank = 1").select("doc_id", F.col("edge").alias("best"))
    inner = ranked.select("doc_id", "edge").distinct().join(best, "doc_id").filter("edge <= best").withColumn("out", -F.col("edge"))
    zone = ordered.run_to_break(inner, ["doc_id"], ["out"], "out", F.col("edge") == F.col("best"), 72.0).groupBy("doc_id").agg(F.min("edge").alias("zone"))
    rows = grouped.join(zone, "doc_id").join(ranked.select("doc_id", "anchor", "c", "edge", "rank"), ["doc_id", "anchor", "c"], "left")
    kept = F.coalesce(F.col("rank") == 1, F.lit(False)) | F.col("hit") & (F.coalesce(F.col("edge") >= F.col("zone"), F.lit(False)) | (F.col("h") > F.col("zone")))
    return rows.filter(kept).select("doc_id", "word_id").distinct()
