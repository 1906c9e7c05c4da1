"""Queries that assign, move and merge within orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, ordered, parts
from .views import Views, query

SUPPLIERS = ", opts AS (SELECT pin, list_sort(list(signal)) opts FROM claims GROUP BY pin)"


def suppliers(v: Views) -> DataFrame:
    """The suppliers of each part, in order."""
    return v.claims(False).groupBy("pin").agg(F.sort_array(F.collect_list("signal")).alias("options"))


def with_options(v: Views, rows: DataFrame) -> DataFrame:
    return rows.join(suppliers(v), "pin", "left").withColumn("options", F.coalesce("options", F.array().cast("array<long>")))


@query("I1_conflict_free", """, opts AS (SELECT pin, list(signal ORDER BY signal) opts FROM claims WHERE signal IS NOT NULL GROUP BY pin), n AS (SELECT g.doc_id, g.pin, coalesce(opts, CAST([] AS BIGINT[])) opts FROM (SELECT DISTINCT doc_id, pin FROM (SELECT doc_id, seq, min(pin) pin FROM boards GROUP BY doc_id, seq)) g LEFT JOIN opts ON opts.pin = g.pin),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(opts), CAST(pin AS VARCHAR)) k FROM n), z AS (SELECT doc_id, count(*) z FROM n GROUP BY doc_id),
q(doc_id, k, picks) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM z UNION ALL SELECT doc_id, k, list_append(picks, p) FROM (SELECT o.doc_id, o.k, q.picks, list_filter(o.opts, lambda x: NOT list_contains(q.picks, x))[1] p FROM q JOIN o ON o.doc_id = q.doc_id AND o.k = q.k + 1) WHERE p IS NOT NULL),
d AS (SELECT q.doc_id, picks FROM q JOIN z ON z.doc_id = q.doc_id AND z.z = q.k), r AS (SELECT *, coalesce(flatten(list(opts) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), CAST([] AS BIGINT[])) later FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = o.doc_id)),
s(doc_id, k, used, picks) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM r UNION ALL SELECT doc_id, k, used, min(picks) FROM (SELECT doc_id, k, list_sort(list_intersect(list_append(used, x), later)) used, list_append(picks, x) picks FROM (SELECT r.doc_id, r.k, r.later, s.used, s.picks, unnest(r.opts) x FROM s JOIN r ON r.doc_id = s.doc_id AND r.k = s.k + 1) WHERE NOT list_contains(picks, x)) GROUP BY doc_id, k, used),
b AS (SELECT doc_id, picks FROM d UNION ALL SELECT s.doc_id, min(picks) FROM s JOIN z ON z.doc_id = s.doc_id AND z.z = s.k GROUP BY s.doc_id)
SELECT l.doc_id, l.seq, CASE WHEN b.doc_id IS NULL THEN o.opts[1] ELSE b.picks[o.k] END pick, b.doc_id IS NOT NULL solved, l.shares FROM (SELECT doc_id, seq, min(pin) pin, count(*) OVER (PARTITION BY doc_id, min(pin)) shares FROM boards GROUP BY doc_id, seq) l
JOIN o ON o.doc_id = l.doc_id AND o.pin = l.pin LEFT JOIN b ON b.doc_id = o.doc_id""")
def i1(v: Views) -> DataFrame:
    """A supplier for every line of an order, among all that have its part: lines of one part share theirs, others have
    different ones. The SQL takes the first free one line after line, which is the answer where it comes to the end; elsewhere
    it holds all assignments against each other."""
    lines = v.B.groupBy("doc_id", "seq").agg(F.min("pin").alias("pin"))
    return assign.owners_served(lines, v.claims(False).select("pin", "signal"), "doc_id", "seq", "pin", "signal").select("doc_id", "seq", "pick", "solved", "shares")


@query("I2_greedy_allocation", SUPPLIERS + """, o AS (SELECT b.doc_id, b.seq, b.pin, b.dev, coalesce(opts, CAST([] AS BIGINT[])) opts, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(len(opts), 0), seq, b.pin, dev, qty) k FROM boards b LEFT JOIN opts ON opts.pin = b.pin),
s(doc_id, k, taken, owners, pick) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM o
UNION ALL SELECT doc_id, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, CASE WHEN p IS NULL THEN owners ELSE list_append(owners, pin) END, p FROM (SELECT o.doc_id, o.k, o.pin, s.taken, s.owners, list_filter(o.opts, lambda x: NOT list_contains(s.taken, x))[1] p FROM s JOIN o ON o.doc_id = s.doc_id AND o.k = s.k + 1)),
w AS (SELECT o.*, s.pick, s.taken, s.owners FROM o JOIN s ON s.doc_id = o.doc_id AND s.k = o.k)
SELECT doc_id, seq, pin, dev, coalesce(pick, opts[1]) taken, CASE WHEN pick IS NOT NULL THEN NULL WHEN len(opts) = 0 THEN 'no option'
ELSE 'taken by ' || array_to_string(list_sort(list_distinct([owners[i] for i in range(1, len(taken) + 1) if list_contains(opts, taken[i])])), ',') END problem FROM w""")
def i2(v: Views) -> DataFrame:
    """Lines of an order, those with the fewest suppliers of their part first, take the first supplier that no earlier line took.

    A line of which all are taken keeps the first one, with the parts that took them.
    """
    order = F.struct(F.size("options").alias("n"), "seq", "pin", "dev", "qty")
    out = assign.greedy(with_options(v, v.B), ["doc_id"], order, "pin", "options")
    problem = F.when(F.col("pick").isNull(), "no option").when(~F.col("free"), F.concat(F.lit("taken by "), F.array_join(F.col("owners").cast("array<string>"), ",")))
    return out.select("doc_id", "order.seq", "order.pin", "order.dev", F.col("pick").alias("taken"), problem.alias("problem"))


@query("I11_repick_or_withhold", SUPPLIERS + """, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dev ORDER BY seq, pin, qty) r FROM boards), t AS (SELECT doc_id, list(DISTINCT dev) taken FROM boards GROUP BY doc_id),
o AS (SELECT d.doc_id, d.seq, d.pin, d.dev, coalesce(opts, CAST([] AS BIGINT[])) opts, row_number() OVER (PARTITION BY doc_id ORDER BY seq, d.pin, dev, qty) k FROM d LEFT JOIN opts ON opts.pin = d.pin WHERE r > 1),
s(doc_id, k, taken, pick) AS (SELECT doc_id, CAST(0 AS BIGINT), taken, CAST(NULL AS BIGINT) FROM t WHERE doc_id IN (SELECT doc_id FROM o)
UNION ALL SELECT doc_id, k, CASE WHEN p IS NULL THEN taken ELSE list_append(taken, p) END, p FROM (SELECT o.doc_id, o.k, s.taken, list_filter(o.opts, lambda x: NOT list_contains(s.taken, x))[1] p FROM s JOIN o ON o.doc_id = s.doc_id AND o.k = s.k + 1))
SELECT o.doc_id, o.seq, o.pin, s.pick dev, CASE WHEN s.pick IS NULL THEN 'withheld' ELSE 'moved' END state FROM o JOIN s ON s.doc_id = o.doc_id AND s.k = o.k""")
def i11(v: Views) -> DataFrame:
    """Rows whose device an earlier row of their board has: moved to a device of the part that is free on the board, or withheld."""
    taken = v.B.groupBy("doc_id").agg(F.collect_set("dev").alias("gone"))
    late = ordered.ranked(v.B, ["doc_id", "dev"], ["seq", "pin", "qty"]).filter("rank > 1")
    out = assign.greedy(with_options(v, late.join(taken, "doc_id")), ["doc_id"], F.struct("seq", "pin", "dev", "qty"), "pin", "options", "gone")
    return out.select("doc_id", "order.seq", "order.pin", F.when(F.col("free"), F.col("pick")).alias("dev"), F.when(F.col("free"), "moved").otherwise("withheld").alias("state"))


@query("I6_clash_repair", """, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, pin, dev, net, qty) idx, seq, pin, dev, net FROM boards), o AS (SELECT pin, list_sort(list(signal)) opts FROM claims GROUP BY pin),
z AS (SELECT doc_id, list({'idx': idx, 'seq': seq, 'pin': b.pin, 'dev': dev, 'net': net, 'opts': coalesce(opts, CAST([] AS BIGINT[]))} ORDER BY idx) r, list(dev ORDER BY idx) devs FROM b LEFT JOIN o ON o.pin = b.pin GROUP BY doc_id),
s(doc_id, n, r, now) AS (SELECT doc_id, 0, r, devs FROM z UNION ALL SELECT doc_id, n + 1, r, list_transform(now, lambda d, j: CASE WHEN j = m.i THEN m.o ELSE d END) FROM (SELECT doc_id, n, r, now, list_filter(list_transform(r, lambda x: {'i': x.idx, 'o': CASE WHEN x.net <> 'NO' AND len(list_filter(r, lambda y: now[y.idx] = now[x.idx] AND y.net <> x.net)) > 0
  THEN list_filter(x.opts, lambda q: q <> now[x.idx] AND len(list_filter(r, lambda y: now[y.idx] = q AND y.net <> x.net)) = 0)[1] END}), lambda y: y.o IS NOT NULL)[1] m FROM s) WHERE m IS NOT NULL),
e AS (SELECT doc_id, arg_max(r, n) r, arg_max(now, n) now FROM s GROUP BY doc_id), x AS (SELECT doc_id, unnest(r) x, unnest(now) now FROM e) SELECT doc_id, x.seq seq, x.pin pin, x.dev dev, x.net net, now FROM x""")
def i6(v: Views) -> DataFrame:
    """Move lines, one an order at a time, until no device of an order serves several nets or nothing can move; lines of net NO stay."""
    rows = ordered.ranked(v.B, ["doc_id"], ["seq", "pin", "dev", "net", "qty"], "idx").select("doc_id", "idx", "seq", "pin", "dev", "net")
    options = v.claims(False).select("pin", F.col("signal").alias("place"), F.col("signal").alias("option"))
    return assign.repaired(rows, options, "doc_id", "idx", "pin", "dev", "net", "NO").select("doc_id", "seq", "pin", "dev", "net", "now")


@query("I7_part_merging", """, w AS (SELECT doc_id, floor(h / 84) part, word_id, h, y, floor(y) pin FROM pts WHERE text <> 'error'), g AS (SELECT *, round(h, 2) - lag(round(h, 2)) OVER (PARTITION BY doc_id, part ORDER BY round(h, 2), word_id) g FROM w),
p AS (SELECT doc_id, CAST(part AS BIGINT) part, list(DISTINCT pin) pins, coalesce(min(round(g, 2)) FILTER (round(g, 2) > 0.5 AND round(g, 2) < 20), 3.66) pitch, count(*) n, min(h) x0, max(h) x1, min(y) y0, max(y) y1, CAST(floor(part / 2) AS BIGINT) page, bool_or(word_id % 4 = 0) upright FROM g GROUP BY doc_id, part),
o AS (SELECT doc_id, part, pins, pitch, {'page': page, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'lo': CASE WHEN upright THEN y0 ELSE x0 END, 'hi': CASE WHEN upright THEN y1 ELSE x1 END} b, row_number() OVER (PARTITION BY doc_id ORDER BY len(pins) DESC, n DESC, part) k FROM p),
s(doc_id, k, mine, pitch, boxes, ok) AS (SELECT doc_id, k, pins, pitch, [b], TRUE FROM o WHERE k = 1 UNION ALL SELECT doc_id, k, CASE WHEN ok THEN list_concat(mine, pins) ELSE mine END, pitch, CASE WHEN ok THEN list_append(boxes, b) ELSE boxes END, ok FROM (SELECT o.doc_id, o.k, s.mine, o.pins, s.pitch, s.boxes, o.b,
  len(list_intersect(s.mine, o.pins)) = 0 AND abs(o.pitch - s.pitch) <= s.pitch * 0.5 AND (len(o.pins) >= 12 AND len(o.pins) * 3 >= len(s.mine) OR len(list_filter(s.boxes, lambda a: a.page = o.b.page AND (o.b.x0 <= a.x1 + 2 * s.pitch AND a.x0 <= o.b.x1 + 2 * s.pitch AND o.b.y0 <= a.y1 + 2 * s.pitch AND a.y0 <= o.b.y1 + 2 * s.pitch
    OR least(o.b.hi, a.hi) - greatest(o.b.lo, a.lo) > 0 AND least(o.b.hi, a.hi) - greatest(o.b.lo, a.lo) >= 0.5 * least(o.b.hi - o.b.lo, a.hi - a.lo)))) > 0) ok FROM s JOIN o ON o.doc_id = s.doc_id AND o.k = s.k + 1))
SELECT o.doc_id, o.part, s.ok accepted FROM o JOIN s ON s.doc_id = o.doc_id AND s.k = o.k""")
def i7(v: Views) -> DataFrame:
    """The parts (half weeks) of a user's events that make up one whole: no whole value in common with what is accepted, a like
    rhythm, and large, adjacent, or beside an accepted part of the same week."""
    words = v.P.filter("text <> 'error'").withColumn("part", F.floor(F.col("h") / 84))
    pitch = ordered.least_spacing(words, ["doc_id", "part"], "h", 0.5, 20.0, 3.66)
    box = [F.min("h").alias("x0"), F.max("h").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    shape = words.groupBy("doc_id", "part").agg(F.collect_set(F.floor("y")).alias("pins"), F.count(F.lit(1)).alias("n"), *box, F.bool_or(F.col("word_id") % 4 == 0).alias("upright"))
    whole = shape.join(pitch, ["doc_id", "part"]).withColumn("page", F.floor(F.col("part") / 2))
    return parts.merged(whole, "doc_id", [F.desc(F.size("pins")), F.desc("n"), F.col("part")], "part", "pins", "pitch", "page", "upright", spread=0.5)
