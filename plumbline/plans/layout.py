"""Queries on positions: windows, clusters and nearness joins over the views of points, boxes, tokens and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import near, ordered, readings
from .views import Views, query

GAP = 21600.0


@query("E1_consecutive_gap", "SELECT doc_id, word_id, round(x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, word_id), 3) gap FROM pts")
def e1(v: Views) -> DataFrame:
    return ordered.consecutive_gap(v.P, ["doc_id"], "x", "word_id").select("doc_id", "word_id", F.round("gap", 3).alias("gap"))


CLUSTERS = f""", d1 AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, word_id) > {GAP} THEN 1 ELSE 0 END n FROM pts),
k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY x, word_id) "cluster" FROM d1),
s AS (SELECT doc_id, CAST("cluster" AS BIGINT) "cluster", count(*) n, min(x) low, max(x) high FROM k GROUP BY ALL) """


@query("D1_gap_clusters", CLUSTERS + 'SELECT doc_id, "cluster", n, round(low, 3) low, round(high, 3) high FROM s')
def d1(v: Views) -> DataFrame:
    return ordered.cluster_sizes(v.P, ["doc_id"], "x", "word_id", GAP).select("doc_id", "cluster", "n", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("D2_dominant_cluster", CLUSTERS + ', r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, low) r FROM s) SELECT doc_id, "cluster", n, round(low, 3) low FROM r WHERE r = 1')
def d2(v: Views) -> DataFrame:
    return ordered.dominant_cluster(v.P, ["doc_id"], "x", "word_id", GAP).select("doc_id", "cluster", "n", F.round("low", 3).alias("low"))


@query("D3_least_spacing", """, p AS (SELECT DISTINCT doc_id, round(h, 2) p FROM pts), g AS (SELECT doc_id, round(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), 2) g FROM p)
SELECT doc_id, coalesce(min(CASE WHEN g > 0.5 AND g < 20 THEN g END), 3.66) pitch FROM g GROUP BY doc_id""")
def d3(v: Views) -> DataFrame:
    return ordered.least_spacing(v.P, ["doc_id"], "h", 0.5, 20.0, 3.66)


@query("E5_carry_forward", """, z AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) asked FROM conversations)
SELECT conv_id, turn, asked FROM z WHERE role = 'assistant'""")
def e5(v: Views) -> DataFrame:
    out = ordered.carried(v.conversations, ["conv_id"], ["turn"], F.col("role") == "user", F.col("text"), "asked")
    return out.filter("role = 'assistant'").select("conv_id", "turn", "asked")


@query("A4_sectioned_scan", """, z AS (SELECT doc_id, line_no, line, CASE WHEN line LIKE 'L%' THEN 1 WHEN line = '' OR line LIKE 'T%' THEN 2 ELSE 0 END m FROM lns),
y AS (SELECT *, last_value(CASE WHEN m > 0 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) s FROM z)
SELECT y.doc_id, y.line_no, CAST(z.line_no AS INTEGER) section FROM y JOIN z ON z.doc_id = y.doc_id AND z.line_no = y.s WHERE z.m = 1""")
def a4(v: Views) -> DataFrame:
    """Lines that stand in a section: a header begins one, an empty line or another kind of header ends it."""
    end = (F.col("line") == "") | F.col("line").startswith("T")
    out = ordered.carried(v.L, ["doc_id"], ["line_no"], F.col("line").startswith("L"), F.col("line_no"), "section", reset=end)
    return out.filter("section IS NOT NULL").select("doc_id", "line_no", F.col("section").cast("int").alias("section"))


@query("A5_back_fill", "SELECT doc_id, word_id, first_value(CASE WHEN text = 'purchase' THEN y END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY x, word_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) next_value FROM pts")
def a5(v: Views) -> DataFrame:
    out = ordered.back_filled(v.P, ["doc_id"], ["x", "word_id"], F.when(F.col("text") == "purchase", F.col("y")), "next_value")
    return out.select("doc_id", "word_id", "next_value")


@query("E10_parity_toggle", "SELECT doc_id, line_no, sum(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 1 inside FROM lns")
def e10(v: Views) -> DataFrame:
    return ordered.toggled(v.L, ["doc_id"], ["line_no"], F.col("line").contains("|")).select("doc_id", "line_no", "inside")


@query("E4_occurrence_index", "SELECT pin, signal, row_number() OVER (PARTITION BY pin ORDER BY af, signal) occurrence FROM CLAIMS")
def e4(v: Views) -> DataFrame:
    return ordered.ranked(v.claims(False), ["pin"], ["af", "signal"], "occurrence").select("pin", "signal", F.col("occurrence").cast("long").alias("occurrence"))


SPANS = """, a AS (SELECT DISTINCT doc_id, h FROM pts WHERE text = 'signup'), m AS (SELECT doc_id, median(g) p FROM (SELECT doc_id, h - lag(h) OVER (PARTITION BY doc_id ORDER BY h) g FROM a) GROUP BY doc_id),
sp AS (SELECT a.doc_id, a.h, coalesce((lag(a.h) OVER w + a.h) / 2, a.h - coalesce(p, 60) / 2) lo, coalesce((lead(a.h) OVER w + a.h) / 2, a.h + coalesce(p, 60) / 2) hi FROM a JOIN m ON m.doc_id = a.doc_id WINDOW w AS (PARTITION BY a.doc_id ORDER BY a.h))
"""


@query("E6_midpoint_spans", SPANS + "SELECT doc_id, round(h, 4) h, round(lo, 4) lo, round(hi, 4) hi FROM sp")
def e6(v: Views) -> DataFrame:
    anchors = v.P.filter("text = 'signup'").select("doc_id", "h").distinct()
    return ordered.midpoint_spans(anchors, ["doc_id"], "h", 60.0).select("doc_id", *(F.round(c, 4).alias(c) for c in ("h", "lo", "hi")))


@query("E7_hole_slots", """, d AS (SELECT DISTINCT doc_id, floor(h / 24) d FROM pts), g AS (SELECT doc_id, d, lead(d) OVER (PARTITION BY doc_id ORDER BY d) e FROM d)
SELECT doc_id, CAST(unnest(range(CAST(d AS BIGINT) + 1, CAST(e AS BIGINT))) AS DOUBLE) slot FROM g WHERE e > d + 1""")
def e7(v: Views) -> DataFrame:
    days = v.P.select("doc_id", F.floor(F.col("h") / 24).cast("double").alias("d")).distinct()
    return ordered.hole_slots(days, ["doc_id"], "d", 1.0)


@query("E9_run_to_break", """, g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, word_id) > 172800 THEN 1 ELSE 0 END s, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, word_id) best FROM pts),
b AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY x, word_id) run FROM g), o AS (SELECT doc_id, run FROM b WHERE best = 1) SELECT b.doc_id, word_id FROM b JOIN o ON o.doc_id = b.doc_id AND o.run = b.run""")
def e9(v: Views) -> DataFrame:
    """Events that a walk from a user's largest one reaches, either way, before a pause of two days."""
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("y"), "word_id")) == 1
    return ordered.run_to_break(v.P, ["doc_id"], ["x", "word_id"], "x", best, 172800.0).select("doc_id", "word_id")


@query("E12_first_definition", """, r AS (SELECT doc_id, sha256(text) digest, row_number() OVER (PARTITION BY text ORDER BY doc_id) r FROM documents WHERE text IS NOT NULL)
SELECT doc_id, digest, r > 1 duplicate FROM r""")
def e12(v: Views) -> DataFrame:
    """The least document of each text defines it; others are duplicates. Documents meet the first one of their text by id and
    digest together, so that a text of very many copies is no load on one task."""
    docs = v.documents.filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return docs.join(first, ["doc_id", "digest"], "left").select("doc_id", "digest", F.col("first").isNull().alias("duplicate"))


@query("E11_rival_resolution", """, r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) r,
count(*) OVER (PARTITION BY o_custkey, o_orderpriority) same FROM orders) SELECT o_custkey, o_orderkey, same > 1 contested FROM r WHERE r = 1""")
def e11(v: Views) -> DataFrame:
    same = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority"))
    rows = v.orders.select("o_custkey", "o_orderkey", "o_orderpriority").withColumn("contested", same > 1)
    return ordered.first_by(rows, ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey", "contested")


@query("F1_strongest_candidate", """, s AS (SELECT doc_id, count(*) n, count(DISTINCT pin) pins FROM boards GROUP BY doc_id),
r AS (SELECT o_custkey, o_orderkey, pins, n, row_number() OVER (PARTITION BY o_custkey ORDER BY pins DESC, n DESC, o_orderkey) r FROM orders JOIN s ON doc_id = o_orderkey)
SELECT o_custkey, min(o_orderkey) FILTER (r = 1) o_orderkey, min(pins) FILTER (r = 1) pins, min(n) FILTER (r = 1) n, count(*) - 1 rivals, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (r BETWEEN 2 AND 6), '') pages FROM r GROUP BY o_custkey""")
def f1(v: Views) -> DataFrame:
    """The strongest order of a customer, how many rivals it has, and the strongest five of them."""
    size = v.B.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pin").alias("pins"))
    rows = v.orders.select("o_custkey", "o_orderkey").join(size, "o_orderkey")
    top = ordered.first_by(rows, ["o_custkey"], [F.desc("pins"), F.desc("n"), "o_orderkey"], 6)
    best = F.struct((-F.col("pins")).alias("a"), (-F.col("n")).alias("b"), "o_orderkey", "pins", "n")
    strongest = top.groupBy("o_custkey").agg(F.min(best).alias("s"), F.sort_array(F.collect_list("o_orderkey")).alias("listed"))
    total = rows.groupBy("o_custkey").agg((F.count(F.lit(1)) - 1).alias("rivals"))
    pages = F.array_join(F.array_except("listed", F.array("s.o_orderkey")).cast("array<string>"), ",")
    return strongest.join(total, "o_custkey").select("o_custkey", "s.o_orderkey", "s.pins", "s.n", "rivals", pages.alias("pages"))


@query("F4_top_and_rest", "SELECT doc_id, seq, pin, rank, rank <= 4 listed FROM (SELECT doc_id, seq, pin, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY qty DESC, seq, pin, dev) AS INTEGER) rank FROM boards)")
def f4(v: Views) -> DataFrame:
    return ordered.top_and_rest(v.B, ["doc_id"], [F.desc("qty"), "seq", "pin", "dev"], 4).select("doc_id", "seq", "pin", "rank", "listed")


@query("I3_numbering_with_ceiling", """, e AS (SELECT *, net <> 'NO' e FROM boards), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, e ORDER BY seq, pin, dev) - 1 n FROM e)
SELECT doc_id, seq, pin, CAST(CASE WHEN e AND n < 3 THEN n ELSE -1 END AS INTEGER) number, CASE WHEN NOT e THEN 'not eligible' WHEN n >= 3 THEN 'beyond the ceiling' END reason FROM n""")
def i3(v: Views) -> DataFrame:
    out = ordered.numbered(v.B, ["doc_id"], ["seq", "pin", "dev"], F.col("net") != "NO", F.lit(3))
    return out.select("doc_id", "seq", "pin", F.col("number").cast("int").alias("number"), "reason")


@query("I9_near_duplicate_collapse", """SELECT doc_id, h FROM (SELECT doc_id, unnest(list_reduce(list_prepend(CAST([] AS DOUBLE[]), list_transform(list_sort(list(h)), lambda v: [v])),
 lambda acc, v: CASE WHEN len(acc) = 0 OR v[1] - acc[len(acc)] >= 48 THEN list_concat(acc, v) ELSE acc END)) h FROM pts GROUP BY doc_id)""")
def i9(v: Views) -> DataFrame:
    return ordered.thinned(v.P, ["doc_id"], "h", 48.0)


@query("C7_token_stitching", """, l AS (SELECT doc_id, CAST(floor(y / 25) AS BIGINT) line, word_id, h, h + 2 e, text FROM pts), g AS (SELECT *, CASE WHEN h - lag(e) OVER w > 24 OR lag(text) OVER w = 'purchase' THEN 1 ELSE 0 END n FROM l WINDOW w AS (PARTITION BY doc_id, line ORDER BY h, word_id)),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id, line ORDER BY h, word_id) AS BIGINT) chain FROM g)
SELECT doc_id, line, chain, string_agg(text, '' ORDER BY h, word_id) joined, count(*) pieces, round(min(h), 4) x0, round(max(e), 4) x1 FROM c GROUP BY doc_id, line, chain""")
def c7(v: Views) -> DataFrame:
    """Events of a line of values, joined while the next one begins within a day, up to a purchase; with the box that they fill."""
    words = v.P.select("doc_id", F.floor(F.col("y") / 25).alias("line"), "word_id", "h", (F.col("h") + 2).alias("e"), "text")
    out = ordered.stitched(words, ["doc_id", "line"], "h", "e", "word_id", "text", 24.0, F.col("text") == "purchase")
    return out.select("doc_id", "line", "chain", "joined", "pieces", F.round("x0", 4).alias("x0"), F.round("x1", 4).alias("x1"))


PAIRS = "SELECT a.doc_id, a.word_id a, a.h, b.word_id b, b.h bh FROM pts a JOIN pts b ON a.doc_id = b.doc_id AND a.text = 'click' AND b.text = 'view'"


def sides(v: Views, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    a = v.P.filter(F.col("text") == left).select("doc_id", F.col("word_id").alias("a"), "h", "y")
    return a, v.P.filter(F.col("text") == right).select("doc_id", F.col("word_id").alias("b"), F.col("h").alias("bh"), F.col("y").alias("by"))


@query("C3_nearest_within", f", p AS ({PAIRS}), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(h - bh), b) r FROM p WHERE abs(h - bh) <= 24) SELECT doc_id, a, b, round(abs(h - bh), 4) distance FROM r WHERE r = 1")
def c3(v: Views) -> DataFrame:
    a, b = sides(v, "click", "view")
    return near.nearest_within(a, b, ["doc_id"], "h", "bh", 24.0, ["a"], ["b"]).select("doc_id", "a", "b", F.round("distance", 4).alias("distance"))


@query("C6_right_neighbour", f", p AS ({PAIRS} AND abs(a.y - b.y) <= 15), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY bh - h, b) r FROM p WHERE bh - h BETWEEN -0.5 AND 24) SELECT doc_id, a, b, round(bh - h, 4) distance FROM r WHERE r = 1")
def c6(v: Views) -> DataFrame:
    """The next view to the right of a click on the same line (values no further apart than 15)."""
    a, b = sides(v, "click", "view")
    line = near.band_join(a, b, ["doc_id"], "y", "by", 15.0)
    gap = F.col("bh") - F.col("h")
    return near.nearest(line.filter(gap.between(-0.5, 24.0)), ["a"], gap, ["b"]).select("doc_id", "a", "b", F.round("distance", 4).alias("distance"))


@query("C8_radius_join", "SELECT a.doc_id, a.word_id a, b.word_id b, round(sqrt((a.h - b.h) * (a.h - b.h) + (a.y - b.y) * (a.y - b.y)), 4) distance FROM pts a JOIN pts b ON a.doc_id = b.doc_id AND a.text = 'click' AND b.text = 'view' WHERE sqrt((a.h - b.h) * (a.h - b.h) + (a.y - b.y) * (a.y - b.y)) <= 20")
def c8(v: Views) -> DataFrame:
    a, b = sides(v, "click", "view")
    return near.radius_join(a, b, ["doc_id"], ("h", "y"), ("bh", "by"), 20.0).select("doc_id", "a", "b", F.round("distance", 4).alias("distance"))


@query("C5_band_join", "SELECT pts.doc_id, word_id, box_id FROM pts JOIN boxes ON pts.doc_id = boxes.doc_id AND h BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE word_id <> box_id")
def c5(v: Views) -> DataFrame:
    return near.in_box(v.P, v.R, ["doc_id"], "h", "y", 24.0).filter("word_id <> box_id").select("doc_id", "word_id", "box_id")


@query("C4_owner_assignment", """, p AS (SELECT pts.doc_id, word_id, box_id, unnest([CASE WHEN y BETWEEN y0 AND y1 AND h < x0 AND x0 - h <= 24 THEN {'o': 0, 'side': 'L', 'd': x0 - h} END, CASE WHEN y BETWEEN y0 AND y1 AND h > x1 AND h - x1 <= 24 THEN {'o': 1, 'side': 'R', 'd': h - x1} END,
CASE WHEN h BETWEEN x0 AND x1 AND y < y0 AND y0 - y <= 24 THEN {'o': 2, 'side': 'T', 'd': y0 - y} END, CASE WHEN h BETWEEN x0 AND x1 AND y > y1 AND y - y1 <= 24 THEN {'o': 3, 'side': 'B', 'd': y - y1} END]) s FROM pts JOIN boxes ON pts.doc_id = boxes.doc_id),
r AS (SELECT doc_id, word_id, box_id, s.side side, row_number() OVER (PARTITION BY word_id ORDER BY s.d, box_id, s.o) r FROM p WHERE s IS NOT NULL) SELECT doc_id, word_id, box_id, side FROM r WHERE r = 1""")
def c4(v: Views) -> DataFrame:
    """The box whose edge is nearest of all whose gutter holds a point: to the left, right, above or below."""
    h, y, x0, x1, y0, y1 = map(F.col, ("h", "y", "gx0", "gx1", "gy0", "gy1"))
    wide = v.R.select("doc_id", "box_id", *(F.col(c).alias(f"g{c}") for c in ("x0", "x1", "y0", "y1")), (F.col("x0") - 25).alias("x0"), (F.col("x1") + 25).alias("x1"), (F.col("y0") - 25).alias("y0"), (F.col("y1") + 25).alias("y1"))  # a little wider, as 24 less than an edge is rounded: the gutters decide
    level, within = y.between(y0, y1), h.between(x0, x1)
    gutters = [(level, x0 - h, "L"), (level, h - x1, "R"), (within, y0 - y, "T"), (within, y - y1, "B")]
    found = F.array_compact(F.array(*(F.when(c & (d > 0) & (d <= 24), F.struct(d.alias("d"), F.lit(k).alias("o"), F.lit(s).alias("side"))) for k, (c, d, s) in enumerate(gutters))))
    p = near.in_box(v.P, wide, ["doc_id"], "h", "y", 74.0).select("doc_id", "word_id", "box_id", F.explode(found).alias("g"))
    return near.nearest(p, ["word_id"], F.col("g.d"), ["box_id", F.col("g.o")]).select("doc_id", "word_id", "box_id", "g.side")


BOXES = """, p AS (SELECT a.doc_id, a.box_id a, b.box_id b, a.y0 ay0, a.y1 ay1, b.y0 by0, b.y1 by1, sqrt(pow(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + pow(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2)) gap
FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.box_id < b.box_id) """


@query("C9_box_gap_join", BOXES + "SELECT doc_id, a, b, round(gap, 4) gap FROM p WHERE gap <= 10")
def c9(v: Views) -> DataFrame:
    return near.box_pairs(v.R, ["doc_id"], "box_id", 10.0, 24.0).select("doc_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round("gap", 4).alias("gap"))


@query("C25_box_overlap", BOXES + "SELECT doc_id, a, b FROM p WHERE gap <= 10 AND greatest(0, least(ay1, by1) - greatest(ay0, by0)) / 40 >= 0.5")
def c25(v: Views) -> DataFrame:
    pairs = near.box_pairs(v.R, ["doc_id"], "box_id", 10.0, 24.0)
    return pairs.filter(F.round(near.overlap_share("a_", "b_"), 9) >= 0.5).select("doc_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"))


NEAREST_KIND = """, p AS (SELECT a.doc_id, a.word_id a, b.text kind, min(abs(a.h - b.h)) distance FROM pts a JOIN pts b ON a.doc_id = b.doc_id AND a.text = 'purchase' AND b.text <> 'purchase' AND abs(a.h - b.h) <= 24 GROUP BY ALL),
r AS (SELECT *, row_number() OVER w r, lead(distance) OVER w nxt FROM p WINDOW w AS (PARTITION BY a ORDER BY distance, kind)) """


@query("C10_dominance_nearest", NEAREST_KIND + 'SELECT doc_id, a, kind, round(distance, 4) distance, round(nxt, 4) "second", nxt IS NULL OR nxt >= 3 * distance decided FROM r WHERE r = 1')
def c10(v: Views) -> DataFrame:
    """The nearest kind of point to each purchase, undecided where another kind is not three times as far."""
    a = v.P.filter("text = 'purchase'").select("doc_id", F.col("word_id").alias("a"), "h")
    b = v.P.filter("text <> 'purchase'").select("doc_id", F.col("text").alias("kind"), F.col("h").alias("bh"))
    kinds = near.band_join(a, b, ["doc_id"], "h", "bh", 24.0).groupBy("doc_id", "a", "kind").agg(F.min(F.abs(F.col("h") - F.col("bh"))).alias("distance"))
    return ordered.runner_up(kinds, ["doc_id", "a"], "distance", "kind", 3.0).select("doc_id", "a", "kind", F.round("distance", 4).alias("distance"), F.round("second", 4).alias("second"), "decided")


@query("C26_line_of_sight", f", p AS ({PAIRS} WHERE abs(a.h - b.h) <= 24) SELECT doc_id, a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE q.doc_id = p.doc_id AND q.text = 'signup' AND q.h > least(p.h, p.bh) AND q.h < greatest(p.h, p.bh))")
def c26(v: Views) -> DataFrame:
    """Pairs of neighbours with no rival strictly between them."""
    pairs = near.band_join(*sides(v, "click", "view"), ["doc_id"], "h", "bh", 24.0)
    rival = v.P.filter("text = 'signup'").select("doc_id", F.col("h").alias("rh"))
    between = (F.col("rh") > F.least("h", "bh")) & (F.col("rh") < F.greatest("h", "bh"))
    blocked = near.band_join(pairs, rival, ["doc_id"], "h", "rh", 24.0).filter(between).select("a", "b").distinct()
    return pairs.join(blocked, ["a", "b"], "left_anti").select("doc_id", "a", "b")


@query("D9_vote_with_tie_refusal", """, e AS (SELECT doc_id, text, x, word_id, floor(y / 10) token, CASE WHEN floor(y) % 2 = 0 THEN word_id % 4 END idx FROM pts), c AS (SELECT doc_id, text, count(DISTINCT token) n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER w r, lead(n) OVER w nxt FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, text)), i AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(x), min(word_id)) q FROM e WHERE idx IS NOT NULL GROUP BY doc_id, idx),
v AS (SELECT doc_id, CASE WHEN n >= 2 AND n > coalesce(nxt, 0) THEN text END winner, CASE WHEN n >= 2 AND n > coalesce(nxt, 0) THEN n END votes FROM r WHERE r = 1) SELECT v.doc_id, winner, votes, CASE WHEN winner = 'click' THEN idx END idx FROM v LEFT JOIN i ON i.doc_id = v.doc_id AND q = 1""")
def d9(v: Views) -> DataFrame:
    """The kind of event that has the most different tokens (values by tens), two at least and no tie; clicks have a sub-index, the
    one that most events state, the first seen on ties."""
    rows = v.P.select("doc_id", "text", "x", "word_id", F.floor(F.col("y") / 10).alias("token"), F.when(F.floor("y") % 2 == 0, F.col("word_id") % 4).alias("idx"))
    return ordered.voted(rows, ["doc_id"], "text", "token", "idx", ["x", "word_id"], 2).select("doc_id", "winner", "votes", F.when(F.col("winner") == "click", F.col("idx")).alias("idx"))


@query("D12_median_spacing", """, g AS (SELECT doc_id, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, word_id) g FROM pts)
SELECT doc_id, round(median(g), 3) spacing, round(least(greatest(median(g) / 2, 3600), 86400), 3) tolerance FROM g GROUP BY doc_id""")
def d12(v: Views) -> DataFrame:
    g = ordered.consecutive_gap(v.P, ["doc_id"], "x", "word_id").groupBy("doc_id").agg(F.median("gap").alias("m"))
    return g.select("doc_id", F.round("m", 3).alias("spacing"), F.round(F.least(F.greatest(F.col("m") / 2, F.lit(3600.0)), F.lit(86400.0)), 3).alias("tolerance"))


@query("D11_dominant_band", """, c AS (SELECT doc_id, floor(y / 25) band, count(*) n FROM pts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, band) r FROM c) SELECT doc_id, CAST(band AS BIGINT) band, n FROM r WHERE r = 1""")
def d11(v: Views) -> DataFrame:
    bands = v.P.groupBy("doc_id", F.floor(F.col("y") / 25).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return ordered.first_by(bands, ["doc_id"], [F.desc("n"), "band"])


SWEEP = """, o AS (SELECT unnest(range(-18, 19)) o), ax AS (SELECT doc_id, 'h' axis, word_id, text, h p, y q FROM pts UNION ALL SELECT doc_id, 'y', word_id, text, y, h FROM pts), a AS (SELECT * FROM ax WHERE text = 'click'), b AS (SELECT * FROM ax WHERE text = 'view'),
c AS (SELECT a.doc_id, a.axis, o, a.word_id a, b.word_id b, a.q, b.q bq, abs(a.p + o - b.p) d FROM a JOIN b ON a.doc_id = b.doc_id AND a.axis = b.axis AND abs(a.p - b.p) <= 24 CROSS JOIN o WHERE abs(a.p + o - b.p) <= 6),
n AS (SELECT *, row_number() OVER (PARTITION BY axis, o, a ORDER BY d, b) r FROM c),
s AS (SELECT doc_id, axis, o, count(*) pairs, count(*) FILTER (a % 3 <> 0) chk, count(*) FILTER (a % 3 <> 0 AND abs(q - bq) <= 30) sat, count(*) FILTER (b % 5 = 0) reserved FROM n WHERE r = 1 GROUP BY doc_id, axis, o),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, axis ORDER BY sat DESC, chk - sat, reserved, pairs DESC, abs(o), o) r FROM s) """


def aligned(v: Views) -> DataFrame:
    """For each user, axis (time, value) and shift of the clicks by -18 to 18 twelfths of a pitch of 12: how many clicks have a
    view within half a pitch, how many of them claim something (their id is no multiple of 3) and how many of those agree
    with it (the other coordinate lies near), and how many land on a reserved view (every fifth)."""
    axes = F.explode(F.array(F.struct(F.lit("h").alias("axis"), F.col("h").alias("p"), F.col("y").alias("q")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("p"), F.col("h").alias("q"))))
    points = v.P.select("doc_id", "word_id", "text", axes.alias("c")).select("doc_id", "word_id", "text", "c.*")
    a = points.filter("text = 'click'").select("doc_id", "axis", F.col("word_id").alias("a"), "p", "q")
    b = points.filter("text = 'view'").select("doc_id", "axis", F.col("word_id").alias("b"), F.col("p").alias("bp"), F.col("q").alias("bq"))
    agrees = F.abs(F.col("q") - F.col("bq")) <= 30
    return readings.swept(a, b, ["doc_id", "axis"], "p", "bp", 18, 6.0, "a", "b", F.col("a") % 3 != 0, agrees, F.col("b") % 5 == 0)


@query("F2_alignment_sweep", SWEEP + "SELECT doc_id, axis, CAST(o AS INTEGER) o, pairs, chk, sat, reserved FROM r WHERE r = 1")
def f2(v: Views) -> DataFrame:
    return readings.best_shift(aligned(v), ["doc_id", "axis"])


@query("C20_grid_cells", SPANS + """, n AS (SELECT c.doc_id, c.word_id, c.h, v.word_id row_id, row_number() OVER (PARTITION BY c.word_id ORDER BY abs(c.y - v.y), v.word_id) r FROM pts c JOIN pts v ON v.doc_id = c.doc_id AND v.text = 'view' AND c.text = 'click' AND abs(c.y - v.y) <= 6)
SELECT n.doc_id, n.word_id, n.row_id, round(sp.h, 4) col FROM n JOIN sp ON sp.doc_id = n.doc_id AND sp.lo <= n.h AND n.h < sp.hi WHERE r = 1""")
def c20(v: Views) -> DataFrame:
    """Clicks in a grid: the row of the nearest view by value, the column of the signup whose span holds their time."""
    rows = v.P.filter("text = 'view'").select("doc_id", F.col("word_id").alias("row_id"), F.col("y").alias("by"))
    words = near.nearest_within(v.P.filter("text = 'click'").select("doc_id", "word_id", "h", "y"), rows, ["doc_id"], "y", "by", 6.0, ["word_id"], ["row_id"])
    anchors = v.P.filter("text = 'signup'").select("doc_id", "h").distinct()
    return near.in_spans(words, ordered.midpoint_spans(anchors, ["doc_id"], "h", 60.0), ["doc_id"], "h").select("doc_id", "word_id", "row_id", F.round("span_h", 4).alias("col"))


@query("E8_hole_adoption", """, e AS (SELECT DISTINCT doc_id, word_id, h, y FROM pts WHERE text = 'view'), g AS (SELECT *, lead(h) OVER (PARTITION BY doc_id ORDER BY h, word_id) - h n FROM e), s AS (SELECT doc_id, min(n) FILTER (n > 20) p, median(y) a FROM g GROUP BY doc_id HAVING count(*) >= 3),
k AS (SELECT g.doc_id, g.h, p, a, CAST(round_even(n / p, 0) AS INTEGER) k FROM g JOIN s ON s.doc_id = g.doc_id WHERE p IS NOT NULL), t AS (SELECT doc_id, p, a, h + unnest(range(1, k)) * p slot FROM k WHERE k > 1),
c AS (SELECT t.doc_id, slot, o.word_id, row_number() OVER (PARTITION BY t.doc_id, slot ORDER BY abs(o.h - slot), o.word_id) r FROM t JOIN pts o ON o.doc_id = t.doc_id AND o.text = 'click' WHERE abs(o.h - slot) <= p / 3 AND abs(o.y - a) <= 40),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word_id ORDER BY slot) q FROM c WHERE r = 1) SELECT doc_id, round(slot, 4) slot, word_id FROM d WHERE q = 1""")
def e8(v: Views) -> DataFrame:
    """Clicks that stand where the rhythm of a user's views has a hole."""
    edge = v.P.filter("text = 'view'").select("doc_id", "word_id", "h", "y")
    spare = v.P.filter("text = 'click'").select("doc_id", "word_id", "h", "y")
    out = ordered.adopted(edge, spare, ["doc_id"], "h", "y", "word_id", 20.0, 40.0, 1 / 3)
    return out.select("doc_id", F.round("slot", 4).alias("slot"), "word_id")
