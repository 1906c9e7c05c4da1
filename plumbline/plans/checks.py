"""Quality checks over boards, claims and parts: each returns the rows that violate it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, ordered, resolve
from .views import Views, query


@query("L4_one_owner", "SELECT dev, pin, count(DISTINCT net) owners FROM boards GROUP BY dev, pin HAVING count(DISTINCT net) > 1")
def l4(v: Views) -> DataFrame:
    """Parts of a supplier that stand under more than one net."""
    return v.B.groupBy("dev", "pin").agg(F.countDistinct("net").alias("owners")).filter("owners > 1")


@query("L5_instances_without_pins", ", h AS (SELECT DISTINCT doc_id, dev FROM boards WHERE net = 'NO') SELECT DISTINCT b.doc_id, b.dev FROM boards b ANTI JOIN h ON h.doc_id = b.doc_id AND h.dev = b.dev")
def l5(v: Views) -> DataFrame:
    return v.B.select("doc_id", "dev").distinct().join(v.B.filter("net = 'NO'").select("doc_id", "dev").distinct(), ["doc_id", "dev"], "left_anti")


@query("L6_incapable_lines", """, k AS (SELECT pin, count(*) rows FROM truth GROUP BY 1) SELECT b.doc_id, b.seq, b.pin, b.dev, CASE WHEN t.pin IS NULL THEN 'not capable' ELSE 'out of range' END problem
FROM boards b LEFT JOIN truth t ON t.pin = b.pin AND t.signal = b.dev LEFT JOIN k ON k.pin = b.pin WHERE t.pin IS NULL OR b.seq > k.rows""")
def l6(v: Views) -> DataFrame:
    """Lines whose supplier the truth doesn't have for the part, or whose ordinal lies beyond the part's rows."""
    truth = v.claims(True).select("pin", F.col("signal").alias("dev"), F.lit(True).alias("hit"))
    counts = truth.groupBy("pin").agg(F.count(F.lit(1)).alias("rows"))
    rows = v.B.join(truth, ["pin", "dev"], "left").join(counts, "pin", "left").filter("hit IS NULL OR seq > rows")
    return rows.select("doc_id", "seq", "pin", "dev", F.when(F.col("hit"), "out of range").otherwise("not capable").alias("problem"))


@query("L7_occurrence_errors", ", r AS (SELECT pin, signal, row_number() OVER (PARTITION BY pin ORDER BY signal) k FROM claims) SELECT b.doc_id, b.seq, b.pin, b.dev, r.signal expected FROM boards b JOIN r ON r.pin = b.pin AND r.k = b.seq WHERE r.signal <> b.dev")
def l7(v: Views) -> DataFrame:
    """Lines whose ordinal selects another supplier of the part than the one stated."""
    listed = ordered.ranked(v.claims(False), ["pin"], ["signal"], "seq").select("pin", "seq", F.col("signal").alias("expected"))
    return v.B.join(listed, ["pin", "seq"]).filter("expected <> dev").select("doc_id", "seq", "pin", "dev", "expected")


@query("L9_option_conflicts", """, o AS (SELECT doc_id, CAST(qty % 8 AS INTEGER) opt, count(*) n FROM boards GROUP BY ALL) SELECT doc_id, opt, n, 'clash' problem FROM o WHERE n > 1
UNION ALL SELECT doc_id, opt, n, 'out of range' FROM o WHERE opt = 7""")
def l9(v: Views) -> DataFrame:
    """Options that several lines of an order take, and options beyond the pool."""
    used = v.B.groupBy("doc_id", (F.col("qty") % 8).cast("int").alias("opt")).agg(F.count(F.lit(1)).alias("n"))
    problems = F.array_compact(F.array(F.when(F.col("n") > 1, "clash"), F.when(F.col("opt") == 7, "out of range")))
    return used.withColumn("problem", F.explode(problems))


@query("L9_stream_conflicts", """, r AS (SELECT pin, signal, row_number() OVER (PARTITION BY pin ORDER BY signal) k FROM claims), u AS (SELECT doc_id, seq, b.pin, net, CAST(qty % 6 AS BIGINT) - 1 opt, r.signal chan FROM boards b LEFT JOIN r ON r.pin = b.pin AND r.k = b.seq),
s AS (SELECT *, CASE WHEN opt >= 0 AND opt < chan % 4 + 1 THEN (chan * 7 + opt * 3) % 16 END stream FROM u), c AS (SELECT doc_id, stream, arg_max(seq, seq) holder FROM s WHERE net <> 'NO' AND stream IS NOT NULL GROUP BY doc_id, stream)
SELECT s.doc_id, s.seq, s.pin, s.opt, s.stream, c.holder, CASE WHEN s.stream IS NULL THEN 'not an option' ELSE 'stream is taken' END problem FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.stream = s.stream WHERE net = 'NO' AND opt >= 0 AND (s.stream IS NULL OR c.holder IS NOT NULL)""")
def l9_streams(v: Views) -> DataFrame:
    """Options of the fixed style, which index each channel's own list of streams: those that are no option, and those whose
    stream another use of the order has. A line's channel is the supplier that its number selects."""
    listed = ordered.ranked(v.claims(False), ["pin"], ["signal"], "seq").select("pin", "seq", F.col("signal").alias("chan"))
    opt = (F.col("qty") % 6).cast("long") - 1
    stream = F.when((F.col("opt") >= 0) & (F.col("opt") < F.col("chan") % 4 + 1), (F.col("chan") * 7 + F.col("opt") * 3) % 16)
    uses = v.B.select("doc_id", "seq", "pin", "net", opt.alias("opt")).join(listed, ["pin", "seq"], "left").withColumn("stream", stream)
    return audit.stream_conflicts(uses.filter("net <> 'NO'"), uses.filter("net = 'NO' AND opt >= 0"), "doc_id", "stream", "seq").select("doc_id", "seq", "pin", "opt", "stream", "holder", "problem")


@query("L11_recorded_defects", """, a AS (SELECT doc_id, pin FROM boards WHERE qty <= 40 GROUP BY ALL HAVING count(*) > 1), b AS (SELECT doc_id, pin FROM boards WHERE qty >= 10 GROUP BY ALL HAVING count(*) > 1)
SELECT coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.pin, b.pin) pin, CASE WHEN a.doc_id IS NULL THEN 'new' ELSE 'vanished' END state FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pin = b.pin WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def l11(v: Views) -> DataFrame:
    """Defects of two readings held against each other: new ones fail, and so do those that vanished."""
    old, new = (F.count(F.when(c, 1)) > 1 for c in (F.col("qty") <= 40, F.col("qty") >= 10))
    rows = v.B.groupBy("doc_id", "pin").agg(old.alias("old"), new.alias("new")).filter("old <> new")
    return rows.select("doc_id", "pin", F.when(F.col("new"), "new").otherwise("vanished").alias("state"))


@query("L12_data_shape", r"""SELECT 'duplicate name' "check", p_name subject, count(*) n FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'brand pattern', p_brand, count(*) FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3][0-9]*') GROUP BY p_brand
UNION ALL SELECT 'size range', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_size > 45 GROUP BY p_size""")
def l12(v: Views) -> DataFrame:
    """Shape rules on the part table, one row for each offending value."""
    when = lambda c, name, subject: F.when(c, F.struct(F.lit(name).alias("check"), F.col(subject).cast("string").alias("subject")))
    found = F.array(
        F.struct(F.lit("duplicate name").alias("check"), F.col("p_name").alias("subject")),
        when(~F.col("p_brand").rlike("^Brand#[1-3][0-9]*$"), "brand pattern", "p_brand"), when(F.col("p_size") > 45, "size range", "p_size"),
    )
    rows = v.part.select(F.explode(F.array_compact(found)).alias("f")).groupBy("f.check", "f.subject").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("check <> 'duplicate name' OR n > 1")


@query("L13_vocabulary_gates", """, t AS (SELECT event_type || json_extract_string(props, '$.k') t FROM events UNION ALL SELECT event_type FROM events), g AS (SELECT t, regexp_matches(t, '^(click|view|purchase)[0-9]*$') named, regexp_matches(t, '^(?:click|view)([0-9]+)$|^(?:purchase)([0-9]*)$') asks, regexp_matches(t, '^[a-z]{4,}') known FROM t)
SELECT t, count(*) n, CASE WHEN NOT known THEN 'unknown' ELSE 'asks for nothing' END problem FROM g WHERE named AND NOT (known AND asks) GROUP BY t, known""")
def l13(v: Views) -> DataFrame:
    """Spellings that the classifier names but the vocabulary gate refuses or the requirement rules don't see."""
    spelt = v.events.select(F.explode(F.array(F.concat("event_type", F.get_json_object("props", "$.k")), "event_type")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("t")
    named = resolve.classified(t, [("^(click|view|purchase)[0-9]*$", "event")])["role"].isNotNull()
    asks = resolve.classified(t, [("^(?:click|view)([0-9]+)$", "look"), ("^(?:purchase)([0-9]*)$", "buy")])["role"].isNotNull()
    known = t.rlike("^[a-z]{4,}")
    return spelt.filter(named & ~(known & asks)).select("t", "n", F.when(~known, "unknown").otherwise("asks for nothing").alias("problem"))


@query("L15_named_without_function", ", h AS (SELECT DISTINCT b.doc_id, b.net FROM boards b JOIN truth t ON t.pin = b.pin AND t.signal = b.dev) SELECT DISTINCT b.doc_id, b.net FROM boards b ANTI JOIN h ON h.doc_id = b.doc_id AND h.net = b.net")
def l15(v: Views) -> DataFrame:
    """Nets of an order none of whose lines the truth supports."""
    truth = v.claims(True).select("pin", F.col("signal").alias("dev"), F.lit(1).alias("hit"))
    rows = v.B.join(truth, ["pin", "dev"], "left").groupBy("doc_id", "net").agg(F.max("hit").alias("hit"))
    return rows.filter("hit IS NULL").select("doc_id", "net")
