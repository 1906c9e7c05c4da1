"""Queries that classify and resolve names, and scans of text."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, components, resolve
from ..operators.stored import stored
from .views import Views, query


# Rules are data: a pattern with up to two groups, and the role it gives. The first that matches wins; of its groups the
# first of digits is the index, the first other one the sub-role, folded by ALIASES.
RULES = [("^([A-Z][a-z]*)-?([0-9]+)$", "named"), ("^([0-9]+)$", "number"), ("^(un|re)([0-9]*)[a-z]+$", "prefixed"), ("^([a-z]+)(?:tion|ment)$", "noun"), ("^(THE|The|the|and|of)$", "function"), ("^([A-Z])[a-z]+$", "capital")]
ALIASES = {"un": "not", "re": "again", "The": "the", "THE": "the"}


def rules_sql(token: str) -> str:
    """The same rules as SQL: role, idx and sub."""

    def first(p: str, wanted: str) -> str:
        each = [f"regexp_extract({token}, '{p}', {i + 1})" for i in range(resolve.groups_of(p))]
        return "CASE " + " ".join(f"WHEN regexp_full_match({x}, '{wanted}') THEN {x}" for x in each) + " END"

    pick = lambda f: "CASE " + " ".join(f"WHEN regexp_matches({token}, '{p}') THEN {f(p, r)}" for p, r in RULES) + " END"
    sub = pick(lambda p, r: first(p, ".*[^0-9].*"))
    alias = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in ALIASES.items())
    return f"{pick(lambda p, r: chr(39) + r + chr(39))} role, {pick(lambda p, r: first(p, '[0-9]+'))} idx, CASE {sub} {alias} ELSE {sub} END sub"


@query("B1_ordered_rules", f", t AS (SELECT regexp_replace(token, '[.,]+$', '') t, count(*) n FROM toks GROUP BY 1), c AS (SELECT {rules_sql('t')}, n FROM t) SELECT role, idx, sub, CAST(sum(n) AS BIGINT) n FROM c GROUP BY role, idx, sub")
def b1(v: Views) -> DataFrame:
    """Tokens without closing punctuation, classified to role, index and sub-role; each distinct token once."""
    t = v.T.groupBy(F.regexp_replace("token", "[.,]+$", "").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return t.select(resolve.classified(F.col("t"), RULES, ALIASES).alias("c"), "n").groupBy("c.role", "c.idx", "c.sub").agg(F.sum("n").alias("n"))


@query("B2_normalised_names", r"""SELECT p_partkey, CASE WHEN u LIKE 'SMALL\_%' ESCAPE '\' THEN 'S' || substr(u, 6) WHEN u LIKE 'OLD\_%' ESCAPE '\' THEN 'O' || substr(u, 4) ELSE u END name FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper(trim(p_name)), 'IIC', 'I2C', 'g'), '_PIN$', ''), '[ .]+', '_', 'g') u FROM part)""")
def b2(v: Views) -> DataFrame:
    """Upper case, spellings, suffix and separators in order; then the first family whose name stands before a separator is folded."""
    text = resolve.normalised(F.col("p_name"), [("IIC", "I2C"), ("_PIN$", ""), ("[ .]+", "_")])
    return v.part.select("p_partkey", resolve.family_folded(text, [("SMALL", "S"), ("OLD", "O")]).alias("name"))


@query("B3_requirement_extraction", """, e AS (SELECT event_id, event_type || json_extract_string(props, '$.k') t FROM events) SELECT event_id, CASE WHEN regexp_matches(t, '^(?:click|view)([0-9]+)$') THEN 'look' WHEN regexp_matches(t, '^(?:purchase)([0-9]*)$') THEN 'buy' END kind,
CASE WHEN regexp_matches(t, '^(?:click|view)([0-9]+)$') THEN regexp_extract(t, '^(?:click|view)([0-9]+)$', 1) WHEN regexp_matches(t, '^(?:purchase)([0-9]*)$') THEN nullif(regexp_extract(t, '^(?:purchase)([0-9]*)$', 1), '') END idx FROM e""")
def b3(v: Views) -> DataFrame:
    """Kind and index that the name of an event asks for; null where it constrains nothing."""
    name = F.concat("event_type", F.get_json_object("props", "$.k"))
    rule = resolve.classified(name, [("^(?:click|view)([0-9]+)$", "look"), ("^(?:purchase)([0-9]*)$", "buy")])
    return v.events.select("event_id", rule.alias("c")).select("event_id", F.col("c.role").alias("kind"), "c.idx")


@query("B4_vocabulary_gate", "SELECT doc_id, count(*) n FROM toks WHERE regexp_matches(token, '^[A-Za-z]{3,}$') AND NOT regexp_matches(token, '(?i)^(the|and|with)$') GROUP BY doc_id")
def b4(v: Views) -> DataFrame:
    ok = lambda t: t.rlike("^[A-Za-z]{3,}$") & ~t.rlike("(?i)^(the|and|with)$")
    return v.documents.select("doc_id", F.size(F.filter(v.tokens, ok)).cast("long").alias("n")).filter("n > 0")


@query("B5_token_tagging", """, p AS (SELECT token, CASE WHEN regexp_matches(token, '^[0-9]') THEN 'pin' WHEN contains(token, '@') THEN 'supply' WHEN regexp_matches(token, '^[a-z]+(-[a-z]*)*$') THEN 'function' END tag, len(list_filter(regexp_split_to_array(token, '[-/]'), lambda x: x <> '')) k FROM toks)
SELECT tag, count(*) n, count(DISTINCT token) kinds, CAST(sum(k) AS BIGINT) pieces FROM p GROUP BY tag""")
def b5(v: Views) -> DataFrame:
    """Pin first, else supply, else function; the pieces of a joined token, without empty ones."""
    t = v.T.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tag = resolve.first_match(F.col("token"), [("^[0-9]", "pin"), ("@", "supply"), ("^[a-z]+(-[a-z]*)*$", "function")])
    pieces = F.size(F.filter(F.split("token", "[-/]"), lambda x: x != ""))
    return t.select(tag.alias("tag"), "n", (pieces * F.col("n")).alias("k")).groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("pieces"))


PREFIXES = ("re", "un", "in", "th")


@query("B6_echo_filter", """, n AS (SELECT doc_id, pos, token, replace(regexp_replace(translate(token, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]', '', 'g'), '0', '') k FROM toks), d AS (SELECT doc_id, list(DISTINCT k) ks FROM n GROUP BY doc_id),
a AS (SELECT doc_id, pos, token, substr(token, 3) rest FROM toks WHERE substr(token, 1, 2) IN ('re', 'un', 'in', 'th') AND length(token) > 2), c AS (SELECT doc_id, pos, token, list_filter(list_transform([rest, CASE WHEN length(rest) > 1 THEN rest[:-2] END, CASE WHEN length(rest) > 2 THEN rest[:-3] END, CASE WHEN length(rest) > 3 THEN rest[:-4] END],
  lambda r: replace(regexp_replace(translate(r, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]', '', 'g'), '0', '')), lambda r: r <> '') keys FROM a) SELECT c.doc_id, pos, token FROM c JOIN d ON d.doc_id = c.doc_id WHERE NOT list_has_any(ks, keys)""")
def b6(v: Views) -> DataFrame:
    """Prefixed tokens that are no annotation of another token of their document: what follows the prefix, whole or without its
    last one to three characters, is none of them, in capitals without separators and zeros; all within the row."""
    norm = lambda c: F.replace(F.regexp_replace(F.translate(c, ascii_lowercase, ascii_uppercase), "[^A-Z0-9]", ""), F.lit("0"), F.lit(""))
    prefixed = lambda t: F.substr(t, F.lit(1), F.lit(2)).isin(*PREFIXES) & (F.length(t) > 2)
    found = F.filter(F.transform("a", lambda t, i: F.struct(i.alias("pos"), t.alias("token"))), lambda s: prefixed(s["token"]))
    rows = v.documents.select("doc_id", v.all_tokens.alias("a")).select("doc_id", "a", found.alias("found")).filter(F.size("found") > 0)

    def keys(t: Column) -> Column:
        size = F.length(t) - 2
        cut = [norm(F.when(size > n, F.substr(t, F.lit(3), size - n))) for n in range(4)]
        return F.filter(F.array(*cut), lambda k: k.isNotNull() & (k != ""))

    rows = rows.select("doc_id", F.transform("found", lambda s: F.struct(s["pos"].alias("pos"), s["token"].alias("token"), keys(s["token"]).alias("keys"))).alias("found"), F.array_distinct(F.transform("a", norm)).alias("names"))
    # only what some prefixed token leaves needs to be looked for
    rows = rows.select("doc_id", "found", F.array_intersect(F.flatten(F.transform("found", lambda s: s["keys"])), "names").alias("echo"))
    kept = F.filter("found", lambda s: ~F.arrays_overlap(s["keys"], F.col("echo")))
    return rows.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.pos", "s.token")


@query("B9_document_triage", """, c AS (SELECT d.doc_id, count(token) n, count(CASE WHEN length(token) >= 6 THEN 1 END) long, count(CASE WHEN regexp_matches(token, '^[A-Z]') THEN 1 END) caps FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN n < 25 THEN 'no text' WHEN long < 5 THEN 'unmapped' WHEN caps < 8 THEN 'no names' ELSE 'unaligned' END class FROM c""")
def b9(v: Views) -> DataFrame:
    count = lambda c: F.size(F.filter("t", c))
    rows = v.documents.select("doc_id", F.coalesce(v.tokens, F.array().cast("array<string>")).alias("t"))
    rows = rows.select("doc_id", F.size("t").alias("n"), count(lambda t: F.length(t) >= 6).alias("long"), count(lambda t: t.rlike("^[A-Z]")).alias("caps"))
    return rows.select("doc_id", F.expr("CASE WHEN n < 25 THEN 'no text' WHEN long < 5 THEN 'unmapped' WHEN caps < 8 THEN 'no names' ELSE 'unaligned' END").alias("class"))


@query("B10_message_groups", "SELECT CASE WHEN contains(event_type, 'sign') THEN 'account' WHEN contains(event_type, 'view') OR contains(event_type, 'click') THEN 'browse' ELSE 'other' END grp, count(*) n FROM events GROUP BY ALL")
def b10(v: Views) -> DataFrame:
    group = F.coalesce(resolve.first_match(F.col("event_type"), [("sign", "account"), ("view|click", "browse")]), F.lit("other"))
    return v.events.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("B11_provenance_flags", "SELECT regexp_matches(source, '^src[0-4]$') released, count(*) n FROM documents GROUP BY ALL")
def b11(v: Views) -> DataFrame:
    return v.documents.groupBy(F.col("source").rlike("^src[0-4]$").alias("released")).agg(F.count(F.lit(1)).alias("n"))


@query("B12_first_contained", "SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 'fast' WHEN contains(p_type, 'STEEL') THEN 'slow' WHEN contains(p_type, 'TIN') THEN 'inert' END rate FROM part")
def b12(v: Views) -> DataFrame:
    return v.part.select("p_partkey", resolve.first_match(F.col("p_type"), [("BRASS", "fast"), ("STEEL", "slow"), ("TIN", "inert")]).alias("rate"))


@query("B13_marking_normalisation", "SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') norm, regexp_matches(p_name, '(?i)(dnp|red)') unfitted FROM part")
def b13(v: Views) -> DataFrame:
    return v.part.select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z0-9]", "").alias("norm"), F.col("p_name").rlike("(?i)(dnp|red)").alias("unfitted"))


@query("B14_plausibility", "SELECT CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN 'out of range' WHEN l_quantity IN (10, 20, 30) THEN 'typical' WHEN l_quantity IN (13) THEN 'implausible' ELSE 'plausible' END verdict, count(*) n FROM lineitem GROUP BY ALL")
def b14(v: Views) -> DataFrame:
    q = F.col("l_quantity")
    verdict = F.when(~q.between(1, 45), "out of range").when(q.isin(10.0, 20.0, 30.0), "typical").when(q.isin(13.0), "implausible").otherwise("plausible")
    return v.lineitem.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("B15_feature_gate", """, n AS (SELECT doc_id, count(*) n FROM boards GROUP BY doc_id)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no driver' WHEN o_orderpriority LIKE '5%' THEN 'switched off' WHEN coalesce(n, 0) < 3 THEN 'too few members' ELSE 'emitted' END gate FROM orders LEFT JOIN n ON doc_id = o_orderkey""")
def b15(v: Views) -> DataFrame:
    size = v.B.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    gate = F.when(F.col("o_orderstatus") == "P", "no driver").when(F.col("o_orderpriority").startswith("5"), "switched off").when(F.coalesce("n", F.lit(0)) < 3, "too few members").otherwise("emitted")
    return v.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").join(size, "o_orderkey", "left").select("o_orderkey", gate.alias("gate"))


@query("B16_decision_ladder", """, d AS (SELECT doc_id, min(dev) device FROM boards GROUP BY doc_id) SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderkey % 97 = 0 THEN 'X' WHEN o_orderstatus <> 'P' THEN o_orderstatus END value,
CASE WHEN o_orderpriority LIKE '5%' THEN 'inert' WHEN o_orderkey % 97 = 0 THEN 'given' WHEN o_orderstatus <> 'P' THEN 'read' ELSE 'not told' END reason, device FROM orders LEFT JOIN d ON doc_id = o_orderkey""")
def b16(v: Views) -> DataFrame:
    """Nothing for exempt families; else the operator's value, else the one read, else null with its reason; and the first device within reach."""
    given = v.orders.filter("o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("given"))
    device = v.B.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.min("dev").alias("device"))
    read, exempt = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.col("o_orderpriority").startswith("5")
    out = v.orders.join(given, "o_orderkey", "left").join(device, "o_orderkey", "left")
    reason = F.when(exempt, "inert").when(F.col("given").isNotNull(), "given").when(read.isNotNull(), "read").otherwise("not told")
    return out.select("o_orderkey", F.when(~exempt, F.coalesce("given", read)).alias("value"), reason.alias("reason"), "device")


@query("C13_containment_merge", """, u AS (SELECT p_brand, split_part(p_name, ' ', 1) p_name, p_size FROM part UNION ALL SELECT p_brand, p_name, p_size FROM part), a AS (SELECT p_brand, p_name, nullif(p_size % 3, 0) mark, count(*) n, max(p_size) conf FROM u GROUP BY ALL),
i AS (SELECT a.p_brand, a.p_name, a.mark, b.p_name host, b.mark host_mark FROM a JOIN a b ON a.p_brand = b.p_brand AND length(b.p_name) > length(a.p_name) AND contains(b.p_name, a.p_name) AND (a.mark IS NULL OR a.mark = b.mark)),
t AS (SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.p_brand = i.p_brand AND j.p_name = i.host AND j.mark IS NOT DISTINCT FROM i.host_mark)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name, mark ORDER BY length(host) DESC, host, host_mark NULLS FIRST) r FROM t),
m AS (SELECT a.p_brand, coalesce(r.host, a.p_name) p_name, CASE WHEN r.host IS NULL THEN a.mark ELSE r.host_mark END mark, a.n, a.conf FROM a LEFT JOIN r ON r.p_brand = a.p_brand AND r.p_name = a.p_name AND r.mark IS NOT DISTINCT FROM a.mark AND r = 1)
SELECT p_brand, p_name, CAST(mark AS INTEGER) mark, CAST(sum(n) AS BIGINT) n, max(conf) confidence FROM m GROUP BY p_brand, p_name, mark""")
def c13(v: Views) -> DataFrame:
    """Names folded into the longest longer name of their brand that contains them, unless their marks differ; numbers add up, the best confidence stays."""
    short = v.part.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p_name"), "p_size")
    every = short.unionByName(v.part.select("p_brand", "p_name", "p_size")).withColumn("mark", F.nullif(F.col("p_size") % 3, F.lit(0)))
    names = every.groupBy("p_brand", "p_name", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("confidence"))
    return resolve.merged_into_hosts(names, "p_brand", "p_name", "mark", "n", "confidence")


def plain_words(v: Views, listed: Column, shape: str) -> DataFrame:
    """Tokens in lower case without signs, each word once (token), and whether it is a name (named): one of its tokens is of that
    shape, of letters alone, and in a document that is listed. A name whose lower case has signs begins no word and is left out.

    Texts are read once, only distinct tokens are folded, and the words are stored, as they are asked for several times.
    """
    seen = v.T.groupBy("token").agg(F.max(listed).alias("listed"))
    word = F.regexp_replace(F.lower("token"), r"[^\p{L}\p{N}]", "")
    named = F.col("listed") & F.col("token").rlike(shape) & (F.lower("token") == word)
    return stored(seen.select(word.alias("token"), named.alias("named")).groupBy("token").agg(F.max("named").alias("named")), "words")


@query("C14_longest_prefix", r""", d AS (SELECT DISTINCT lower(token) driver FROM toks WHERE doc_id % 10 = 0 AND regexp_full_match(token, '[A-Za-z]{4,}')), al AS (SELECT substr(driver, 1, 5) a, min(driver) driver FROM d WHERE length(driver) >= 8 GROUP BY 1),
k AS (SELECT k, arg_min(driver, prio) driver FROM (SELECT driver k, driver, 1 prio FROM d UNION ALL SELECT a, driver, 0 FROM al) GROUP BY k), t AS (SELECT DISTINCT regexp_replace(lower(token), '[^\p{L}\p{N}]', '', 'g') token FROM toks), s AS (SELECT token, unnest(range(4, length(token) + 1)) n FROM t WHERE length(token) >= 4),
o AS (SELECT s.token, k.driver, row_number() OVER (PARTITION BY s.token ORDER BY s.n DESC) k FROM s JOIN k ON k.k = substr(s.token, 1, s.n)),
r(n, token, k, lost) AS (SELECT 0, token, CAST(1 AS BIGINT), TRUE FROM o WHERE k = 1 UNION ALL SELECT n, token, k, lost FROM (SELECT n, token, k, lost, bool_or(lost) OVER () again FROM (SELECT n + 1 n, r.token, CASE WHEN r.token > min(r.token) OVER (PARTITION BY o.driver) THEN r.k + 1 ELSE r.k END k, r.token > min(r.token) OVER (PARTITION BY o.driver) lost FROM r JOIN o ON o.token = r.token AND o.k = r.k)) WHERE again)
SELECT o.token, o.driver FROM r JOIN o ON o.token = r.token AND o.k = r.k WHERE r.n = (SELECT max(n) FROM r)""")
def c14(v: Views) -> DataFrame:
    """Drivers of tokens by their longest leading part, aliases before names. Tokens are served in order: one whose driver an
    earlier one has taken goes on to its next shorter part. The dictionary is that of every tenth document."""
    words = plain_words(v, F.col("doc_id") % 10 == 0, r"^[A-Za-z]{4,}\z")
    drivers = words.filter("named").select(F.col("token").alias("driver"))
    aliases = drivers.filter(F.length("driver") >= 8).groupBy(F.substring("driver", 1, 5).alias("name")).agg(F.min("driver").alias("driver")).withColumn("prio", F.lit(0))
    names = drivers.select(F.col("driver").alias("name"), "driver", F.lit(1).alias("prio")).unionByName(aliases)
    return resolve.served_in_order(resolve.prefixes(words, names, "token", "name", "driver", "prio", 4), [], "token", "driver")


@query("C14_longest_prefix_all", r""", n AS (SELECT DISTINCT lower(token) name FROM toks WHERE regexp_full_match(token, '\p{L}{4,}')),
t AS (SELECT DISTINCT regexp_replace(lower(token), '[^\p{L}\p{N}]', '', 'g') token FROM toks), s AS (SELECT token, unnest(range(4, length(token) + 1)) k FROM t WHERE length(token) >= 4)
SELECT token, arg_max(name, length(name)) name FROM s JOIN n ON name = substr(token, 1, k) GROUP BY token""")
def c14_all(v: Views) -> DataFrame:
    """The longest name that each token begins with, without aliases, whoever else has it."""
    words = plain_words(v, F.lit(True), r"^\p{L}{4,}\z")
    return resolve.longest_prefix(words.select("token"), words.filter("named").select(F.col("token").alias("name")), "token", "name", 4)


@query("C15_hamming_one", """, a AS (SELECT DISTINCT p_brand a FROM part), b AS (SELECT DISTINCT p_brand b FROM part) SELECT a, b FROM a JOIN b ON length(a) = length(b) WHERE hamming(a, b) = 1""")
def c15(v: Views) -> DataFrame:
    brand = v.part.select(F.col("p_brand").alias("a")).distinct()
    return resolve.hamming_one(brand, brand.withColumnRenamed("a", "b"), "a", "b")


@query("C16_wildcard_codes", """, a AS (SELECT DISTINCT CASE WHEN c_custkey % 13 = 0 THEN substr(c_name, 1, 16) || 'x' || substr(c_name, 18) ELSE c_name END code FROM customer),
p AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(c_name, '.$', 'x') ELSE 'xu' || substr(c_name, 3, 14) || 'xx' END pattern FROM customer WHERE c_custkey % 7 = 0)
SELECT code, pattern FROM a JOIN p ON length(code) = length(pattern) AND len(list_filter(range(1, length(code) + 1), lambda i: code[i] <> pattern[i] AND code[i] <> 'x' AND pattern[i] <> 'x')) = 0""")
def c16(v: Views) -> DataFrame:
    """Codes and patterns with wildcards at either's end, middle or beginning."""
    n, key = F.col("c_name"), F.col("c_custkey")
    codes = v.customer.select(F.when(key % 13 == 0, F.concat(F.substring(n, 1, 16), F.lit("x"), F.expr("substr(c_name, 18)"))).otherwise(n).alias("code"))
    patterns = v.customer.filter("c_custkey % 7 = 0").select(F.when(key % 2 == 0, F.regexp_replace(n, ".$", "x")).otherwise(F.concat(F.lit("xu"), F.substring(n, 3, 14), F.lit("xx"))).alias("pattern"))
    return resolve.wildcard(codes, patterns, "code", "pattern")


def misspelt(v: Views) -> tuple[DataFrame, DataFrame]:
    """Names with a letter changed, and the names."""
    names = v.customer.select(F.col("c_mktsegment").alias("name")).unionByName(v.part.select(F.col("p_name").alias("name"))).distinct()
    return names.select(F.regexp_replace("name", "^([^aeI]*)[aeI]", "$1y").alias("wrong")).distinct(), names


@query("C18_close_names", """, a AS (SELECT DISTINCT c_mktsegment name FROM customer UNION SELECT DISTINCT p_name FROM part), m AS (SELECT DISTINCT regexp_replace(name, '[aeI]', 'y') wrong FROM a),
g AS (SELECT wrong, name, round(1 - levenshtein(wrong, name) / greatest(length(wrong), length(name)), 6) ratio FROM m, a),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY wrong ORDER BY ratio DESC, name) AS INTEGER) rank FROM g WHERE ratio >= 0.5) SELECT wrong, name, ratio, rank FROM r WHERE rank <= 3""")
def c18(v: Views) -> DataFrame:
    return resolve.close_names(*misspelt(v), "wrong", "name", 0.5, 3)


@query("C18_suggestions", r""", w AS (SELECT DISTINCT regexp_replace(p_name, '[aeI]', 'y') missing, CASE WHEN p_size % 3 > 0 THEN p_size % 5 END need FROM part),
o AS (SELECT p_partkey pin, p_name label FROM part WHERE p_partkey % 7 > 0), k AS (SELECT DISTINCT pin, signal % 5 need FROM claims),
p AS (SELECT missing, w.need, pin, label, len(list_intersect(string_split(upper(missing), ' '), string_split(upper(label), ' '))) shared, round(1 - levenshtein(upper(missing), upper(label)) / greatest(length(missing), length(label)), 6) ratio FROM w, o
  WHERE w.need IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.pin = o.pin AND k.need = w.need)),
r AS (SELECT *, round(shared + ratio, 3) score, CAST(row_number() OVER (PARTITION BY missing, need ORDER BY round(shared + ratio, 3) DESC, pin, label) AS INTEGER) rank FROM p WHERE shared > 0 OR ratio >= 0.5)
SELECT missing, need, pin, label, score, rank FROM r WHERE rank <= 3""")
def c18_suggestions(v: Views) -> DataFrame:
    """For names of parts with a letter changed and what they need (a class of suppliers, or nothing): the three best parts that
    have such a supplier and are not taken (every seventh is), by shared words and spelling."""
    wrong = F.regexp_replace("p_name", "^([^aeI]*)[aeI]", "$1y")
    missing = v.part.select(wrong.alias("missing"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 5).cast("long").alias("need")).distinct()
    offered = v.part.select(F.col("p_partkey").alias("pin"), F.col("p_name").alias("label"))
    capable = v.claims(False).select("pin", (F.col("signal") % 5).alias("need"))
    taken = v.part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("pin"))
    return resolve.suggested(missing, offered, capable, taken, "missing", "need", "pin", "label", 0.5, 3)


@query("C12_nearest_left", r"SELECT doc_id, line_no, list_extract(regexp_extract_all(string_split(line, ' and ')[1], '\b[A-Z][a-z]+'), -1) designator FROM lns WHERE contains(line, ' and ') AND regexp_matches(string_split(line, ' and ')[1], '\b[A-Z][a-z]+')")
def c12(v: Views) -> DataFrame:
    """The last capitalised word before the first keyword of a line."""
    words = F.regexp_extract_all(F.substring_index("line", " and ", 1), F.lit(components.plain_bounds(r"\b[A-Z][a-z]+")), F.lit(0))
    out = v.L.filter(F.col("line").contains(" and ")).select("doc_id", "line_no", F.try_element_at(words, F.lit(-1)).alias("designator"))
    return out.filter("designator IS NOT NULL")


@query("H1_engineering_values", """, q AS (SELECT DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) q FROM lineitem), u AS (SELECT q || s t, CASE s WHEN 'R' THEN q::DOUBLE WHEN 'K7' THEN (q || '.7')::DOUBLE * 1000 WHEN 'M' THEN q::DOUBLE * 1000000 WHEN 'k' THEN q::DOUBLE * 1000 WHEN '.5kΩ' THEN (q || '.5')::DOUBLE * 1000 WHEN ' ohm' THEN q::DOUBLE END ohms
FROM q, (VALUES ('R'), ('K7'), ('M'), ('Z'), ('k'), ('.5kΩ'), (' ohm'), ('')) s(s)) SELECT t, round(ohms, 3) ohms FROM u""")
def h1(v: Views) -> DataFrame:
    q = v.lineitem.select(F.col("l_quantity").cast("int").cast("string").alias("q")).distinct()
    t = q.select(F.explode(F.array(*(F.concat("q", F.lit(s)) for s in ("R", "K7", "M", "Z", "k", ".5kΩ", " ohm", "")))).alias("t"))
    return t.select("t", F.round(resolve.ohms(F.col("t")), 3).alias("ohms"))


@query("H2_last_number", r"SELECT doc_id, line_no, CAST(list_extract(regexp_extract_all(line, '[0-9]+'), -1) AS VARCHAR) last FROM lns WHERE regexp_matches(line, '[0-9]')")
def h2(v: Views) -> DataFrame:
    return v.L.filter(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", F.try_element_at(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0)), F.lit(-1)).alias("last"))


@query("H3_label_tidy", "SELECT p_partkey, trim(substr(regexp_replace(p_name, '[_#-]', ' ', 'g'), 1, 15)) label FROM part")
def h3(v: Views) -> DataFrame:
    return v.part.select("p_partkey", F.trim(F.substring(F.regexp_replace("p_name", "[_#-]", " "), 1, 15)).alias("label"))


@query("H4_key_renames", "SELECT o_orderkey, upper(regexp_replace(o_orderpriority, '^([0-9])-', 'P\\1_')) k FROM orders")
def h4(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", F.upper(F.regexp_replace("o_orderpriority", "^([0-9])-", "P$1_")).alias("k"))


@query("H6_array_helpers", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_type, ' '), lambda x: x <> ''))), ',') parts FROM part")
def h6(v: Views) -> DataFrame:
    return v.part.select("p_partkey", F.array_join(F.sort_array(F.array_distinct(F.filter(F.split("p_type", " "), lambda x: x != ""))), ",").alias("parts"))


@query("H7_json_access", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') k FROM events")
def h7(v: Views) -> DataFrame:
    return v.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"))


@query("H10_token_pieces", ", t AS (SELECT DISTINCT token FROM toks WHERE contains(token, '-')) SELECT token, unnest(list_distinct(list_concat([token], list_filter(string_split(token, '-'), lambda x: x <> '')))) piece FROM t")
def h10(v: Views) -> DataFrame:
    t = v.T.filter(F.col("token").contains("-")).select("token").distinct()
    return t.select("token", F.explode(F.array_distinct(F.concat(F.array("token"), F.filter(F.split("token", "-"), lambda x: x != "")))).alias("piece"))


@query("G4_union_of_readings", "SELECT doc_id, count(*) n FROM (SELECT doc_id, lower(token) t FROM toks UNION SELECT doc_id, regexp_replace(lower(token), '[.,]$', '') FROM toks UNION SELECT doc_id, upper(token) FROM toks) WHERE regexp_matches(t, '^[a-z]+$') GROUP BY doc_id")
def g4(v: Views) -> DataFrame:
    """How many distinct names a document has in any reading of its tokens: as they are, without closing punctuation, in capitals."""
    read = F.flatten(F.transform(v.tokens, lambda t: F.array(F.lower(t), F.regexp_replace(F.lower(t), "[.,]$", ""), F.upper(t))))
    return v.documents.select("doc_id", F.size(F.array_distinct(F.filter(read, lambda t: t.rlike("^[a-z]+$")))).cast("long").alias("n")).filter("n > 0")


@query("D28_vocabulary_census", r"SELECT regexp_replace(token, '[0-9]', 'n', 'g') shape, count(DISTINCT doc_id) docs, count(*) n FROM toks WHERE regexp_matches(token, '[0-9]') GROUP BY ALL")
def d28(v: Views) -> DataFrame:
    shape = F.regexp_replace("token", "[0-9]", "n").alias("shape")
    return v.T.filter(F.col("token").rlike("[0-9]")).groupBy(shape).agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))


@query("A1_markup_scan", """, a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 0) m FROM pages), x AS (SELECT page_id, unnest(m) m, unnest(range(len(m))) pos FROM a)
SELECT page_id, CAST(pos AS INTEGER) pos, regexp_extract(m, '<a href="([^"]*)">([^<]*)</a>', 1) href, replace(regexp_extract(m, '<a href="([^"]*)">([^<]*)</a>', 2), '&amp;', '&') text FROM x""")
def a1(v: Views) -> DataFrame:
    from ..sources.markup import elements

    return elements(v.pages, "page_id", "html", '<a href="([^"]*)">([^<]*)</a>', ["href", "text"])


@query("A1_positioned_words", """, w AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY floor(h / 168)) k, x, word_id, CASE WHEN word_id % 7 = 0 THEN 'R&D ' || text ELSE text END text, word_id % 100 / 4 x0, word_id % 90 / 8 y0, word_id % 13 = 0 bad, word_id % 11 = 0 empty FROM pts)
SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE k END AS INTEGER) page, CAST(row_number() OVER (PARTITION BY doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE k END ORDER BY x, word_id) - 1 AS INTEGER) pos, text, CASE WHEN NOT bad THEN x0 END x0, y0, x0 + 2.5 x1, y0 + 1 y1, empty, CASE WHEN bad THEN 'box is no number' END problem FROM w QUALIFY NOT empty""")
def a1_words(v: Views) -> DataFrame:
    """Events written as pages (weeks) of words with boxes, or without pages for every fifth user, and scanned again."""
    from ..sources.markup import positioned_words

    number, text = F.col("word_id"), F.when(F.col("word_id") % 7 == 0, F.concat(F.lit("R&amp;D "), "text")).otherwise(F.col("text"))
    x0, y0 = (number % 100) / 4, (number % 90) / 8
    shown = [F.when(number % 13 == 0, "1.2.3").otherwise(x0.cast("string")), y0.cast("string"), (x0 + 2.5).cast("string"), (y0 + 1).cast("string")]
    word = F.concat(F.lit('<word xMin="'), shown[0], F.lit('" yMin="'), shown[1], F.lit('" xMax="'), shown[2], F.lit('" yMax="'), shown[3], F.lit('">'), F.when(number % 11 == 0, " ").otherwise(text), F.lit("</word>"))
    words = v.P.select("doc_id", F.floor(F.col("h") / 168).alias("week"), F.struct("x", "word_id", word.alias("w")).alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["w"]), "\n")
    sheets = words.groupBy("doc_id", "week").agg(body.alias("b"))
    paged = F.when(F.col("doc_id") % 5 == 0, F.col("b")).otherwise(F.concat(F.lit('<page width="9">'), "b", F.lit("</page>")))
    docs = sheets.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("week", paged.alias("b")))), lambda s: s["b"]), "\n").alias("xml"))
    return positioned_words(docs, "doc_id", "xml").select("doc_id", "page", "pos", "text", "x0", "y0", "x1", "y1", F.lit(False).alias("empty"), "problem")


@query("A2_nested_flatten", ", k AS (SELECT event_id, unnest(json_keys(props)) \"key\", props FROM events) SELECT event_id, \"key\", json_extract_string(props, '$.' || \"key\") \"value\" FROM k")
def a2(v: Views) -> DataFrame:
    return v.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("A3_pipe_table", """, c AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda x: trim(x)) cells FROM lns WHERE contains(line, ' | ')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cells[1] ORDER BY line_no) r FROM c) SELECT doc_id, line_no, cells[1] id, CAST(len(cells) AS INTEGER) arity, CASE WHEN cells[1] = '' THEN 'empty id' WHEN r > 1 THEN 'duplicate id' END problem FROM r""")
def a3(v: Views) -> DataFrame:
    from ..sources.markup import pipe_rows

    return pipe_rows(v.L.filter(F.col("line").contains(" | ")), "doc_id", "line_no", "line")


@query("A3_registry_tables", """, l AS (SELECT c_custkey // 24 doc, c_custkey line_no, CASE c_custkey % 24 WHEN 0 THEN CASE WHEN c_custkey % 48 = 0 THEN '| Manufacturer Id |Name|Contact|' ELSE 'no table yet' END WHEN 1 THEN '|-|:-:|--|' WHEN 7 THEN '```' WHEN 9 THEN '``` ' WHEN 11 THEN '|AB|two|' WHEN 13 THEN '| |empty||' WHEN 15 THEN '|id|again|x|' WHEN 16 THEN c_name
  ELSE '|' || CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE upper(substr(c_mktsegment, 1, 3)) || c_custkey % 4 END || '| ' || c_name || '|' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'u' END || '|' END line FROM customer),
f AS (SELECT *, starts_with(trim(line), '```') fence, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY doc ORDER BY line_no) % 2 = 1 inside FROM l),
c AS (SELECT doc, line_no, list_transform(string_split(trim(line), '|')[2:-2], lambda x: trim(x)) cells FROM f WHERE NOT fence AND NOT inside AND starts_with(trim(line), '|')), d AS (SELECT * FROM c WHERE len(list_filter(cells, lambda x: x <> '' AND NOT regexp_full_match(x, ':?-+:?'))) > 0),
k AS (SELECT *, lower(cells[1]) IN ('manufacturer id', 'id') lk, sum((lower(cells[1]) IN ('manufacturer id', 'id'))::INT) OVER (PARTITION BY doc ORDER BY line_no) n FROM d), r AS (SELECT doc, line_no, cells, CASE WHEN len(cells) = 3 AND cells[1] <> '' THEN cells[1] END id FROM k WHERE NOT (lk AND n = 1)),
x AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY doc, id ORDER BY line_no) > 1 again FROM r)
SELECT doc, line_no, id, array_to_string(cells, ';') cells, id IS NOT NULL AND NOT again entry, CASE WHEN len(cells) <> 3 THEN 'expected 3 columns, got ' || len(cells) WHEN cells[1] = '' THEN 'empty id' WHEN again THEN 'duplicate id' WHEN NOT regexp_full_match(cells[1], '[A-Z0-9]{3,4}') THEN 'odd id' END problem FROM x
UNION ALL SELECT doc, NULL, NULL, NULL, FALSE, 'no header' FROM l WHERE doc NOT IN (SELECT doc FROM k WHERE lk) GROUP BY doc""")
def a3_tables(v: Views) -> DataFrame:
    """Customers written as the lines of small registries with fences, headers and rows that are wrong, and read again."""
    from ..sources.markup import pipe_tables

    k, name = F.col("c_custkey"), F.col("c_name")
    own = F.when(k % 5 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), (k % 4).cast("string")))
    line = F.concat(F.lit("|"), own, F.lit("| "), name, F.lit("|"), F.when(k % 3 == 0, "").otherwise("u"), F.lit("|"))
    odd = {0: F.when(k % 48 == 0, "| Manufacturer Id |Name|Contact|").otherwise("no table yet"), 1: "|-|:-:|--|", 7: "```", 9: "``` ", 11: "|AB|two|", 13: "| |empty||", 15: "|id|again|x|", 16: name}
    shown = None
    for n, text in odd.items():
        shown = F.when(k % 24 == n, text) if shown is None else shown.when(k % 24 == n, text)
    lines = v.customer.select(F.floor(k / 24).alias("doc"), k.alias("line_no"), shown.otherwise(line).alias("line"))
    out = pipe_tables(lines, "doc", "line_no", "line", ["Manufacturer Id", "id"], "^[A-Z0-9]{3,4}$")
    return out.withColumn("cells", F.array_join("cells", ";"))


@query("A6_first_literal", r"SELECT doc_id, arg_min(t, line_no) value FROM (SELECT doc_id, line_no, TRY_CAST(regexp_extract(line, '\b[0-9]{1,9}\b') AS INTEGER) t FROM lns) WHERE t IS NOT NULL GROUP BY doc_id")
def a6(v: Views) -> DataFrame:
    n = F.regexp_extract("line", r"\b[0-9]{1,9}\b", 0).try_cast("int")
    return v.L.withColumn("t", n).filter("t IS NOT NULL").groupBy("doc_id").agg(F.min_by("t", "line_no").alias("value"))


@query("A7_catalogue_harvest", """, m AS (SELECT doc_id, 1 k, 'state' category, unnest(regexp_extract_all(text, '[a-z]+ment[a-z]*')) w FROM documents UNION ALL SELECT doc_id, 2, 'action', unnest(regexp_extract_all(text, '[a-z]+tion[a-z]*')) FROM documents UNION ALL SELECT doc_id, 3, 'any', unnest(regexp_extract_all(text, '[a-z]+ing')) FROM documents),
g AS (SELECT w, k, category, min(doc_id) first_doc, count(*) n FROM m WHERE length(w) >= 6 AND w NOT IN ('mentment', 'tiontion') GROUP BY w, k, category), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY k) r FROM g) SELECT category, w, first_doc, n FROM r WHERE r = 1""")
def a7(v: Views) -> DataFrame:
    """Words by an ordered list of patterns, without rejected and short ones; the first pattern that finds a word gives its category."""
    patterns = [("[a-z]+ment[a-z]*", "state"), ("[a-z]+tion[a-z]*", "action"), ("[a-z]+ing", "any")]

    def hits(k: int) -> Column:
        pattern, category = patterns[k]
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda w: F.struct(w.alias("w"), F.lit(k).alias("k"), F.lit(category).alias("category")))

    found = F.flatten(F.array(*map(hits, range(len(patterns)))))
    words = v.documents.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*").filter(F.length("w") >= 6)
    stop = v.spark.createDataFrame([("mentment",), ("tiontion",)], "w string")
    each = words.join(F.broadcast(stop), "w", "left_anti").groupBy("w", "k", "category").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("w").agg(F.min(F.struct("k", "category", "first_doc", "n")).alias("b")).select("b.category", "w", "b.first_doc", "b.n")


@query("A8_read_back", """, m AS (SELECT page_id, regexp_extract_all(html, '([a-z]+)="[^"]*"', 0) m FROM pages), x AS (SELECT page_id, unnest(m) m, unnest(range(len(m))) pos FROM m)
SELECT page_id, regexp_extract(m, '^[a-z]+') name, arg_max(regexp_extract(m, '"([^"]*)"', 1), pos) "value" FROM x GROUP BY ALL""")
def a8(v: Views) -> DataFrame:
    """Attributes of a page, the last value of each."""
    m = v.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('([a-z]+)="[^"]*"'), F.lit(0))).alias("pos", "m"))
    return m.groupBy("page_id", F.regexp_extract("m", "^[a-z]+", 0).alias("name")).agg(F.max_by(F.regexp_extract("m", '"([^"]*)"', 1), "pos").alias("value"))


@query("A9_hash_inventory", "SELECT sha256(text) digest, min(doc_id) first_doc, count(*) copies FROM documents WHERE text IS NOT NULL AND strlen(text) <= 4000 AND text IN (SELECT text FROM documents WHERE doc_id % 5 = 0) GROUP BY text")
def a9(v: Views) -> DataFrame:
    """First document and number of copies of every registered digest, of texts up to 4000 bytes (the size cap of the inventory)."""
    docs = v.documents.filter((F.octet_length("text") <= 4000)).select("doc_id", F.sha2("text", 256).alias("digest"))
    registered = docs.filter("doc_id % 5 = 0").select("digest").distinct()
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).join(registered, "digest", "left_semi")


@query("A10_required_fields", "SELECT d.doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN coalesce(trim(lang), '') = '' THEN 'lang' END], lambda x: x IS NOT NULL), ',') missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a10(v: Views) -> DataFrame:
    """What required fields each document lacks; `audit.required` fails the load where any does."""
    rows = v.documents.select("doc_id", "lang").join(v.labels, "doc_id", "left")
    return rows.select("doc_id", audit.lacking(["quality", "toxic", "lang"], rows).alias("missing"))


@query("C17_target_ladder", """, nm AS (SELECT DISTINCT substr(token, 1, 5) name FROM toks WHERE doc_id % 97 = 0 AND regexp_matches(token, '^[A-Z][a-z]{4}')), n4 AS (SELECT DISTINCT token name FROM toks WHERE doc_id % 97 = 0 AND regexp_full_match(token, '[a-z]{4}')),
c AS (SELECT doc_id, pos, substr(token, 1, 5) code FROM toks WHERE regexp_matches(token, '^[A-Z][a-z]{4}')), k AS (SELECT DISTINCT code FROM c),
e AS (SELECT code, code target, 1 rung FROM k WHERE code IN (SELECT name FROM nm)),
w AS (SELECT code, min(name) target, 3 rung FROM k JOIN nm ON substr(name, 1, 2) = substr(code, 1, 2) AND regexp_full_match(name, replace(code, 'x', '.')) WHERE contains(substr(code, 3), 'x') GROUP BY code HAVING count(*) = 1),
s AS (SELECT code, min(name) target, 2 rung FROM k JOIN nm ON substr(name, 1, 2) = substr(code, 1, 2) WHERE NOT contains(substr(code, 3), 'x') GROUP BY code HAVING count(*) = 1),
r AS (SELECT code, target, rung, row_number() OVER (PARTITION BY code ORDER BY rung) r FROM (SELECT * FROM e UNION ALL SELECT * FROM w UNION ALL SELECT * FROM s)),
d AS (SELECT c.doc_id, arg_min(target, pos) target, arg_min(rung, pos) rung FROM c JOIN r ON r.code = c.code AND r = 1 GROUP BY c.doc_id),
f AS (SELECT doc_id, arg_min(substr(token, 1, 3) || substr(token, 5, 1), pos) target, 4 rung FROM toks WHERE regexp_full_match(token, '[a-z]{5}') AND substr(token, 1, 3) || substr(token, 5, 1) IN (SELECT name FROM n4) AND doc_id NOT IN (SELECT doc_id FROM d) GROUP BY doc_id)
SELECT * FROM d UNION ALL SELECT * FROM f""")
def c17(v: Views) -> DataFrame:
    """The name that a document's first resolvable code stands for: the exact one (1), the only one of its family (2), the only one that its x fits (3); else a name by line and last letter (4). The names are those of every 97th document."""
    codes = v.T.filter(F.col("token").rlike("^[A-Z][a-z]{4}")).select("doc_id", "pos", F.substring("token", 1, 5).alias("code"))
    names = codes.filter("doc_id % 97 = 0").select(F.col("code").alias("name")).distinct()
    targets = resolve.laddered(codes.select("code").distinct(), names, "code", "name", 2, "x")
    first = codes.join(targets, "code").groupBy("doc_id").agg(F.min(F.struct("pos", "target", "rung")).alias("b")).select("doc_id", "b.target", "b.rung")
    short = v.T.filter((F.col("doc_id") % 97 == 0) & F.col("token").rlike("^[a-z]{4}$")).select(F.col("token").alias("target")).distinct()
    last = v.T.filter(F.col("token").rlike("^[a-z]{5}$")).select("doc_id", "pos", F.concat(F.substring("token", 1, 3), F.substring("token", 5, 1)).alias("target")).join(short, "target")
    last = last.join(first, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("target", "pos").alias("target")).withColumn("rung", F.lit(4))
    return first.unionByName(last)


@query("K1_gestalt_ratio", None)
def k1(v: Views) -> DataFrame:
    return resolve.alike(*misspelt(v), "wrong", "name", 0.6, 3)


@query("H8_date_stamps", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') stamp, strftime(o_orderdate, '%Y-%m-%d') < '1998-06-01' old FROM orders")
def h8(v: Views) -> DataFrame:
    """Year-month-day stamps, compared as text; there is no date arithmetic."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    return v.orders.select("o_orderkey", stamp.alias("stamp"), (stamp < "1998-06-01").alias("old"))
