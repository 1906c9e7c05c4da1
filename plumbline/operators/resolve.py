"""Classification by ordered rules, and joins that resolve names: prefix, wildcard, one character, containment, spelling."""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ordered import first_by
from .stored import stored


def first_match(value: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first pattern that value contains; null where none does. Rules are data, compiled to one CASE."""
    out = None
    for pattern, label in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return F.lit(None).cast("string") if out is None else out


def first_group(value: Column, pattern: str, group: int = 1) -> Column:
    """A capture group, null where it is empty or unmatched."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def groups_of(pattern: str) -> int:
    """The number of capture groups of a pattern."""
    return re.compile(pattern).groups


def validated(rules: Sequence[tuple[str, str]]) -> Sequence[tuple[str, str]]:
    """The rules, if every one is a pattern that compiles and a role, and no pattern stands twice; a ValueError otherwise."""
    for pattern, role in rules:
        if not role:
            raise ValueError(f"the rule {pattern} has no role")
        try:
            groups_of(pattern)
        except re.error as e:
            raise ValueError(f"the rule {pattern} is no pattern: {e}") from e
    if len({p for p, _ in rules}) < len(rules):
        raise ValueError("a pattern stands twice; its second rule can't match")
    return rules


def classified(value: Column, rules: Sequence[tuple[str, str]], aliases: dict[str, str] | None = None) -> Column:
    """role, idx and sub by the first rule that matches: of its groups, idx is the first of digits and sub the first other
    one, folded by aliases. Null fields where nothing matches or a group is empty."""
    none = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("role", "idx", "sub")))
    out = None
    for pattern, role in validated(rules):
        groups = [F.regexp_extract(value, pattern, i + 1) for i in range(groups_of(pattern))]
        first = lambda shape, groups=groups: F.coalesce(*(F.when(g.rlike(shape), g) for g in groups), F.lit(None).cast("string"))
        sub = first("[^0-9]")
        for a, to in (aliases or {}).items():
            sub = F.when(first("[^0-9]") == a, F.lit(to)).otherwise(sub)
        row = F.struct(F.lit(role).alias("role"), first("^[0-9]+$").alias("idx"), sub.alias("sub"))
        out = F.when(value.rlike(pattern), row) if out is None else out.when(value.rlike(pattern), row)
    return none if out is None else out.otherwise(none)


def family_folded(value: Column, families: Sequence[tuple[str, str]]) -> Column:
    """The first family whose name begins value before a separator is replaced; others stay as they are."""
    out = None
    for name, to in families:
        hit = value.rlike(f"^{name}(?=[_-])")
        new = F.regexp_replace(value, f"^{name}(?=[_-])", to)
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return value if out is None else out.otherwise(value)


def normalised(value: Column, folds: Sequence[tuple[str, str]]) -> Column:
    """Upper case, trimmed, with replacements in order."""
    out = F.upper(F.trim(value))
    for pattern, to in folds:
        out = F.regexp_replace(out, pattern, to)
    return out


def hamming_one(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of equal length that differ in exactly one character, by equi-join on the masked forms."""

    def masked(df: DataFrame, c: str) -> DataFrame:
        at = F.sequence(F.lit(1), F.length(c))
        forms = F.transform(at, lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.lit("\u0000"), F.substr(F.col(c), i + 1)))
        return df.filter(F.length(c) > 0).select(c, F.explode(forms).alias("_k"))

    return masked(left, a).join(masked(right, b), "_k").filter(F.col(a) != F.col(b)).select(a, b).distinct()


def wildcard(left: DataFrame, right: DataFrame, a: str, b: str, any_char: str = "x") -> DataFrame:
    """Pairs of distinct codes of equal length whose characters agree wherever neither has the wildcard.

    Codes are told apart by their masks (length and places of wildcards), of which there are few. For every two masks of
    a length the codes meet by equi-join on the characters that both fix.
    """

    def masked(df: DataFrame, c: str) -> DataFrame:
        chars = F.split(c, "")
        mask = F.filter(F.transform(chars, lambda x, i: F.when(x == any_char, i)), lambda i: i.isNotNull())
        return df.filter(F.length(c) > 0).select(c).distinct().withColumn("_mask", mask).withColumn("_n", F.length(c))

    def fixed(c: str) -> Column:
        both = F.transform(F.split(c, ""), lambda x, i: F.when((x == any_char) | F.array_contains("_other", i), F.lit("\u0000")).otherwise(x))
        return F.array_join(both, "")

    def keyed(own: DataFrame, rest: DataFrame, c: str, mine: str, theirs: str) -> DataFrame:
        others = rest.select("_n", F.col("_mask").alias("_other")).distinct()
        return own.join(others, "_n").select(c, F.col("_mask").alias(mine), F.col("_other").alias(theirs), fixed(c).alias("_k"))

    one, two = masked(left, a), masked(right, b)
    return keyed(one, two, a, "_ma", "_mb").join(keyed(two, one, b, "_mb", "_ma"), ["_ma", "_mb", "_k"]).select(a, b)


def longest_prefix(tokens: DataFrame, names: DataFrame, token: str, name: str, least: int) -> DataFrame:
    """Each token with the longest of the names that it begins with, of at least `least` characters."""
    lengths = names.filter(F.length(name) >= least).agg(F.collect_set(F.length(name)).alias("_ends"))  # only prefixes as long as some name can hit
    ends = F.filter("_ends", lambda n: n <= F.length(token))
    pieces = tokens.filter(F.length(token) >= least).join(F.broadcast(lengths)).withColumn(name, F.explode(F.transform(ends, lambda n: F.substr(F.col(token), F.lit(1), n)))).drop("_ends")
    hits = pieces.join(names.select(name).distinct(), name)
    return hits.groupBy(*tokens.columns).agg(F.max_by(name, F.length(name)).alias(name))


def prefixes(tokens: DataFrame, names: DataFrame, token: str, name: str, driver: str, prio: str, least: int) -> DataFrame:
    """The drivers of each token's leading parts of at least `least` characters that are names: token, driver, rank.

    The longest part has the least rank; of a part's names the one of the least prio, then driver, counts. Tokens stand once
    each. Parts are many times the names: these, one row each, are hashed, and parts travel as token and length, unsorted.
    """
    lengths = names.filter(F.length(name) >= least).agg(F.collect_set(F.length(name)).alias("_ends"))  # only prefixes as long as some name can hit
    ends = F.filter("_ends", lambda n: n <= F.length(token))
    pieces = tokens.select(token).filter(F.length(token) >= least).join(F.broadcast(lengths)).select(token, F.explode(ends).alias("_n"))
    one = names.groupBy(name).agg(F.min(F.struct(prio, driver))[driver].alias(driver))
    hits = pieces.join(one.hint("shuffle_hash"), F.substr(F.col(token), F.lit(1), F.col("_n")) == F.col(name))
    return hits.select(token, driver, (-F.col("_n")).alias("rank"))


def served_in_order(options: DataFrame, group: Sequence[str], token: str, driver: str) -> DataFrame:
    """Tokens in their order, each with its first option (by rank) that no earlier token of its group took: group, token,
    driver. A token of which all are taken has no row.

    In rounds for all groups at once: every token asks for its next option, and a driver stays with the least token that
    asks. That ends in the same as serving the tokens one after the other, as all drivers prefer the same ones. A token's
    options travel with it in an array, so that a round needs no join with them. Each round is stored; only tokens that were
    turned down go on, so the rounds are as many as the longest chain of refusals.
    """
    turns = F.transform(F.sort_array(F.collect_list(F.struct("rank", driver))), lambda x: x[driver])
    every = options.groupBy(*group, token).agg(turns.alias("_turns")).select(*group, token, "_turns", F.lit(1).alias("_at"))
    every = stored(every.withColumn(driver, F.element_at("_turns", F.col("_at"))), "options")
    while True:
        least = every.groupBy(*group, driver).agg(F.min(token).alias("_least"))
        told = stored(every.join(least, [*group, driver]), "asked")
        held = told.filter(F.col(token) == F.col("_least")).drop("_least")
        refused = told.filter((F.col(token) != F.col("_least")) & (F.col("_at") < F.size("_turns"))).drop("_least", driver)
        if not refused.limit(1).count():
            return held.select(*group, token, driver)
        asking = refused.withColumn("_at", F.col("_at") + 1).withColumn(driver, F.element_at("_turns", F.col("_at")))
        every = held.unionByName(asking)


def containing(names: DataFrame, block: str, name: str, more: Sequence[Column] = (), q: int = 3) -> DataFrame:
    """Each name of a block with every longer one that contains it: block, name, _host, *more (columns of the host's row).

    A name meets its hosts on the rarest of its pieces of q letters (or on itself where it is shorter), so it has one key,
    and a host as many as it has pieces.
    """

    def grams(c: str, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, n))

    every = F.flatten(F.array(*(F.when(F.length("_host") >= n, grams("_host", F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, q + 1))))
    hosts = names.select(block, F.col(name).alias("_host"), *more).withColumn("_g", F.explode(F.array_distinct(every)))
    often = hosts.groupBy(block, "_g").agg(F.count(F.lit(1)).alias("_f"))
    own = names.select(block, name).filter(F.length(name) > 0).distinct()
    each = own.withColumn("_g", F.explode(F.array_distinct(grams(name, F.least(F.length(name), F.lit(q))))))
    rarest = each.join(often, [block, "_g"]).groupBy(block, name).agg(F.min(F.struct("_f", "_g"))["_g"].alias("_g"))
    met = rarest.join(hosts, [block, "_g"]).filter((F.length("_host") > F.length(name)) & F.col("_host").contains(F.col(name)))
    return met.drop("_g")


def merged_into_hosts(names: DataFrame, block: str, name: str, mark: str, number: str, confidence: str) -> DataFrame:
    """names (block, name, mark, number, confidence), folded into hosts: a longer name of the block that contains theirs, with an
    equal mark unless they have none, itself in no other; the longest, then the first. Numbers add up, confidence is the
    highest."""
    pairs = containing(names.select(block, name, mark).distinct(), block, name, [F.col(mark).alias("_mark")])
    a = names.select(block, name, mark)
    inside = a.join(pairs, [block, name]).filter(F.col(mark).isNull() | (F.col(mark) == F.col("_mark")))
    own = inside.select(block, F.col(name).alias("_in"), F.col(mark).alias("_in_mark")).distinct()
    top = inside.join(own, (inside[block] == own[block]) & (inside["_host"] == own["_in"]) & inside["_mark"].eqNullSafe(own["_in_mark"]), "left_anti")
    order = Window.partitionBy(block, name, mark).orderBy(F.desc(F.length("_host")), "_host", F.asc_nulls_first("_mark"))
    best = top.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(F.col(block).alias("_b"), F.col(name).alias("_n"), F.col(mark).alias("_m"), "_host", "_mark")
    out = names.join(best, (names[block] == best["_b"]) & (names[name] == best["_n"]) & names[mark].eqNullSafe(best["_m"]), "left")
    to = F.when(F.col("_host").isNull(), F.col(mark)).otherwise(F.col("_mark"))
    return out.groupBy(block, F.coalesce("_host", name).alias(name), to.alias(mark)).agg(F.sum(number).alias(number), F.max(confidence).alias(confidence))


def laddered(codes: DataFrame, names: DataFrame, code: str, name: str, family: int, any_char: str) -> DataFrame:
    """code, target and rung for each code that a name answers: the name itself (1); for a code without the wildcard behind
    its `family` characters, the only name of its family (2); for one with it, the only name of its family that fits (3)."""
    fam = lambda c: F.substring(c, 1, family)
    exact = codes.join(names, codes[code] == names[name]).select(code, F.col(name).alias("target"), F.lit(1).alias("rung"))
    loose = F.expr(f"substr({code}, {family + 1})").contains(any_char)
    rest = codes.join(exact, code, "left_anti")
    only = names.groupBy(fam(name).alias("_f")).agg(F.min(name).alias("target"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    sibling = rest.filter(~loose).withColumn("_f", fam(code)).join(only, "_f").select(code, "target", F.lit(2).alias("rung"))
    # a letter that stands for itself in a name must not pass as a wildcard
    shield = lambda c: F.translate(F.col(c), any_char, "\u0001")
    whole = names.select(name, shield(name).alias("_s"))
    marked = rest.filter(loose).select(code, F.concat(F.translate(fam(code), any_char, "\u0001"), F.expr(f"substr({code}, {family + 1})")).alias("_c"))
    fits = wildcard(marked.select("_c"), whole.select("_s"), "_c", "_s", any_char).join(marked, "_c").join(whole, "_s").select(code, name)
    third = fits.groupBy(code).agg(F.min(name).alias("target"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(code, "target", F.lit(3).alias("rung"))
    return exact.unionByName(sibling).unionByName(third)


def numbered_letters(name: str) -> Column:
    """The letters of a name, each with how often it has occurred so far, so that a bag of letters is a set."""
    chars = F.filter(F.split(name, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def distinct_names(df: DataFrame, block: Sequence[str], name: str) -> DataFrame:
    return df.select(*block, name).filter(F.length(name) > 0).distinct()


def sharing_letters(left: DataFrame, right: DataFrame, a: str, b: str, least: float, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct names of a block whose bags of letters allow a gestalt ratio of `least` (twice the matched letters /
    the sum of lengths); none that reaches it is missing.

    Such names have one of their rarest letters in common, as many as may be missing and one (prefix filter), and their
    lengths lie in a band. Of the pairs that meet so, those stay whose whole bags share enough letters.
    """
    shrink = least / (2 - least)  # the shorter name's least share of the longer
    one = distinct_names(left, block, a).withColumn("_la", numbered_letters(a))
    two = distinct_names(right, block, b).withColumn("_lb", numbered_letters(b))
    letters = lambda df, c: df.select(F.explode(c).alias("_l"))
    often = letters(one, "_la").unionByName(letters(two, "_lb")).groupBy("_l").agg(F.count(F.lit(1)).alias("_f"))

    def prefix(df: DataFrame, c: str, bag: str) -> DataFrame:
        n = F.length(c)
        need = F.ceil(least * n * (1 + shrink) / 2 - 1e-9)
        rows = df.withColumn("_l", F.explode(bag)).join(often, "_l").groupBy(*block, c, bag).agg(F.sort_array(F.collect_list(F.struct("_f", "_l"))).alias("_s"))
        return rows.select(*block, c, bag, F.explode(F.slice("_s", F.lit(1), F.greatest(n - need + 1, F.lit(1)).cast("int"))["_l"]).alias("_l"))

    enough = 2 * F.size(F.array_intersect("_la", "_lb")) >= least * (F.length(a) + F.length(b)) - 1e-9
    return prefix(one, a, "_la").join(prefix(two, b, "_lb"), [*block, "_l"]).filter(enough).select(*block, a, b).distinct()


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, least: float, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct names of a block with an edit ratio (1 - edits / the longer length) of `least`.

    A pair of lengths allows so many edits, e. The shorter name is cut into e + 1 segments; one of them stands whole in
    the longer name (pigeonhole principle), at a shift that leaves room for the edits before and behind it. So the
    names meet on lengths, number of the segment and its letters. Lengths that allow one edit only meet on the name
    without one of its letters, or whole, instead: ids that differ in a digit have long stretches in common, but not
    those. `least` lies above zero.

    The pieces are many times the names, which Spark doesn't see when it estimates a side: they are never broadcast.
    """
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is at most 1")
    one, two = distinct_names(left, block, a), distinct_names(right, block, b)
    edits = lambda longer: F.floor((1 - least) * longer + 1e-9).cast("int")
    number = lambda c: F.col(c).cast("int")

    def segment(short: Column, k: Column, i: Column) -> tuple[Column, Column]:
        """Start (from 0) and length of the i-th of k segments; the last ones are a letter longer."""
        each, more = F.floor(short / k).cast("int"), (short % k).cast("int")
        return i * each + F.greatest(F.lit(0), i - (k - more)), each + F.when(i >= k - more, 1).otherwise(0)

    def cut(df: DataFrame, c: str) -> DataFrame:
        sizes = F.sequence(F.length(c), F.floor(F.length(c) / least + 1e-9).cast("int"))
        rows = df.withColumn("_short", F.length(c)).withColumn("_long", F.explode(sizes)).filter(number("_long") - edits(F.col("_long")) <= number("_short"))
        rows = rows.filter(edits(F.col("_long")) > 1).withColumn("_k", F.least(edits(F.col("_long")) + 1, F.col("_short"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        start, size = segment(F.col("_short"), F.col("_k"), F.col("_i"))
        return rows.select(*block, c, "_short", "_long", "_i", F.substr(F.col(c), start + 1, size).alias("_piece"))

    def pieces(df: DataFrame, c: str) -> DataFrame:
        least_size = F.greatest(F.lit(1), F.length(c) - edits(F.length(c)))
        rows = df.withColumn("_long", F.length(c)).withColumn("_short", F.explode(F.sequence(least_size, F.length(c)))).withColumn("_e", edits(F.col("_long")))
        rows = rows.filter("_e > 1").withColumn("_k", F.least(F.col("_e") + 1, F.col("_short"))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        start, size = segment(F.col("_short"), F.col("_k"), F.col("_i"))
        more, i, e = F.col("_long") - F.col("_short"), F.col("_i"), F.col("_e")
        # what is inserted and deleted before and behind a segment makes up the shift and the rest of the lengths' difference
        low, high = -F.floor((e - more) / 2), F.floor((e + more) / 2)
        whole = F.col("_k") == e + 1  # with a segment for each edit, earlier and later segments bound the shift, too
        low = F.when(whole, F.greatest(low, -i, more - (e - i))).otherwise(low)
        high = F.when(whole, F.least(high, i, more + (e - i))).otherwise(high)
        rows = rows.withColumn("_from", F.greatest(F.lit(0), start + low).cast("int")).withColumn("_to", F.least(F.col("_long") - size, start + high).cast("int")).withColumn("_size", size)
        rows = rows.filter("_from <= _to").withColumn("_at", F.explode(F.sequence("_from", "_to")))
        return rows.select(*block, c, "_short", "_long", "_i", F.substr(F.col(c), F.col("_at") + 1, F.col("_size")).alias("_piece")).distinct()

    def without_one(df: DataFrame, c: str) -> DataFrame:
        rows = df.filter(edits(F.length(c)) < 2)
        shorter = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))
        return rows.select(*block, c, F.explode(F.array_distinct(F.when(edits(F.length(c)) > 0, F.concat(F.array(c), shorter)).otherwise(F.array(c)))).alias("_piece"))

    one_edit = without_one(one, a).join(without_one(two, b).hint("merge"), [*block, "_piece"]).select(*block, a, b)
    on = [*block, "_short", "_long", "_i", "_piece"]
    met = cut(one, a).join(pieces(two, b).hint("merge"), on).select(*block, a, b)
    longer = pieces(one, a).filter("_short < _long").join(cut(two, b).hint("merge"), on).select(*block, a, b)
    most = F.greatest(F.length(a), F.length(b))
    enough = F.levenshtein(a, b) <= edits(most)
    return met.unionByName(longer).unionByName(one_edit).distinct().filter(enough)


def edit_ratio(a: str, b: str) -> Column:
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 6)


def close_names(left: DataFrame, right: DataFrame, a: str, b: str, least: float, n: int, block: Sequence[str] = ()) -> DataFrame:
    """The n names most similar by edit distance for each left name (of its block), of all those with a ratio of at least `least`."""
    w = Window.partitionBy(*block, a).orderBy(F.desc("ratio"), b)
    pairs = within_edits(left, right, a, b, least, block).withColumn("ratio", edit_ratio(a, b))
    return pairs.filter(F.col("ratio") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def suggested(missing: DataFrame, offered: DataFrame, capable: DataFrame, taken: DataFrame, name: str, need: str, item: str, label: str, least: float, n: int, block: Sequence[str] = ()) -> DataFrame:
    """For each missing function (block, name, need) the n best of the offered items (block, item, label) of its block:
    name, item, label, score, rank.

    An item counts if `capable` (item, need) lists it for what the function needs (null: anything), if `taken` (block,
    item) doesn't hold it, and if its label shares a word with the name or has an edit ratio of at least `least`. The
    score is the number of shared words and the ratio. Words are runs of letters and digits that are not all digits;
    case doesn't count. Ties go to the smaller item, then label: items of one label score alike, so that for each label and
    need only the n smallest items are held against names.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.upper(F.col(c)), "[^A-Z0-9]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$")))
    want = missing.select(*block, F.col(name).alias("_name"), F.col(need).alias("_need"), F.upper(name).alias("_a")).distinct()
    have = offered.select(*block, item, F.col(label).alias("_label"), F.upper(label).alias("_b")).distinct()
    free = have.join(taken.select(*block, item).distinct(), [*block, item], "left_anti")
    each = lambda df, c: df.select(*block, c, F.explode(words(c)).alias("_w")).distinct()
    sharing = each(want, "_a").join(each(free, "_b"), [*block, "_w"]).select(*block, "_a", "_b").distinct()
    close = within_edits(want, free, "_a", "_b", least, block)
    able = capable.select(item, F.col(need).alias("_need")).filter("_need IS NOT NULL").distinct()
    kind = lambda df: df.withColumn("_any", F.col("_need").isNull()).withColumn("_kind", F.coalesce(F.col("_need").cast("string"), F.lit("")))
    every = free.withColumn("_need", F.lit(None).cast(able.schema["_need"].dataType)).unionByName(free.join(able, item))
    first = first_by(kind(every), [*block, "_label", "_any", "_kind"], [item], n).drop("_need")
    pairs = sharing.unionByName(close).distinct().join(kind(want), [*block, "_a"]).join(first, [*block, "_b", "_any", "_kind"]).drop("_any", "_kind")
    shared, ratio = F.size(F.array_intersect(words("_a"), words("_b"))), edit_ratio("_a", "_b")
    fits = pairs.filter((shared > 0) | (ratio >= least)).withColumn("score", F.round(shared + ratio, 3))
    w = Window.partitionBy(*block, "_name", "_need").orderBy(F.desc("score"), item, "_label")
    best = fits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return best.select(*block, F.col("_name").alias(name), F.col("_need").alias(need), item, F.col("_label").alias(label), "score", "rank")


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks / the sum of lengths (longest block first, then on either side of it)."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def alike(left: DataFrame, right: DataFrame, a: str, b: str, least: float, n: int) -> DataFrame:
    """The n names of highest gestalt ratio for each left name, of all those with at least `least`."""
    pairs = sharing_letters(left, right, a, b, least).withColumn("ratio", F.round(gestalt(a, b), 6)).filter(F.col("ratio") >= least)
    w = Window.partitionBy(a).orderBy(F.desc("ratio"), b)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def checked_ids(ids: DataFrame, registry: DataFrame, key: str, reserved: str, shape: str, least: float, n: int) -> DataFrame:
    """ids with status (empty, malformed, unregistered, ok), `reserved` (of a registered id, else false) and `near`, the n
    registered ids most like an unregistered one, joined by commas; null where none is as like as `least`.

    registry has one row for each id. No id is fatal; a null one is empty.
    """
    rows = ids.withColumn(key, F.coalesce(key, F.lit(""))).join(registry.select(key, F.col(reserved).alias("_r"), F.lit(True).alias("_known")), key, "left")
    status = F.when(F.col(key) == "", "empty").when(~F.col(key).rlike(shape), "malformed").when(F.col("_known").isNull(), "unregistered").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn(reserved, F.coalesce("_r", F.lit(False))).drop("_r", "_known")
    lost = rows.filter("status = 'unregistered'").select(key).distinct()
    like = close_names(lost, registry.select(F.col(key).alias("_id")), key, "_id", least, n).groupBy(key)
    near = like.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_id"))), lambda x: x["_id"]), ",").alias("near"), F.lit("unregistered").alias("status"))
    return rows.join(near, [key, "status"], "left")


def ohms(value: Column) -> Column:
    """Engineering values such as 4K7, 13.7K, 10k, 100R, 100 ohm or 100k\u03a9 as a number; null where it is none."""
    shape = r"(?i)^([0-9]+)(?:\.([0-9]+))?\s*([RKM]?)([0-9]*)\s*(?:OHMS?|\u03a9|\u2126)?$"
    whole, dot, unit, rest = (F.regexp_extract(value, shape, i) for i in (1, 2, 3, 4))
    number = F.concat(whole, F.lit("."), F.when(dot != "", dot).when(rest != "", rest).otherwise("0")).try_cast("double")
    marked = (unit != "") | F.lower(value).rlike("ohms?$|[\u03c9\u2126]$")
    return F.when(value.rlike(shape) & marked, number * F.when(F.upper(unit) == "K", 1e3).when(F.upper(unit) == "M", 1e6).otherwise(1.0))
