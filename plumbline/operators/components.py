"""Components named in texts, found by a table of patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category, pattern, and the pattern of the designators that its components have.
Rule = tuple[str, str, str]


def needed(pattern: str) -> list[str]:
    """Texts of which every match of a pattern holds one, in lower case: the longest literal that it can't do without, or one
    for each of its alternatives. Empty where the pattern has none, and then everything has to be searched.

    Only plain letters, digits and a few signs count; a letter that is optional or repeated from zero ends a literal, and
    so does everything in classes, or groups that are optional.
    """
    best: list[str] = []

    def better(new: list[str]) -> None:
        nonlocal best
        if new and all(new) and min(map(len, new)) > min(map(len, best), default=0):
            best = new

    run, i, depth, start = "", 0, 0, 0
    parts: list[str] = []
    while i < len(pattern):
        c = pattern[i]
        if c == "[":  # a class
            i = pattern.index("]", i + 2)
            better([run]) if not depth else None
            run = "" if not depth else run
        elif c == "(":
            if not depth:
                better([run])
                run, start = "", i
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth and pattern[i + 1 : i + 2] not in ("?", "*", "{"):
                inner = re.sub(r"^[?]:", "", pattern[start + 1 : i])
                parts = [needed(x) for x in split_alternatives(inner)]
                better([y for x in parts for y in x] if all(parts) else [])
        elif c == "\\":
            i += 1
            if not depth:
                literal = not pattern[i].isalnum()
                run, done = (run + pattern[i], "") if literal else ("", run)
                better([done])
        elif not depth:
            if c in "?*{":
                better([run[:-1]])
                run = ""
                i = pattern.index("}", i) if c == "{" else i
            elif c in "+.^$":
                better([run])
                run = ""
            else:
                run += c
        i += 1
    better([run])
    return sorted({x.lower() for x in best})


def split_alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its outermost level."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def literals(pattern: str) -> list[str]:
    own = [needed(x) for x in split_alternatives(pattern)]
    return sorted({y for x in own for y in x}) if all(own) else []


#: Where an ASCII letter, digit or underscore meets anything else.
BOUND = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def plain_bounds(pattern: str) -> str:
    """The pattern with \\b as SQL has it, by ASCII words; Java's takes the letters of every script for parts of words."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + BOUND, pattern)


def found_in(line: str, at: str, rules: Sequence[Rule]) -> Column:
    """The hits of all rules in a line, as an array of category, part, designator, confidence and order."""
    lower = F.lower(line)

    def hits(number: int, category: str, pattern: str, designator: str) -> Column:
        every = F.regexp_extract_all(line, F.lit(f"(?i){plain_bounds(pattern)}"), F.lit(0))

        def one(m: Column, i: Column) -> Column:
            before = F.substr(F.col(line), F.lit(1), F.position(m, F.col(line)) - 1)
            name = F.try_element_at(F.regexp_extract_all(before, F.lit(plain_bounds(designator)), F.lit(0)), F.lit(-1))
            sure = F.when(name.isNotNull(), 0.9).otherwise(0.8 if len(pattern) > 12 else 0.6)
            return F.struct(F.lit(category).alias("category"), F.upper(F.regexp_replace(m, r"\s+", "")).alias("part"), name.alias("designator"), sure.alias("confidence"), F.struct(F.lit(number).alias("rule"), F.col(at).alias("line"), i.alias("pos")).alias("order"))

        some = literals(pattern)
        given = F.transform(every, one)
        if not some:
            return given
        held = lower.contains(some[0])
        for x in some[1:]:
            held = held | lower.contains(x)
        return F.when(held, given).otherwise(F.slice(given, 1, 0))

    return F.flatten(F.array(*(hits(k, *r) for k, r in enumerate(rules))))


def components(docs: DataFrame, key: str, text: str, rules: Sequence[Rule]) -> DataFrame:
    """key, category, part, designator, instances and confidence of the components that texts name.

    Rules are data: every match of a pattern (in any case, within a line) is a hit, whose part is written in capitals
    without white space. Its designator is the last match of the rule's other pattern in the line before the part's first
    place there. Hits of a category with one designator are one component, and so are those of one part without any; it
    has the part of the first hit (by rule, line, place). A hit is 0.9 sure with a designator, 0.8 by a long pattern
    (more than 12 characters), else 0.6; a component as sure as its surest hit.

    A text is split into lines only if it holds one of the literals that some pattern can't do without, and a line is
    searched by a pattern only if it holds one of that pattern's.
    """
    some = [literals(p) for _, p, _ in rules]
    rows = docs.filter(F.col(text).isNotNull())
    if all(some):
        rows = rows.filter(F.lower(text).rlike("|".join(re.escape(x) for x in sorted({y for x in some for y in x}))))
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("_at", "_line"))
    hits = lines.select(key, F.explode(found_in("_line", "_at", rules)).alias("h")).select(key, "h.*")
    name = F.coalesce("designator", "part")
    out = hits.groupBy(key, "category", name.alias("_name")).agg(
        F.min_by("part", "order").alias("part"), F.max("designator").alias("designator"), F.count(F.lit(1)).alias("instances"), F.max("confidence").alias("confidence"),
    )
    return out.drop("_name")
