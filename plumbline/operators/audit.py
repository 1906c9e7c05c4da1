"""Comparing tables: claims against truth both ways, differences, digests, set conditions, allocation and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Columns = Sequence[str]


def two_way(claims: DataFrame, truth: DataFrame, on: Columns, value: str) -> DataFrame:
    """Every claim and truth row by key: exact, wrong value, not in truth, or missing from the claims."""
    a = claims.select(*on, F.col(value).alias("claimed"), F.lit(True).alias("_a"))
    b = truth.select(*on, F.col(value).alias("true_value"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "not in truth").when(F.col("_a").isNull(), "missing")
    kind = kind.when(F.col("claimed").isNull() | F.col("true_value").isNull(), "unknown").when(F.col("claimed") == F.col("true_value"), "exact").otherwise("wrong value")
    return a.join(b, list(on), "full").withColumn("kind", kind).drop("_a", "_b")


def scoped(claims: DataFrame, truth: DataFrame, scope: DataFrame, pin: str, signal: str, value: str, unit: Column, interest: Column) -> DataFrame:
    """Every claim (pin, signal, value) within the scope (pin) with its verdict, and what the claims lack: pin, signal, claimed,
    true_value, kind.

    A claim is not judged where the truth has no row for its pin (off package), or none for its signal's unit (absent
    unit); both are told. Others are not in truth, unknown (a side states no value), exact or of a wrong value. Missing
    are the truth's rows within the scope of signals that are claimed (by a judged claim) and of interest, unless the
    pair is claimed: what nobody asked for is no gap. claims and truth have one row for each pin and signal.
    """
    inside = scope.select(pin).distinct()
    own, true = (df.select(pin, signal, value).join(inside, pin, "left_semi") for df in (claims, truth))
    true = true.withColumn("_unit", unit)
    pins = true.select(pin).distinct().withColumn("_pin", F.lit(True))
    units = true.select("_unit").distinct().withColumn("_known", F.lit(True))
    both = own.withColumnRenamed(value, "claimed").join(true.select(pin, signal, F.col(value).alias("true_value"), F.lit(True).alias("_hit")), [pin, signal], "left")
    rows = both.withColumn("_unit", unit).join(pins, pin, "left").join(units, "_unit", "left")
    kind = F.when(F.col("_pin").isNull(), "off package").when(F.col("_known").isNull(), "absent unit").when(F.col("_hit").isNull(), "not in truth")
    kind = kind.when(F.col("claimed").isNull() | F.col("true_value").isNull(), "unknown").when(F.col("claimed") == F.col("true_value"), "exact").otherwise("wrong value")
    told = rows.withColumn("kind", kind).select(pin, signal, "claimed", "true_value", "kind")
    judged = told.filter("kind NOT IN ('off package', 'absent unit')").select(pin, signal)
    lacks = true.filter(interest).join(judged, [pin, signal], "left_anti").join(judged.select(signal).distinct(), signal, "left_semi")
    none = F.lit(None).cast(told.schema["claimed"].dataType)
    return told.unionByName(lacks.select(pin, signal, none.alias("claimed"), F.col(value).alias("true_value"), F.lit("missing").alias("kind")))


def summary(rows: DataFrame, family: str, pin: str, unit: Column, least: float) -> DataFrame:
    """The verdicts of scoped() by family, and of all (family "all"): numbers of claims checked, corroborated (the truth has the
    pair), exact, unknown, wrong, unsupported and missing, of pins off package and absent units; the percentage of
    checked ones that are corroborated, and a warning below `least`."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    of = lambda kind, c: F.count_distinct(F.when(F.col("kind") == kind, c))
    found = ["exact", "wrong value", "unknown"]
    out = rows.rollup(family).agg(
        F.grouping(family).alias("_all"), n(*found, "not in truth").alias("checked"), n(*found).alias("corroborated"), n("exact").alias("exact"), n("unknown").alias("unknown"), n("wrong value").alias("wrong"),
        n("not in truth").alias("unsupported"), n("missing").alias("missing"), of("off package", F.col(pin)).alias("off_package"), of("absent unit", unit).alias("absent_units"),
    )
    share = F.when(F.col("checked") > 0, 100 * F.col("corroborated") / F.col("checked"))
    out = out.withColumn(family, F.when(F.col("_all") == 1, "all").otherwise(F.col(family))).drop("_all")
    return out.withColumn("percent", F.round(share, 4)).withColumn("warning", F.coalesce(share < least, F.lit(False)))


def drift(old: DataFrame, new: DataFrame, group: Columns, parts: Sequence[Column], buckets: int) -> DataFrame:
    """The groups whose rows differ between two snapshots: group, state (added, removed, changed), old_n, new_n."""

    def side(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(*group).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return n.join(split_digest(df, group, parts, buckets, f"_{name}"), list(group))

    both = side(old, "old").join(side(new, "new"), list(group), "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    state = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed").otherwise("changed")
    return both.select(*group, state.alias("state"), "old_n", "new_n")


def supported(claims: DataFrame, truth: DataFrame, on: Columns) -> DataFrame:
    """claims with `ok`: whether truth has the key; null where truth knows nothing of the first key column."""
    known = truth.select(on[0]).distinct().withColumn("_known", F.lit(True))
    have = truth.select(*on).distinct().withColumn("_have", F.lit(True))
    out = claims.join(known, on[0], "left").join(have, list(on), "left")
    return out.withColumn("ok", F.when(F.col("_known").isNotNull(), F.col("_have").isNotNull())).drop("_known", "_have")


def difference(old: DataFrame, new: DataFrame, key: Columns, value: str) -> DataFrame:
    """Added, removed and changed keys with the old and the new value."""
    a = old.select(*key, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, list(key), "full").withColumn("change", change).filter("change IS NOT NULL").drop("_a", "_b")


def upserted(old: DataFrame, new: DataFrame, key: Columns) -> DataFrame:
    """New rows replace old rows of their key; other old rows stay."""
    return old.join(new, list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def conserved(labels: DataFrame, links: DataFrame, key: Columns) -> DataFrame:
    """Keys whose number of rows differs between two tables, with the surplus (a multiset difference)."""
    both = labels.select(*key, F.lit(1).alias("_n")).unionByName(links.select(*key, F.lit(-1).alias("_n")))
    return both.groupBy(*key).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def digest(df: DataFrame, group: Columns, parts: Sequence[Column], to: str = "digest") -> DataFrame:
    """sha256 of a group's rows, each written as text and joined in order."""
    line = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return df.groupBy(*group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias(to))


def split_digest(df: DataFrame, group: Columns, parts: Sequence[Column], buckets: int, to: str = "digest") -> DataFrame:
    """sha256 of a group's rows that no task has to hold together: of the digests of its buckets, in order.

    Rows are dealt by a hash of their text, so equal multisets of rows have equal digests.
    """
    line = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    rows = df.select(*group, line.alias("_l")).withColumn("_k", F.pmod(F.xxhash64("_l"), F.lit(buckets)))
    each = digest(rows, [*group, "_k"], [F.col("_l")], "_d")
    return digest(each, group, [F.col("_k"), F.col("_d")], to)


def by_rarity(have: DataFrame, need: DataFrame, group: Columns, item: str) -> DataFrame:
    """need with _often (how many owners an item has), _rank (the rarest of the group first, then the least), the item of the
    next rank (the last has its own), and _size (the group's items)."""
    often = have.groupBy(item).agg(F.count(F.lit(1)).alias("_often"))
    w = Window.partitionBy(*group)
    order = w.orderBy("_often", item)
    told = need.join(often, item, "left").withColumn("_often", F.coalesce("_often", F.lit(0)))
    next_one = F.coalesce(F.lead(item).over(order), F.col(item))
    return told.withColumn("_rank", F.row_number().over(order)).withColumn("_next", next_one).withColumn("_size", F.count(F.lit(1)).over(w))


def of_two_rarest(have: DataFrame, told: DataFrame, group: Columns, owner: str, item: str) -> DataFrame:
    """The owners that have both of each group's two rarest items (fewest owners, then the least item): all that can cover it.

    have has one row for each owner and item, told is from by_rarity. A group that needs what nobody has has no owner here.
    Owners of the rarest item go on with the key of the second alone, so that only those with both meet all items.
    """
    first = told.filter("_rank = 1 AND _often > 0").select(*group, item, "_next", "_size")
    either = first.join(have.select(owner, item), item).select(*group, owner, "_size", F.col("_next").alias(item))
    return either.join(have.select(owner, item), [owner, item], "left_semi").select(*group, owner, "_size")


def covering(have: DataFrame, need: DataFrame, group: Columns, owner: str, item: str) -> DataFrame:
    """Relational division: the owners that have every item that a group needs.

    Only owners of a group's two rarest items are held against its other items; a group without others meets its last.
    """
    wanted, held = need.select(*group, item).distinct(), have.select(owner, item).distinct()
    told = by_rarity(held, wanted, group, item)
    rest = told.filter("_rank > 2 OR _rank = _size").select(*group, item)
    asked = of_two_rarest(held, told, group, owner, item).join(rest, list(group))
    hits = asked.join(held, [owner, item], "left_semi").groupBy(*group, owner).agg(F.count(F.lit(1)).alias("_hit"), F.first("_size").alias("_size"))
    return hits.filter("_hit = greatest(_size - 2, 1)").select(*group, owner)


def covering_roles(have: DataFrame, need: DataFrame, group: Columns, owner: str, item: str, role: str, label: str) -> DataFrame:
    """The owners at which every item that a group needs takes a role of its own.

    An item that has one role at an owner takes it whatever its label says; of several it takes the one of its label.
    need has one row for each item of a group. Only owners of a group's two rarest items are held against all of them, and
    each owner and item has one row, with its roles.
    """
    cap = have.groupBy(owner, item).agg(F.collect_set(role).alias("_roles"))  # an item has few roles at an owner
    told = by_rarity(cap.select(owner, item), need.select(*group, item, label), group, item)
    asked = of_two_rarest(cap, told, group, owner, item).join(told.select(*group, item, label), list(group))
    taken = F.when(F.size("_roles") == 1, F.col("_roles")[0]).when(F.array_contains("_roles", F.col(label)), F.col(label))
    roles = asked.join(cap, [owner, item]).groupBy(*group, owner).agg(F.count_distinct(taken).alias("_n"), F.first("_size").alias("_size"))
    return roles.filter("_n = _size").select(*group, owner)


def waived(found: DataFrame, waivers: DataFrame, key: Columns, source: str, scope: str) -> DataFrame:
    """found with state: waived where a waiver of its key has a scope that begins its source, else open.

    The scopes of a key, which are few, travel as one row, so that found meets them once and keeps its rows."""
    scopes = waivers.groupBy(*key).agg(F.collect_set(scope).alias("_scopes"))
    covered = F.exists("_scopes", lambda s: F.col(source).startswith(s))
    return found.join(scopes, list(key), "left").withColumn("state", F.when(covered, "waived").otherwise("open")).drop("_scopes")


def stale(waivers: DataFrame, found: DataFrame, key: Columns, scope: str, source: str) -> DataFrame:
    """Waivers for which nothing of their key is found in a source that contains their scope."""
    scopes = waivers.groupBy(*key).agg(F.collect_set(scope).alias("_scopes"))
    met = found.select(*key, source).join(scopes, list(key)).select(*key, F.filter("_scopes", lambda s: F.col(source).contains(s)).alias("_u"))
    used = met.select(*key, F.explode("_u").alias("_u")).groupBy(*key).agg(F.collect_set("_u").alias("_used"))
    return waivers.join(used, list(key), "left").filter(~F.coalesce(F.array_contains("_used", F.col(scope)), F.lit(False))).drop("_used")


def refreshed(old: DataFrame, new: DataFrame, key: Columns) -> DataFrame:
    """New rows replace old ones of their key, other old ones stay; `moved` names the fields that differ."""
    fields = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_new"))
    out = old.join(fresh, list(key), "full")
    known = F.coalesce("_new", F.lit(False))
    moved = F.array_compact(F.array(*(F.when(known & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in fields)))
    return out.select(*key, *(F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.array_join(moved, ",").alias("moved"))


def common_choice(have: DataFrame, need: DataFrame, group: Columns, owner: str, item: str) -> DataFrame:
    """For each group the least owner common to its items; items that nobody has don't count; null if none is common."""
    wanted = need.select(*group, item).distinct().join(have.select(item).distinct(), item, "left_semi")
    chosen = covering(have, wanted, group, owner, item).groupBy(*group).agg(F.min(owner).alias("choice"), F.count(F.lit(1)).alias("candidates"))
    return need.select(*group).distinct().join(chosen, list(group), "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def repeated(df: DataFrame, group: Columns, item: str) -> DataFrame:
    """Items that occur more than once in a group, with their number."""
    return df.groupBy(*group, item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def against_limit(counts: DataFrame, limit: Column) -> DataFrame:
    """full, over or open for a count n; null where the limit is unknown."""
    return counts.withColumn("state", F.when(limit.isNull(), None).when(F.col("n") > limit, "over").when(F.col("n") == limit, "full").otherwise("open"))


def lacking(columns: Sequence[str], df: DataFrame) -> Column:
    """The names of the required columns that a row lacks (null, or empty text), joined."""
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "") if dict(df.dtypes)[c] == "string" else F.col(c).isNull()
    return F.array_join(F.array_compact(F.array(*(F.when(empty(c), c) for c in columns))), ",")


def required(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df, if every row has the required columns; a ValueError that names the first rows without them otherwise."""
    bad = df.withColumn("_missing", lacking(columns, df)).filter("_missing <> ''").select(key, "_missing").orderBy(key).limit(5).collect()
    if bad:
        raise ValueError("required fields are missing: " + "; ".join(f"{r[0]}: {r[1]}" for r in bad))
    return df


def stream_conflicts(first: DataFrame, later: DataFrame, document: str, stream: str, label: str) -> DataFrame:
    """The later uses of a document whose stream is null (not an option) or taken by a first use, with the last holder.

    First uses may share a stream; what must not happen is that a later one lands on it.
    """
    held = first.filter(F.col(stream).isNotNull()).groupBy(document, stream).agg(F.max(label).alias("holder"))
    problem = F.when(F.col(stream).isNull(), "not an option").when(F.col("holder").isNotNull(), "stream is taken")
    return later.join(held, [document, stream], "left").withColumn("problem", problem).filter("problem IS NOT NULL")


def missing_members(df: DataFrame, group: Columns, member: str, required: Sequence[str]) -> DataFrame:
    """Groups that hold some but not all of the required members, with those that they lack."""
    own = df.filter(F.col(member).isin(list(required))).groupBy(*group).agg(F.collect_set(member).alias("_own"))
    lack = F.sort_array(F.array_except(F.array(*map(F.lit, required)), F.col("_own")))
    return own.select(*group, F.array_join(lack, ",").alias("lacks")).filter("lacks <> ''")


def lacking_members(owners: DataFrame, have: DataFrame, members: DataFrame, owner: str, member: str, most: int = 10_000) -> DataFrame:
    """The pairs of an owner and one of the distinct members that `have` (owner, member) doesn't hold.

    Every owner carries the list of members, which is counted first; more than `most` of them are refused (a ValueError),
    as the pairs would be too many to list.
    """
    each = [r[0] for r in members.select(member).filter(F.col(member).isNotNull()).distinct().limit(most + 1).collect()]
    if len(each) > most:
        raise ValueError(f"there are more than {most} members")
    kind = members.schema[member].dataType
    listed = F.array(*(F.lit(x).cast(kind) for x in sorted(each))) if each else F.array().cast(f"array<{kind.simpleString()}>")
    held = have.groupBy(owner).agg(F.collect_set(member).alias("_held"))  # no more than `most`
    rows = owners.select(owner).join(held, owner, "left")
    lacks = F.array_except(listed, F.coalesce("_held", F.slice(listed, 1, 0)))
    return rows.select(owner, F.explode(lacks).alias(member))


def override(df: DataFrame, patch: DataFrame, key: Columns, value: str) -> DataFrame:
    """df with the values that patch gives for its keys; patch keys that df lacks are added; `replaced` tells which."""
    p = patch.select(*key, F.col(value).alias("_v"), F.lit(True).alias("_p"))
    out = df.select(*key, value, F.lit(True).alias("_d")).join(p, list(key), "full")
    return out.select(*key, F.when(F.col("_p"), F.col("_v")).otherwise(F.col(value)).alias(value), (F.coalesce("_p", F.lit(False)) & F.coalesce("_d", F.lit(False))).alias("replaced"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
