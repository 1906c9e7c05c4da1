"""Assignments within bounded groups (the lines of an order, the parts of a sheet), over all groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import covering
from .ordered import first_by
from .stored import shared_folder, stored

Columns = Sequence[str]


def conflict_free(groups: DataFrame, document: str, group: str, options: str, more: Columns = ()) -> DataFrame:
    """One option for each group of a document, all distinct: document, group, pick and solved, and `more` columns of groups.

    Groups are served by (number of options, group as text); of all assignments the lexicographically first counts.
    Where none exists every group takes its first option (null if it has none) and `solved` is false.

    Two folds over a document's groups. One gives each group its first option that is not gone; where it comes to the end
    it is the answer. Elsewhere a group may have to leave its first free option to a later one, but only among the
    groups up to the last one that has no more options than groups stand before it: whoever comes after always finds
    one. For those the states of a fold hold partial assignments. Two of them that have used the same of the options
    which later ones of these groups may want have the same futures, so only the first one stays: options that nobody
    else wants make no states, and neither do groups that have fewer options among them than they are. The rest take
    their first free option again. Every fold looks at all options.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.size(options).alias("n"), F.col(group).cast("string").alias("t"), F.col(group).alias("g"), F.sort_array(F.array_distinct(F.array_compact(options))).cast("array<bigint>").alias("o"), *more)))
    own = groups.repartition(document).groupBy(document).agg(rows.alias("r"))  # the rows of a document are apart until then
    none = F.array().cast("array<bigint>")

    def first_free(picks: Column, r: Column) -> Column:
        return F.array_append(picks, F.get(F.array_except(r["o"], picks), F.lit(0)))

    own = own.withColumn("p", F.aggregate("r", none, first_free))
    last = F.array_max(F.transform("r", lambda x, i: F.when(F.size(x["o"]) <= i, i + 1)))
    short = F.slice("r", 1, F.coalesce(last, F.lit(0)))
    later = lambda i: F.array_distinct(F.flatten(F.transform(F.slice(short, i + 2, F.size(short)), lambda y: y["o"])))
    states = "array<struct<used:array<bigint>,picks:array<bigint>>>"
    union = lambda i: F.array_distinct(F.flatten(F.transform(F.slice(short, 1, i + 1), lambda y: y["o"])))
    few = F.exists(F.transform(short, lambda _, i: F.size(union(i)) <= i), lambda x: x)
    start = F.when(~few, F.array(F.struct(none.alias("used"), none.alias("picks"))))

    def step(acc: Column, s: Column) -> Column:
        grown = lambda a, x: F.struct(F.array_sort(F.array_intersect(F.array_append(a["used"], x), s["later"])).alias("used"), F.array_append(a["picks"], x).alias("picks"))
        every = F.flatten(F.transform(acc, lambda a: F.transform(F.array_except(s["o"], a["picks"]), lambda x: grown(a, x))))
        same = lambda kept, x: F.try_element_at(kept, F.lit(-1))["used"].eqNullSafe(x["used"])
        return F.aggregate(F.sort_array(every), F.array().cast(states), lambda kept, x: F.when(same(kept, x), kept).otherwise(F.array_append(kept, x)))

    held = F.get(F.aggregate(F.transform(short, lambda x, i: F.struct(x["o"].alias("o"), later(i).alias("later"))), start.cast(states), step), F.lit(0))["picks"]
    looked = F.aggregate(F.slice("r", F.size(short) + 1, F.size("r")), held, first_free)
    solved = own.select(document, "r", F.when(~F.exists("p", F.isnull), F.col("p")).otherwise(looked).alias("p"))
    each = solved.select(document, F.col("p").isNotNull().alias("solved"), F.explode(F.arrays_zip("r", F.coalesce("p", F.transform("r", lambda x: F.get(x["o"], F.lit(0)))).alias("p"))).alias("z"))
    return each.select(document, F.col("z.r.g").alias(group), F.col("z.p").alias("pick"), "solved", *(F.col("z.r")[c].alias(c) for c in more))


def owners_served(owners: DataFrame, able: DataFrame, document: str, owner: str, wire: str, unit: str) -> DataFrame:
    """A unit for each owner of a document, from its wires (document, owner, wire) and what they can do (able: wire, unit):
    document, owner, pick, solved and `shares`, the number of owners on the same wires.

    Owners with the same set of wires are one group and get one unit; others get different ones. A group's options are
    the units that all of its wires can serve. They depend on the wires alone, so a set of wires is looked up once, however
    many documents have it; the rows of a document are brought together once, and owners travel with their group.
    """
    known = owners.filter(F.col(document).isNotNull()).repartition(document)
    sets = known.groupBy(document, owner).agg(F.array_sort(F.transform(F.collect_set(F.struct(wire)), lambda w: w[wire])).alias("_set"))
    shared = stored(sets.groupBy(document, "_set").agg(F.collect_list(F.struct(owner)).alias("_owners")), "wires")
    held = stored(able.select(wire, unit).distinct(), "able")
    need = shared.select("_set").distinct().select("_set", F.explode("_set").alias(wire))
    fits = covering(held, need, ["_set"], unit, wire).groupBy("_set").agg(F.collect_set(unit).alias("_options"))
    groups = shared.join(fits, "_set", "left").withColumn("_options", F.coalesce("_options", F.array().cast("array<bigint>")))
    by_text = F.array_join(F.array_sort(F.col("_set").cast("array<string>")), "+")
    served = conflict_free(groups.select(document, by_text.alias("_wires"), "_options", "_owners"), document, "_wires", "_options", ["_owners"])
    each = served.select(document, F.explode("_owners").alias("_o"), "pick", "solved", F.size("_owners").cast("long").alias("shares"))
    return each.select(document, F.col("_o")[owner].alias(owner), "pick", "solved", "shares")


def greedy(df: DataFrame, group: Columns, order: Column, item: str, options: str, taken: str | None = None) -> DataFrame:
    """In order, each item of a group takes its first option that nobody has taken: group, seq, item, free, pick, owners.

    `taken`, a column that is the same for all rows of a group, lists options that are gone before. An item all of whose
    options are taken has free = false, its first option as pick, and the items that took them as owners (sorted). A
    fold over the group's sorted items; groups are small (pins of a part, lines of an order). Its state is what is gone and
    what each item took; of an item's options only one more than are gone can matter. Owners are found after it, for the
    items that took nothing alone.
    """
    rows = F.sort_array(F.collect_list(F.struct(order.alias("order"), F.col(item).cast("long").alias("item"), F.col(options).cast("array<bigint>").alias("options"))))
    gone = F.coalesce(F.first(taken).cast("array<bigint>"), F.array().cast("array<bigint>")) if taken else F.array().cast("array<bigint>")
    own = df.groupBy(*group).agg(rows.alias("_r"), gone.alias("_t"))
    start = F.struct(F.col("_t").alias("gone"), F.array().cast("array<bigint>").alias("picks"))

    def step(acc: Column, r: Column) -> Column:
        near = F.slice(F.array_compact(r["options"]), 1, F.size(acc["gone"]) + 1)
        picked = F.array(F.get(F.array_except(near, acc["gone"]), F.lit(0)))  # an array, so that transform names it once
        grown = lambda p: F.struct(F.when(p.isNull(), acc["gone"]).otherwise(F.array_append(acc["gone"], p)).alias("gone"), F.array_append(acc["picks"], p).alias("picks"))
        return F.get(F.transform(picked, grown), F.lit(0))

    def told(z: Column, i: Column) -> Column:
        r, pick = z["_r"], z["_k"]
        owners = F.transform(F.filter(F.slice("_z", 1, i), lambda y: F.array_contains(r["options"], y["_k"])), lambda y: y["_r"]["item"])
        return F.struct(
            r["order"].alias("order"), r["item"].alias("item"), pick.isNotNull().alias("free"), F.coalesce(pick, F.get(r["options"], F.lit(0))).alias("pick"),
            F.when(pick.isNull(), F.array_sort(F.array_distinct(owners))).otherwise(F.array().cast("array<bigint>")).alias("owners"),
        )

    folded = own.select(*group, F.arrays_zip("_r", F.aggregate("_r", start, step)["picks"].alias("_k")).alias("_z"))
    return folded.select(*group, F.explode(F.transform("_z", told)).alias("z")).select(*group, "z.*")


def repaired(rows: DataFrame, options: DataFrame, document: str, index: str, item: str, unit: str, kind: str, protected: str) -> DataFrame:
    """Clash repair to a fixed point: rows (document, index, item, unit, kind) with `now`, the unit after all moves.

    A unit that serves several kinds in a document clashes. In each round, the first row by index that stands in such a
    unit, isn't of the protected kind and has an alternative takes the first of its item's options (item, place, option)
    whose unit then serves one kind only. A document goes on until it has no move. It ends: a move takes a row out of a
    clashing unit and makes no other clash, so a document has no more rounds than rows. Only documents that moved take
    part in the next round; those without a clash take part in none, and those that are done are set aside.
    """
    spark = rows.sparkSession
    state = rows.select(document, index, item, F.col(unit).alias("now"), kind)
    clash = state.groupBy(document, "now").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).filter("lo <> hi")
    active = stored(state.join(clash.select(document).distinct(), document, "left_semi"), "clashing")
    done = shared_folder(spark, "repaired")
    while True:
        kinds = active.groupBy(document, "now").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi"))
        stuck = active.filter(F.col(kind) != protected).join(kinds.filter("lo <> hi").select(document, "now"), [document, "now"])
        there = kinds.select(document, F.col("now").alias("option"), "lo", "hi")
        moves = stuck.join(options, item).filter(F.col("option") != F.col("now")).join(there, [document, "option"], "left")
        moves = moves.filter(F.col("lo").isNull() | (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col(kind)))
        chosen = stored(first_by(moves, [document], [index, "place", "option"]).select(document, F.col(index).alias("_i"), "option"), "moves")
        active.join(chosen, document, "left_anti").select(document, index, "now").write.mode("append").parquet(done)
        if not chosen.limit(1).count():
            break
        moved = active.join(chosen, document).withColumn("now", F.when(F.col(index) == F.col("_i"), F.col("option")).otherwise(F.col("now")))
        active = stored(moved.select(*active.columns), "active")
    end = spark.read.schema(active.select(document, index, "now").schema).parquet(done).withColumnRenamed("now", "_now")
    return rows.join(end, [document, index], "left").withColumn("now", F.coalesce("_now", unit)).drop("_now")
