"""Parts of a drawing: edges peeled off one by one, and parts that make up one whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import gap_clusters, within
from .stored import stored

Columns = Sequence[str]
BOX = ("x0", "x1", "y0", "y1")


def largest_clusters(items: DataFrame, group: Columns, tolerance: tuple[float, float]) -> DataFrame:
    """items (group, ..., x0, x1, y0, y1) with a flag for each anchor (_x0 ... _y1): whether the item is in the largest gap
    cluster of its group along that coordinate, the lowest on ties. Everything stays where the group is: no shuffle if
    items are dealt by group."""
    anchors = F.explode(F.array(*(F.struct(F.lit(c).alias("_anchor"), (F.col(c) / tolerance[c[0] == "y"]).alias("_p")) for c in BOX)))
    each = items.withColumn("_a", anchors).select(*items.columns, "_a.*")
    line = [*group, "_anchor"]
    each = gap_clusters(each, line, "_p", "_p", 1.0, "_c").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*line, "_c")))
    best = F.max(F.struct("_n", -F.col("_c"))).over(Window.partitionBy(*line))
    hit = F.struct("_n", -F.col("_c")) == best
    return each.withColumn("_hit", hit).groupBy(*items.columns).agg(*(F.bool_or(F.col("_hit") & (F.col("_anchor") == c)).alias(f"_{c}") for c in BOX))


def dealt_by(df: DataFrame, group: Columns, rows: int) -> DataFrame:
    """df dealt into tasks by group, so many that each has about `rows` rows however many there are (a group stays whole)."""
    tasks = -(-df.count() // rows)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *group)


def peeled(items: DataFrame, group: Columns, item: str, tolerance: tuple[float, float], least: int, most: int = 6, rows: int = 200_000) -> DataFrame:
    """The edges of each group's drawing, strongest first, in at most `most` rounds: group, item, box, round, side.

    An edge is the largest gap cluster along an anchor: the left or the right ends of boxes, their tops or their bottoms
    (tolerance along x, along y). The left and the right edge are taken together; a box on both belongs to the larger,
    to the right on ties, to the left if they are the same boxes. A row of tops (or of bottoms, if those are more) wins
    only if it is larger than both together; it is a top or a bottom by the middle of the frame, which is the box around
    all items at first and around the edges taken so far then. Fewer than `least` boxes make no edge, and the group is
    done. All groups take a round at once; what a round leaves is stored with the groups' frames, without the groups
    that are done. Rows that repeat an item of a group with its box count once. A task takes about `rows` rows, so that its
    memory doesn't grow with the table (partitions of a set number, or of a set size in the shuffle, hold ever more).
    """
    w = Window.partitionBy(*group)
    names = [*group, item, *BOX]
    frame = {f"f{c}": (F.min if c.endswith("0") else F.max)(c).over(w) for c in BOX}
    rest = dealt_by(items.select(*group, item, *(F.col(c).cast("double").alias(c) for c in BOX)), group, rows).withColumns(frame)
    n = lambda c: F.count(F.when(c, 1)).over(w)
    rounds = []
    for turn in range(1, most + 1):
        left, right, top, bottom = (F.col(f"_{c}") for c in BOX)
        marked = largest_clusters(rest, group, tolerance).withColumns({"_l": n(left), "_r": n(right), "_lr": n(left & right), "_t": n(top), "_b": n(bottom)})
        same = (F.col("_l") == F.col("_lr")) & (F.col("_r") == F.col("_lr"))
        columns = F.when(same, F.col("_l")).otherwise(F.col("_l") + F.col("_r") - F.col("_lr"))
        row = F.greatest("_t", "_b")
        to_right = ~same & (F.col("_r") >= F.col("_l"))
        upright = F.when(left & ~(right & to_right), "L").when(right & ~same & ~(left & ~to_right), "R")
        flat = F.when(F.when(F.col("_b") > F.col("_t"), bottom).otherwise(top), "H")
        dealt = marked.withColumn("side", F.when(row > columns, flat).otherwise(upright)).filter(F.greatest(row, columns) >= least)
        # the sides of an edge bound it: boxes of the left edge on the left, of the right edge on the right
        own = F.col("side").isNotNull()
        of = lambda f, c, ok: f(F.when(own & ok, F.col(c))).over(w)
        bound = {"ex0": F.coalesce(of(F.min, "x0", F.col("side") != "R"), of(F.min, "x0", own)), "ex1": F.coalesce(of(F.max, "x1", F.col("side") != "L"), of(F.max, "x1", own)), "ey0": of(F.min, "y0", own), "ey1": of(F.max, "y1", own), "_at": of(F.avg, "y0", own)}
        facing = F.when(F.col("_at") < (F.col("fy0") + F.col("fy1")) / 2, "T").otherwise("B")
        grown = {f"f{c}": F.col(f"e{c}") if turn == 1 else (F.least if c.endswith("0") else F.greatest)(f"f{c}", f"e{c}") for c in BOX}
        dealt = dealt.withColumns(bound).withColumn("side", F.when(F.col("side") == "H", facing).otherwise(F.col("side"))).withColumns(grown)
        dealt = stored(dealt.select(*names, *frame, "side"), "peel")
        rounds.append(dealt.filter("side IS NOT NULL").select(*names, F.lit(turn).alias("round"), "side"))
        rest = dealt.filter("side IS NULL").drop("side")
        if turn == most or not rest.limit(1).count():
            break
        rest = dealt_by(rest, group, rows)
    return reduce(DataFrame.unionByName, rounds)


def merged(parts: DataFrame, document: str, order: Sequence[Column], key: str, pins: str, pitch: str, page: str, upright: str, spread: float = 0.1, size: int = 12, share: int = 3, reach: float = 2.0, overlap: float = 0.5) -> DataFrame:
    """Which of a document's parts (with a box x0, x1, y0, y1) make up one whole with its strongest: document, key, accepted.

    The strongest part is accepted. Each further one in order is if it has pins, none of them among the accepted ones,
    its pitch differs from the strongest one's by no more than `spread` of that, and it is

    - large: `size` pins or more, and 1 / share of the accepted ones, or
    - adjacent to an accepted part of its page: no further than `reach` pitches along either axis, or
    - beside one: their spans (along y for an upright part, along x otherwise) overlap by `overlap` of the shorter.

    A fold over a document's parts, whose state holds the accepted pins and boxes.
    """
    box = lambda: [F.col(c).cast("double").alias(c) for c in BOX]
    span = lambda lo, hi: F.when(F.col(upright), F.col(lo)).otherwise(F.col(hi)).cast("double")
    fields = [F.row_number().over(within([document], order)).alias("k"), F.col(key).alias("key"), F.col(pins).alias("pins"), F.col(pitch).cast("double").alias("pitch"), F.struct(F.col(page).alias("page"), *box(), span("y0", "x0").alias("lo"), span("y1", "x1").alias("hi")).alias("box")]
    rows = parts.select(document, *fields).groupBy(document).agg(F.sort_array(F.collect_list(F.struct("k", "key", "pins", "pitch", "box"))).alias("r"))
    first = F.col("r")[0]
    start = F.struct(F.slice(first["pins"], 1, 0).alias("pins"), F.slice(F.array(first["box"]), 1, 0).alias("boxes"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, r: Column) -> Column:
        b, far = r["box"], first["pitch"] * reach
        large = (F.size(r["pins"]) >= size) & (F.size(r["pins"]) * share >= F.size(acc["pins"]))
        touches = lambda a: (b["x0"] <= a["x1"] + far) & (a["x0"] <= b["x1"] + far) & (b["y0"] <= a["y1"] + far) & (a["y0"] <= b["y1"] + far)
        common = lambda a: F.least(b["hi"], a["hi"]) - F.greatest(b["lo"], a["lo"])
        beside = lambda a: (common(a) > 0) & (common(a) >= overlap * F.least(b["hi"] - b["lo"], a["hi"] - a["lo"]))
        near = F.exists(acc["boxes"], lambda a: (a["page"] == b["page"]) & (touches(a) | beside(a)))
        fits = (F.size(r["pins"]) > 0) & ~F.arrays_overlap(acc["pins"], r["pins"]) & (F.abs(r["pitch"] - first["pitch"]) <= first["pitch"] * spread) & (large | near)
        ok = F.coalesce((r["k"] == 1) | fits, F.lit(False))
        grown = lambda c, more: F.when(ok, F.concat(acc[c], more)).otherwise(acc[c]).alias(c)
        return F.struct(grown("pins", r["pins"]), grown("boxes", F.array(b)), F.concat(acc["ok"], F.array(ok)).alias("ok"))

    folded = rows.select(document, "r", F.aggregate("r", start, step)["ok"].alias("ok"))
    return folded.select(document, F.explode(F.arrays_zip("r", "ok")).alias("z")).select(document, F.col("z.r.key").alias(key), F.col("z.ok").alias("accepted"))

