"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only lengths matter for the plan, and there are at most `capacity` of them: Spark counts the pieces of each length, the
driver plans on that histogram (its size depends on the capacity alone), and Spark places the pieces. The plan:

1. Pieces above one third of the capacity go at most two to a bin. Largest first, each is matched with the largest other
   such piece that still fits, which gives the greatest number of pairs.
2. Smaller pieces, largest first, go where the remaining gap is smallest; a new bin opens only when none fits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import partial

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import map_slices, written

CAPACITY, END = 4096, 1
#: Bytes of text cut into words at once: a slice holds a pointer for each word and one object for each different word.
CUT_BYTES = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first, n, sequence, offset): pieces first..first+n-1 of a length go, one each, at that offset of
    the n sequences from `sequence` on. counts: the number of pieces of each length from 1 to capacity."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list] = {}  # remaining gap -> groups [bins, slots]; a slot is (length, first piece, offset)
    open_gaps: list[int] = []
    groups: list = []

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        return first

    def keep(bins: int, slots: list, gap: int) -> None:
        if not bins:
            return
        if not gap:
            groups.append((bins, slots))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((bins, slots))

    third = capacity / 3
    large = sorted(k for k in left if k > third)
    while large:
        a = large[-1]
        i = bisect_left(large, min(a, capacity - a) + 1) - 1
        b = large[i] if i >= 0 else None
        if b is None or b == a and left[a] == 1 and i == 0:
            n = left[a]
            keep(n, [(a, take(a, n), 0)], capacity - a)
        elif b == a and left[a] > 1:
            n = left[a] // 2
            keep(n, [(a, take(a, n), 0), (a, take(a, n), a)], capacity - 2 * a)
        else:
            b = large[i - 1] if b == a else b
            n = min(left[a], left[b])
            keep(n, [(a, take(a, n), 0), (b, take(b, n), a)], capacity - a - b)
        large = [x for x in large if x in left]
    for length in sorted(left, reverse=True):
        while length in left:
            n = left[length]
            at = bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                bins, slots = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            else:
                gap, slots = capacity, []
                bins = -(-n // (gap // length))
            each = min(gap // length, n)
            full = min(bins, n // each)
            rest = [(k, f + full, o) for k, f, o in slots]
            placed = [(length, take(length, full), capacity - gap + j * length) for j in range(each)]
            keep(full, slots + placed, gap - each * length)
            keep(bins - full if slots else 0, rest, gap)
    for gap in open_gaps:
        groups += gaps[gap]
    out, sequence = [], 0
    for bins, slots in groups:
        out += [(k, first, bins, sequence, offset) for k, first, offset in slots]
        sequence += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Tokenise every whole text and cut what is longer than capacity; nth counts a task's pieces of one length."""

    def run(seen, doc_id, text):
        bpe, part = load(path), TaskContext.get().partitionId()
        rows = []
        for doc, ids in zip(doc_id, bpe.encode(text), strict=True):
            ids += END.to_bytes(4, "little")
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at : at + 4 * capacity]
                n = len(own) // 4
                rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen.get(n, 0)))
                seen[n] = seen.get(n, 0) + 1
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"), zip(*rows, strict=True), strict=True))

    return map_slices(docs.select("doc_id", "text"), run, PIECES, 1024, dict, CUT_BYTES)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces, a stored table whose nth counts the pieces of each (part, length) from 0."""
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.withColumn("base", F.coalesce(before, F.lit(0))).drop("n")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    rows = plan({r.length: r.n for r in counts}, capacity)
    keys = (rows[:, 0] << 44) + rows[:, 1]
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(keys, rows, doc_id, piece, start, length, ids_crc32, rank):
        rank = np.array(rank, np.int64)
        at = np.searchsorted(keys, (np.array(length, np.int64) << 44) + rank, "right") - 1
        return {
            "doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": ids_crc32,
            "sequence_id": rows[at, 3] + rank - rows[at, 1], "offset": rows[at, 4],
        }

    ranked = pieces.join(base, ["part", "length"]).select(*keep, (F.col("base") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_slices(ranked, partial(run, keys, rows), schema, 8192)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the tokens of all documents into few sequences of at most `capacity` tokens.

    path is a vocabulary file of the tokenizers library; id 1 ends each document. A null or empty text is that id alone.
    Repeated and null doc_ids are packed as rows of their own; columns other than doc_id and text are ignored; an empty
    table gives no rows. Very long texts are encoded whole, one at a time. Pieces of equal length are alike to the plan, so
    which of them lies where is open, but every token has one place.
    """
    return place(written(cut(docs, path, capacity), "pieces"), capacity)
