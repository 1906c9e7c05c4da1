"""Filter interaction audit by truth tables: what each filter removes in every order of the filters.

A document fails some of the five filters. Its survival word has a bit for each of the 32 subsets of filters, set if the
document survives that subset. Positional popcounts of the words (by carry-save adders over whole arrays) give the
survivors of every subset, for each part and label; kept, removed, redundant and good or toxic losses of every order, and
the Shapley sums, are differences of those 32 counts. No document is looked at again for an order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_slices, written

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Bit k of a mask stands for the k-th filter. A document that fails `mask` survives the subsets that share no filter with it.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)
LEAST_WORDS = 200
SYMBOL = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that continue a code point of UTF-8
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are words at once.
PIECE = 1 << 20
#: Words that are counted bit by bit rather than added.
FEW = 48
LABELS = ("all", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes, cut at white space only."""
    at = 0
    while len(raw) - at > PIECE:
        cut = BLANK.search(raw, at + PIECE)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:] if at else raw


def failed(raw: bytes) -> int:
    """The mask of the filters A to D that a text (UTF-8) fails."""
    n, seen = 0, set()
    for piece in pieces(raw):
        words = piece.split()  # splits at the six ASCII blanks
        n += len(words)
        seen.update(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw.translate(None, CONTINUED))
    return (n < LEAST_WORDS) | (100 * len(seen) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (SYMBOL.search(raw) is not None) << 3


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words (uint32) have each of the 32 bits set.

    Three words of a weight become a sum of that weight and a carry of twice the weight, for all thirds of the array at
    once, until a few words of each weight are left.
    """
    counts, todo, weight = np.zeros(32, np.int64), [words], 1
    while todo:
        now, carries = todo.pop(), []
        while len(now) > FEW:
            third = len(now) // 3
            a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            now = np.concatenate([half ^ c, now[3 * third :]])
        bits = np.unpackbits(now.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts += weight * bits.sum(0, dtype=np.int64)
        if carries:
            todo.append(np.concatenate(carries))
        weight *= 2
    return counts


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and the mask of failed filters of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text.alias("raw"))

    def fn(ids, parts, digests, raws):
        return {"doc_id": ids, "part": parts, "digest": digests, "mask": [failed(r) for r in raws]}

    told = written(map_slices(rows, fn, "doc_id long, part string, digest string, mask int"), "failed")
    first = told.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = written(known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    # a row is the first of its text if it has the least id: a join by that id and not by the text, which may be hot
    out = told.join(first.hint("merge"), ["doc_id", "digest"], "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int")
    out = out.select("doc_id", "part", (F.col("mask") + 16 * copy).alias("mask"))
    return join_small(out, known, ["doc_id"], "left").select("part", (F.col("good") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), "mask")


def survivors(rows: DataFrame) -> DataFrame:
    """part, label (all, good, toxic) and n: the survivors of every subset of filters (bit k of its number: filter k)."""

    def run(batches):
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            words = SURVIVES[batch.column(3).to_numpy(zero_copy_only=False)]
            held = [np.ones(len(words), bool)] + [c.fill_null(False).to_numpy(zero_copy_only=False) for c in batch.columns[1:3]]
            codes = part.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(part.dictionary)))
            found = []
            for name, end, start in zip(part.dictionary.to_pylist(), ends.tolist(), [0, *ends.tolist()], strict=False):
                own = order[start:end]
                for label, mine in zip(LABELS, held, strict=True):
                    found.append((name, label, positional_counts(words[own[mine[own]]]).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)] if found else [pa.array([], t) for t in (pa.string(), pa.string(), pa.list_(pa.int64()))], names=["part", "label", "n"])

    own = rows.mapInArrow(run, "part string, label string, n array<long>")
    return own.groupBy("part", "label").agg(F.array(*(F.sum(F.col("n")[s]) for s in range(SUBSETS))).alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """RESULT from survivors(): 600 rows for every part."""
    wide = counts.groupBy("part").agg(*(F.first(F.when(F.col("label") == x, F.col("n")), ignorenulls=True).alias(x) for x in LABELS))
    names = ["".join(p) for p in permutations(FILTERS)]
    steps = [(name, k + 1, FILTERS.index(name[k]), sum(1 << FILTERS.index(f) for f in name[:k])) for name in names for k in range(len(FILTERS))]
    bit, before = (np.array([s[i] for s in steps]) for i in (2, 3))
    after, everything = before | 1 << bit, SUBSETS - 1
    size = len(FILTERS)
    times = [factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) if s != everything else 0 for s in range(SUBSETS)]

    def run(batches):
        for batch in batches:
            for part, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, good, toxic = (np.array(x, np.int64) for x in lists)
                fails = n[0] - n[1 << bit]
                removed = n[before] - n[after]
                shapley = np.array([sum(times[s] * int(n[s] - n[s | 1 << f]) for s in range(SUBSETS) if not s >> f & 1) for f in range(size)], np.int64)
                columns = (n[after], removed, fails - removed, n[everything ^ 1 << bit] - n[everything], good[before] - good[after], toxic[before] - toxic[after], shapley[bit])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(steps)), pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32()), *map(pa.array, columns)],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return wide.mapInArrow(run, RESULT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part (lang), order of the filters A to E and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, as RESULT.

    Null texts and parts count as empty; very long texts are split into words piece by piece. A document fails E if a row
    with a smaller doc_id has the same text (told by SHA-256): of rows that repeat a doc_id with its text none is smaller,
    and a row without doc_id fails nobody's E nor its own. Every row counts. A document is good or toxic if any of its
    rows in `labels` says so; rows of labels without document count nowhere. An empty table gives no rows; other columns
    of either table are ignored.
    """
    return orders(survivors(marked(docs, labels)))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) good, max((toxic = 1)::INT) toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic FROM m LEFT JOIN l ON l.doc_id = m.doc_id GROUP BY part, mask),
f AS (SELECT unnest(range(5)) k), o AS (SELECT a.k a, b.k b, c.k c, d.k d, e.k e FROM f a, f b, f c, f d, f e WHERE (1 << a.k) + (1 << b.k) + (1 << c.k) + (1 << d.k) + (1 << e.k) = 31),
s AS (SELECT substr('ABCDE', a + 1, 1) || substr('ABCDE', b + 1, 1) || substr('ABCDE', c + 1, 1) || substr('ABCDE', d + 1, 1) || substr('ABCDE', e + 1, 1) filter_order,
  unnest([{'step': 1, 'k': a, 'b': 0}, {'step': 2, 'k': b, 'b': 1 << a}, {'step': 3, 'k': c, 'b': (1 << a) + (1 << b)}, {'step': 4, 'k': d, 'b': (1 << a) + (1 << b) + (1 << c)}, {'step': 5, 'k': e, 'b': 31 - (1 << e)}]) x FROM o),
r AS (SELECT part, filter_order, CAST(x.step AS INTEGER) step, x.k k, CAST(coalesce(sum(n) FILTER (mask & (x.b + (1 << x.k)) = 0), 0) AS BIGINT) kept,
  CAST(coalesce(sum(n) FILTER (mask & x.b = 0 AND mask & (1 << x.k) <> 0), 0) AS BIGINT) removed, CAST(coalesce(sum(n) FILTER (mask & x.b <> 0 AND mask & (1 << x.k) <> 0), 0) AS BIGINT) redundant,
  CAST(coalesce(sum(n) FILTER (mask = 1 << x.k), 0) AS BIGINT) unique_fails, CAST(coalesce(sum(good) FILTER (mask & x.b = 0 AND mask & (1 << x.k) <> 0), 0) AS BIGINT) good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & x.b = 0 AND mask & (1 << x.k) <> 0), 0) AS BIGINT) toxic_lost FROM c, s GROUP BY part, filter_order, x.step, x.k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) shapley FROM r
"""
