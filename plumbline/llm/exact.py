"""Exact deduplication by progressive refinement: length, then hash of a prefix, then hash of the whole text.

A first scan measures each text: its length and the hash of its first bytes. Lengths that occur once are done with; among
the others, so are pairs of length and prefix hash that occur once. What survives is put in a Bloom filter of bounded
size, and a second scan hashes the whole of those texts alone that the filter lets through. Texts are never shuffled,
and equal whole hashes (SHA-256) are the groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_slices, written

BLANKS = bytes(range(0x09, 0x0E))
TO_SPACE = bytes.maketrans(BLANKS, b" " * len(BLANKS))
#: Bytes of a text that its prefix hash covers.
PREFIX = 512
#: Bits of the Bloom filter as a power of two (8 MB), and bits set for each key. Beyond 30 million keys it lets through more,
#: which costs hashing and changes no result.
LOG_BITS, PROBES = 26, 4
M64 = (1 << 64) - 1


def normalised(raw: bytes) -> bytes:
    """A text (UTF-8) with every run of ASCII white space as one space."""
    raw = raw.translate(TO_SPACE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


def prefix_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text[:PREFIX], digest_size=8).digest(), "little", signed=True)


def measured(docs: DataFrame) -> DataFrame:
    """length and prefix (hash) of every normalised text, stored."""

    def fn(raws):
        texts = [normalised(r) for r in raws]
        return {"length": [len(t) for t in texts], "prefix": [prefix_hash(t) for t in texts]}

    return written(map_slices(docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary")), fn, "length long, prefix long"), "measured")


def surviving(sizes: DataFrame) -> DataFrame:
    """The pairs of length and prefix that more than one row has. Counts are taken on the map side first, so that a length
    or pair of very many rows is no load."""
    lengths = written(sizes.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("length"), "lengths")
    alike = join_small(sizes, lengths, ["length"], "left_semi")
    return alike.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("length", "prefix")


def probe(length: int, prefix: int) -> int:
    """A 64-bit mix of a length and a prefix hash (the finaliser of splitmix64 over their sum)."""
    z = (prefix + length * 0x9E3779B97F4A7C15) & M64
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & M64
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & M64
    return z ^ z >> 31


def bits_of(mix: int) -> list[int]:
    step = mix >> 32 | 1
    return [(mix + i * step & M64) >> (64 - LOG_BITS) for i in range(PROBES)]


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys: words of 32 bits that Spark has put together, 2 ** LOG_BITS bits at most."""

    def fn(lengths, prefixes):
        hits = [b for n, p in zip(lengths, prefixes, strict=True) for b in bits_of(probe(n, p))]
        return {"word": [b >> 5 for b in hits], "bits": [1 << (b & 31) for b in hits]}

    words = map_slices(keys, fn, "word int, bits long", rows=4096).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (LOG_BITS - 5), np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def hashed(docs: DataFrame, filter_words: np.ndarray, digests: bool) -> DataFrame:
    """doc_id, text_sha256 (hex) and alike of every row, stored. Only texts that the filter lets through (alike) are hashed,
    and the others too where digests are asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_words.tobytes())  # 2 ** (LOG_BITS - 3) bytes

    def once():
        return np.frombuffer(sent.value, np.uint32)

    def fn(words, ids, raws):
        out = {"doc_id": ids, "text_sha256": [], "alike": []}
        for raw in raws:
            text = normalised(raw)
            hit = all(words[b >> 5] >> (b & 31) & 1 for b in bits_of(probe(len(text), prefix_hash(text))))
            out["alike"].append(hit)
            out["text_sha256"].append(hashlib.sha256(text).hexdigest() if hit or digests else None)
        return out

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = written(map_slices(rows, fn, "doc_id long, text_sha256 string, alike boolean", once=once), "hashed")
    sent.unpersist()
    return found


def groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row: texts are equal when they are after each run of ASCII
    white space is made one space, and the row with the smallest doc_id stays.

    A null text counts as empty, and empty texts equal each other. Rows that repeat a doc_id with its text count as rows of
    the group and share their `kept`; a null doc_id stays only in a group without any other. Very long texts are hashed
    whole, one at a time. text_sha256 is null for texts that were never hashed, unless digests are asked for. An empty
    table gives no rows; other columns are ignored.
    """
    rows = hashed(docs, bloom(surviving(measured(docs))), digests)
    alike = rows.filter("alike").select("doc_id", "text_sha256")
    sizes = alike.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = written(sizes.filter("group_size > 1"), "groups")
    same = join_small(alike, several, ["text_sha256"], "left")
    same = same.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    alone = rows.filter(~F.col("alike")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = same.unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t FROM documents)
SELECT doc_id, min(doc_id) OVER g keep_id, count(*) OVER g group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER g kept, sha256(t) text_sha256 FROM n WINDOW g AS (PARTITION BY t)
"""
