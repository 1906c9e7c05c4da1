"""Quality rules from repetition: rolling hashes of several n-gram lengths measure the characters that repeat."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import keep_rows, map_slices

#: n-gram lengths in words, and the largest share of word characters that repeated n-grams of that length may cover.
#: First occurrences don't count, and a single repeated boilerplate line in a short text stays below every bound.
LENGTHS = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Largest share of characters in lines that equal an earlier line; symbols per word; share of upper-case letters.
LINE_SHARE, SYMBOLS_PER_WORD, UPPER_SHARE = 0.30, 0.10, 0.50
MIN_WORDS, REPEAT_SHARE = 50, 50
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, dup_gram_chars array<long>, upper_share double"
)
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[SYMBOLS] = True


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def again(keys: np.ndarray, n: int, size: int, first: bool) -> np.ndarray:
    """Which of `size` words lie in an n-word window whose key occurs more than once; first: also at its first place."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    if first:
        hit[order[:-1][same]] = True
    edge = np.zeros(size + 1, np.int32)
    start = np.flatnonzero(hit)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of COLUMNS without doc_id."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    flat = np.frombuffer(raw, np.uint8)
    n_symbols = int(IS_SYMBOL[flat].sum())
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    chars = np.array([len(w) if w.isascii() else len(w.decode()) for w in ids], np.int64)[seq] if n else seq
    word_chars = int(chars.sum())
    repeat = 0
    if n >= 3:
        _, pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)
        repeat = int(again(pair[:-1].astype(np.int64) * len(ids) + seq[2:], 3, n, True).sum())
    lines, dup_lines, dup_chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line in lines:
            dup_lines += 1
            dup_chars += len(line.decode())
        elif line and not line.isspace():
            lines.add(line)
    grams = []
    if n:
        value = np.array([word_hash(w) for w in ids], np.uint64)[seq]
        rolled, at = value, 1
        for size in LENGTHS:
            while at < min(size, n):
                rolled = rolled[:-1] * BASE + value[at:]
                at += 1
            grams.append(int(chars[again(rolled, size, n, False)].sum()) if n > size else 0)
    letters = sum(map(str.isalpha, text)) if text and not raw.isascii() else int(((flat | 32) - 97 < 26).sum())
    upper = sum(map(str.isupper, text)) if text and not raw.isascii() else int((flat - 65 < 26).sum())
    share = upper / letters if letters else 0.0
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_SHARE * n
    kept = (
        not failed
        and n_symbols <= SYMBOLS_PER_WORD * n
        and share <= UPPER_SHARE
        and dup_chars <= LINE_SHARE * len(text or "")
        and all(g <= most * word_chars for g, most in zip(grams, LENGTHS.values(), strict=True))
    )
    return n, word_chars, n_symbols, dup_lines, repeat, failed, kept, dup_chars, grams or [0] * len(LENGTHS), share


def rate(docs: DataFrame) -> DataFrame:
    """Measures and verdict for every row of docs, over whole texts.

    A null or empty text has no words and fails. Ties don't arise; repeated rows and null doc_ids are measured as rows of
    their own; other columns than doc_id and text are ignored; an empty table gives no rows.
    """

    def run(doc_id, text):
        got = list(zip(*map(measure, text), strict=True))
        return dict(zip((c.split()[0] for c in COLUMNS.split(", ")), (doc_id, *got), strict=True))

    return map_slices(docs.select("doc_id", "text"), run, COLUMNS)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that the rules keep.

    Null and empty texts, and those of fewer than MIN_WORDS words, go; repeated rows share their fate; long texts are
    measured whole; an empty table gives an empty one.
    """
    return keep_rows(docs, "text", lambda texts: [measure(t)[6] for t in texts])
