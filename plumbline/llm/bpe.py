"""Byte-pair encoding and decoding with vocabulary files of the tokenizers library.

A short word is a row of a matrix: its parts lie contiguously, with the rank of every adjacent pair beside them. Each
round scans every row for its lowest rank, deletes that boundary and refreshes the ranks on both sides of it. Ranks are
read from a hash table in which each pair has one of two places; those of two bytes from a table of all of them. Words of
one length take their rounds together in numpy. Words beyond SHORT parts keep their boundaries in a linked list with a
heap of ranks, so very long ones stay at n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_slices

SHORT = 48
#: Pieces up to this length are remembered, at most CACHED of them in a worker; when there are more, those of the texts at hand stay.
CHUNK, CACHED = 40, 100_000
NONE = np.int32(2**31 - 1)
#: White space of the pre-tokenizers (Unicode's White_Space).
WS = "\t-\r \x85\xa0  -     　"
SPACES = "".join(re.findall(f"[{WS}]", "".join(map(chr, range(0x3001)))))
LETTER, DIGIT = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
#: Texts of these characters only are split by re with explicit classes; others by regex with Unicode's classes.
PLAIN = re.compile("[\x00-\x7fÀ-ÿ]*").fullmatch
SHORT_FORMS = "'(?:[stmd]|re|ve|ll)"


def splitters(words: bool):
    """Functions that split a plain text and any other text into the pieces that merges stay within."""
    shape = "[{l}]+|[{n}]|{forms}|[^{ws}{l}{n}]+" if words else " ?[{l}]+| ?[{n}]+|{forms}| ?[^{ws}{l}{n}]+|[{ws}]+(?![^{ws}])|[{ws}]+"
    if words:  # with the white space before it, which saves a failed match at each space; none may be left at the end
        shape = "[{ws}]*+(" + shape.replace("]+", "]++") + ")"
    plain = re.compile(shape.format(forms=SHORT_FORMS, l=LETTER, n=DIGIT, ws=WS)).findall
    full = regex.compile(shape.format(forms=SHORT_FORMS, l=r"\p{L}", n=r"\p{N}", ws=WS)).findall
    if words:
        return lambda t: plain(t.rstrip(SPACES)) if PLAIN(t) else full(t.rstrip(SPACES))
    return lambda t: plain(t) if PLAIN(t) else full(t)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


def places(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places that a pair (40 bits) may have in a table of `size` (a power of two) entries."""
    mixed = key * np.int64(-7046029254386353131)
    return mixed >> 40 & size - 1, mixed >> 20 & size - 1


def two_places(ranks: dict[int, int]) -> np.ndarray:
    """A table of pair << 20 | rank, each entry at one of its two places, so that a look-up reads two entries; -1 is empty."""
    keys = list(ranks)
    size = 1 << max(10, (4 * len(keys)).bit_length())
    while True:
        one, other = (x.tolist() for x in places(np.array(keys, np.int64), size))
        held = [-1] * size
        for k in range(len(keys)):
            at = one[k]
            for _ in range(100):
                held[at], k = k, held[at]  # who was there moves to its other place
                if k < 0:
                    break
                at = one[k] + other[k] - at
            else:
                break
        else:
            return np.array([-1 if k < 0 else keys[k] << 20 | ranks[keys[k]] for k in held], np.int64)
        size *= 2


class Bpe:
    """Tables of one vocabulary file, and the words this worker has met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.words = bool(suffix)
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        joined = [a + (b if not suffix or not a.endswith(suffix) else b) for a, b in merges]
        self.new = np.array([vocab[x] for x in joined], np.int32)
        self.by_pair = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.table = two_places(self.by_pair)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_ranks = self.rank(self.first[a], self.first[b]), self.rank(self.first[a], self.last[b])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.pieces = splitters(self.words)
        self.spelt = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.spelt)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where the vocabulary does not merge it."""
        key = a.astype(np.int64) << 20 | b
        one, other = places(key, len(self.table))
        found = self.table[one]
        found = np.where(found >> 20 == key, found, self.table[other])
        return np.where(found >> 20 == key, (found & 0xFFFFF).astype(np.int32), NONE)

    def merge_short(self, raw: np.ndarray) -> list[bytes]:
        """Ids of words of equal length (a row of bytes each), as little-endian unsigned 32-bit integers."""
        n, width = raw.shape
        parts = self.first[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        out, rows = [b""] * n, np.arange(n)
        if width == 1:
            return [x.tobytes() for x in parts.astype("<u4")]
        pairs = raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]
        ranks = self.byte_ranks[0][pairs]
        ranks[:, -1] = self.byte_ranks[1][pairs[:, -1]]
        while True:
            at = ranks.argmin(1)
            low = ranks.ravel()[np.arange(len(rows)) * (width - 1) + at]
            live = low != NONE
            if not live.all():
                done = ~live
                flat, size = parts[done].astype("<u4").tobytes(), 4 * width
                for k, r in enumerate(rows[done].tolist()):
                    out[r] = flat[size * k : size * (k + 1)]
                rows, parts, ranks, at, low = rows[live], parts[live], ranks[live], at[live], low[live]
                if not len(rows):
                    return out
            m, new = len(rows), self.new[low]
            first = np.arange(m) * width + at
            parts = parts.ravel()
            parts[first] = new
            keep = np.ones(m * width, bool)
            keep[first + 1] = False
            parts = parts[keep]
            width -= 1
            if width == 1:
                flat = parts.astype("<u4").tobytes()
                for k, r in enumerate(rows.tolist()):
                    out[r] = flat[4 * k : 4 * k + 4]
                return out
            keep = np.ones(m * width, bool)
            keep[np.arange(m) * width + at] = False
            ranks = ranks.ravel()[keep]
            # the pair that ends in the new part, and the one that begins with it
            left, right = (at > 0).nonzero()[0], (at < width - 1).nonzero()[0]
            i = np.concatenate([left, right])
            side = np.concatenate([at[left] - 1, at[right]])
            first = i * width + side
            ranks[i * (width - 1) + side] = self.rank(parts[first], parts[first + 1])
            parts, ranks = parts.reshape(m, width), ranks.reshape(m, width - 1)

    def merge_long(self, raw: bytes) -> bytes:
        ids = self.first[np.frombuffer(raw, np.uint8)].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n, get = len(ids), self.by_pair.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.new[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode pieces that are not yet known."""
        by_len: defaultdict[int, tuple[list[str], list[bytes]]] = defaultdict(lambda: ([], []))
        for p in pieces:
            raw = p.encode()
            ps, raws = by_len[len(raw)]
            ps.append(p)
            raws.append(raw)
        ids: dict[str, bytes] = {}
        for n, (ps, raws) in by_len.items():
            if n > SHORT:
                ids.update(zip(ps, map(self.merge_long, raws), strict=True))
            else:
                rows = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, n)
                ids.update(zip(ps, self.merge_short(rows), strict=True))
        return ids

    def ready(self, text: str) -> list[str]:
        """The pieces of a text; special tokens that it spells out are pieces of their own."""
        parts = self.split.split(text) if self.split else [text]
        out: list[str] = []
        for s in parts:
            if s in self.special:
                out.append(s)
                continue
            if self.words:
                s = s if PLAIN(s) else unicodedata.normalize("NFC", s)
                s = "".join(x.lower() for x in s) if "Σ" in s else s.lower()
            out += self.pieces(s)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; null counts as empty."""
        pieces: dict[str, str] = {}  # one string for all pieces that are equal
        split = []
        for t in texts:
            own = self.ready(t) if t else []
            split.append(list(map(pieces.setdefault, own, own)))
        missing = [p for p in pieces if p not in self.known]
        if len(self.known) + len(missing) > CACHED:
            self.known = self.spelt | {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(self.learn(missing))
        get = self.known.__getitem__
        out = [b"".join(map(get, ps)) for ps in split]
        for p in missing:
            if len(p) > CHUNK:
                del self.known[p]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join([self.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids ARRAY<INT> and the decoded text of every document; a null text counts as empty.

    Empty texts have no ids. Special tokens that a text spells out become their ids. Rows are kept one for one, repeated
    or null doc_ids included.
    """

    def run(doc_id, text):
        bpe = load(path)
        ids = bpe.encode(text)
        return {"doc_id": doc_id, "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded": [bpe.decode(x) for x in ids]}

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string", 1024)


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, sha256 of the ids (little-endian unsigned 32-bit) and of the decoded text.

    A null or empty text has no tokens and decodes to an empty one. Special tokens that a text spells out become their
    ids. Texts are encoded whole; rows are kept one for one, repeated or null doc_ids included; other columns are ignored.
    """

    def run(doc_id, text):
        bpe = load(path)
        ids = bpe.encode(text)
        return {
            "doc_id": doc_id,
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1024)
