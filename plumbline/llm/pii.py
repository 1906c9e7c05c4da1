"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation rates the labelers.

Candidates are the base spans, which the contract's patterns define and which always stay, and looser ones that those
patterns miss: numbers in other groupings, obfuscated addresses, secrets. Each labeler (the shape of the expression, the
rules of its kind, gazetteers of words near it, the word just before it, its edges, its variety) votes yes, no or abstains. Spark counts how often
each pattern of votes occurs with each set of features; that table is small, so the driver runs expectation-maximisation
on it, which estimates every labeler's reliability without labels, and fits a logistic span classifier on the result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, replace_text

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails fails wherever it is entered, so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
ANY = re.compile(r"[@0-9]")
#: Looser candidates: kind and pattern; the last group, where there is one, is the span. Lengths are bounds of the formats
#: (a host label has 63 characters, an address at most five labels here), not cuts of the text.
LOOSE = [
    ("email", re.compile(r"(?i)(?<![\w.])[a-z0-9][a-z0-9._-]{0,63} ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]{1,63}){1,4}")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])[0-9]{10}(?![\w.-])")),
    ("id", re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_.-]{8,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,}(?![A-Za-z0-9])")),
]
LOOSE_CUE = re.compile(r"(?i:\(at\)|\[at\]|passw|pwd|token|secret|key)|[0-9]{3}[-. )]|[0-9]{10}|[A-Z][A-Z0-9]{15}")
#: Gazetteers: words beside a span that speak for each kind, words that speak for other numbers, beginnings of access keys.
CUES = {
    "email": frozenset("mail email e-mail write contact address".split()),
    "ip": frozenset("ip host address server login".split()),
    "card": frozenset("card visa mastercard account pay paid".split()),
    "phone": frozenset("call phone tel telephone mobile fax contact ring".split()),
    "id": frozenset("ssn social security id insurance".split()),
    "secret": frozenset("password passwd pwd login token secret key user access".split()),
}
OTHERS = frozenset("order invoice version page chapter isbn figure table no nr serial item part total ticket build".split())
KEY_PREFIXES = ("AKIA", "ASIA")
WORD = re.compile(r"[A-Za-z-]+")
NEAR, BESIDE = 48, 16
VOTES = ("shape", "check", "gazetteer", "context", "edges", "variety")


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern: the run of local characters before an @ and a domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans in the order of BASE_KINDS, then of their start."""
    if not ANY.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates beyond the base: looser spellings that overlap no base span."""
    if not LOOSE_CUE.search(text):
        return []
    out, taken = [], sorted((a, b) for _, a, b in base)
    for kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if not any(x < b and a < y for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b))
    return out


def plausible(kind: str, span: str, number: str) -> int:
    """Whether the characters obey the rules of their kind: 1 yes, -1 no, 0 where there is no rule."""
    if kind == "card":
        ok = luhn(number)
    elif kind == "phone":  # a national number has an area and an exchange that begin with 2 to 9
        ok = 9 <= len(number) <= 15 if span[0] == "+" else number[0] > "1" and number[3] > "1"
    elif kind == "id":
        ok = number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"
    elif kind == "secret":
        ok = bool(number) and len(set(span)) >= 6 and not span.isdigit()
    elif kind == "ip":  # four single digits are rather a version
        ok = len(number) > 4
    else:
        return 0
    return 1 if ok else -1


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (1 yes, -1 no, 0 abstain) on a span, and its features for the classifier."""
    span, before, after = text[a:b], text[max(0, a - NEAR) : a], text[b : b + NEAR]
    check = plausible(kind, span, digits(span))
    left = [w.lower() for w in WORD.findall(before)]
    near = {*left, *(w.lower() for w in WORD.findall(after))}
    cue, other = bool(near & CUES[kind]), bool(near & OTHERS)
    last = next((w.lower() for w in reversed(WORD.findall(before[-BESIDE:]))), "")
    context = 1 if last in CUES[kind] else -1 if last in OTHERS else 0
    bare = span.isdigit()
    if base or kind in ("email", "id") or span.startswith(KEY_PREFIXES):
        shape = 1
    else:
        shape = -1 if bare else int(kind == "secret" and context == 1)
    edges = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    variety = len(set(span))
    vote = (shape, check, int(cue) - int(other), context, 1 if edges else -1, 1 if variety >= 5 else -1)
    feature = (KINDS.index(kind), int(base), min(len(span) // 8, 4), int(cue), int(other), int(edges), min(variety // 3, 4), check, context, shape)
    return vote, feature


def design(features: np.ndarray) -> np.ndarray:
    """One column for each kind, then the other features scaled to about one."""
    kinds = np.eye(len(KINDS))[features[:, 0]]
    return np.hstack([kinds, features[:, 1:] / np.array([1, 4, 1, 1, 1, 4, 1, 1, 1])])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The probability that each vote pattern marks personal data, by expectation-maximisation (two latent classes)."""
    prior, n = 0.7, patterns.shape[1]
    table = np.full((2, n, 3), 1 / 3)  # class, labeler, vote + 1
    table[1] += np.array([-0.2, 0.0, 0.2])
    table[0] += np.array([0.2, 0.0, -0.2])
    onehot = (patterns[:, :, None] + 1 == np.arange(3)) * 1.0
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + (onehot * np.log(table[1] / table[0])).sum((1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip((p * counts).sum() / counts.sum(), 0.05, 0.95))
        for c, weight in ((1, p * counts), (0, (1 - p) * counts)):
            table[c] = ((onehot * weight[:, None, None]).sum(0) + 1) / (weight.sum() + 3)
    return p


def train(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier from all candidates of all documents; constant weights where there are none.

    Null and empty texts have no candidates; very long texts are searched whole; repeated rows count as often as they
    stand; an empty table gives the constant weights; other columns are ignored.
    """

    def count(text):
        c: Counter = Counter()
        for t in text:
            if t:
                base = base_spans(t)
                for spans, is_base in ((base, True), (loose_spans(t, base), False)):
                    c.update(votes(t, *s, is_base) for s in spans)
        keys = list(c)
        return {"vote": [k[0] for k in keys], "feature": [k[1] for k in keys], "n": [c[k] for k in keys]}

    counts = map_slices(docs.select("text"), count, "vote array<int>, feature array<int>, n long", 1024)
    rows = counts.groupBy("vote", "feature").agg(F.sum("n").alias("n")).orderBy("vote", "feature").collect()  # bounded by the votes and features there are
    width = len(KINDS) + 10
    if not rows:
        return np.zeros(width)
    pattern, feature, n = np.array([r.vote for r in rows]), np.array([r.feature for r in rows]), np.array([r.n for r in rows], float)
    target = estimate(pattern, n)
    x, weight, beta = np.hstack([design(feature), np.ones((len(n), 1))]), n / n.sum(), np.zeros(width)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (target - p)) - 1e-3 * beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(width)
        beta = beta + np.clip(np.linalg.solve(h, g), -2, 2)
    return beta


def find(text: str | None, weights: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base and the looser candidates that the classifier accepts; by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    loose = loose_spans(text, base)
    if loose:
        x = design(np.array([votes(text, *s, False)[1] for s in loose]))
        ok = x @ weights[:-1] + weights[-1] > 0
        loose = [s for s, k in zip(loose, ok, strict=True) if k]
    return base, sorted(base + loose, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Counts and spans of every row of docs, in code points of its whole text.

    A null or empty text has none. n_email to n_phone count base spans, n_spans all of them. Repeated rows and null doc_ids are rows of their
    own; other columns are ignored; an empty table gives no rows.
    """

    def run(doc_id, text):
        got = [find(t, weights) for t in text]
        kinds = [Counter(s[0] for s in base) for base, _ in got]
        return {
            "doc_id": doc_id,
            **{f"n_{k}": [c[k] for c in kinds] for k in BASE_KINDS},
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got],
            "spans": [joined(every) for _, every in got],
            "n_spans": [len(every) for _, every in got],
        }

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return map_slices(docs.select("doc_id", "text"), run, schema)


def mask(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    spans = sorted((a, b, k) for k, a, b in find(text, weights)[1])
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs, in all its columns, with personal data in text masked; n_chars, where docs have it, is of the masked text.

    A null or empty text stays as it is; rows and their number stay; an empty table gives an empty one.
    """
    out = replace_text(docs, "text", lambda texts: [mask(t, weights) for t in texts])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
