"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Fitting counts words and word beginnings in labelled texts. Their log-odds take an informative Dirichlet prior from the
whole sample; those clearly toxic (by their z-score) form a lexicon. In a text, a lexicon word scores its log-odds and
any other word a small negative log-likelihood ratio. One linear scan finds all maximal segments of positive score. The
best score of a clean text of n words follows an extreme-value distribution with parameters lambda and K; a text's
evidence is how far its segments lie beyond it, and a logistic curve, fitted on texts that the lexicon half in use has
not seen, turns evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about, id_hash, keep_rows, map_slices, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Bound of the fit: labelled rows in the sample.
SAMPLE = 20_000
#: Bytes of text whose features a task counts at once, before Spark adds the counts up.
COUNT_BYTES = 1 << 20
PRIOR, LEAST_Z, LEAST_COUNT = 1000.0, 3.0, 3
#: Least log of the ratio of rates of a telling feature: eight times as frequent among the words of toxic texts, whatever
#: the sizes of the classes and of the sample. Words that are a little more frequent there, though surely so, make long segments of any clean text.
LEAST_ODDS = math.log(8)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    other: float
    lam: float
    k: float
    weights: tuple[float, float]

    def word(self, w: str) -> float:
        """Score of a word by its most telling feature: itself, or its beginning."""
        get = self.lexicon.get
        return max(get(w, 0.0), *(get(f"^{w[:n]}", 0.0) if len(w) >= n else 0.0 for n in PREFIXES))

    def heads(self) -> frozenset[str]:
        return frozenset(x.lstrip("^")[: PREFIXES[0]] for x in self.lexicon)


def features(words: list[str]) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w] += n
        for k in PREFIXES:
            if len(w) >= k:
                out[f"^{w[:k]}"] += n
    return out


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), given the words that score above zero by position.

    Every other word scores `other`, below zero. The scan is linear: an open segment knows the nearest earlier one that
    begins lower, so no segment is passed over twice; where none begins lower, all earlier ones are final.
    """
    final: list[tuple] = []
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum at its end, nearest lower one
    total, at = 0.0, 0
    for i, s in hits:
        left = total + other * (i - at)
        total, at = left + s, i + 1
        first, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, _, left, _, lower = found[j]
            del found[j:]
            j = lower
        if j < 0:
            final += found
            found.clear()
        found.append((first, i, left, total, j))
    return [(a, b, right - left) for a, b, left, right, _ in final + found]


def evidence(hits: list[tuple[int, float]], n: int, other: float, lam: float, k: float) -> tuple[float, list]:
    """How far the segments of a text of n words lie beyond chance, and those that do (first, last, score)."""
    chance = math.log(max(k * n, 1e-9))
    own = segments(hits, other)
    beyond = [(a, b, s) for a, b, s in own if lam * s > chance]
    best = max((lam * s - chance for _, _, s in own), default=-chance)
    more = sum(lam * s - chance for _, _, s in beyond) - max(best, 0.0)
    return min(100.0, max(-20.0, best + math.log1p(max(0.0, more)))), beyond


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b, ridge = 0.0, 0.0, 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return a, b


def log_odds(toxic: Column, clean: Column, size: Column) -> tuple[Column, Column]:
    """Log-odds of toxic against clean with an informative Dirichlet prior, and their z-scores.

    toxic and clean are structs of a feature's count (n) and the words of the class (words); size is the number of features.
    """
    prior = 0.5 + PRIOR * (toxic["n"] + clean["n"]) / F.greatest(toxic["words"] + clean["words"], F.lit(1))
    weight = PRIOR + 0.5 * size
    odds = lambda c: F.log((c["n"] + prior) / F.greatest(c["words"] + weight - c["n"] - prior, F.lit(1.0)))
    delta = odds(toxic) - odds(clean)
    return delta, delta / F.sqrt(1 / (toxic["n"] + prior) + 1 / (clean["n"] + prior))


def rate_ratio(toxic: Column, clean: Column) -> Column:
    """Log of how many times as frequent a feature is among the words of toxic texts; no prior, so that it holds in small samples."""
    rate = lambda c: (c["n"] + 0.5) / (c["words"] + 1)
    return F.log(rate(toxic) / rate(clean))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` labelled rows of labels (doc_id, toxic) with their texts in docs.

    A doc_id with several labels counts as toxic if any of them is 1; null labels and null texts don't count. Without
    both classes the model scores every text the same, below one half. Words of any length and their beginnings are
    features. Spark counts them and computes their log-odds and z-scores, which follow from rates, so that the lexicon
    doesn't depend on how rare the class is; every feature that toxic texts of the sample hold LEAST_COUNT times or more,
    whose rates have a ratio of LEAST_ODDS (a logarithm) and whose z-score is LEAST_Z or more, is in it. Only those are told to the driver, so their
    number is bounded by the sample's.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = about(known, sample, "doc_id")  # so few rows that they can be broadcast
    train = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    train = train.select((F.xxhash64("doc_id") % 2 == 0).alias("half"), (F.col("toxic") == 1).alias("toxic"), "text")

    def count(half, toxic, text):
        by: dict[tuple, Counter] = {}
        for h, y, t in zip(half, toxic, text, strict=True):
            words = WORD.findall(t.lower())
            by.setdefault((h, y), Counter()).update(features(words))
            by[h, y][""] += len(words)
        rows = [(h, y, f, n) for (h, y), c in by.items() for f, n in c.items()]
        return dict(zip(("half", "toxic", "feature", "n"), zip(*rows, strict=True), strict=True))

    counts = map_slices(train, count, "half boolean, toxic boolean, feature string, n long", 2048, most=COUNT_BYTES)
    cell = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), F.col("n")).otherwise(0))
    table = counts.groupBy("feature").agg(*(cell(h, y).alias(f"n{int(h)}{int(y)}") for h in (False, True) for y in (False, True)))
    table = written(table, "features")
    nothing = Model({}, -0.05, 1.0, 1e-3, (-2.0, 0.0))
    words = table.filter("feature = ''").first()
    if not words or not words.n01 + words.n11 or not words.n00 + words.n10:
        return nothing
    size = F.lit(table.filter(f"feature <> '' AND n01 + n11 >= {LEAST_COUNT}").count())

    def telling(*halves: str) -> Column:
        """The log-odds of a feature that passes in these halves; null for others."""
        own = lambda y: F.struct(sum(F.col(f"n{h}{y}") for h in halves).alias("n"), F.lit(sum(words[f"n{h}{y}"] for h in halves)).alias("words"))
        delta, z = log_odds(own(1), own(0), size)
        return F.when((z >= LEAST_Z) & (rate_ratio(own(1), own(0)) >= LEAST_ODDS) & (own(1)["n"] >= LEAST_COUNT), F.round(delta, 4))

    chosen = table.filter("feature <> ''").select("feature", telling("0", "1").alias("every"), telling("0").alias("first"), telling("1").alias("last"))
    rows = chosen.filter("every IS NOT NULL OR first IS NOT NULL OR last IS NOT NULL").orderBy("feature").collect()
    if not rows:
        return nothing
    lexicon = lambda c: {r.feature: r[c] for r in rows if r[c] is not None}

    lexicons = {False: lexicon("last"), True: lexicon("first")}  # each half of the texts is scored by what the other half taught
    scorers = {h: Model(x, -0.05, 1.0, 1.0, (0.0, 0.0)) for h, x in lexicons.items()}

    def score(half, toxic, text):
        hits, size = [], []
        for h, t in zip(half, text, strict=True):
            words, m = WORD.findall(t.lower()), scorers[h]
            hits.append([(i, s) for i, w in enumerate(words) if (s := m.word(w))])
            size.append(len(words))
        return {"toxic": toxic, "size": size, "at": [[i for i, _ in x] for x in hits], "score": [[s for _, s in x] for x in hits]}

    got = map_slices(train, score, "toxic boolean, size int, at array<int>, score array<double>").collect()  # the sample
    clean, bad = [r for r in got if not r.toxic], [r for r in got if r.toxic]
    if not clean or not bad:
        return nothing
    rate = lambda rs: (sum(len(r.at) for r in rs) + 0.5) / (sum(r.size for r in rs) + 1)
    q1, q0 = rate(bad), rate(clean)
    other = min(-0.01, max(-0.5, math.log((1 - q1) / (1 - q0))))
    scores = np.array([s for r in (clean if q0 * sum(r.size for r in clean) > 20 else got) for s in r.score] or [5.0])
    low, high = 0.01, 5.0
    for _ in range(60):  # lambda: the positive root of E[exp(lambda s)] = 1 over the words of clean texts
        lam = (low + high) / 2
        low, high = (lam, high) if q0 * np.exp(np.minimum(lam * scores, 50)).mean() + (1 - q0) * math.exp(lam * other) < 1 else (low, lam)
    best = lambda r: max((s for _, _, s in segments(list(zip(r.at, r.score, strict=True)), other)), default=0.0)
    k = len(clean) / max(1.0, sum(r.size * math.exp(-lam * best(r)) for r in clean))
    x = np.array([evidence(list(zip(r.at, r.score, strict=True)), r.size, other, lam, k)[0] for r in got])
    return Model(lexicon("every"), other, lam, k, logistic(x, np.array([float(r.toxic) for r in got])))


def assess(text: str | None, model: Model, heads: frozenset[str]) -> tuple[float, list[tuple[int, int, float]]]:
    """The probability that a text is toxic, and its significant passages (start, end, score) in code points."""
    lower = (text or "").lower()
    words = WORD.findall(lower)
    hits = [(i, s) for i, w in enumerate(words) if w[:4] in heads and (s := model.word(w))]
    x, beyond = evidence(hits, len(words), model.other, model.lam, model.k)
    a, b = model.weights
    p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
    if not beyond:
        return p, []
    at = [m.span() for m in WORD.finditer(lower)]
    return p, [(at[i][0], at[j][1], s) for i, j, s in beyond]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the toxic passages of every row of docs.

    A null or empty text has no words and gets the score of no evidence; a very long one is scored whole, in linear
    time. Passages are code points of the lower-cased text. Repeated rows and null doc_ids are rows of their own; other columns are ignored; no rows give no rows.
    """
    heads = model.heads()

    def run(doc_id, text):
        got = [assess(t, model, heads) for t in text]
        passages = [[{"start": a, "end": b, "score": s} for a, b, s in g[1]] for g in got]
        return {"doc_id": doc_id, "score": [g[0] for g in got], "predicted": [int(g[0] >= 0.5) for g in got], "passages": passages}

    schema = "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double>>"
    return map_slices(docs.select("doc_id", "text"), run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, in all their columns, that are not predicted toxic.

    Null and empty texts have the score of no evidence and stay if that is below one half; repeated rows share their
    fate; an empty table gives an empty one. Long texts are scored whole.
    """
    heads = model.heads()
    return keep_rows(docs, "text", lambda texts: [assess(t, model, heads)[0] < 0.5 for t in texts])


def held_out() -> Column:
    return F.coalesce(id_hash() % 5 == 0, F.lit(False))
