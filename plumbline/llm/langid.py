"""Language identification by compression: the language whose dictionary compresses a text best.

Each language's dictionary is raw content: texts of a bounded sample of its labelled rows. zstandard encodes every whole
text, reduced to its lower-cased words and in chunks, once for each dictionary. The smallest total wins; a narrow margin is marked as rejected.
"""

from __future__ import annotations

import re
from functools import lru_cache

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_hash, map_slices

#: Bounds of the fitting sample: pieces of texts for each language, characters of a piece, bytes of a dictionary, and of
#: all of them. However many languages there are, each has a dictionary: beyond TOTAL / BYTES of them, smaller ones.
TEXTS, LONGEST, BYTES, TOTAL = 120, 4000, 160_000, 64 << 20
LEVEL, CHUNK, MARGIN = 6, 4096, 0.02
UNDETERMINED = "und"
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """The words of a whole text in lower case, one space apart."""
    return OTHER.sub(" ", text.lower())


def fit(train: DataFrame) -> dict[str, bytes]:
    """A dictionary for every language of train (lang, text), from a bounded sample of its rows.

    The bounds are TEXTS, LONGEST, BYTES and TOTAL. Rows without a language or a text don't count. Copies of a text
    count once. A language takes its texts of at most LONGEST characters, and pieces of that length of longer ones
    where those are fewer than TEXTS.
    """
    order = F.pmod("h", F.lit(1 << 30)).alias("o")
    rows = train.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    languages = rows.agg(F.approx_count_distinct("lang", 0.02)).first()[0]
    size = max(1, min(BYTES, TOTAL // max(1, languages)))
    longest = min(LONGEST, size)
    most = max(1, min(TEXTS, size * TEXTS // BYTES))
    last = F.least(F.lit(most), F.ceil(F.length("text") / longest)).cast("int") - 1
    pieces = rows.select("lang", "h", (last > 0).alias("long"), F.explode(F.sequence(F.lit(0), last)).alias("k")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "k", order, "h"))  # each task keeps `most` of a language at most
    chosen = pieces.withColumn("r", rank).filter(F.col("r") <= most).groupBy("lang", "h").agg(F.collect_list("k").alias("ks"))
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "ks", "text").distinct().select("lang", order, F.explode("ks").alias("k"), "text")
    sample = texts.select("lang", "o", "k", F.expr(f"substring(text, k * {longest} + 1, {longest})"))
    by_lang: dict[str, list[str]] = {}
    for r in sorted(map(tuple, sample.collect())):  # `most` rows a language of at most LONGEST characters
        by_lang.setdefault(r[0], []).append(r[3])
    return {lang: plain("\n".join(texts)).encode()[-size:] for lang, texts in by_lang.items()}


@lru_cache(2)
def compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """Language, score (the margin to the runner-up, 0 to 1) and whether the margin is too narrow."""
    if not model or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, True
    raw = plain(text).encode()
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    for level in (LEVEL, 19):  # the second only for ties
        size = [sum(len(c.compress(x)) for x in chunks) for c in compressors(model, level)]
        best, *rest = sorted(range(len(size)), key=size.__getitem__)
        if not rest:
            return model[best][0], 1.0, False
        if size[best] < size[rest[0]]:
            break
    margin = (size[rest[0]] - size[best]) / size[rest[0]]
    return model[best][0], min(1.0, margin), margin < MARGIN


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs, learnt from the lang and text of train.

    A text that is null or has no letters is `und`, as is every text if train is empty. Ties go to the language that a
    slower level compresses better, then to the first by name. Repeated rows and null doc_ids are rows of their own. Very long texts are compressed
    whole, one at a time; an empty table gives no rows; other columns are ignored.
    """
    model = tuple(sorted(fit(train).items()))

    def run(doc_id, text):
        got = [classify(t, model) for t in text]
        return {"doc_id": doc_id, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(id_hash() % 4 == 2, F.lit(False))
