"""The queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, langid, licenses, neardup, packing, pii, quality, survival, toxicity, vafile, walsh, warc
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens; nulls and odd rows as packing.pack() has them."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector; nulls and odd rows as vafile.search() has them."""
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out quarter; nulls and odd rows as langid.identify() has them."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.filter(~langid.held_out()))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; nulls and odd rows as warc.round_trip() has them."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates by shingles of two words; nulls and odd rows as neardup.groups() has them."""
    return neardup.groups(table(spark, sf_dir, "documents"), size=2, percent=80)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of their decoding; nulls and odd rows as bpe.digest_documents() has them."""
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of licences in every document; nulls and odd rows as licenses.scan() has them."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and passages of every document, learnt outside the held-out fifth; nulls and odd rows as toxicity.score() has them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "passages")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; nulls and odd rows as pii.detect() has them."""
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.train(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of every document; nulls and odd rows as quality.rate() has them."""
    out = quality.rate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in every order, by language; nulls and odd rows as survival.audit() has them."""
    return survival.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors of 64 components; nulls and odd rows as walsh.cluster() has them."""
    return walsh.cluster(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, with every row's digest; nulls and odd rows as exact.groups() has them."""
    return exact.groups(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_vafile_topk, op3_language, op4_warc, op5_neardup, op6_bpe, op7_licenses, op8_toxicity, op9_pii, op10_quality, op11_filter_audit, op12_walsh_clusters,
        op13_exact_dedup,
    )
}
#: The other operators can't be put in SQL; tests/llm hold them against brute force, exact round trips or held-out rows.
ORACLE_SQL = {
    "op2_vafile_topk": vafile.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_neardup": neardup.ORACLE_SQL,
    "op7_licenses": licenses.ORACLE_SQL,
    "op11_filter_audit": survival.ORACLE_SQL,
    "op12_walsh_clusters": walsh.ORACLE_SQL,
    "op13_exact_dedup": exact.ORACLE_SQL,
}
