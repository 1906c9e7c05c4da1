"""Ingest of texts that arrive in batches, each text once, without reading again what came before.

Digests lie in buckets, one folder for each batch and bucket. A Bloom filter of fixed size covers all digests so far; a
batch reads the filter that the batch before it left, and of the digests only those buckets in which the filter may know
one of its own. So what a batch of new texts reads does not grow with the number of batches before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter as a power of two (4 MB), bits set for each digest, buckets of digests. Beyond some 3 million
#: digests the filter knows too much, and more buckets are read; results stay the same.
LOG_BITS, PROBES, BUCKETS = 25, 5, 256


def bits(digest: str) -> Column:
    """word and mask of every bit that a digest sets."""
    place = lambda i: F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(1 << LOG_BITS))
    return F.array(*(F.struct(F.shiftright(place(i), 6).alias("word"), F.expr("1L").alias("one"), (place(i) % 64).cast("int").alias("at")) for i in range(PROBES)))


def set_bits(digests: DataFrame) -> DataFrame:
    """word, mask: the filter of these digests alone."""
    each = digests.select(F.explode(bits("digest")).alias("b")).select("b.*")
    return each.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("mask"))


def maybe_known(digests: DataFrame, known: DataFrame) -> DataFrame:
    """The digests all of whose bits a filter has: all that it covers, and few others."""
    each = digests.select("digest", F.explode(bits("digest")).alias("b")).select("digest", "b.*")
    hit = each.join(known, "word").filter(F.expr("(mask & shiftleft(one, at)) <> 0"))
    return hit.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == PROBES).select("digest")


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest", F.lit(-1)), F.lit(BUCKETS)).cast("int"))


def metrics(documents: DataFrame) -> DataFrame:
    """doc_id, digest, words, distinct_words, lines and longest (the longest word) of every text; null texts are left out."""
    words = F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda w: w != "")
    out = documents.filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), words.alias("_w"), F.size(F.split("text", "\n")).alias("lines"))
    longest = F.coalesce(F.array_max(F.transform("_w", lambda w: F.length(w))), F.lit(0))
    return out.select("doc_id", "digest", F.size("_w").alias("words"), F.size(F.array_distinct("_w")).alias("distinct_words"), "lines", longest.alias("longest"))


def earlier(spark: SparkSession, base: str, batch: int, buckets: list[int]) -> DataFrame | None:
    """The digests of earlier batches in these buckets; None where there are none."""
    if not batch or not buckets:
        return None
    try:
        every = spark.read.option("basePath", f"{base}/digests").schema("digest string, batch int, bucket int").parquet(f"{base}/digests")
    except AnalysisException:  # no batch had a text
        return None
    return every.filter(F.col("bucket").isin(buckets) & (F.col("batch") < batch)).select("digest")


def keep_new(batch: DataFrame, folder: str) -> None:
    """Write the metric rows of the texts of a batch (doc_id, text) that no earlier batch has, each with its least doc_id,
    to `folder` (.../out/batch=k), and their words to .../words/batch=k.

    A batch that is run again replaces what it wrote.
    """
    spark, number, base = batch.sparkSession, int(folder.rpartition("=")[2]), folder.rpartition("/out/")[0]
    rows = metrics(batch)
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(least, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    own = f"{base}/seen/batch={number}"
    first.write.mode("overwrite").parquet(own)
    mine = spark.read.schema(first.schema).parquet(own)
    known = spark.read.parquet(f"{base}/filter/batch={number - 1}") if number else None
    new = mine
    if known is not None:
        suspects = bucketed(maybe_known(mine, known))
        hit = sorted(r.bucket for r in suspects.select("bucket").distinct().collect())  # at most BUCKETS numbers
        before = earlier(spark, base, number, hit)
        if before is not None:
            new = mine.join(before.join(suspects.select("digest"), "digest", "left_semi"), "digest", "left_anti")
    new.select("doc_id", "digest", "words", "distinct_words", "lines", "longest").write.mode("overwrite").parquet(folder)
    kept = spark.read.schema(mine.schema).parquet(folder)
    bucketed(kept.select("digest")).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/digests/batch={number}")
    texts = batch.withColumn("digest", F.sha2("text", 256)).join(kept.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["digest"])
    tokens = texts.select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda w: w != "")).alias("pos", "token"))
    tokens.write.mode("overwrite").parquet(f"{base}/words/batch={number}")
    grown = set_bits(kept) if known is None else set_bits(kept).unionByName(known).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    grown.write.mode("overwrite").parquet(f"{base}/filter/batch={number}")
