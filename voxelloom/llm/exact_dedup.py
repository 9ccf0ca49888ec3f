"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so. Chunks become identifiers: a 64-bit hash with its length, verified by
a 256-bit digest; where one hash stands for several digests, these are numbered. Two documents are equal when their
ordered identifier lists are, so whole texts are read once and never shuffled.

Defined results: a null text equals an empty one. Of equal texts the row with the largest id stays; rows without an
id lose to any row with one. Of rows that repeat both id and text, one stays. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import join_few, once, row_keys, stage, text_of, without

# A chunk ends after the first sentence or line end past 512 characters, or at 4096 characters.
CHUNK = r"(?s).{511,4095}?[.!?\n]|.{1,4096}"


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """Content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """(doc_id, k1, k2, text_sha256, parts): per document the ordered chunks as (hash, length, digest)."""
    text = text_of(docs)
    rows = docs.select("doc_id", *row_keys(docs["doc_id"], text), F.sha2(text, 256).alias("text_sha256"),
                       chunks(text, pattern).alias("_chunks"))
    return rows.select("doc_id", "k1", "k2", "text_sha256", F.transform("_chunks", lambda c: F.struct(
        F.xxhash64(c).alias("h"), F.length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("parts"))


def verified_chunks(listed: DataFrame) -> DataFrame:
    """Distinct chunks (h, n, digest, copies, rank); ``rank`` is above 1 only where a hash has several digests."""
    rows = listed.select(F.explode("parts").alias("p")).groupBy("p.h", "p.n", "p.digest").agg(
        F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("h", "n").orderBy("digest")))


def exact_dedup(docs: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, k1, k2), one row per input row."""
    listed = stage(recipes(docs, pattern))
    # Identifiers differ from plain hashes only where digests disagree; those documents are renumbered.
    clash = verified_chunks(listed).where("rank > 1").select("h", "n", "digest", "rank")
    renamed = listed.select("text_sha256", F.posexplode("parts").alias("pos", "p")).select(
        "text_sha256", "pos", "p.*").join(clash, ["h", "n", "digest"]).groupBy("text_sha256").agg(
        F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("ranks"))
    none = F.array().cast("array<struct<pos:int,rank:int>>")
    named = join_few(listed, renamed, ["text_sha256"], ["doc_id"]).select("doc_id", "k1", "k2", "text_sha256", F.struct(
        F.transform("parts", lambda p: F.struct(p["h"], p["n"])).alias("ids"),
        F.coalesce("ranks", none).alias("ranks")).alias("_recipe"))
    # The lists themselves are the key: equal lists meet after a map-side combine, then over salted keys.
    groups = stage(named.groupBy("_recipe").agg(
        F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1"))
    joined = join_few(named, groups, ["_recipe"], ["doc_id"])
    alone, keeper = F.col("_size").isNull(), F.col("doc_id").eqNullSafe(F.col("_keep"))
    first = F.row_number().over(W.partitionBy("text_sha256").orderBy("_size")) == 1
    out = [F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
           F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size")]
    last = ["text_sha256", "k1", "k2"]
    keepers = joined.where(~alone & keeper).select("doc_id", *out, first.alias("kept"), *last)
    return joined.where(alone | ~keeper).select("doc_id", *out, alone.alias("kept"), *last).unionByName(keepers)


def deduplicated(docs: DataFrame, pattern: str = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged."""
    keys = stage(exact_dedup(docs, pattern).groupBy("k1", "k2").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept"))
    left = without(docs, keys.where("not kept"))
    repeated = keys.where("kept")
    return left if repeated.isEmpty() else once(left, repeated)
