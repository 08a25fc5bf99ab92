"""Documents to packed training sequences: language, exact copies, near copies, mixture, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; run() writes every stage's rows to the shared folder and reads them
back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import bitmap_hits, documents, drop, stash
from quillstone.llm.exact_dedup import exact_dedup, normalised
from quillstone.llm.language_id import keep_identified, learn
from quillstone.llm.mixing import mix_sources
from quillstone.llm.ngram_join import ngram_join
from quillstone.llm.packing import pack


def _boxed(docs: DataFrame, *keys: str) -> DataFrame:
    """Rows of docs as one column, __row, beside copies of keys: no column that a step adds can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *(F.col(k).alias(f"__{k}") for k in keys))


def _opened(boxed: DataFrame, docs: DataFrame) -> DataFrame:
    return boxed.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language of is not told: no letters, or a narrow margin.

    Null and empty texts have no letters and go; repeated rows stay or go together; a text of any length is judged whole;
    no rows give no rows; columns of any name are handed on.
    """
    return keep_identified(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: of the least doc_id, null last; of rows that share it too, any one.

    Null text counts as empty; a text of any length is compared whole; no rows give no rows; columns of any name are
    handed on. Only rows whose doc_id may be one of those to drop are hashed and shuffled again.
    """
    kept = exact_dedup(docs).where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("__stays"), F.count("*").alias("__n"))
    odd = stash(kept.where("not __stays or __n > 1").withColumnsRenamed({"doc_id": "__id", "text_sha256": "__sha"}), "odd")
    seen = bitmap_hits(_boxed(docs, "doc_id"), F.col("__doc_id"), odd, F.col("__id"), odd.count())
    among = seen.where("__hit").withColumn("__own", F.sha2(normalised("__row.text"), 256))
    among = among.join(odd, F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left").where("__stays is null or __stays")
    alike = F.when(F.col("__n") > 1, F.concat_ws(":", "__own", F.col("__doc_id").cast("string"))).otherwise(F.monotonically_increasing_id().cast("string"))
    one = among.withColumn("__alike", alike).dropDuplicates(["__alike"])
    return _opened(seen.where("not __hit"), docs).unionByName(_opened(one, docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component of near copies: five words, a similarity of 0.8 or more.

    Rows that share a doc_id go only if all of them would; rows without words, with null text, or with a null doc_id link
    with nothing or stay. A text of any length is one set; no rows give no rows; columns of any name are handed on.
    """
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = ngram_join(docs, n=5, num=80, den=100).groupBy("doc_id").agg(stays.alias("stays")).where("not stays and doc_id is not null")
    gone = stash(gone.select(F.col("doc_id").alias("__id")), "gone")
    seen = bitmap_hits(_boxed(docs, "doc_id"), F.col("__doc_id"), gone, F.col("__id"), gone.count())
    among = seen.where("__hit").join(gone, F.col("__doc_id") == F.col("__id"), "left_anti")
    return _opened(seen.where("not __hit"), docs).unionByName(_opened(among, docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it.

    A null source is a source, sorted last; rows that share doc_id and source are taken the same number of times; rows
    without words get the whole copies only. No rows give no rows; columns of any name are handed on.
    """
    got = mix_sources(docs).where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__from")).agg(F.max("copies").alias("__n"))
    both = _boxed(docs, "doc_id", "source").join(got, F.col("__doc_id").eqNullSafe(F.col("__id")) & F.col("__source").eqNullSafe(F.col("__from")))
    return _opened(both.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence; null and empty texts are their end alone, repeated rows documents of their own, long texts many pieces."""
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packed", packed)]
#: Compression, tokenizing and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_stashed"):
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
