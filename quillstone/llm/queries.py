"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, lm, media, pii, token_count
from .common import documents
from .exact_dedup import exact_dedup
from .language_id import held_out, identify, learn
from .mixing import mix_sources
from .ngram_join import ngram_join
from .packing import pack


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm.score(docs, lm.train(docs.where(~lm.held_out())))
    return scored.select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(held_out(), F.lit(False))
    got = identify(docs, learn(docs.where(~out)))
    return got.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("identity")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("copies", "source")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_lm_scoring, op3_html_text, op4_language_id, op5_exact_dedup, op6_media, op7_token_counts, op8_mixing, op9_pii, op10_packing)}

#: What SQL can express, for DuckDB.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t
    """,
}
