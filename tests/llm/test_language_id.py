import os

import pytest
from pyspark.sql import functions as F

from quillstone.llm.language_id import held_out, identify, learn

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    got = identify(docs, learn(docs.where(~held_out()))).join(docs.select("doc_id", "lang"), "doc_id").where(held_out())
    right, n, rejected = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right > 0.96 and n > 100, right


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (None, "und", None), (5, "", None), (5, "ж", None)]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in identify(df, learn(df)).collect()}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")} <= got and len(identify(df, learn(df)).collect()) == 7
    assert {r.lang_pred for r in identify(df, {}).collect()} == {"und"}
    assert identify(df.limit(0), learn(df.limit(0))).collect() == []


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_accuracy_by_length(spark):
    docs = spark.read.parquet(SF)
    dictionaries = learn(docs.where(~held_out()))
    said = docs.where(held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    cut = F.expr("explode(array(60, 150, 255, 256, 257, 1000, 5000, 1000000))").alias("most")
    parts = said.select("lang", "text", cut).select("lang", "most", F.expr("substring(text, 1, most)").alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    parts = spark.createDataFrame(parts.collect(), parts.schema)
    got = identify(parts, dictionaries).join(parts.select("doc_id", "lang", "most"), "doc_id")
    right = {r.most: r.right for r in got.groupBy("most").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert all(v > (0.85 if k < 100 else 0.93 if k < 1000 else 0.98) for k, v in right.items()), right
    assert abs(right[255] - right[257]) < 0.03  # no step at any length


def test_every_language_is_learned(spark):
    import random

    r = random.Random(4)
    words = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for k in range(300)}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(120)), k) for i, k in enumerate([*words] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = learn(docs.where("doc_id < 300"))
    assert sorted(dictionaries) == sorted(words)
    got = identify(docs.where("doc_id between 300 and 419"), dictionaries).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() == 120


def test_long_text_and_clashing_columns(spark):
    from quillstone.llm.language_id import keep_identified

    en, de = "the cat and the dog were of the house ", "der Hund und die Katze sind nicht im Haus "
    rows = [(1, en * 9, "en", 0.1, "x"), (2, de * 9, "de", 0.2, "y"), (3, de * 60_000, None, 0.3, "z"), (3, de * 60_000, None, 0.3, "z"), (4, None, "en", 0.4, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    dictionaries = learn(docs)
    assert [(r.lang_pred, r.rejected) for r in identify(docs, dictionaries).where("doc_id = 3").collect()] == [("de", False)] * 2
    kept = keep_identified(docs, dictionaries)
    assert kept.columns == docs.columns and sorted(kept.select("doc_id", "score", "lang_pred").collect()) == [(1, 0.1, "x"), (2, 0.2, "y"), (3, 0.3, "z"), (3, 0.3, "z")]
