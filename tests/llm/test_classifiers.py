"""Held-out figures of the three classifiers, on rows whose labels weren't learned from."""

from pyspark.sql import functions as F

from veristrata.llm import language, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_language(spark):
    got = language.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    r = got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hit")).first()
    assert r["n"] > 1000 and r["hit"] >= 0.95


def test_quality(spark):
    got = quality.op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("hit"), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept")).first()
    assert r["hit"] >= 0.95 and r["kept"] >= 0.98


def test_toxicity(spark):
    got = toxicity.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first()
    assert r["recall"] >= 0.85 and r["precision"] >= 0.95


def test_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "a " * 300_000, "en", "x"), (4, "123 !!!", "en", "x"), (5, "plain words here", "en", "x"), (5, "plain words here", "en", "x"), (None, "plain words here", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    named = language.identify(docs, language.fit_discriminator(docs))
    assert {r["doc_id"]: r["lang_pred"] for r in named.collect() if r["doc_id"] in (1, 2, 4)} == {1: "und", 2: "und", 4: "und"}
    for scored in (quality.score_quality(docs, quality.fit_field(docs, none)), toxicity.score_toxicity(docs, toxicity.fit_machine(docs, none))):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (5, None)}) == 1
    assert quality.score_quality(docs.limit(0), quality.fit_field(docs.limit(0), none)).count() == 0 and language.identify(docs.limit(0), language.fit_discriminator(docs.limit(0))).count() == 0
