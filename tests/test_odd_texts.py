"""Queries over sentences against their SQL on texts with other spaces and letters than the given tables have."""

import random
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import cluster, features, provenance
from veristrata.plans import catalogue

WORDS = "no not only may have might possible ruled out denies if without doubt negative for concern l\u0130kely \u0130f \u212anow 12".split()
MARKS = [*" \t\r\v\f.!?;:\n_-'", *"\u00a0\u2003\u202f\u3000\u0085\u2028\u200b\u00e9\U0001f600", "not only not only not", "no evidence of"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(7)
    texts = ["".join(rng.choice(WORDS if rng.random() < 0.4 else MARKS) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    folder = tmp_path_factory.mktemp("odd")
    rows = [*enumerate([*texts, None, "", "a.\u3000", "\u00a0.b", "l\u0130kely"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["q_sentence_stats", "q_assertion_sentences", "q_status_baselines", "q_status_scores", "q_tfidf_top"])
def test_query(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, odd)
    got = con.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(got)


def test_classes_without_negation(spark):
    """but() is the negated class, over every character."""
    planes = [(k, "".join(chr(c) for c in range(k << 16, (k + 1) << 16) if not 0xD800 <= c < 0xE000)) for k in range(17)]
    rows = spark.createDataFrame(planes, "k int, x string")
    for kept in (".", "%./+-", "./ \t\n\x0b\f\r"):
        old = "[^a-z0-9" + "".join(f"\\x{{{ord(c):x}}}" for c in kept) + "]"
        assert rows.filter(F.regexp_replace("x", old, "") != F.regexp_replace("x", T.but_words(kept), "")).count() == 0
    assert T.but((0, 5), (7, sys.maxunicode)) == r"[\x{6}-\x{6}]"


def test_taxonomy_normalises_once(spark):
    """The loose form and its table of characters aren't in the plan that the taxonomy returns: they would be there many times."""
    docs = spark.createDataFrame([(1, "Aspirin 81 mg was started"), (2, "Ａspirin 8.5. mg"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "aspirin, 81 mg"), (2, "aspirin 8.5"), (3, None)], "item_id int, text string")
    found = provenance.miss_taxonomy(items, docs)
    assert "translate(" not in found._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "normalized", 1.0, 1), (2, "normalized", 1.0, 2), (3, "low_overlap", 0.0, None)}


def test_terms_of_repeated_ids(spark):
    """Rows that share an id are one document for the vocabulary; only its terms are counted by document, from a settled table."""
    rows = spark.createDataFrame([(i // 2, t) for i, t in enumerate(["red fox", "red fox den", "red owl", "fox red", "owl", None, "", "x y"])], "doc_id int, text string")
    found = cluster.tfidf(rows, 2, 1.0)
    assert {(r["doc_id"], r["token"]) for r in found.collect()} == {(0, "red"), (0, "fox"), (1, "red"), (1, "fox"), (1, "owl"), (2, "owl")}
    assert "vocabulary-" in found._jdf.queryExecution().toString()


def test_support_reads_each_text_once(spark):
    """By words counted, as the columns say it; a long text isn't searched again for each word."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("a b c d.e f/g no prior , \u0130".split()) for _ in range(rng.randint(0, 9)))
    rows = spark.createDataFrame([(i, text(), text()) for i in range(200)] + [(200, None, "no"), (201, "a", None), (202, "", "")], "k int, v string, q string")
    want = rows.select("k", features.lexical_support(F.col("v"), F.col("q")), features.cue_aware_support(F.col("v"), F.col("q"))).collect()
    assert sorted(map(tuple, features.support(rows, "k", "v", "q").collect())) == sorted(map(tuple, want))
    plan = catalogue.QUERIES["q_support_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "RLIKE" not in plan[: plan.index("Generate")]


@pytest.mark.parametrize("most", [provenance.SENT_IDS, 0])
def test_taxonomy_with_and_without_sent_ids(spark, monkeypatch, most):
    """The ids that items meet may be sent to the tasks or not; the summary is the same."""
    monkeypatch.setattr(provenance, "SENT_IDS", most)
    docs = spark.createDataFrame([(1, "Aspirin 81 mg was started for chest pain.\nFollow up in clinic."), (1, "unrelated words"), (None, "Aspirin")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "aspirin 81 MG was started"), (2, "Aspirin, 81 mg was started for chest"), (3, "zebra giraffe")], "item_id int, text string")
    found = provenance.miss_taxonomy(items, docs)
    assert "translate(" not in provenance.summarise(found)._jdf.queryExecution().analyzed().toString()
    assert {(r["category"], r["items"]) for r in provenance.summarise(found).collect()} == {("exact", 1), ("normalized", 1), ("low_overlap", 1)}


@pytest.mark.parametrize("threshold", ["10m", "256k"])
def test_key_rows_stay_off_the_driver(spark, monkeypatch, threshold):
    """The documents' keys and the pairs take next to nothing in files, as they repeat, and much more in the driver: they're never broadcast."""
    plans, settle = {}, provenance.settle
    joins = lambda df: re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(provenance, "settle", lambda df, name: (plans.update({name: joins(df)}), settle(df, name))[1])
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("aspirin 81 mg was started for chest pain").alias("text"))
    items = spark.createDataFrame([(k, "aspirin 81 mg was started for chest pain") for k in range(20)], "item_id int, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = provenance.contained(items, docs)
        assert joins(found)[0] == plans["quote-pairs"][0] == "SortMergeJoin"
        assert found.count() == 400_000
        monkeypatch.setattr(provenance, "SENT_IDS", 0)
        assert set(joins(provenance.shared_tokens(items, docs))[1:]) == {"SortMergeJoin"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
