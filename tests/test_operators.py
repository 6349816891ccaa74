"""Operators that have no SQL, and readers and writers, on small tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import cohort, conformal, matching, provenance, retrieval, sample, segment, spans, stats
from veristrata.sources import readers
from veristrata.streaming import resume


def test_loose_form_has_nfkc(spark):
    import unicodedata

    rng = random.Random(1)
    pool = [chr(c) for c in (0xFF21, 0xFB01, 0xBD, 0x2460, 0x33AE, 0x2126, 0xE9, 0x301, 0x308, 0x41, 0x65, 0x71, 0x31, 0x2E, 0x20, 0x5B, 0x2026, 0x1D400, 0x2075)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["[**a\nb**] x [**]y**]"]
    slow = lambda x: re.sub(r"[^a-z0-9.]+", " ", re.sub(r"\[\*\*[^\]]+\*\*\]", " ", unicodedata.normalize("NFKC", x).lower())).strip()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normal_loose(F.col("t")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got] == [(t, slow(t)) for t in texts]


def test_small_forms(spark):
    r = spark.createDataFrame([("Aspirin  81 MG tablet, 5 grapes", "a-b É9", "x1 2.50 y 7")], "a string, b string, c string").select(T.normal_dose(F.col("a")), T.normal_quote(F.col("b")), T.numbers(F.col("c"))).first()
    assert list(r) == ["aspirin tablet 5 grapes", "a b é9", [2.5, 7.0]]
    rows = spark.createDataFrame([(2, 1, 30, 20, 0.9), (2, 3, 30, 20, 0.9), (4, 2, 30, 20, 0.4), (1, 1, 50, 20, 0.9)], "s int, sec int, win int, w int, q double")
    args = [F.col(c) for c in ("s", "sec", "win", "w", "q")]
    assert [tuple(r) for r in rows.select(retrieval.risky(*args), retrieval.risky(*args, strict=True)).collect()] == [(False, False), (True, True), (True, True), (True, True)]


def test_contained_is_plain_inclusion(spark):
    rng = random.Random(3)
    words = ["the", "up", "follow", "course", "brief", "a", "é", "x1", "was"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    items = []
    for i in range(120):
        text = rng.choice(docs)[1]
        a = rng.randrange(len(text) + 1)
        items.append((i, text[a : a + rng.randint(0, 14)] if rng.random() < 0.8 else " ".join(rng.choice(words) for _ in range(3))))
    form = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    want = {(i, d) for i, q in items for d, t in docs if form(q) and form(q) in form(t)}
    got = provenance.contained(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_running_over_any_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(-50, 900, 7), 1e9, -3.5]), rng.choice("ab"), rng.randint(0, 3)) for _ in range(600)]
    by = spark.createDataFrame([(None if s is None else float(s), g, n) for s, g, n in rows], "s double, g string, n long").groupBy("s", "g").agg(F.sum("n").alias("n"))
    for r in stats.running(by, "s", ["g"]).collect():
        assert r["n__below"] == sum(n for s, g, n in rows if s is not None and g == r["g"] and s <= r["s"])
    df = spark.createDataFrame([(float(s), g) for s, g, _ in rows if s is not None], "s double, g string")
    for r in conformal.quantiles(df, "s", 0.1, ["g"]).collect():
        own = sorted(float(s) for s, g, _ in rows if s is not None and g == r["g"])
        rank = math.ceil((len(own) + 1) * 0.9 - 1e-9)
        assert (r["n"], r["q"]) == (len(own), own[rank - 1] if rank <= len(own) else math.inf)


def test_upper_bounds():
    direct = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 5, 0.1), (1, 150, 0.04), (7, 20, 0.5), (19, 20, 0.99), (3, 400, 0.02), (30, 60, 0.4)):
        assert abs(conformal.binomial_cdf(k, n, p) - direct(k, n, p)) < 1e-10
        assert abs(direct(k, n, conformal.clopper_pearson(k, n, 0.05)) - 0.05) < 1e-9
    assert conformal.clopper_pearson(3, 3, 0.05) == conformal.clopper_pearson(0, 0, 0.05) == 1.0


def test_neighbours_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(cohort, "CHUNK", 16)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(70)]
    got = {}
    for r in cohort.neighbours(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 4).collect():
        got[r["id"], r["rank"]] = r["neighbour"]
    size = lambda v: math.sqrt(sum(x * x for x in v))
    like = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (size(a) * size(b)), 12) if size(a) and size(b) else 0.0
    for i, v in rows:
        order = sorted(((-like(v, w), j) for j, w in rows if j != i))[:4]
        assert [got[i, k] for k in (1, 2, 3, 4)] == [j for _, j in order]


def test_many_items_are_assigned_fast(spark):
    import time

    rng = random.Random(2)
    edges = [(a, b, rng.randint(72, 100) / 100) for a in range(80) for b in range(80)]
    began = time.process_time()
    assert len(matching.assign(edges)) == 80 and time.process_time() - began < 5


def test_even_sample_of_large_keys(spark):
    rows = spark.range(1000).select((F.col("id") * 3 + (1 << 60)).alias("k"))
    got = {r["position"]: r["k"] for r in sample.even_sample(rows, "k", 7).collect()}
    assert got == {i * 1000 // 7: (i * 1000 // 7) * 3 + (1 << 60) for i in range(7)}
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(50)], "k string")
    assert {r["position"]: r["k"] for r in sample.even_sample(names, "k", 5).collect()} == {i * 10: f"n{i * 10:03}" for i in range(5)}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/batch_1.json").write_text('{"results": 1, "rows": [{"case_id": "a", "model": "m"}, {"case_id": "b", "model": "m"}]}')
    (tmp_path / "in/batch_2.json").write_text('{"results": 1, "rows": [{"case_id": "c", "model": "m"}]}')
    (tmp_path / "in/other.json").write_text('{"deep": [{"x": {"case_id": "z\\"q"}}], "case_id": 7}')
    assert sorted(r["case_id"] for r in readers.union_batches(spark, str(tmp_path / "in"), ["case_id", "model"]).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        readers.union_batches(spark, str(tmp_path / "in"), ["model"])
    assert {tuple(r) for r in readers.every_value(spark, str(tmp_path / "in"), "case_id").collect()} == {("batch_1.json", "a"), ("batch_1.json", "b"), ("batch_2.json", "c"), ("other.json", 'z"q'), ("other.json", "7")}
    (tmp_path / "l.jsonl").write_text('{"id": "1", "src": "s"}\n{"id": "2", "src": " "}\n')
    assert [r["record_id"] for r in readers.as_records(readers.read_records(spark, str(tmp_path / "l.jsonl"))).collect()] == ["1"]
    (tmp_path / "c.csv").write_text("case_id,text\n , \n,note b\n,note a\nx,t\n")
    cases = readers.as_cases(readers.read_records(spark, str(tmp_path / "c.csv")), "text").collect()
    assert {r["case_id"]: r["text"] for r in cases} == {"CASE_00001": "note a", "CASE_00002": "note b", "x": "t"}
    rows = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "k int, t string")
    readers.write_csv(rows, str(tmp_path / "out"))
    assert {r["t"] for r in readers.read_records(spark, str(tmp_path / "out"), "csv").collect()} >= {'say "hi", you'}
    assert readers.markdown(rows, "T") == '# T\n\n| k | t |\n| - | - |\n| 1 | say "hi", you |\n| 2 |  |\n'
    both, twice = readers.union_reports([rows, rows.drop("t")], ["k"])
    assert both.count() == 4 and twice.count() == 2


def test_resume(spark, tmp_path):
    source, done, marks = (str(tmp_path / n) for n in ("source", "done", "marks"))
    work = lambda rows: rows.select((F.col("k") * 2).alias("k"))
    for n in (3, 5):
        spark.range(n).withColumnRenamed("id", "k").write.mode("append").parquet(source)
        resume.resume(spark, source, "k long", done, marks, work)
    assert sorted(r["k"] for r in spark.read.parquet(done).collect()) == sorted([0, 2, 4, 0, 2, 4, 6, 8])


def test_spans_of_odd_texts():
    for text in ("", "\n\n", "a", "Labs:", "x" * 5000, "a;b;;c", "Medications: Discharge: x / y | z, and w. V"):
        for g in spans.GRANULARITIES:
            got = list(spans.spans(text, g))
            assert all(text[a:b] == t for _, _, t, a, b, _, _ in got) and [s[1] for s in got] == [f"S{i + 1}" for i in range(len(got))]
    with pytest.raises(ValueError):
        list(spans.spans("a", "paragraph"))
    for text in (None, "", "word " * 400, "MAJOR ALLERGY: x\nLABS: ? * 1. 2) ??? y"):
        assert all(text[s:e] == q for _, _, _, _, _, _, s, e, _, q, _ in spans.candidates(text))


def test_lines_beyond_four_digits(spark):
    text = "\n".join(str(i) for i in range(1, 10_006))
    got = retrieval.ranked_lines(spark.createDataFrame([(1, 1, "10005", "10005")], "item_id int, doc_id int, quote string, label string"), spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert got.filter("rank = 1").first()["line_id"] == "L10005" and segment.line_id is not None


def test_splits_against_a_slow_run(spark):
    rng = random.Random(8)
    rows = [(f"c{i // 3:02}", round(rng.random(), 2), rng.random() < 0.6) for i in range(60)]
    items = spark.createDataFrame(rows, "c string, s double, ok boolean")
    got = {r["alpha"]: r for r in conformal.repeated_splits(items, "c", ["s"], "ok", [0.1, 0.3], splits=7).collect()}
    state, cases = 0x1234567, sorted({c for c, _, _ in rows})
    for alpha in (0.1, 0.3):
        risks = []
        for _ in range(7):
            x = list(cases)
            for i in range(len(x) - 1, 0, -1):
                state = int(state * 1103515245.0 + 12345.0) & 0x7FFFFFFF
                j = int(state / 0x7FFFFFFF * (i + 1))
                x[i], x[j] = x[j], x[i]
            cal = [r for r in rows if r[0] in x[: len(x) // 2]]
            cuts = sorted({0.0, conformal.BEYOND, *(s for _, s, _ in cal)})
            lam = next((t for t in cuts if (sum(s >= t and not ok for _, s, ok in cal) + 1) / (len(cal) + 1) <= alpha), conformal.BEYOND)
            test = [r for r in rows if r[0] not in x[: len(x) // 2]]
            risks.append(sum(s >= lam and not ok for _, s, ok in test) / len(test))
        assert got[alpha]["risk"] == round(sum(risks) / 7, 6)


def test_regression_and_power(spark):
    import numpy as np

    x = np.array([[1.0, -1.0], [1.0, 1.0], [1.0, 2.0], [1.0, -2.0]])
    w = conformal.logistic(x, np.array([0, 1, 1, 0]))
    assert w[1] > 1 and abs(w[0]) < 1e-9
    got = {r["n"]: r for r in cohort.planned_sizes(spark, [30, 120], 0.05, 0.25, 0.08, 60).collect()}
    for n, r in got.items():
        state, found = 20260618 + n, 0
        for _ in range(60):
            a = b = 0
            for _ in range(n):
                state = (1664525 * state + 1013904223) % 2**32
                u = state / 2**32
                a, b = a + (0.05 <= u < 0.30), b + (0.05 + 0.25 <= u < 0.05 + 0.25 + 0.08)
            found += (a + b > 0) and cohort.exact_mcnemar(a, b) < 0.05
        assert abs(r["power"] - found / 60) < 1e-9
    assert got[120]["power"] > got[30]["power"] and got[120]["half_width"] < got[30]["half_width"]


def test_compaction():
    from veristrata.operators import attribution

    text, score = attribution.compacted("Check potassium level", "Doctor: we talked about the garden and check potassium level before the visit, then the weather was fine for a walk")
    assert "potassium level" in text and len(text.split()) < 12 and score > 0.8
