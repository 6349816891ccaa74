"""Operators on claims, lines and items, on small tables and against slow versions."""

import itertools
import random

from pyspark.sql import functions as F

from veristrata.operators import assertion, gates, matching, retrieval, runlog, segment, stats


def test_sections_and_lines(spark):
    docs = spark.createDataFrame([(1, "intro\nDischarge Medications:\naspirin 81 mg\n\nFollow up:\nclinic"), (2, None), (3, "")], "doc_id int, text string")
    got = segment.sections(docs, {"meds": "medications", "plan": r"follow\s*up"}).orderBy("doc_id", "ordinal").collect()
    assert [(r["ordinal"], r["section"]) for r in got] == [(1, "unknown"), (2, "meds"), (3, "meds"), (4, "plan"), (5, "plan")]
    found = segment.signals(docs)
    assert {(r["domain"], r["first_line"]) for r in found.collect()} == {("medication_changes", 2), ("follow_up_actions", 4)}
    have = spark.createDataFrame([(1, "medication_changes")], "doc_id int, domain string")
    assert [r["domain"] for r in segment.uncovered_signals(found, have).collect()] == ["follow_up_actions"]
    ask = spark.createDataFrame([(1, 2, 3), (1, 3, 2), (1, 1, 9), (9, 1, 1), (2, 1, 1), (1, None, 1)], "doc_id int, first int, last int")
    got = sorted(((r["status"], r["quote"]) for r in segment.pointed(ask, docs).collect()), key=str)
    assert got == sorted([("as_given", "Discharge Medications:\naspirin 81 mg"), ("reversed", "Discharge Medications:\naspirin 81 mg"), ("unknown_line", None), ("unknown_document", None), ("unknown_line", None), ("unknown_line", None)], key=str)


def test_span_errors(spark):
    rows = [(1, ["S1"], "supported", "present"), (2, [], "supported", "present"), (3, ["S9"], "supported", "odd"), (4, None, None, "absent"), (5, ["S1", "S2", "S1", "S2"], "not_found", "absent")]
    got = spark.createDataFrame(rows, "k int, ids array<string>, s string, a string").select("k", segment.span_errors(F.col("ids"), F.array(F.lit("S1"), F.lit("S2")), F.col("s"), F.col("a")).alias("e"))
    assert {r["k"]: r["e"] for r in got.collect()} == {1: [], 2: ["empty_supported_span_ids"], 3: ["invalid_assertion", "unknown_span_id:S9"], 4: ["invalid_support_status", "span_ids_not_array"], 5: ["too_many_span_ids"]}
    what = got.select("k", segment.span_policy(F.col("e"), F.col("k") % 4).alias("p"))
    assert {r["k"]: r["p"] for r in what.collect()} == {1: "accept", 2: "exhausted", 3: "exhausted", 4: "retry", 5: "retry"}


def test_selector(spark):
    docs = spark.createDataFrame([(1, "aspirin started monday\nnoise alone here\nwarfarin dose raised\nclinic visit soon"), (2, None)], "doc_id int, text string")
    claims = spark.createDataFrame([(1, 1, "aspirin warfarin clinic", "aspirin"), (2, 1, "zebra giraffe", "zebra"), (3, 1, "noise alone zebra giraffe lion", "lion zebra"), (4, 2, "aspirin", "aspirin")], "item_id int, doc_id int, quote string, label string")
    got = {r["item_id"]: (r["status"], r["line_ids"]) for r in retrieval.select_minimal(retrieval.ranked_lines(claims, docs)).collect()}
    assert got == {1: ("supported", ["L0001"]), 2: ("not_found", []), 3: ("insufficient_evidence", ["L0002"])}
    lines = [{"ordinal": i, "line_id": str(i), "score": 0.5, "words": 2, "shared": [w]} for i, w in enumerate("abc", 1)]
    assert retrieval.greedy(lines, set("abc"), set(), 3)[0] == "supported" and len(retrieval.greedy(lines, set("abc"), set(), 2)[1]) == 2
    assert retrieval.greedy([{**x, "ordinal": x["ordinal"] * 500} for x in lines], set("abc"), set(), 3)[0] == "insufficient_evidence"


def test_assignment_is_best():
    rng = random.Random(5)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        edges = [(a, b, rng.randint(70, 100) / 100) for a in range(n) for b in range(m) if rng.random() < 0.6]
        best = (0, 0.0)
        for k in range(1, len(edges) + 1):
            for part in itertools.combinations(edges, min(k, 4)):
                if len({e[0] for e in part}) == len(part) == len({e[1] for e in part}):
                    best = max(best, (len(part), round(sum(e[2] for e in part), 6)))
        got = matching.assign(edges)
        assert (len(got), round(sum(e[2] for e in got), 6)) == best
    many = [(i, j, 1.0 if i == j else 0.8) for i in range(60) for j in range(60)]
    assert matching.assign(many) == [(i, i, 1.0) for i in range(60)]
    assert matching.assign([]) == []


def test_matches(spark):
    columns = "record_id int, domain string, item_id int, label string, source_quote string, assertion string"
    gold = spark.createDataFrame([(1, "labs", 1, "sodium low", "sodium 128", "present"), (1, "labs", 2, "potassium high", "k 6.1", "present"), (2, "meds", 1, "aspirin", None, None)], columns)
    predicted = spark.createDataFrame([(1, "labs", 7, "low sodium", "sodium 128", "absent"), (1, "meds", 8, "potassium high", "k 6.1", "present"), (3, "labs", 9, None, None, None)], columns)
    found = matching.matches(matching.candidates(predicted, gold))
    assert [(r["prediction"], r["gold"], round(r["score"], 2)) for r in found.collect()] == [(7, 1, 0.88)]
    assert {r["record_id"]: (r["tp"], r["fp"], r["fn"]) for r in matching.matched_scores(predicted, gold, found).collect()} == {1: (1, 1, 1), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_near_repeats(spark):
    rows = [(1, 0, "Aspirin started", "Aspirin 81 mg was started."), (1, 1, "aspirin  started", "aspirin 81 mg was started."), (1, 2, "Warfarin held", "Warfarin was held on admission."), (1, 3, "started aspirin 81", "Aspirin 81 mg was started"), (1, 4, None, None), (1, 5, None, ""), (2, 0, "Aspirin started", "Aspirin 81 mg was started.")]
    got = gates.drop_near_repeats(spark.createDataFrame(rows, "doc_id int, at long, label string, source_quote string"), ["doc_id"], "at")
    assert {(r["doc_id"], r["at"]): (r["kept_at"], r["reason"]) for r in got.collect()} == {(1, 0): (None, None), (1, 1): (0, "same_source_quote"), (1, 2): (None, None), (1, 3): (0, "contained_source_quote"), (1, 4): (None, None), (1, 5): (None, None), (2, 0): (None, None)}


def test_assertions(spark):
    rows = [("no evidence of pneumonia", "pneumonia", "absent"), ("history of stroke", "stroke", "historical"), ("mother with diabetes", "diabetes", "associated_with_someone_else"), ("possible pneumonia today", "pneumonia", "possible"), ("return if fever develops", "fever", "conditional"), ("no fever but pneumonia confirmed", "pneumonia", "present"), ("", "pneumonia", "present"), (None, None, "present")]
    df = spark.createDataFrame(rows, "context string, target string, want string")
    for r in assertion.scoped(df, "context", "target").collect():
        assert r["assertion"] == r["want"], r
    s = spark.createDataFrame([("It may rain", "possible"), ("not only rain", "present"), ("no rain", "absent"), (None, "present")], "s string, want string").select("want", assertion.of_sentence(F.col("s")).alias("got"))
    assert all(r["want"] == r["got"] for r in s.collect())


def test_exact_test(spark):
    rows = spark.createDataFrame([(1, 0)] * 9 + [(0, 1)] + [(1, 1)] * 5, "a int, b int")
    r = stats.mcnemar(rows, F.col("a") == 1, F.col("b") == 1).first()
    assert (r["only_first"], r["only_second"], r["p"]) == (9, 1, 0.021484)
    assert runlog.spread(rows.limit(0), "a", F.col("b")).count() == 0
