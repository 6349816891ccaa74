"""Queries on small notes whose answers are known and written out as SQL values: rules that read a text, which SQL can't repeat."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veristrata.operators import assertion, attribution, claims, gates, matching, multispan, provenance, retrieval, segment, spans
from veristrata.plans.catalogue import query


def values(columns: str, *rows: tuple) -> str:
    """SELECT of the rows; a string that begins with = is an expression."""
    one = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else (v[1:] if v.startswith("=") else "'" + v.replace("'", "''") + "'") if isinstance(v, str) else repr(v)
    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


NOTE = "DISCHARGE MEDICATIONS: Aspirin 81 mg daily / Metformin 500 mg BID.\nHOSPITAL COURSE:\nAdmission: Lasix 40 mg daily. Discharge: Furosemide 20 mg daily.\nFOLLOW-UP: Cardiology in one week, with BMP before visit."


def _spans(spark, granularity):
    rows = spark.createDataFrame([(1, NOTE), (2, None), (3, " \n"), (4, "Labs:\r\n\r\nsodium 128; potassium low")], "doc_id int, text string")
    return spans.span_index(rows, granularity).drop("ordinal")


@query(
    values(
        "doc_id, span_id, text, char_start, char_end, section, line",
        (1, "S1", "Aspirin 81 mg daily", 23, 42, "medications", 1), (1, "S2", "Metformin 500 mg BID.", 45, 66, "medications", 1), (1, "S3", "Admission: Lasix 40 mg daily.", 84, 113, "course", 3),
        (1, "S4", "Discharge: Furosemide 20 mg daily.", 114, 148, "course", 3), (1, "S5", "Cardiology in one week", 160, 182, "follow_up_safety", 4), (1, "S6", "with BMP before visit.", 184, 206, "follow_up_safety", 4),
        (4, "S1", "sodium 128", 9, 19, "labs", 3), (4, "S2", "potassium low", 21, 34, "labs", 3),
    )
)
def q_span_index(spark, d):
    return _spans(spark, "clause")


@query(
    values(
        "doc_id, span_id, text, char_start, char_end, section, line",
        (1, "S1", "DISCHARGE MEDICATIONS: Aspirin 81 mg daily / Metformin 500 mg BID.", 0, 66, "medications", 1), (1, "S2", "Admission: Lasix 40 mg daily. Discharge: Furosemide 20 mg daily.", 84, 148, "course", 3),
        (1, "S3", "FOLLOW-UP: Cardiology in one week, with BMP before visit.", 149, 206, "follow_up_safety", 4), (4, "S1", "sodium 128; potassium low", 9, 34, "labs", 3),
    )
)
def q_span_lines(spark, d):
    return _spans(spark, "line")


@query(values("spans, wrong", (6, 0)))
def q_span_places(spark, d):
    """Spans of the note, and how many of them their places don't give."""
    rows = spark.createDataFrame([(1, NOTE)], "doc_id int, note string")
    found = spans.span_index(rows.withColumnRenamed("note", "text")).join(rows, "doc_id")
    return found.agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.expr("substring(note, char_start + 1, char_end - char_start)") != F.col("text")).alias("wrong"))


LIST_NOTE = "DISCHARGE MEDICATIONS:\n1. Aspirin 81 mg daily.\n2. Prednisone taper from 60 mg to 20 mg.\n\nDISCHARGE DIAGNOSES:\n1. Pneumonia.\n\nFOLLOW-UP:\nClinic in one week."
_id = lambda domain, text: f"='C_{domain[:3].upper()}_' || substr(sha256('{domain}|{text.lower()}'), 1, 12)"
_entries = [("medication_changes", "1. Aspirin 81 mg daily."), ("medication_changes", "2. Prednisone taper from 60 mg to 20 mg."), ("diagnosis_changes", "1. Pneumonia."), ("follow_up_actions", "Clinic in one week.")]


@query(values("doc_id, ordinal, candidate_id, domain, origin, canonical_text", *((k, i, _id(a, t), a, "section_entry", t) for k in (1, 2, 3) for i, (a, t) in enumerate(_entries, 1)), (4, 1, _id("labs", "Sodium was 128 today."), "labs", "cue_chunk", "Sodium was 128 today.")))
def q_candidates(spark, d):
    """One note in three layouts gives the same candidates by the same names."""
    notes = [(1, LIST_NOTE), (2, LIST_NOTE.replace("\n", "   \n")), (3, " ".join(LIST_NOTE.split())), (4, "Sodium was 128 today. Nothing else."), (5, None)]
    return spans.candidate_index(spark.createDataFrame(notes, "doc_id int, text string")).select("doc_id", "ordinal", "candidate_id", "domain", "origin", "canonical_text")


@query(values("doc_id, found, wrong, left_over", (1, 4, 0, 2)))
def q_candidate_places(spark, d):
    notes = spark.createDataFrame([(1, LIST_NOTE)], "doc_id int, text string")
    found = spans.candidate_index(notes, most=2).join(notes, "doc_id")
    wrong = F.expr("substring(text, original_start + 1, original_end - original_start)") != F.col("source_quote")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count_if(wrong).alias("wrong"), F.count_if(~F.col("kept")).alias("left_over"))


SIGNS = "DISCHARGE DIAGNOSES:\nNo evidence of pulmonary embolism on CTA.\nPossible pneumonia, treated empirically.\nReturn for chest pain if symptoms recur.\nHistory of atrial fibrillation, resolved after ablation.\nFamily history of colon cancer in father.\nAcute kidney injury improved before discharge."
_sentences = ["No association was observed between treatment and response in the adjusted analysis.", "These findings may indicate improved adherence after discharge.", "The intervention was not only feasible but associated with better follow-up completion."]
_asked = [("pulmonary embolism", "absent"), ("pneumonia", "possible"), ("chest pain", "conditional"), ("atrial fibrillation", "historical"), ("colon cancer", "associated_with_someone_else"), ("Acute kidney injury", "present")]
_cases = [(i, SIGNS, q, q, s) for i, (q, s) in enumerate(_asked, 1)] + [(7, "No fever but has pneumonia.", "pneumonia", "pneumonia", "present"), (8, SIGNS, "missing target", "pneumonia", "present")] + [(9 + i, s, s, s, w) for i, (s, w) in enumerate(zip(_sentences, ("absent", "possible", "present")))] + [(12, None, None, "x", "present")]


@query(values("item_id, assertion, quote_found", *((i, w, i not in (8, 12)) for i, _, _, _, w in _cases)))
def q_assertion(spark, d):
    rows = spark.createDataFrame([c[:4] for c in _cases], "item_id int, source string, quote string, label string")
    return assertion.detected(rows).select("item_id", "assertion", "quote_found")


TYPED_NOTE = "\n".join([
    "Metoprolol tartrate 25 mg, 1 tab PO twice daily - NEW.", "No evidence of pulmonary embolism on CTA.", "Acute kidney injury improved before discharge.", "Follow up with nephrology in one week.",
    "Cardiology as needed.", "Potassium was 3.1 mmol/L after diuresis and was replaced.", "Potassium was low after diuresis and was replaced.", "Potassium was 3.1 mmol/L after diuresis.", "The wound was surgically debrided.",
])
_typed = [
    ("Acute kidney injury", "Acute kidney injury improved before discharge.", "", "direct_quote"), ("metoprolol tartrate 25 mg oral twice daily", "Metoprolol tartrate 25 mg, 1 tab PO twice daily - NEW.", "", "normalized"),
    ("pulmonary embolism", "pulmonary embolism", "", "assertion_conflict"), ("nephrology appointment", "Follow up with nephrology in one week.", "", "inferential"), ("cardiac catheterization", "Cardiology as needed.", "", "unsupported"),
    ("Simvastatin 20 mg nightly stopped", "Simvastatin was stopped because of muscle pain.", "medication_changes.stopped[0]", "inferential"),
    ("Echocardiogram performed", "Echocardiogram showed an ejection fraction of 35 percent.", "procedures_and_tests[0]", "inferential"),
    ("Hypokalemia, corrected", "Potassium was 3.1 mmol/L after diuresis and was replaced.", "diagnosis_changes.discharge[0]", "inferential"),
    ("Hypokalemia, corrected", "Potassium was low after diuresis and was replaced.", "diagnosis_changes.discharge[0]", "inferential"),
    ("Hypokalemia, corrected", "Potassium was 3.1 mmol/L after diuresis.", "diagnosis_changes.discharge[0]", "unsupported"),
    ("Surgical debridement of left lower-leg wound", "The wound was surgically debrided.", "procedures_and_tests[0]", "inferential"), ("fever", None, "", "unsupported"),
]


def _claims(spark):
    rows = [(i, TYPED_NOTE, q, x, (dom or "none").split(".")[0].split("[")[0]) for i, (x, q, dom, _) in enumerate(_typed, 1)]
    return assertion.typed_provenance(spark.createDataFrame(rows, "item_id int, source string, quote string, label string, domain string"))


@query(values("item_id, type", *((i, w) for i, (_, _, _, w) in enumerate(_typed, 1))))
def q_typed_provenance(spark, d):
    return _claims(spark).select("item_id", "type")


@query(
    f"with t as ({values('item_id, domain, type, found', *((i, (dom or 'none').split('.')[0].split('[')[0], w, i not in (6, 7, 12)) for i, (_, _, dom, w) in enumerate(_typed, 1)))}) select domain, type, count(*) as claims, count(*) filter (found) as located from t group by cube (domain, type)"
)
def q_typed_report(spark, d):
    return assertion.provenance_report(_claims(spark))


@query(values("located, conflicts, rate", (9, 1, "=0.111111::double")))
def q_overstatement(spark, d):
    return assertion.overstatement(_claims(spark))


GATE_NOTE = "The patient started aspirin 81 mg daily. Follow up with primary care in one week. The discharge diagnosis was pneumonia."


def _extraction(**changed) -> str:
    item = lambda label, quote: {"label": label, "rationale": "Explicitly documented in source.", "source_quote": quote}
    aspirin, visit = item("Aspirin 81 mg daily", "started aspirin 81 mg daily"), item("Primary care in one week", "Follow up with primary care in one week")
    own = {
        "case_id": "A", "patient_context": {"age": "60", "gender": "F", "admission_diagnosis": "Pneumonia"},
        "medication_changes": {"started": [aspirin], "stopped": [], "changed": [], "continued": [], "uncertain": []},
        "diagnosis_changes": {"admission": "Pneumonia", "discharge": [item("Pneumonia", "discharge diagnosis was pneumonia")], "new_or_changed": []},
        "procedures_and_tests": [], "labs": [], "follow_up_actions": [visit], "safety_flags": [], "uncertain_items": [],
        "two_page_summary": "Hospitalized for pneumonia. Aspirin 81 mg daily was documented, with primary-care follow-up planned in one week.",
    }
    if changed.get("lost"):
        visit["source_quote"] = "quote that is not present"
    if changed.get("twice"):
        own["follow_up_actions"].append(dict(visit))
    if changed.get("both"):
        own["medication_changes"]["stopped"].append(dict(aspirin))
    if changed.get("odd"):
        own["labs"], own["extra"] = "none", 1
        del own["safety_flags"]
        own["procedures_and_tests"] = [7, {"label": " ", "rationale": "r", "source_quote": "discharge"}]
    return json.dumps(own | {k: v for k, v in changed.items() if k in own})


def _runs(spark):
    made = [("A", _extraction()), ("B", _extraction(case_id="B", two_page_summary="")), ("C", _extraction(case_id="C", lost=True)), ("D", _extraction(case_id="D", both=True)), ("E", _extraction(case_id="E", twice=True)), ("F", _extraction(case_id="WRONG")), ("G", "[]"), ("H", None), ("I", _extraction(case_id="I", odd=True))]
    return spark.createDataFrame([(k, e, GATE_NOTE) for k, e in made], "case_id string, extraction string, source string")


@query(
    values(
        "case_id, code, path, details",
        ("B", "empty_or_short_summary", "two_page_summary", None), ("C", "source_quote_not_found", "follow_up_actions[0].source_quote", None), ("D", "medication_state_conflict", "medication_changes", "aspirin daily: started, stopped"),
        ("E", "duplicate_evidence_item", "follow_up_actions[1]", "0"), ("F", "case_id_mismatch", "case_id", "F"), ("G", "not_object", "$", None), ("H", "not_object", "$", None),
        ("I", "missing_required_field", "safety_flags", None), ("I", "unexpected_field", "extra", None), ("I", "invalid_array", "labs", None), ("I", "invalid_array", "safety_flags", None),
        ("I", "invalid_evidence_item", "procedures_and_tests[0]", None), ("I", "empty_evidence_field", "procedures_and_tests[1].label", None),
    )
)
def q_quality_gate(spark, d):
    return claims.quality_gate(_runs(spark))


@query(
    values(
        "case_id, valid, codes, action", ("A", True, "", "accept"), ("B", False, "empty_or_short_summary", "summary_only_regeneration"), ("C", False, "source_quote_not_found", "targeted_evidence_reextraction"),
        ("D", False, "medication_state_conflict", "medication_reconciliation_reextraction"), ("E", False, "duplicate_evidence_item", "deterministic_duplicate_review"), ("F", False, "case_id_mismatch", "full_json_schema_reextraction"),
        ("G", False, "not_object", "full_json_schema_reextraction"), ("H", False, "not_object", "full_json_schema_reextraction"),
        ("I", False, "empty_evidence_field,invalid_array,invalid_evidence_item,missing_required_field,unexpected_field", "targeted_evidence_reextraction"),
    )
)
def q_gate_report(spark, d):
    runs = _runs(spark)
    return claims.gate_report(runs, claims.quality_gate(runs))


_items = {
    "diagnosis_changes": {"discharge": [{"label": "pulmonary embolism", "source_quote": "pulmonary embolism"}, {"label": "possible pneumonia", "source_quote": "Possible pneumonia, treated empirically."}, {"label": "history of atrial fibrillation", "source_quote": "atrial fibrillation"}, {"label": "Acute kidney injury", "source_quote": "Acute kidney injury improved before discharge."}]},
    "medication_changes": {"stopped": [{"label": "warfarin 5 mg", "source_quote": "Acute kidney injury improved"}]},
    "safety_flags": [{"label": "wound monitoring", "source_quote": "Return for chest pain if symptoms recur.", "safety_type": "monitoring_instruction"}, {"label": "chest pain return", "source_quote": "Return for chest pain if symptoms recur.", "safety_type": "other"}, {"label": "conditional chest pain return if it recurs", "source_quote": "Return for chest pain if symptoms recur."}],
    "two_page_summary": "AKI improved after 3 days.",
}


@query(
    values(
        "case_id, code, path, details",
        (1, "possible_assertion_status_conflict", "diagnosis_changes.discharge[0]", "absent"), (1, "label_numeric_detail_not_in_span", "medication_changes.stopped[0]", "5"),
        (1, "label_terms_not_in_span", "medication_changes.stopped[0]", "warfarin"), (1, "stopped_medication_without_stop_cue", "medication_changes.stopped[0]", None),
        (1, "label_terms_not_in_span", "safety_flags[0]", "wound,monitoring"), (1, "possible_assertion_status_conflict", "safety_flags[0]", "conditional"), (1, "broad_safety_abstraction", "safety_flags[0]", "monitoring_instruction"),
        (1, "monitoring_instruction_without_monitoring_cue", "safety_flags[0]", None), (1, "possible_assertion_status_conflict", "safety_flags[1]", "conditional"), (1, "invalid_safety_type", "safety_flags[1]", "other"),
        (1, "missing_safety_type", "safety_flags[2]", None), (1, "summary_numeric_detail_not_in_accepted_evidence", "two_page_summary", "3"),
    )
)
def q_semantics(spark, d):
    return claims.semantics(spark.createDataFrame([(1, json.dumps(_items), SIGNS), (2, None, None)], "case_id int, extraction string, source string"))


PLACE_NOTE = "Aspirin 81 mg was started for chest pain.\nFollow up was the brief course."


@query(values("item_id, form, doc_id", *((i, f, 1) for i in (1, 2, 3, 4, 5) for f in ("exact", "loose")), (6, "loose", 1)))
def q_short_quotes(spark, d):
    """Quotes of stop words alone, of parts of words, of one and two characters; one that only normalising finds, one that isn't there."""
    items = spark.createDataFrame([(1, "was the brief course"), (2, "ollow u"), (3, "up"), (4, "p"), (5, "CHEST  pain"), (6, "aspirin, 81 mg"), (7, "zebra"), (8, " "), (9, None)], "item_id int, text string")
    docs = spark.createDataFrame([(1, PLACE_NOTE), (2, None), (3, "")], "doc_id int, text string")
    found = lambda form, name: provenance.contained(items, docs, form).select("item_id", F.lit(name).alias("form"), "doc_id")
    return found(provenance.T.normal_exact, "exact").unionByName(found(provenance.T.normal_loose, "loose"))


@query(values("ordinal, line_id", (1, "L0001"), (1000, "L1000"), (9999, "L9999"), (10000, "L10000"), (10005, "L10005")))
def q_line_ids(spark, d):
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(10005)), lambda i: i.cast("string")), "\n").alias("text"))
    return segment.line_index(rows).filter(F.col("ordinal").isin(1, 1000, 9999, 10000, 10005)).select("ordinal", "line_id")


@query(values("doc_id, dose_mentions, note_words, route", (1, 1, 6, "single_stage_standard"), (2, 18, 36, "two_stage_complex"), (3, 0, 1200, "two_stage_complex")))
def q_complexity_notes(spark, d):
    notes = [(1, "5 grapes and 5 MG daily"), (2, "81 mg " * 18), (3, "Pertinent Results procedure " + "word " * 1197)]
    return segment.complexity(spark.createDataFrame(notes, "doc_id int, text string")).select("doc_id", "dose_mentions", "note_words", "route")


@query(values("a, b, reason", (0, 1, "same_source_quote"), (0, 3, "contained_source_quote")))
def q_near_repeats(spark, d):
    items = [(1, 0, "Aspirin started", "Aspirin 81 mg was started."), (1, 1, "aspirin  started", "aspirin 81 mg was started."), (1, 2, "Warfarin held", "Warfarin was held on admission."), (1, 3, "started aspirin 81", "Aspirin 81 mg was started")]
    kept = gates.drop_near_repeats(spark.createDataFrame(items, "doc_id int, at long, label string, source_quote string"), ["doc_id"], "at")
    return kept.filter("kept_at is not null").select(F.col("kept_at").alias("a"), F.col("at").alias("b"), "reason")


@query(values("item_id, status, line_ids", (1, "supported", "L0001"), (2, "not_found", ""), (3, "insufficient_evidence", "L0002")))
def q_selector_notes(spark, d):
    docs = spark.createDataFrame([(1, "aspirin started monday\nnoise alone here\nwarfarin dose raised\nclinic visit soon")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, 1, "aspirin warfarin clinic", "aspirin"), (2, 1, "zebra giraffe", "zebra"), (3, 1, "noise alone zebra giraffe lion", "lion zebra")], "item_id int, doc_id int, quote string, label string")
    return retrieval.select_minimal(retrieval.ranked_lines(asked, docs)).select("item_id", "status", F.array_join("line_ids", ",").alias("line_ids"))


STRESS_NOTE = "\n".join([
    "ADMISSION MEDICATIONS:", "Aspirin 81 mg daily.", "Lasix 40 mg daily.", "DISCHARGE MEDICATIONS:", "Aspirin 81 mg daily.", "Furosemide 20 mg daily.", "FOLLOW-UP:", "Follow-up cardiology in one week.", "LABS:",
    "Creatinine 1.3 mg/dL.", "Potassium 4.9 mmol/L.", "DISCHARGE DIAGNOSES:", "Heart failure exacerbation.", "No pneumonia was seen.",
])
_tasks = [
    ("Lasix changed to furosemide 20 mg daily", 'Admission: "Lasix 40 mg daily." Discharge: "Furosemide 20 mg daily."', "medication"),
    ("Aspirin 81 mg daily continued", "ADMISSION MEDICATIONS: Aspirin 81 mg daily. ... DISCHARGE MEDICATIONS: Aspirin 81 mg daily.", "medication"), ("Pneumonia", "Pneumonia present.", "diagnosis"),
    ("Cardiac catheterization completed", "Cardiac catheterization completed without complication.", "procedure_or_test"),
    ("Creatinine 1.3 mg/dL and potassium 4.9 mmol/L", "Creatinine 1.3 mg/dL and potassium 4.9 mmol/L", "lab"), ("Follow-up cardiology in one week", "Follow up cardiology in one week", "follow_up"),
]


def _stress(spark):
    rows = [(i, 1, q, x, d, False) for i, (x, q, d) in enumerate(_tasks, 1)] + [(7, 9, "x", "x", "lab", False)]
    return spark.createDataFrame(rows, "item_id int, doc_id int, quote string, label string, domain string, low_overlap boolean"), spark.createDataFrame([(1, STRESS_NOTE)], "doc_id int, text string")


@query(
    values(
        "item_id, method, supported, status, lines",
        *((i, "exact_full_note", False, "abstain", 0) for i in range(1, 7)), *((i, "normalized_full_note", i == 6, "supported" if i == 6 else "abstain", 0) for i in range(1, 7)),
        *((i, "line_span_id", ok, "single_line_supported" if ok else "abstain_line_weak", 1) for i, ok in ((1, False), (2, True), (3, True), (4, False), (5, False), (6, True))),
        *((i, "section_filtered_span", ok, "section_supported" if ok else "abstain_section_weak", 1) for i, ok in ((1, False), (2, True), (3, True), (4, False), (5, False), (6, True))),
        (1, "query_aware_multispan", True, "query_multispan_supported", 2), (2, "query_aware_multispan", True, "query_greedy_multispan_supported", 2), (3, "query_aware_multispan", False, "abstain_query_assertion_conflict", 1),
        (4, "query_aware_multispan", False, "abstain_query_weak", 0), (5, "query_aware_multispan", True, "query_greedy_multispan_supported", 2), (6, "query_aware_multispan", True, "query_single_span_supported", 1),
    )
)
def q_span_methods(spark, d):
    return multispan.methods(*_stress(spark)).select("item_id", "method", "supported", "status", F.size("line_ids").alias("lines"))


@query(values("method, claims, supported, rank", ("exact_full_note", 6, 0, 5), ("normalized_full_note", 6, 1, 4), ("line_span_id", 6, 3, 2), ("section_filtered_span", 6, 3, 3), ("query_aware_multispan", 6, 4, 1)))
def q_span_method_summary(spark, d):
    return multispan.method_summary(multispan.methods(*_stress(spark))).select("method", "claims", "supported", "rank")


@query(
    f"with t as ({values('condition, matcher', *((c, m) for c in multispan.GUARDS for m in ('lexical_topk', 'transparent_rerank_topk')))}) select matcher, condition, budget, 1 as claims, case when condition = 'all_guards_disabled' then 1 else 0 end as supported, case when condition = 'all_guards_disabled' then 0 else 1 end as conflicts, 0 as risks from t, (values (1), (2)) b(budget)"
)
def q_guard_curves(spark, d):
    """The claim that the note denies: only without guards do its first lines support it."""
    items, docs = _stress(spark)
    return multispan.curve_summary(multispan.guard_curves(items.filter("item_id = 3"), docs).filter("budget <= 2"))


@query(values("item_id, flags, risk, acceptance", (1, "label_only_support,low_quote_coverage", "medium", "review_required"), (2, "", "low", "auto_accept"), (3, "", "not_supported", "abstain"), (4, "", "not_supported", "abstain"), (5, "", "low", "auto_accept"), (6, "", "low", "auto_accept")))
def q_coherence(spark, d):
    found = multispan.coherence(multispan.methods(*_stress(spark)), F.lit(False), F.lit(False))
    return found.select("item_id", F.array_join("flags", ",").alias("flags"), "risk", "acceptance")


@query(values("item_id, conflict", (1, True), (2, False), (3, False), (4, True), (5, False), (6, True), (7, False), (8, False)))
def q_cue_conflicts(spark, d):
    rows = [
        (1, "No pneumonia was seen.", "Pneumonia", "diagnosis"), (2, "No pneumonia was seen.", "no pneumonia", "diagnosis"), (3, "No fever but pneumonia was treated.", "pneumonia", "diagnosis"), (4, "Possible stroke on imaging", "stroke", "diagnosis"),
        (5, "CT head with no evidence of bleeding", "CT head performed", "procedure_or_test"), (6, "CT head with no evidence of bleeding", "CT head performed", "medication"), (7, None, "x", None), (8, "no", None, None),
    ]
    return multispan.conflicts(spark.createDataFrame(rows, "item_id int, text string, label string, domain string"), "text", "label", "domain").select("item_id", "conflict")


@query(
    values(
        "item_id, category, status, action",
        (1, "exact_contiguous", "strict_exact_contiguous", "materialize_from_span_ids"), (2, "normalization_or_punctuation", "normalized_single_span", "materialize_from_span_ids"),
        (3, "quote_terms_present_noncontiguous", "multi_span_recovered", "materialize_from_span_ids"), (4, "label_supported_quote_unresolved", "label_span_recovered", "materialize_from_span_ids"),
        (5, "low_overlap_possible_fabrication", "abstain_low_overlap", "abstain_needs_review"), (6, "missing_quote", "abstain_missing_quote", "abstain_needs_review"), (7, "missing_source_text", "abstain_missing_source_text", "abstain_needs_review"),
    )
)
def q_span_proposals(spark, d):
    rows = [(1, 1, "Creatinine 1.3 mg/dL.", "creatinine"), (2, 1, "follow up cardiology, in one week", "visit"), (3, 1, "Lasix 40 mg ... Heart failure exacerbation", "lasix"), (4, 1, "zebra giraffe", "potassium 4.9"), (5, 1, "zebra giraffe", "lion"), (6, 1, " ", "x"), (7, 8, "x", "x")]
    items = spark.createDataFrame(rows, "item_id int, doc_id int, quote string, label string")
    return multispan.proposals(items, spark.createDataFrame([(1, STRESS_NOTE)], "doc_id int, text string")).select("item_id", "category", "status", "action")


@query(values("item_id, expanded", (1, "aspirin oral twice daily"), (2, "acute kidney injury"), (3, "copd1"), (4, "")))
def q_expanded_terms(spark, d):
    rows = spark.createDataFrame([(1, "Aspirin PO, BID"), (2, "AKI"), (3, "copd1"), (4, "")], "item_id int, text string")
    return rows.select("item_id", assertion.expand(F.col("text")).alias("expanded"))


@query(
    values(
        "case_id, code, path, details", (1, "empty_source_quote", "labs[0]", None), (1, "source_quote_may_be_incomplete", "labs[1]", "35,5"), (1, "label_not_extractively_supported_by_quote", "labs[1]", "potassium,replaced,after,diuresis"),
    )
)
def q_fidelity(spark, d):
    items = [{"label": "x", "source_quote": " "}, {"label": "potassium replaced after diuresis 3", "source_quote": "K 3.1"}, {"label": "potassium low", "source_quote": "potassium was low today and replaced"}]
    return claims.fidelity(spark.createDataFrame([(1, json.dumps({"labs": items})), (2, None)], "case_id int, extraction string"))


@query(values("case_id, summary", (1, "medication_changes.started: Aspirin 81 mg. labs: K 3.1; Na 128."), (2, None)))
def q_rematerialised(spark, d):
    own = {"labs": [{"label": "x", "source_quote": "1. K  3.1"}, {"label": "y", "source_quote": "- Na 128"}, {"label": "z", "source_quote": None}], "medication_changes": {"started": [{"source_quote": "Aspirin 81 mg"}]}}
    return claims.rematerialise(spark.createDataFrame([(1, json.dumps(own)), (2, None)], "case_id int, extraction string")).select("case_id", "summary")


@query(values("id, cue_note", (1, "Doctor: start aspirin 81 mg. Check potassium please."), (2, "talk only"), (3, "")))
def q_cue_notes(spark, d):
    rows = [(1, "Hello there friend. Doctor: start aspirin 81 mg. We talk about gardens. Check potassium please.", 10), (2, "small talk only", 2), (3, None, 5)]
    return attribution.cue_notes(spark.createDataFrame(rows, "id int, source string, budget int"), "source", "budget").select("id", "cue_note")


@query(values("prediction, gold, score", (1, 1, "=0.9::double")))
def q_greedy_assignment(spark, d):
    """By descending score alone one pair is made where two are possible."""
    pairs = spark.createDataFrame([(7, 1, 1, 0.9), (7, 1, 2, 0.8), (7, 2, 1, 0.8)], "record_id int, prediction int, gold int, score double")
    return matching.matches(pairs, greedy=True).drop("record_id")


@query(values("prediction, gold, score", (1, 2, "=0.8::double"), (2, 1, "=0.8::double")))
def q_best_assignment(spark, d):
    pairs = spark.createDataFrame([(7, 1, 1, 0.9), (7, 1, 2, 0.8), (7, 2, 1, 0.8)], "record_id int, prediction int, gold int, score double")
    return matching.matches(pairs).drop("record_id")
