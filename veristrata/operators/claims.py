"""Whole extractions checked against their sources: shape, quotes, semantics."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from veristrata.operators import _rows, assertion, gates

# The fields of an extraction, the lists that hold evidence, and what safety items may say.
BUCKETS = ["started", "stopped", "changed", "continued", "uncertain"]
LISTS = ["procedures_and_tests", "labs", "follow_up_actions", "safety_flags", "uncertain_items"]
FIELDS = ["case_id", "patient_context", "medication_changes", "diagnosis_changes", *LISTS, "two_page_summary"]
SAFETY_TYPES = ["return_precaution", "monitoring_instruction", "medication_safety", "pending_or_critical_result", "source_stated_risk"]
SAFETY_CUES = {
    "return_precaution": ("return_precaution_without_trigger_cue", "return|call|seek|present|promptly|immediately|if|for|worsening|severe|fever|pain|redness|drainage|gain"),
    "monitoring_instruction": ("monitoring_instruction_without_monitoring_cue", "monitor|check|record|measure|log|lab|laboratory|weight|potassium|creatinine|inr|glucose|blood pressure"),
    "medication_safety": ("medication_safety_without_medication_cue", "anticoag|insulin|opioid|steroid|antibiotic|renal dosing|hold|stop|toxicity|interaction|bleeding|dose|warfarin|heparin"),
    "pending_or_critical_result": ("pending_result_without_result_cue", "pending|critical|result|culture|biopsy|pathology|follow up|follow-up|repeat|abnormal"),
}
BROAD = "monitoring required|management optimization|therapy completion monitoring|fluid status|signs of infection|wound monitoring|renal function monitoring|diabetes management|infection monitoring"
ATOMIC_QUOTE = "return|call|promptly|if|for|fever|severe|spreading|increasing|gain|kg|days?|check|lab|creatinine|potassium|weight"
ATOMIC_LABEL = "fever|severe|spreading|increasing|gain|kg|days?|creatinine|potassium|weight"
STOP_CUE = "stop|stopped|discontinue|discontinued|held|avoid"
LEAST_SUMMARY = 80

ISSUE = "code string, path string, details string"


def _lists(extraction: dict, buckets: bool = True) -> Iterator[tuple[str, object]]:
    part = lambda name: x if isinstance(x := extraction.get(name), dict) else {}
    yield from ((f"medication_changes.{b}", part("medication_changes").get(b)) for b in BUCKETS)
    yield from ((f"diagnosis_changes.{b}", part("diagnosis_changes").get(b)) for b in ("discharge", "new_or_changed"))
    yield from ((name, extraction.get(name)) for name in LISTS)


def _quoted(x: str) -> str:
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x).lower()).strip()


def _folded(x: object) -> str:
    return " ".join(x.split()).lower() if isinstance(x, str) else ""


def _drug(x: object) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|units?|ml|meq)\b", "", _folded(x))).strip()


def gate_issues(extraction: str | None, source: str | None, case_id: str | None, evidence_wanted: bool = False) -> Iterator[tuple[str, str, str | None]]:
    """(code, path, details) of what blocks an extraction, given as JSON: its shape, its quotes, repeats, states that conflict."""
    try:
        own = json.loads(extraction or "null")
    except ValueError:
        own = None
    if not isinstance(own, dict):
        yield "not_object", "$", None
        return
    yield from (("missing_required_field", f, None) for f in FIELDS if f not in own)
    yield from (("unexpected_field", f, None) for f in own if f not in FIELDS)
    if case_id and own.get("case_id") != case_id:
        yield "case_id_mismatch", "case_id", case_id
    for name, strings in (("patient_context", ["age", "gender", "admission_diagnosis"]), ("medication_changes", []), ("diagnosis_changes", ["admission"])):
        if not isinstance(own.get(name), dict):
            yield "invalid_object", name, None
        else:
            yield from (("invalid_string", f"{name}.{s}", None) for s in strings if not isinstance(own[name].get(s), str))
    inside = _quoted(source) if source else ""
    states: dict[str, set[str]] = {}
    for path, items in _lists(own):
        if not isinstance(items, list):
            if "." not in path or isinstance(own.get(path.split(".")[0]), dict):
                yield "invalid_array", path, None
            continue
        first: dict[tuple[str, str], int] = {}
        for i, item in enumerate(items):
            if not isinstance(item, dict):
                yield "invalid_evidence_item", f"{path}[{i}]", None
                continue
            yield from (("empty_evidence_field", f"{path}[{i}].{k}", None) for k in ("label", "rationale", "source_quote") if not isinstance(item.get(k), str) or not item[k].strip())
            quote = item.get("source_quote")
            if source and isinstance(quote, str) and quote.strip() and _quoted(quote) not in inside:
                yield "source_quote_not_found", f"{path}[{i}].source_quote", None
            at = first.setdefault((_folded(item.get("label")), _folded(quote)), i)
            if at != i:
                yield "duplicate_evidence_item", f"{path}[{i}]", str(at)
            if path.startswith("medication_changes.") and path.split(".")[1] in ("started", "stopped", "continued") and (drug := _drug(item.get("label"))):
                states.setdefault(drug, set()).add(path.split(".")[1])
    if evidence_wanted and not any(x for _, x in _lists(own) if isinstance(x, list)):
        yield "vacuous_extraction", "$", None
    summary = own.get("two_page_summary")
    if not isinstance(summary, str) or len(summary.strip()) < LEAST_SUMMARY:
        yield "empty_or_short_summary", "two_page_summary", None
    yield from (("medication_state_conflict", "medication_changes", f"{drug}: {', '.join(sorted(s))}") for drug, s in sorted(states.items()) if len(s) > 1)


def quality_gate(runs: DataFrame, key: str = "case_id", extraction: str = "extraction", source: str = "source", evidence_wanted: bool = False) -> DataFrame:
    """(key, code, path, details): a row for each issue that blocks a run's extraction; runs without any are valid."""
    case = F.col(key).cast("string").alias("__case")
    return _rows.exploded(runs.select(key, extraction, source, case), key, [extraction, source, "__case"], ISSUE, lambda e, s, c: gate_issues(e, s, c, evidence_wanted))


def gate_report(runs: DataFrame, issues: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, valid, codes, action): each run with its codes and what they call for; runs without a source row are kept."""
    codes = issues.groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    rows = runs.select(key).join(codes, key, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return rows.select(key, (F.size("codes") == 0).alias("valid"), F.array_join("codes", ",").alias("codes"), gates.recovery(F.col("codes")).alias("action"))


def _has(words: str, text: str) -> bool:
    return bool(re.search(rf"\b(?:{words})\b", text, re.ASCII))


def _numbers(x: str | None) -> list[str]:
    return re.findall(r"\b\d+(?:\.\d+)?\b", x or "", re.ASCII)


def semantic_issues(extraction: str | None, source: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(code, path, details) of what an extraction's items say beyond their quotes: numbers, terms, assertions, stops, safety, summary."""
    try:
        own = json.loads(extraction or "null")
    except ValueError:
        own = None
    own = own if isinstance(own, dict) else {}
    said = []
    for path, items in [*_lists(own), ("handoff_atoms", own.get("handoff_atoms"))]:
        for i, item in enumerate(items if isinstance(items, list) else []):
            at, item = f"{path}[{i}]", item if isinstance(item, dict) else {}
            label, raw = str(item.get("label") or ""), item.get("source_quote")
            said += [str(item.get(k) or "") for k in ("label", "rationale", "source_quote")]
            quote = assertion.plain(raw)
            if missing := [n for n in _numbers(label) if not re.search(rf"\b{re.escape(n)}\b", quote, re.ASCII)]:
                yield "label_numeric_detail_not_in_span", at, ",".join(missing)
            words = assertion.keywords(label)
            if words and not any(w in quote for w in words):
                yield "label_terms_not_in_span", at, ",".join(words)
            status = assertion.detect(source, raw, label)[0]
            if status != "present" and not assertion.acknowledges(label, status, "|possible" if status == "hypothetical" else ""):
                yield "possible_assertion_status_conflict", at, status
            if path == "medication_changes.stopped" and not _has(STOP_CUE, quote):
                yield "stopped_medication_without_stop_cue", at, None
            if path == "safety_flags":
                kind, name = str(item.get("safety_type") or ""), assertion.plain(label)
                if kind not in SAFETY_TYPES:
                    yield "invalid_safety_type" if kind else "missing_safety_type", at, kind or None
                if _has(BROAD, name) and _has(ATOMIC_QUOTE, quote) and not _has(ATOMIC_LABEL, name):
                    yield "broad_safety_abstraction", at, kind or None
                code, cue = SAFETY_CUES.get(kind, ("", ""))
                if cue and not _has(cue, assertion.plain(f"{label} {raw or ''}")):
                    yield code, at, None
    corpus = " ".join(said)
    missing = [n for n in dict.fromkeys(_numbers(str(own.get("two_page_summary") or ""))) if not re.search(rf"\b{re.escape(n)}\b", corpus, re.ASCII)]
    if missing:
        yield "summary_numeric_detail_not_in_accepted_evidence", "two_page_summary", ",".join(missing)


def semantics(runs: DataFrame, key: str = "case_id", extraction: str = "extraction", source: str = "source") -> DataFrame:
    """(key, code, path, details): a row for each semantic_issues() of a run."""
    return _rows.exploded(runs, key, [extraction, source], ISSUE, semantic_issues)


def flatten(runs: DataFrame, key: str = "case_id", extraction: str = "extraction") -> DataFrame:
    """(key, path, domain, label, quote): the items of the evidence lists of each run's extraction."""

    def items(text: str | None) -> Iterator[tuple]:
        own = json.loads(text or "{}")
        for path, found in _lists(own):
            yield from ((f"{path}[{i}]", path.split(".")[0], x.get("label"), x.get("source_quote")) for i, x in enumerate(found if isinstance(found, list) else []) if isinstance(x, dict))

    return _rows.exploded(runs, key, [extraction], "path string, domain string, label string, quote string", items)


#: A label's share of words that its quote lacks, and its words from which that counts; shortest quote beside a longer label.
MISSING, LABEL_WORDS, SHORT_QUOTE, LONGER_BY = 0.4, 4, 18, 10
_bullet = re.compile(r"^(?:\?{3,}|\d{1,2}[.)]|[-*])\s*")


def fidelity_issues(extraction: str | None) -> Iterator[tuple[str, str, str | None]]:
    """(code, path, details) of quotes that are empty, seem cut short, or lack much of what their label says (words of four characters or more)."""
    own = json.loads(extraction or "{}")
    for path, items in _lists(own):
        for i, item in enumerate(items if isinstance(items, list) else []):
            quote, label = str(item.get("source_quote") or ""), str(item.get("label") or "")
            if not quote.strip():
                yield "empty_source_quote", f"{path}[{i}]", None
                continue
            if len(quote) < min(SHORT_QUOTE, len(label)) and len(label) > len(quote) + LONGER_BY:
                yield "source_quote_may_be_incomplete", f"{path}[{i}]", f"{len(label)},{len(quote)}"
            words, have = [w for w in assertion.content(label) if len(w) >= 4], set(assertion.content(quote))
            missing = [w for w in words if w not in have]
            if len(words) >= LABEL_WORDS and len(missing) / len(words) > MISSING:
                yield "label_not_extractively_supported_by_quote", f"{path}[{i}]", ",".join(missing[:12])


def fidelity(runs: DataFrame, key: str = "case_id", extraction: str = "extraction") -> DataFrame:
    """(key, code, path, details): a row for each fidelity_issues() of a run."""
    return _rows.exploded(runs, key, [extraction], ISSUE, fidelity_issues)


def _extractive(x: object) -> str:
    return _bullet.sub("", " ".join(str(x or "").split())).strip()[:300]


def rematerialised(extraction: str | None) -> tuple[str | None, str | None]:
    """An extraction whose labels are what its quotes say, and the summary that follows: eight labels a list, 4,000 characters."""
    if not extraction:
        return None, None
    own = json.loads(extraction)
    parts = []
    for path, items in _lists(own):
        items = items if isinstance(items, list) else []
        for item in items:
            item |= {"label": _extractive(item.get("source_quote")), "rationale": "Extractive label copied from the source quotation."}
        if labels := [x["label"] for x in items if x["label"]][:8]:
            parts.append(f"{path}: {'; '.join(labels)}.")
    own["two_page_summary"] = " ".join(parts)[:4000]
    return json.dumps(own), own["two_page_summary"]


def rematerialise(runs: DataFrame, extraction: str = "extraction") -> DataFrame:
    """All columns with the extraction made anew from its quotes, and `summary`."""
    return _rows.with_columns(runs, [extraction], f"{extraction} string, summary string", rematerialised)
