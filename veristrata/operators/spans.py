"""Texts cut into spans with their places: clauses, sentences, lines, and candidates for claims."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from veristrata.operators import _rows

# What a heading's words say of its section, first match first; words that begin a new clause with a colon; where
# sentences and clauses end.
SECTIONS = [
    ("medications", r"\b(discharge medications|medications at home|admission medications|medications)\b"),
    ("diagnoses", r"\b(discharge diagnoses|diagnoses|assessment|impression)\b"),
    ("labs", r"\b(laboratory|labs|chemistry|cbc|results)\b"),
    ("procedures_tests", r"\b(procedure|operation|imaging|radiology|studies|tests)\b"),
    ("follow_up_safety", r"\b(follow-?up|follow up|discharge instructions|instructions|pending|plan)\b"),
    ("course", r"\b(hospital course|brief hospital course|history of present illness)\b"),
]
PREFIXES = r"\b(?:admission|discharge|follow-?up instructions?|medications? on admission|medications? on discharge|mri head|ct head|labs?|laboratory|imaging|procedure|procedures)\s*:"
SENTENCE_END = r"(?<=[.!?])\s+"
CLAUSE_END = r"\s+/\s+|;\s*|\s+\|\s+|(?<=[.!?])\s+|,\s+(?=(?:and|but|with|without|then)\b)"
#: A heading's colon stands among its first characters; a span of so few words that ends with a colon is a heading alone.
HEADING_CHARACTERS, HEADING_WORDS = 70, 8
GRANULARITIES = ("clause", "sentence", "line")

SPAN = "ordinal int, span_id string, text string, char_start int, char_end int, section string, line int"


def _section(text: str, lexicon: list[tuple[str, re.Pattern]]) -> str | None:
    text = text.strip().removesuffix(":")
    return next((name for name, pattern in lexicon if text and pattern.search(text)), None)


def _cut(text: str, at: int, pattern: str) -> Iterator[tuple[str, int]]:
    """The pieces between matches, with their places."""
    last = 0
    for m in re.finditer(pattern, text, re.I | re.ASCII):
        yield text[last : m.start()], at + last
        last = m.end()
    yield text[last:], at + last


def _pieces(line: str, at: int, granularity: str, lexicon: list[tuple[str, re.Pattern]]) -> Iterator[tuple[str, int]]:
    if granularity == "line":
        yield line, at
        return
    colon, parts = line.find(":"), [(line, at)]
    if 0 <= colon <= HEADING_CHARACTERS and _section(line[: colon + 1], lexicon):
        parts = [(line[: colon + 1], at), (line[colon + 1 :], at + colon + 1)]
    for text, spot in parts:
        if granularity == "sentence":
            yield from _cut(text, spot, SENTENCE_END)
            continue
        text, spot = text.lstrip(), spot + len(text) - len(text.lstrip())
        cuts = [0, *(m.start() for m in re.finditer(PREFIXES, text, re.I | re.ASCII) if m.start()), len(text)]
        for a, b in zip(cuts, cuts[1:]):
            yield from _cut(text[a:b], spot + a, CLAUSE_END)


def spans(text: str | None, granularity: str = "clause", lexicon: list[tuple[str, str]] = SECTIONS) -> Iterator[tuple]:
    """(ordinal, span_id, text, char_start, char_end, section, line) of each span, so that text[char_start:char_end] is the span's text.

    Lines are numbered from 1, blank ones too. A section goes on until a line or span names another; spans that are headings alone are
    left out. Places count code points.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity is one of {', '.join(GRANULARITIES)}")
    known = [(name, re.compile(p, re.I | re.ASCII)) for name, p in lexicon]
    section, n, at = None, 0, 0
    for number, raw in enumerate(re.split(r"(\r\n|\r|\n)", text or "")):
        if number % 2 == 0 and raw.strip():
            start = at + len(raw) - len(raw.lstrip())
            section = _section(raw, known) or section
            for piece, spot in _pieces(raw.strip(), start, granularity, known):
                own = piece.strip()
                if not own:
                    continue
                spot += len(piece) - len(piece.lstrip())
                section = _section(own, known) or section
                if not (own.endswith(":") and len(own.split()) <= HEADING_WORDS):
                    n += 1
                    yield n, f"S{n}", own, spot, spot + len(own), section, number // 2 + 1
        at += len(raw)


def span_index(docs: DataFrame, granularity: str = "clause", lexicon: list[tuple[str, str]] = SECTIONS) -> DataFrame:
    """(doc_id, ordinal, span_id, text, char_start, char_end, section, line): spans() of each document; null and empty texts have none."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity is one of {', '.join(GRANULARITIES)}")
    return _rows.exploded(docs, "doc_id", ["text"], SPAN, lambda t: spans(t, granularity, lexicon))


def canonical(text: str | None) -> tuple[str, list[int], list[int]]:
    """The text trimmed and with white space as single spaces, and where each of its characters begins and ends in the text."""
    out, starts, ends = [], [], []
    for m in re.finditer(r"(\s*)(\S)", text or ""):
        if m[1] and out:
            out.append(" ")
            starts.append(m.start(1))
            ends.append(m.end(1))
        out.append(m[2])
        starts.append(m.start(2))
        ends.append(m.end(2))
    return "".join(out), starts, ends


# Headings and cues by domain; a heading of no known domain ends a section; marks that begin a list's entry.
DOMAINS = {
    "medication_changes": (r"\b(?:DISCHARGE MEDICATIONS?|MEDICATIONS? ON DISCHARGE)\s*:", r"\b(?:mg|mcg|units?|tablet|capsule|p\.o\.|po\b|bid\b|tid\b|q\.?d\.?|daily|medication|prednisone|insulin|aspirin|antibiotic)\b"),
    "diagnosis_changes": (r"\b(?:DISCHARGE DIAGNOSES?|FINAL DIAGNOSES?|PRINCIPAL DIAGNOSES?)\s*:", r"\b(?:diagnos|assessment|impression|failure|syndrome|disease|pneumonia|infection|exacerbation|hypertension|infarction)\b"),
    "procedures_and_tests": (
        r"\b(?:MAJOR SURGICAL OR INVASIVE PROCEDURE|PROCEDURES?|OPERATIONS?)\s*:",
        r"\b(?:procedure|surgery|operation|performed|underwent|ct\b|mri\b|x-?ray|ultrasound|echocardiogram|biopsy|catheter|intubat|extubat|bronchoscopy)\b",
    ),
    "labs": (r"\b(?:PERTINENT RESULTS?|LABORATOR(?:Y|IES)(?: ON ADMISSION)?)\s*:", r"\b(?:wbc|hgb|hemoglobin|hematocrit|platelets?|creatinine|bun\b|sodium|potassium|glucose|inr\b|troponin|laborator|ph\b|pco2)\b"),
    "follow_up_actions": (
        r"\b(?:DISCHARGE FOLLOWUP|FOLLOWUP INSTRUCTIONS?|FOLLOW[- ]?UP|DISCHARGE INSTRUCTIONS?)\s*:",
        r"\b(?:follow\s*-?\s*up|appointment|clinic|within\s+\w+\s+(?:day|week|month)|return to|call\s+.*clinic|scheduled)\b",
    ),
}
OTHER_HEADING = r"(?:^|\s)([A-Z][A-Z0-9 /&()'_-]{3,})\s*:"
ENTRY = r"(?:^|\s)(?:\?{3,}|\d{1,2}[.)]|[-*])\s+"
BREAK = r"[.!?](?=\s+[A-Z\[])|(?=\s\d{1,2}[.)]\s+)"
#: Longer pieces are read through windows of WINDOW characters, one every STEP.
LONGEST_PIECE, WINDOW, STEP = 700, 600, 500


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Places of the sentences and numbered entries of a canonical text; long ones as overlapping windows."""
    cuts = [0, *(m.end() for m in re.finditer(BREAK, text)), len(text)]
    for a, b in zip(cuts, cuts[1:]):
        own = text[a:b]
        a, b = a + len(own) - len(own.lstrip(" ")), b - (len(own) - len(own.rstrip(" ")))
        if 0 < b - a <= LONGEST_PIECE:
            yield a, b
        elif b > a:
            yield from ((at, min(b, at + WINDOW)) for at in range(a, b, STEP))


def _entries(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of a section's list entries, or of its chunks where it has no list."""
    marks = list(re.finditer(ENTRY, text[at:end]))
    if not marks:
        yield from ((at + a, at + b) for a, b in chunks(text[at:end]))
    for m, after in zip(marks, [*marks[1:], None]):
        start = at + m.start() + m[0][0].isspace()
        start += len(x[0]) if (x := re.match(r"\?{3,}\s*", text[start:end])) else 0
        stop = at + after.start() if after else end
        if stop > start:
            yield start, stop


CANDIDATE = "ordinal int, candidate_id string, domain string, origin string, canonical_start int, canonical_end int, original_start int, original_end int, canonical_text string, source_quote string, kept boolean"


def candidates(source: str | None, domains: dict[str, tuple[str, str]] = DOMAINS, most: int = 160, most_of_domain: int = 70) -> Iterator[tuple]:
    """Rows of CANDIDATE: entries of the sections that headings announce, then chunks outside them that hold a domain's cue.

    A candidate is named by its domain and a hash of its normalised text, and the same one counts once. Of those beyond `most`, or
    `most_of_domain`, `kept` is false and the id null: the reference's own limits, which report the rest as overflow.
    """
    text, starts, ends = canonical(source)
    heads = sorted((m.start(), m.end(), name) for name, (head, _) in domains.items() for m in re.finditer(head, text, re.I | re.ASCII))
    found, covered = [], []
    for (start, content, name), after in zip(heads, [*heads[1:], (len(text), 0, "")]):
        other = re.search(OTHER_HEADING, text[content : after[0]])
        end = content + other.start() + other[0].startswith(" ") if other else after[0]
        covered.append((start, end))
        found += [(name, a, b, "section_entry") for a, b in _entries(text, content, end)]
    from_, to = [a for a, _ in covered], [b for _, b in covered]
    for a, b in chunks(text):
        i = bisect_right(from_, (a + b) / 2) - 1
        if i < 0 or (a + b) / 2 >= to[i]:
            found += [(name, a, b, "cue_chunk") for name, (_, cue) in domains.items() if re.search(cue, text[a:b], re.I | re.ASCII)]
    seen, times, n, of_domain = set(), Counter(), 0, Counter()
    for name, a, b, origin in found:
        own = text[a:b]
        a, b = a + len(own) - len(own.lstrip(" ")), b - (len(own) - len(own.rstrip(" ")))
        own = text[a:b]
        key = f"{name}|{' '.join(unicodedata.normalize('NFKC', own).lower().split())}"
        if len(own) < 3 or key in seen:
            continue
        seen.add(key)
        kept = n < most and of_domain[name] < most_of_domain
        base = f"C_{name[:3].upper()}_{hashlib.sha256(key.encode()).hexdigest()[:12]}"
        if kept:
            n += 1
            of_domain[name] += 1
            times[base] += 1
        yield len(seen), (base if times[base] == 1 else f"{base}_{times[base]}") if kept else None, name, origin, a, b, starts[a], ends[b - 1], own, source[starts[a] : ends[b - 1]], kept


def candidate_index(docs: DataFrame, domains: dict[str, tuple[str, str]] = DOMAINS, most: int = 160, most_of_domain: int = 70) -> DataFrame:
    """doc_id with the columns of CANDIDATE, for each document's candidates()."""
    return _rows.exploded(docs, "doc_id", ["text"], CANDIDATE, lambda t: candidates(t, domains, most, most_of_domain))
