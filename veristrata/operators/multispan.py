"""A claim against the lines of its document by several methods: one line, its section's lines, a few lines together; guards on what they select.

A document's lines are prepared once for the claims that follow each other in a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from veristrata.functions import text as T
from veristrata.operators import _rows, assertion, spans

# Sections that matter for a domain; cues of negation and uncertainty, what owns up to them, and how many tokens around
# a cue it reaches; words that are no target; what makes a finding's negation part of its result.
RELEVANT = {"medication": "medications", "diagnosis": "diagnoses", "lab": "labs", "procedure_or_test": "procedures_tests", "follow_up": "follow_up_safety", "safety": "follow_up_safety"}
ALWAYS = "course"
HEADERS = [r"[A-Z0-9 /\-(),]+:\s*", r"[A-Z][A-Za-z0-9 /\-(),]{2,45}:\s*", r"(?i:(?:DISCHARGE|ADMISSION|FOLLOW|HOSPITAL|BRIEF|LAB|MEDICATION|DIAGNOS|PROCEDURE|PLAN|INSTRUCTION)[^\n]*:)"]
FAMILIES = {
    "negation": ("cannot rule out|ruled out|rule out|denies|denied|without|negative|resolved|not|no", "no|not|without|denies|denied|negative|resolved|ruled out|rule out", 3, 8),
    "uncertainty": ("cannot exclude|may represent|concern for|possible|possibly|probable|probably|suspected|suspicion|concern", "possible|possibly|probable|probably|suspected|suspicion|concern|concern for|cannot exclude|may represent", 3, 10),
}
LONG_BEFORE = {"negative": 8, "resolved": 8}
NO_TARGET = set(
    "a an and at by for from in into is of on or the to with without patient patients status change changed completion compliance course care follow followup up evaluation monitoring test tests procedure "
    "procedures result results study studies".split()
)
UNIT_END = r"[.;|()[\]{}]|\s+-\s+|\bbut\b|\bhowever\b|\bthough\b|\balthough\b"
TEST_FRAME = r"\b(?:culture|ct|mri|xray|x-ray|scan|ultrasound|egd|endoscopy|puncture|catheterization|catheterisation|imaging|test|study|screen|evaluation|workup|performed|completed|obtained|sent)\b"
RESULT_NEGATION = r"\b(?:no growth|no evidence|negative|not anthracis|without evidence|rule out|ruled out|without complication|without event)\b"
POSITIVE_RESULT = r"\b(?:positive|grew|growth|showed|revealed|demonstrated|evidence of|consistent with)\b"
#: Coverage from which a claim is supported; least score of a line that is taken greedily, and where a quote has many tokens.
SUPPORTED, LEAST, RELAXED, MANY_TOKENS = 0.72, 0.16, 0.08, 16
#: Lines that are tried greedily and taken, a claim's window of lines and words.
TRIED, TAKEN, WINDOW, WORDS = 40, 4, 80, 100
BUDGETS = (1, 2, 4, 8)
GUARDS = {"all_guards_active": (True, "strict"), "label_risk_disabled": (True, "off"), "all_guards_disabled": (False, "off"), "budget_normalized_label_risk": (True, "normalized")}


def _words(x: str) -> list[str]:
    x = re.sub(r"\[\*\*[^\]]+\*\*\]", " ", unicodedata.normalize("NFKC", x).lower())
    return re.sub("[^a-z0-9]+", " ", x).split()


def _folded(x: str | None) -> str:
    return " ".join((x or "").lower().split())


def conflict(text: str | None, label: str | None, domain: str | None = None) -> bool:
    """Whether a cue of negation or uncertainty in the text reaches a target of the label, which doesn't own up to it."""
    source, item = _folded(text), _folded(label)
    if not source or not item:
        return False
    targets = {w for w in _words(item) if w not in NO_TARGET and len(w) > 1}
    units = [u.strip() for u in re.split(UNIT_END, source, flags=re.I) if u.strip()]
    for name, (phrases, owned, before, after) in FAMILIES.items():
        if re.search(rf"\b(?:{owned})\b", item, re.ASCII):
            continue
        for unit in units:
            words, reached = _words(unit), set()
            for phrase in (p.split() for p in phrases.split("|")):
                for i in range(len(words) - len(phrase) + 1):
                    if words[i : i + len(phrase)] == phrase:
                        reached |= {w for w in words[max(0, i - LONG_BEFORE.get(phrase[0], before)) : i + len(phrase) + after] if w not in NO_TARGET}
            if not reached or (targets and not reached & targets):
                continue
            result = name == "negation" and domain in ("lab", "procedure_or_test") and re.search(TEST_FRAME, item) and re.search(RESULT_NEGATION, unit) and not re.search(POSITIVE_RESULT, item)
            if not result:
                return True
    return False


def conflicts(rows: DataFrame, text: str, label: str, domain: str) -> DataFrame:
    """All columns with `conflict`, as conflict() gives it."""
    return _rows.with_columns(rows, [text, label, domain], "conflict boolean", lambda t, x, d: (conflict(t, x, d),))


def _content(x: str, longer: bool = False) -> list[str]:
    """Content tokens of the expanded text; `longer` leaves out the stop words of columns, which are more."""
    if not longer:
        return assertion.content(assertion.expanded(x))
    words = (w if re.fullmatch(r"\d+(?:\.\d+)?", w) else w.rstrip(".") for w in assertion.expanded(x).split())
    return [w for w in words if len(w) >= 3 and w not in _stops]


_stops = set(T.STOP_WORDS)


def _loose(x: str | None) -> str:
    return assertion.plain(re.sub(r"\[\*\*[^\]]+\*\*\]", " ", unicodedata.normalize("NFKC", x or "").lower()))


def _share(wanted: list[str], have: set[str]) -> float:
    own = set(wanted)
    return len(own & have) / len(own) if own else 0.0


def is_header(line: str) -> bool:
    return any(re.fullmatch(p, line.strip()) for p in HEADERS)


@dataclass
class Line:
    ordinal: int
    text: str
    section: str
    header: bool

    @cached_property
    def tokens(self) -> set[str]:
        return set(_content(self.text))

    @cached_property
    def longer_tokens(self) -> set[str]:
        return set(_content(self.text, True))

    @cached_property
    def plain(self) -> str:
        return _loose(self.text)

    @property
    def line_id(self) -> str:
        return f"L{self.ordinal:04}"


@lru_cache(maxsize=4)
def lines(source: str) -> tuple[Line, ...]:
    """Non-blank lines with the section of the last header at or above them: its class, or its first 40 characters."""
    out, section = [], "unknown"
    for raw in re.split(r"\r?\n", source):
        text = raw.strip()
        if text:
            if is_header(text):
                value = _loose(text)
                section = next((name for name, p in spans.SECTIONS if re.search(p, value, re.ASCII)), value[:40] or "unknown")
            out.append(Line(len(out) + 1, text, section, is_header(text)))
    return tuple(out)


@dataclass
class Scored:
    line: Line
    quote: float
    label: float
    exact: bool

    @property
    def score(self) -> float:
        return max(self.quote, 0.95 * self.label, float(self.exact))

    @property
    def good(self) -> bool:
        return self.quote >= SUPPORTED or self.label >= SUPPORTED or self.exact


@dataclass
class Task:
    quote: str
    label: str
    domain: str
    low_overlap: bool
    #: whether tokens leave out the longer list of stop words
    longer: bool = False

    @cached_property
    def q(self) -> list[str]:
        return _content(self.quote, self.longer)

    @cached_property
    def x(self) -> list[str]:
        return _content(self.label, self.longer)

    def of(self, line: Line) -> set[str]:
        return line.longer_tokens if self.longer else line.tokens

    def ranked(self, own: tuple[Line, ...] | list[Line], quote: str | None = None) -> list[Scored]:
        """Lines by score, then exactness, coverage of quote and label, and id. Another quote stands for both where one is given."""
        q, x = (self.q, self.x) if quote is None else (_content(quote, self.longer),) * 2
        texts = [t for t in map(_loose, (self.quote, self.label) if quote is None else (quote,)) if t]
        made = [Scored(n, _share(q, self.of(n)), _share(x, self.of(n)), any(t in n.plain for t in texts)) for n in own]
        return sorted(made, key=lambda s: (-s.score, -s.exact, -s.quote, -s.label, s.line.line_id))

    def together(self, chosen: list[Line]) -> tuple[float, float]:
        have = set().union(*(self.of(n) for n in chosen)) if chosen else set()
        return _share(self.q, have), _share(self.x, have)


def _reach(chosen: list[Line]) -> tuple[int, int, int]:
    """Known sections, window of lines, and words of a selection."""
    if not chosen:
        return 0, 0, 0
    places = [n.ordinal for n in chosen]
    return len({n.section for n in chosen} - {"unknown"}), max(places) - min(places) + 1, len(_loose(" ".join(n.text for n in chosen)).split())


def label_risk(chosen: list[Line], quote: float, label: float, status: str, normalized: bool = False) -> bool:
    """Whether lines that only the label speaks for reach too far: over strict limits, or over limits that grow with their number."""
    if not (status.startswith("query_label_") or (label >= SUPPORTED > quote)):
        return False
    sections, window, words = _reach(chosen)
    n = max(1, len(chosen))
    if normalized:
        return sections > min(3, n) or window > 40 * n or words > 24 * n or (len(chosen) > 3 and quote < 0.5)
    return sections > 1 or window > 40 or len(chosen) > 3


def quote_parts(quote: str) -> list[str]:
    """What a quote is put together from: quoted passages, and pieces between ellipses, lines, strokes and named prefixes."""
    parts = re.findall(r'"([^"]{3,})"', quote) + re.split(rf"\.\.\.|…|\r?\n|\s+/\s+|(?={spans.PREFIXES})", quote, flags=re.I)
    bare = lambda p: re.sub(r"^[\"']+|[\"']+$", "", p.strip())
    cut = [bare(re.sub(rf"^(?:{spans.PREFIXES})\s*", "", bare(p), flags=re.I)).strip() for p in dict.fromkeys(parts)]
    return [p for p in cut if _content(p)]


def _greedy(task: Task, own: tuple[Line, ...], least: float) -> tuple[bool, list[Line]]:
    """Up to TAKEN of the best lines, each adding the most targets; whether they cover the quote, or quote and label, inside a window."""
    targets, quote = set(task.q) | set(task.x), set(task.q)
    tried = [s for s in task.ranked(own) if s.score >= least][:TRIED]
    chosen: list[Scored] = []
    covered: set[str] = set()
    while len(targets) >= 2 and len(chosen) < TAKEN:
        open_ = [(-len(new), -len(new & quote), -s.score, s.line.line_id, i) for i, s in enumerate(tried) if s not in chosen and (new := (s.line.tokens & targets) - covered)]
        if not open_:
            break
        chosen.append(tried[min(open_)[-1]])
        covered |= chosen[-1].line.tokens & targets
    got = sorted((s.line for s in chosen), key=lambda n: n.ordinal)
    q, x = task.together(got)
    _, window, words = _reach(got)
    return window <= WINDOW and words <= WORDS and not task.low_overlap and ((q >= 0.86 and len(got) > 1) or (q >= 0.78 and x >= 0.5)), got


def multispan(task: Task, own: tuple[Line, ...]) -> tuple[bool, str, list[Line]]:
    """Lines for the parts of a quote; else taken greedily; else two that the label names; unless a guard holds them back."""
    supports = lambda chosen: bool(chosen) and max(task.together(chosen)) >= SUPPORTED
    kind = lambda chosen: "multispan" if len(chosen) > 1 else "single_span"
    best = [next((s.line for s in task.ranked(own, p) if s.good), None) for p in quote_parts(task.quote)]
    chosen = list({n.ordinal: n for n in best if n}.values())
    status = f"query_{kind(chosen)}_supported"
    if not supports(chosen):
        relaxed = RELAXED if len(set(task.q)) >= MANY_TOKENS else LEAST
        for name, least in (("query_greedy", LEAST), ("query_relaxed_greedy", relaxed)):
            ok, got = _greedy(task, own, least)
            if ok:
                chosen, status = got, f"{name}_{kind(got)}_supported"
                break
    named = [s.line for s in task.ranked(own) if s.label >= SUPPORTED][:2]
    if not task.low_overlap and not supports(chosen) and named:
        chosen, status = named, f"query_label_{kind(named)}_supported"
    q, x = task.together(chosen)
    if conflict(" ".join(n.text for n in chosen), task.label, task.domain):
        return False, "abstain_query_assertion_conflict", chosen
    if label_risk(chosen, q, x, status):
        return False, "abstain_query_label_risk", chosen
    if task.low_overlap and 0 < len(chosen) <= 2 and _reach(chosen)[2] <= 40 and q >= 0.86 and x >= 0.6:
        return True, "query_low_overlap_review_supported", chosen
    return (True, status, chosen) if not task.low_overlap and supports(chosen) else (False, "abstain_query_weak", chosen)


def relevant(section: str, domain: str) -> bool:
    return section in (RELEVANT.get(domain, section), ALWAYS)


METHOD = "method string, supported boolean, status string, line_ids array<string>, quote_coverage double, label_coverage double, words int, window int, sections int"


def _methods(source: str | None, quote: str | None, label: str | None, domain: str | None, low_overlap: bool | None) -> Iterator[tuple]:
    own, task = lines(source or ""), Task(quote or "", label or "", domain or "", bool(low_overlap))

    def row(method: str, supported: bool, status: str, chosen: list[Line]) -> tuple:
        q, x = task.together(chosen)
        sections, window, words = _reach(chosen)
        return method, supported, status, [n.line_id for n in chosen], round(q, 6), round(x, 6), words, window, sections

    for method, flat in (("exact_full_note", _folded), ("normalized_full_note", _loose)):
        found = bool(flat(quote)) and flat(quote) in flat(source)
        yield method, found, "supported" if found else "abstain", [], float(found), 0.0, len(_loose(source).split()) if found else 0, len(own) if found else 0, 0
    near = [n for n in own if relevant(n.section, task.domain)] or [n for n in own if n.header]
    for method, some, name in (("line_span_id", own, "line"), ("section_filtered_span", near, "section")):
        best = task.ranked(some)[:1]
        ok = bool(best) and best[0].good
        yield row(method, ok, ("single_line_supported" if name == "line" else "section_supported") if ok else f"abstain_{name}_weak", [s.line for s in best])
    yield row("query_aware_multispan", *multispan(task, own))


def methods(claims: DataFrame, docs: DataFrame, key: str = "item_id") -> DataFrame:
    """key with the columns of METHOD, a row for each of five methods: the whole note as it is and normalised, the best line, the best line
    of the sections that matter for the domain (else of the headers), and several lines by multispan().

    claims has key, doc_id, quote, label, domain and low_overlap; a claim whose document is missing has no row.
    """
    rows = claims.join(docs.select("doc_id", F.col("text").alias("__source")), "doc_id").sortWithinPartitions("doc_id")
    return _rows.exploded(rows, key, ["__source", "quote", "label", "domain", "low_overlap"], METHOD, _methods)


CURVE = "matcher string, condition string, budget int, supported boolean, status string, spans int, words int, window int, conflict boolean, risk boolean"


def _curves(source: str | None, quote: str | None, label: str | None, domain: str | None) -> Iterator[tuple]:
    own, task = lines(source or ""), Task(quote or "", label or "", domain or "", False)
    plain = task.ranked(own)
    bonus = lambda s: s.score + (0.12 if relevant(s.line.section, task.domain) else 0) + (0.08 if s.exact else 0) - (0.35 if conflict(s.line.text, task.label, task.domain) else 0)
    again = sorted(plain, key=lambda s: (-bonus(s), -s.score, s.line.line_id))
    for matcher, ranked in (("lexical_topk", plain), ("transparent_rerank_topk", again)):
        for budget in BUDGETS:
            chosen = sorted((s.line for s in ranked[:budget]), key=lambda n: n.ordinal)
            q, x = task.together(chosen)
            found = conflict(" ".join(n.text for n in chosen), task.label, task.domain)
            _, window, words = _reach(chosen)
            for condition, (guarded, mode) in GUARDS.items():
                risk = mode != "off" and label_risk(chosen, q, x, "query_label_span_budget", mode == "normalized")
                ok = bool(chosen) and not (guarded and found) and not risk and max(q, x) >= SUPPORTED
                status = "supported_under_budget" if ok else "abstain_assertion_conflict" if guarded and found else "abstain_label_risk" if risk else "abstain_weak_budget"
                yield matcher, condition, budget, ok, status, len(chosen), words, window, found, risk


def guard_curves(claims: DataFrame, docs: DataFrame, key: str = "item_id") -> DataFrame:
    """key with the columns of CURVE: each claim's first 1, 2, 4 and 8 lines by two rankings, under four settings of the guards."""
    rows = claims.join(docs.select("doc_id", F.col("text").alias("__source")), "doc_id").sortWithinPartitions("doc_id")
    return _rows.exploded(rows, key, ["__source", "quote", "label", "domain"], CURVE, _curves)


def curve_summary(curves: DataFrame) -> DataFrame:
    """Claims, supported ones, and those that a guard held back, by matcher, condition and budget."""
    by = curves.groupBy("matcher", "condition", "budget")
    return by.agg(F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"), F.count_if(F.col("status") == "abstain_assertion_conflict").alias("conflicts"), F.count_if(F.col("status") == "abstain_label_risk").alias("risks"))


def method_summary(found: DataFrame) -> DataFrame:
    """Claims and supported ones of each method with their mean lines, words and window, the best method first (rank)."""
    t = found.groupBy("method").agg(F.count(F.lit(1)).alias("claims"), F.count_if("supported").alias("supported"), F.round(F.avg(F.size("line_ids")), 6).alias("mean_lines"), F.round(F.avg("words"), 6).alias("mean_words"))
    from pyspark.sql import Window

    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.col("supported").desc(), "method")))


def coherence(found: DataFrame, low_overlap: Column, conflicted: Column, words: int = 60, window: int = 40) -> DataFrame:
    """methods() rows of the last method with `flags`, `risk` (not_supported, low, medium or high) and `acceptance`.

    Flags say how a selection may have been stitched together; some are high by themselves, a label alone with a wide selection is too.
    """
    ok = F.col("supported")
    label_only = F.col("status").startswith("query_label_") | ((F.col("label_coverage") >= SUPPORTED) & (F.col("quote_coverage") < SUPPORTED))
    rescue = F.col("status") == "query_low_overlap_review_supported"
    rules = {
        "low_overlap_supported": low_overlap & ~rescue, "low_overlap_review_rescue": rescue, "label_only_support": label_only, "assertion_cue_conflict": conflicted, "cross_section_union": F.col("sections") > 1,
        "wide_span_window": F.col("window") > window, "high_context_words": F.col("words") > words, "many_spans": F.size("line_ids") > 3, "low_quote_coverage": F.col("quote_coverage") < 0.86,
    }
    flags = F.array_compact(F.array(*(F.when(ok & c, F.lit(k)) for k, c in rules.items())))
    rows = found.filter("method = 'query_aware_multispan'").withColumn("flags", flags)
    has = lambda *names: F.arrays_overlap("flags", F.array(*(F.lit(n) for n in names)))
    wide = ("cross_section_union", "wide_span_window", "many_spans")
    risk = (
        F.when(~ok, "not_supported").when(has("low_overlap_supported", "assertion_cue_conflict") | (has("label_only_support") & has(*wide)), "high")
        .when(has("low_overlap_review_rescue", "high_context_words", "label_only_support", *wide), "medium").otherwise("low")
    )
    rows = rows.withColumn("risk", risk)
    return rows.withColumn("acceptance", F.when(F.col("risk") == "low", "auto_accept").when(F.col("risk") == "medium", "review_required").when(F.col("risk") == "high", "blocked_review").otherwise("abstain"))


SUPPORT = "category string, status string, action string, line_ids array<string>"


def _proposal(source: str | None, quote: str | None, label: str | None) -> Iterator[tuple]:
    source, quote, label = source or "", quote or "", label or ""
    task = Task(quote, label, "", False, True)
    plain = set(_loose(source).split())
    words = {w if re.fullmatch(r"\d+(?:\.\d+)?", w) else w.rstrip(".") for w in plain}
    bare = lambda x: [w for w in ((w if re.fullmatch(r"\d+(?:\.\d+)?", w) else w.rstrip(".")) for w in _loose(x).split()) if len(w) >= 3 and w not in _stops]
    q, x = _share(bare(quote), words), _share(_content(label, True), words)
    if not source.strip():
        yield "missing_source_text", "abstain_missing_source_text", "abstain_needs_review", []
        return
    if not quote.strip():
        yield "missing_quote", "abstain_missing_quote", "abstain_needs_review", []
        return
    category = (
        "exact_contiguous" if _folded(quote) and _folded(quote) in _folded(source) else "normalization_or_punctuation" if _loose(quote) and _loose(quote) in _loose(source)
        else "quote_terms_present_noncontiguous" if re.search(r"\.\.\.|…", quote) or q >= 0.92 else "high_overlap_pointer_drift" if q >= SUPPORTED else "label_supported_quote_unresolved" if x >= SUPPORTED
        else "weak_overlap_needs_review" if max(q, x) >= 0.45 else "low_overlap_possible_fabrication"
    )
    own = lines(source)
    best = task.ranked(own)[:1]
    parts = [p.strip() for p in re.split(r"\.\.\.|…|\r?\n", quote) if bare(p)]
    found = [s for p in parts for s in Task(p, "", "", False, True).ranked(own)[:1] if s.quote >= SUPPORTED or s.exact]
    several = list({s.line.ordinal: s.line for s in found}.values())
    one = [s.line for s in best]
    s = best[0] if best else None
    status, chosen = "abstain_weak_overlap", one
    if category == "exact_contiguous":
        status = "strict_exact_contiguous"
    elif len(parts) > 1 and len(several) > 1:
        status, chosen = "multi_span_recovered", several[:4]
    elif category == "normalization_or_punctuation" and s and s.score >= SUPPORTED:
        status = "normalized_single_span"
    elif category in ("quote_terms_present_noncontiguous", "high_overlap_pointer_drift") and s and (s.quote >= SUPPORTED or s.label >= SUPPORTED or s.score >= 0.76):
        status = "single_span_recovered"
    elif category == "label_supported_quote_unresolved" and s and s.label >= SUPPORTED:
        status = "label_span_recovered"
    elif category == "low_overlap_possible_fabrication":
        status = "abstain_low_overlap"
    yield category, status, "abstain_needs_review" if status.startswith("abstain") else "materialize_from_span_ids", [n.line_id for n in chosen]


def proposals(claims: DataFrame, docs: DataFrame, key: str = "item_id") -> DataFrame:
    """key with the columns of SUPPORT: how each claim's quote is missed, and which lines could stand for it. Claims without a document have no source."""
    rows = claims.join(docs.select("doc_id", F.col("text").alias("__source")), "doc_id", "left").sortWithinPartitions("doc_id")
    return _rows.exploded(rows, key, ["__source", "quote", "label"], SUPPORT, _proposal)
