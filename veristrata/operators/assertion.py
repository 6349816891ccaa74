"""What a text asserts about a target: present, absent, possible, conditional and so on; and how a claim is grounded in its quote."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veristrata.functions import text as T
from veristrata.operators import _rows
from veristrata.operators.segment import has_word

# Cues of each status, in the order they are tried, with how many tokens the target may follow them by; cue words;
# words that end a cue's scope; the status whose cue may stand on either side; words that keep a keyword from being one.
NEGATION = r"no|not|never|without|denies?|denied|negative for|no evidence of|ruled out|free of|absence of"
SPECULATION = (
    r"possible|possibly|probable|probably|suspected|concern for|question of|may(?:\s+have)?|might(?:\s+have)?|could|cannot exclude|rule out|r/o|suggests?|suggested|suggesting|"
    r"indicates?|indicated|indicating|appears?|appeared|likely|possibility|potentially|putative|whether"
)
PSEUDO = r"not only|not necessarily|not uncommon|without doubt"
SCOPED = [
    ("associated_with_someone_else", r"family history of|(?:mother|father|sister|brother|son|daughter|wife|husband) with", 14),
    ("historical", r"history of|prior|previous|previously|remote|resolved|status post|s/p|old", 12),
    ("hypothetical", r"risk of|at risk for|would|could|consider|candidate for|planned evaluation for", 14),
    ("conditional", r"if|when|should|unless|in case of|return for|monitor for|watch for", 14),
    ("possible", SPECULATION, 12),
    ("absent", NEGATION, 10),
]
CUE_WORDS = set(
    "no not never without denies denied negative ruled possible possibly probable probably suspected concern question may might cannot rule suggest suggests suggested suggesting indicate indicates "
    "indicated indicating appears appeared likely possibility potentially putative whether if when should unless risk would could consider candidate planned history prior previous previously remote "
    "resolved old family mother father sister brother son daughter wife husband".split()
)
EITHER_SIDE = {"conditional"}
TERMINATORS = {"but", "however", "although", "though", "except", "nevertheless", "nonetheless", "while", "whereas"}
NO_KEYWORDS = set("the and for with from was were daily tablet capsule follow status change continued started stopped".split())
ACKNOWLEDGED = {
    "absent": "no|negative|denied|ruled out|absent|without",
    "possible": "possible|probable|suspected|concern|rule out|cannot exclude|uncertain",
    "conditional": "if|when|monitor|return for|conditional",
    "hypothetical": "risk|consider|planned|hypothetical",
    "historical": "history|prior|previous|remote|resolved|status post|s/p",
    "associated_with_someone_else": "family history|mother|father|sister|brother|son|daughter|wife|husband",
}
NO_CONTENT = set(
    "the was were and for with from this that patient discharge continued started changed stopped performed showed shows showing revealed demonstrated obtained completed because surgical daily nightly "
    "tablet capsule".split()
)
#: Words from which a quote that equals its label is judged as a sentence; keywords of a target that are looked for.
SENTENCE_WORDS, MOST_KEYWORDS = 8, 6

_found = {name: re.compile(rf"\b(?:{cue})\b", re.ASCII) for name, cue, _ in SCOPED}
_speculation, _negation, _pseudo = (re.compile(rf"\b(?:{p})\b", re.ASCII) for p in (SPECULATION, NEGATION, PSEUDO))


def plain(x: str | None) -> str:
    """NFKC, lower case, other than ASCII letters, digits and full stops as single spaces."""
    return re.sub(r"[^a-z0-9.]+", " ", unicodedata.normalize("NFKC", x or "").lower()).strip()


def keywords(x: str | None) -> list[str]:
    """Words of four characters or more that don't begin with a digit and aren't among NO_KEYWORDS."""
    return [w for w in re.split("[^a-z0-9]+", plain(x)) if len(w) >= 4 and not w[0].isdigit() and w not in NO_KEYWORDS]


def content(x: str | None) -> list[str]:
    words = (w if re.fullmatch(r"\d+(?:\.\d+)?", w) else w.rstrip(".") for w in plain(x).split())
    return [w for w in words if len(w) >= 3 and w not in NO_CONTENT]


def of_sentence(x: Column) -> Column:
    """possible, absent or present for a whole sentence; null counts as present."""
    bare = F.regexp_replace(T.lower(F.coalesce(x, F.lit(""))), f"(?<![a-z0-9_])(?:{PSEUDO})(?![a-z0-9_])", " ")
    return F.when(has_word(bare, SPECULATION), "possible").when(has_word(bare, NEGATION), "absent").otherwise("present")


def acknowledged(label: Column, status: Column, extra: dict[str, str] | None = None) -> Column:
    """Whether a label itself says the status; true for present, false for unknown ones. `extra` has more words for a status."""
    out = F.when(status == "present", True)
    for name, words in ACKNOWLEDGED.items():
        out = out.when(status == name, has_word(F.coalesce(label, F.lit("")), words + (f"|{extra[name]}" if extra and name in extra else "")))
    return out.otherwise(False)


def acknowledges(label: str | None, status: str, extra: str = "") -> bool:
    """acknowledged() for one label."""
    return status == "present" or (status in ACKNOWLEDGED and bool(re.search(rf"\b(?:{ACKNOWLEDGED[status]}{extra})\b", (label or "").lower(), re.ASCII)))


def located(source: str | None, quote: str | None) -> tuple[int, int] | None:
    """Where a quote stands in its source: as it is, or else the place in the normalised source (an approximate one, of the quote's length)."""
    if not source or not (quote or "").strip():
        return None
    at = source.find(quote)
    if at < 0:
        at = plain(source).find(plain(quote))
    return None if at < 0 else (at, min(len(source), at + len(quote)))


def narrowed(context: str, target: str | None) -> str:
    """The line of a context that holds the target, else the first sentence that does, else all of it."""
    want = plain((target or "").strip())
    if not context or not (target or "").strip():
        return context
    parts = [x.strip() for x in re.split(r"\r?\n", context)], [x.strip() for x in re.split(r"(?<=[.;:])\s+", context)]
    return next((x for part in parts for x in part if x and want in plain(x)), context)


def toward(context: str | None, target: str | None) -> str:
    """The status of a target inside a context: the first in SCOPED that has a cue there and a cue word near enough before the target
    (conditional: on either side) with no terminator between."""
    text = plain(context)
    words, want = text.split(), keywords(target)[:MOST_KEYWORDS]
    goals = [i for i, w in enumerate(words) if any(w in k or k in w for k in want)]
    cues = [i for i, w in enumerate(words) if w in CUE_WORDS]
    stops = [i for i, w in enumerate(words) if w in TERMINATORS]
    pairs = [goal - cue for goal in goals for cue in cues if not any(min(cue, goal) < s < max(cue, goal) for s in stops)]
    for status, _, reach in SCOPED:
        if _found[status].search(text) and any((abs(d) if status in EITHER_SIDE else d) in range(reach + 1) for d in pairs):
            return status
    return "present"


def detect(source: str | None, quote: str | None, label: str | None, window: int = 140) -> tuple[str, str, bool]:
    """Status of a claim, the context it is read from, and whether its quote stands in the source.

    The context is what stands `window` characters around the quote, narrowed to a line or sentence; without a place, the quote or
    label itself. A quote of SENTENCE_WORDS words that equals its label is judged as a sentence.
    """
    spot = located(source, quote)
    context = narrowed(source[max(0, spot[0] - window) : spot[1] + window] if spot else quote or label or "", quote or label)
    q, x = plain(quote), plain(label)
    if q and q == x and len(x.split()) >= SENTENCE_WORDS:
        text = _pseudo.sub(" ", plain(context))
        return "possible" if _speculation.search(text) else "absent" if _negation.search(text) else "present", context, spot is not None
    return toward(context, q or x), context, spot is not None


def scoped(claims: DataFrame, context: str, target: str) -> DataFrame:
    """All columns of claims with `assertion`; a null context or target is present."""
    return _rows.with_columns(claims, [context, target], "assertion string", lambda c, t: (toward(c, t),))


def detected(claims: DataFrame, source: str = "source", quote: str = "quote", label: str = "label") -> DataFrame:
    """All columns of claims with assertion, context and quote_found, as detect() gives them."""
    return _rows.with_columns(claims, [source, quote, label], "assertion string, context string, quote_found boolean", detect)


# Terms and what they stand for; what a lab finding may be inferred from (label, quote and cue).
SYNONYMS = [
    ("bid", "twice daily"), ("tid", "three times daily"), ("qid", "four times daily"), ("qhs", "nightly"), ("qday", "daily"), ("qd", "daily"), ("po", "oral"), ("aki", "acute kidney injury"),
    ("ckd", "chronic kidney disease"), ("copd", "chronic obstructive pulmonary disease"), ("uti", "urinary tract infection"), ("sob", "shortness of breath"), ("htn", "hypertension"),
    ("afib", "atrial fibrillation"), ("debrided", "debridement"), ("surgically", "surgical"),
]
LAB_RULES = [
    (r"\bhypokalemia\b", r"\bpotassium\b", r"\b(?:low|decreased|repleted|replaced|corrected)\b"),
    (r"\bhyperkalemia\b", r"\bpotassium\b", r"\b(?:high|elevated|increased|treated|corrected)\b"),
    (r"\bacute kidney injury\b|\baki\b", r"\b(?:creatinine|renal function|kidney function)\b", r"\b(?:increased|elevated|rose|improved|resolved|recovered)\b"),
    (r"\banemia\b", r"\b(?:hemoglobin|hgb|hematocrit|hct)\b", r"\b(?:low|decreased|dropped|transfused|improved)\b"),
]
#: (domain, words of the label, words of the quote) that make an inference from a Dice of DOMAIN on.
DOMAIN_RULES = [
    ("procedures_and_tests", r"\b(echocardiogram|radiograph|xray|x ray|cta|ct|mri|ultrasound)\b", r"\b(showed|shows|revealed|demonstrated|obtained|performed)\b"),
    ("medication_changes", r"\b(stopped|started|increased|decreased|continued)\b", r"\b(stopped|started|increased|decreased|continued|replaced)\b"),
]
ANY_DOMAIN = "handoff_atoms"
NORMALIZED, INFERENTIAL, DOMAIN = 0.72, 0.3, 0.25


def expanded(x: str | None, synonyms: list[tuple[str, str]] = SYNONYMS) -> str:
    """The normal form with known terms spelled out, one after the other."""
    return plain(reduce(lambda text, pair: re.sub(rf"\b{re.escape(pair[0])}\b", pair[1], text), synonyms, f" {plain(x)} "))


def expand(x: Column, synonyms: list[tuple[str, str]] = SYNONYMS) -> Column:
    """expanded() as a column."""
    out = T.normal_loose(x)
    for short, long in synonyms:
        out = F.regexp_replace(out, rf"(?<![a-z0-9_]){short}(?![a-z0-9_])", long)
    return out


def _dice(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def inferred(label: str, quote: str, domain: str | None) -> bool:
    """Whether a rule lets the expanded quote stand for the expanded label."""
    if any(re.search(a, label) and re.search(b, quote) and re.search(c, quote) for a, b, c in LAB_RULES):
        return True
    share = _dice(content(label), content(quote))
    return any((d in (domain or "") or ANY_DOMAIN in (domain or "")) and share >= DOMAIN and re.search(a, label) and re.search(b, quote) for d, a, b in DOMAIN_RULES)


def typed(source: str | None, quote: str | None, label: str | None, domain: str | None) -> tuple[str, str, bool, float | None]:
    """How a claim is grounded, its assertion, whether its quote is in the source, and the overlap of label and quote where that decided."""
    status, _, found = detect(source, quote, label)
    a, b = plain(label), plain(quote)
    found = found or bool(b and b in plain(source))
    if status != "present" and not acknowledges(label, status):
        return "assertion_conflict", status, found, None
    if not b:
        return "unsupported", status, False, None
    if a and a in b:
        return "direct_quote", status, found, None
    x, y = expanded(label), expanded(quote)
    overlap = _dice(content(x), content(y))
    if a and (x in y or y in x or overlap >= NORMALIZED):
        return "normalized", status, found, None
    if a and inferred(x, y, domain):
        return "inferential", status, found, None
    return "normalized" if overlap >= NORMALIZED else "inferential" if overlap >= INFERENTIAL and found else "unsupported", status, found, round(overlap, 3)


def typed_provenance(claims: DataFrame, source: str = "source", quote: str = "quote", label: str = "label", domain: str = "domain") -> DataFrame:
    """All columns of claims with type, assertion, quote_found and overlap, as typed() gives them."""
    return _rows.with_columns(claims, [source, quote, label, domain], "type string, assertion string, quote_found boolean, overlap double", typed)


def provenance_report(found: DataFrame) -> DataFrame:
    """Claims by domain and type, with totals (null) over either."""
    return found.cube("domain", "type").agg(F.count(F.lit(1)).alias("claims"), F.count_if("quote_found").alias("located"))


def overstatement(found: DataFrame) -> DataFrame:
    """(located, conflicts, rate): located claims whose label doesn't own up to their assertion."""
    t = found.filter("quote_found").agg(F.count(F.lit(1)).alias("located"), F.count_if(~acknowledged(F.col("label"), F.col("assertion"))).alias("conflicts"))
    return t.withColumn("rate", F.round(T.ratio(F.col("conflicts"), F.col("located")), 6))
