"""Notes traced back to their sources, sentence by sentence, and repaired by what the source says."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from veristrata.functions import text as T
from veristrata.operators import _rows

# Words that carry no content; cues that speak for a candidate; words that make a sentence high-risk; who speaks.
NO_CONTENT = set("the and for with that this from have has had was were are you your will should doctor patient clinician provider".split())
CUES = [
    "start(?:ed)?", "stop(?:ped)?", "discontinue(?:d)?", "continue(?:d)?", "medication", "dose", "mg", r"follow\s?up", "appointment", "return", "call", "monitor", "check", "repeat", "lab", "creatinine", "potassium",
    "glucose", "diagnos(?:is|ed)", "assessment", "plan", "discharge", "ct", "mri", "xray", "ultrasound", "echo", "procedure",
]
HIGH_RISK = (
    "warfarin|heparin|enoxaparin|apixaban|rivaroxaban|insulin|opioid|antibiotic|creatinine|potassium|inr|culture|biopsy|pathology|pending|return|call|follow.?up|monitor|bleeding|oxygen|dialysis|dose|mg"
)
SPEAKERS = r"\s+(?=(?:doctor|patient|clinician|provider|nurse|speaker\s*\d+|dr\.?)\s*:)"
#: Tokens of a candidate, at least, and of one made of two sentences, at most; support from which a sentence isn't weak.
LEAST_TOKENS, MOST_TOKENS, WEAK = 3, 80, 0.28
#: Shares of coverage, precision and bigrams in a score; what a cue adds, and all of them at most; what missing numbers cost.
COVERAGE, PRECISION, BIGRAMS, CUE, CUES_AT_MOST, NUMBERS = 0.58, 0.24, 0.18, 0.015, 0.12, 0.20

_cues = [re.compile(rf"\b{c}\b", re.ASCII) for c in CUES]
_risky = re.compile(rf"\b(?:{HIGH_RISK})\b", re.I | re.ASCII)


def tokens(x: str | None) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)?", (x or "").lower())


def sentences(x: str | None) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?;:])\s+|\n+", x or "") if s.strip()]


def _flat(x: str | None) -> str:
    return " ".join(tokens(x))


def source_candidates(source: str | None) -> Iterator[tuple[int, str]]:
    """(ordinal of its first sentence, text): a source's sentences by speaker, each alone and with the one behind it."""
    marked = re.sub(SPEAKERS, "\n", (source or "").replace("\r", "\n"), flags=re.I)
    parts = [p.strip() for p in re.split(r"\n+|(?<=[.!?;])\s+", marked)]
    parts = [p for p in parts if len(tokens(p)) >= LEAST_TOKENS]
    for i, text in enumerate(parts):
        yield i, text
        if i + 1 < len(parts) and len(tokens(f"{text} {parts[i + 1]}")) <= MOST_TOKENS:
            yield i, f"{text} {parts[i + 1]}"


class _Text:
    """What a score needs of a text."""

    def __init__(self, x: str):
        self.text = x
        self.words = [w for w in tokens(x) if len(w) >= 3 and w not in NO_CONTENT]
        self.pairs = list(zip(self.words, self.words[1:]))
        self.own, self.own_pairs = set(self.words), set(self.pairs)
        self.numbers = re.findall(r"\b\d+(?:\.\d+)?\b", x, re.ASCII)
        plain = re.sub(r"[^a-z0-9.]+", " ", unicodedata.normalize("NFKC", x).lower())
        self.cues = sum(bool(c.search(plain)) for c in _cues)


def score(query: _Text, candidate: _Text) -> float:
    if not query.words or not candidate.words:
        return 0.0
    both = len(query.own & candidate.own)
    pairs = sum(p in candidate.own_pairs for p in query.pairs) / len(query.pairs) if query.pairs else 0.0
    missing = bool(query.numbers) and not set(query.numbers) <= set(candidate.numbers)
    return COVERAGE * both / len(query.own) + PRECISION * both / len(candidate.own) + BIGRAMS * pairs + min(CUES_AT_MOST, CUE * candidate.cues) - (NUMBERS if missing else 0.0)


def traced(source: str | None, note: str | None) -> Iterator[tuple[int, str, bool, float, str | None, bool, bool]]:
    """(ordinal, sentence, exact, score, best, weak, high_risk) of each sentence of a note; the earliest of equally good candidates is best."""
    found, flat = [_Text(t) for _, t in source_candidates(source)], _flat(source)
    for i, sentence in enumerate(sentences(note)):
        exact = bool(_flat(sentence)) and _flat(sentence) in flat
        query = _Text(sentence)
        best, at = max(((score(query, c), -k) for k, c in enumerate(found)), default=(0.0, 1))
        yield i, sentence, exact, round(best, 6), found[-at].text if found else None, not exact and (not found or best < WEAK), bool(_risky.search(sentence))


TRACE = "ordinal int, sentence string, exact boolean, score double, best string, weak boolean, high_risk boolean"


def trace(notes: DataFrame, key: str, source: str, note: str) -> DataFrame:
    """key with the columns of TRACE: a row for each sentence of each note. A note is compared with its own source alone."""
    return _rows.exploded(notes, key, [source, note], TRACE, traced)


def trace_summary(rows: DataFrame) -> DataFrame:
    """Sentences, exact and weak ones, and weak ones among high-risk ones."""
    t = rows.agg(F.count(F.lit(1)).alias("sentences"), F.count_if("exact").alias("exact"), F.count_if("weak").alias("weak"), F.count_if("high_risk").alias("high_risk"), F.count_if(F.col("weak") & F.col("high_risk")).alias("high_risk_weak"), F.round(F.avg("score"), 6).alias("mean_score"))
    return t.withColumn("weak_rate", F.round(T.ratio(F.col("weak"), F.col("sentences")), 6)).withColumn("high_risk_weak_rate", F.round(T.ratio(F.col("high_risk_weak"), F.col("high_risk")), 6))


# Cues of sentences that a note is made of, and who says them.
NOTE_CUES = [
    "start(?:ed)?", "stop(?:ped)?", "discontinue(?:d)?", "continue(?:d)?", "mg", "tablet", "dose", "medication", "prescrib(?:e|ed)", r"follow\s?up", "appointment", "return", "call", "monitor", "check", "repeat", "lab",
    "creatinine", "potassium", "glucose", "diagnos(?:is|ed)", "assessment", "plan", "discharge", "admit(?:ted)?", "ct", "mri", "xray", "ultrasound", "echo", "procedure",
]
_note_cues = [re.compile(rf"\b{c}\b", re.ASCII) for c in NOTE_CUES]


def cue_note(source: str | None, budget: int | None) -> tuple[str]:
    """The source's sentences with the most cues, as many as fit the budget of tokens, in their order; its last tokens where none has a cue."""
    budget = max(1, budget or 1)
    plain = lambda x: re.sub(r"[^a-z0-9.]+", " ", unicodedata.normalize("NFKC", x).lower()).strip()
    cues = lambda x: sum(bool(c.search(plain(x))) for c in _note_cues) + 0.5 * bool(re.match(r"(?:doctor|clinician|provider|dr\.?)\b", x, re.I | re.ASCII))
    found = [(-cues(s), i, s, len(tokens(s))) for i, s in enumerate(sentences((source or "").replace("\r", "\n")))]
    chosen, used = [], 0
    for score_, i, s, n in sorted(f for f in found if f[0] < 0 and f[3]):
        if used and used + n > budget:
            continue
        chosen.append((i, s))
        used += n
        if used >= 0.95 * budget:
            break
    if not chosen:
        return (" ".join(tokens(source)[-budget:]),)
    text = " ".join(s for _, s in sorted(chosen))
    return (text if len(tokens(text)) <= budget else " ".join(tokens(text)[:budget]),)


def cue_notes(rows: DataFrame, source: str, budget: str) -> DataFrame:
    """All columns with `cue_note`, as cue_note() gives it."""
    return _rows.with_columns(rows, [source, budget], "cue_note string", cue_note)


def compacted(query: str, text: str) -> tuple[str, float]:
    """A candidate's text cut down to a clause or a window around what it shares with a sentence, unless that loses more than 0.04 of score."""
    wanted, best = _Text(query), (text, score(_Text(query), _Text(text)))
    most = max(8, min(48, -(-27 * len(tokens(query)) // 20)))
    bare = re.sub(r"^\s*(?:doctor|patient|clinician|provider|nurse|speaker\s*\d+|dr\.?)\s*:\s*", "", text, flags=re.I)
    words, own = tokens(bare), wanted.own
    parts = [bare, *re.split(r"[.;]|\s+-\s+|,\s+|\s+\band\b\s+|\s+\bbut\b\s+", bare, flags=re.I)]
    for i, w in enumerate(words):
        if w in own:
            parts += [" ".join(words[max(0, i - n // 2) : max(0, i - n // 2) + n]) for n in dict.fromkeys((max(6, -(-most * 11 // 20)), max(8, -(-most * 4 // 5)), most))]
    seen = set()
    for part in (p.strip() for p in parts):
        if 3 <= len(tokens(part)) <= most and _flat(part) not in seen:
            seen.add(_flat(part))
            s = score(wanted, _Text(part))
            if s > best[1] or (s >= best[1] - 0.04 and len(tokens(part)) < len(tokens(best[0]))):
                best = part, s
    return best


def compact(rows: DataFrame) -> DataFrame:
    """trace() rows whose best candidates are compacted, with the score that follows."""
    return _rows.with_columns(rows, ["sentence", "best", "score"], "best string, score double", lambda s, b, x: (b, x) if b is None else (lambda c: (c[0], round(c[1], 6)))(compacted(s, b)))


METHODS = ("drop_unsupported", "replace_unsupported", "source_only")


def repaired(rows: DataFrame, key: str, method: str) -> DataFrame:
    """(key, text, kept, dropped, replaced): notes put together again from trace() rows.

    drop_unsupported keeps the sentences that the source has; replace_unsupported takes the best candidate for the others, unless it is
    weak; source_only takes it for all. A text that a note has already isn't added twice.
    """
    best = F.when(F.col("score") >= WEAK, F.col("best"))
    text = {"drop_unsupported": F.when(F.col("exact"), F.col("sentence")), "replace_unsupported": F.when(F.col("exact"), F.col("sentence")).otherwise(best), "source_only": best}[method]
    same = F.array_join(T.word_tokens(F.col("__t")), " ")
    rows = rows.withColumn("__t", text).withColumn("__s", F.when(F.col("__t").isNotNull(), same))
    first = rows.filter("__t is not null").groupBy(key, "__s").agg(F.min(F.struct("ordinal", "__t")).alias("f"))
    made = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["__t"]), " ").alias("text"), F.count(F.lit(1)).alias("kept"))
    counts = rows.groupBy(key).agg(F.count_if(F.col("__t").isNull()).alias("dropped"), F.count_if(F.col("__t").isNotNull() & ~F.col("exact")).alias("replaced"))
    return counts.join(made, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kept", F.lit(0)).alias("kept"), "dropped", "replaced")


def support(notes: DataFrame, key: str, source: str, note: str) -> DataFrame:
    """(key, tokens, novelty, extractive_rate, unsupported): tokens that the source lacks, and sentences that it has as they stand.

    The source's words are looked up in a map, so a note costs its length and not its length times the source's.
    """
    known = F.map_from_arrays(F.array_distinct("s"), F.array_repeat(F.lit(True), F.size(F.array_distinct("s"))))
    rows = notes.select(key, F.coalesce(T.word_tokens(F.col(source)), F.array().cast("array<string>")).alias("s"), F.coalesce(T.word_tokens(F.col(note)), F.array().cast("array<string>")).alias("t"), F.coalesce(note, F.lit("")).alias("note"))
    rows = rows.select(key, "t", "note", known.alias("known"), F.concat(F.lit(" "), F.array_join("s", " "), F.lit(" ")).alias("flat"))
    cut = F.filter(F.transform(F.split("note", r"(?<=[.!?;:])\s+|\n+"), F.trim), lambda x: x != "")
    rows = rows.withColumn("cut", cut).withColumn("found", F.size(F.filter("cut", lambda x: F.col("flat").contains(F.array_join(T.word_tokens(x), " ")))))
    novel = F.size(F.filter("t", lambda w: F.try_element_at("known", w).isNull()))
    return rows.select(key, F.size("t").alias("tokens"), F.round(T.ratio(novel, F.size("t")), 6).alias("novelty"), F.round(T.ratio(F.col("found"), F.size("cut")), 6).alias("extractive_rate"), (F.size("cut") - F.col("found")).alias("unsupported"))
