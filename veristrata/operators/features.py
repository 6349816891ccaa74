"""Column rules about sources and labels: risk features, families, what an instruction says, other layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veristrata.functions import text as T

# Words left out when labels are scored; what makes a source risky; families of diagnoses, first match first; what an
# instruction says of time and limits; who owns it, first match first; cues that gate support.
SCORING_STOPS = "mg|mcg|po|iv|daily|bid|tid|qid|the|and|with|for|to|of|from|dose|was|is|in|a|an"
RISKS = {
    "medication_list_present": "discharge medications|medications on admission|home medications|medications:",
    "anticoagulation_or_bleeding": "coumadin|warfarin|heparin|lovenox|enoxaparin|anticoag|bleed|hemorrhage|inr|ptt",
    "antibiotics_or_infection": "vancomycin|zosyn|cef|cipro|levofloxacin|azithro|flagyl|antibiotic|culture|bacter|sepsis|pneumonia|abscess",
    "renal_or_dosing": "creatinine|renal|kidney|dialysis|bun|ckd|arf|aki|nephro",
    "respiratory_or_oxygen": "oxygen|intubat|ventilat|hypox|respiratory failure|peep|trach|nasal cannula",
    "wound_or_device_care": "wound|drain|foley|catheter|picc|central line|tube|staple|suture|device|ostomy",
    "pending_or_follow_up": "follow.?up|appointment|clinic|pcp|return|monitor|pending|repeat",
    "icu_or_goals": "icu|expired|death|comfort|withdraw|dnr|family meeting|pressor",
}
LONG, SPARSE = 15000, 2500
FAMILIES = {
    "cardiovascular": "cabg|coronary|cardiac|heart|valve|myocard|aortic|mitral|atrial|chf|cad",
    "respiratory": "copd|pneumonia|respiratory|asthma|hypoxia|emphysema|lung",
    "infection": "sepsis|infection|bacteremia|fever|cellulitis",
    "gastrointestinal": "gi|gastro|bleed|abdominal|bowel|liver|pancrea|chole",
    "renal": "renal|kidney|dialysis|esrd|urinary",
    "neurologic": "stroke|seizure|hemorrhage|neuro|brain|spine|mental",
    "surgical_or_wound": "fracture|joint|hip|knee|orthopedic|wound|ulcer|gangrene|amputation",
    "oncology": "cancer|mass|tumor|lymphoma|leukemia|carcinoma",
}
TIME_WINDOW = r"(?:in|within|after|for)\s+\d+\s+(?:hour|hours|day|days|week|weeks|month|months)"
LIMIT = r"(?i)((?:>|>=|<|<=|above|below|over|under|exceeds?|less than|greater than)\s*[\d.]+\s*(?:kg|lb|lbs|mg/dL|mmol/L|%|degrees?)?)"
OWNERS = [("primary care", ["primary care", "pcp"]), ("cardiology", ["cardiology", "cardiologist"]), ("wound clinic", ["wound clinic"]), ("patient", ["patient", "record", "call", "return"])]
SUPPORT_CUES = r"not|no|denies?|without|negative|never|history of|prior|previously|discontinued|since stopped|if|should|when|as needed|prn"
BASELINE_NEGATION = r"no|not|never|without|denies?|denied|negative for|no evidence of|ruled out|absence of|free of"
BULLET = r"^(?:\?{3,}|\d{1,2}[.)]|[-*])\s*"


def scoring_form(x: Column) -> Column:
    """Lower case, ASCII letters and digits, without words that carry no score."""
    bare = F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"(?<![a-z0-9_])(?:{SCORING_STOPS})(?![a-z0-9_])", " "), r"\s+", " "))


def source_risks(x: Column) -> dict[str, Column]:
    """Ten yes-or-no features of a source."""
    return {"long_note": F.length(x) > LONG, "sparse_note": F.length(x) < SPARSE, **{k: x.rlike(f"(?i){p}") for k, p in RISKS.items()}}


def family(x: Column) -> Column:
    """The first family whose words stand in a diagnosis, parts of words too; other for none."""
    out = F.when(F.lit(False), "")
    for name, words in FAMILIES.items():
        out = out.when(F.lower(F.coalesce(x, F.lit("unknown"))).rlike(words), name)
    return out.otherwise("other")


def slug(x: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(made == "", "view").otherwise(made)


def time_window(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, rf"({T.bounded(TIME_WINDOW)})", 1), F.lit(""))


def limit(x: Column) -> Column:
    return F.trim(F.coalesce(F.regexp_extract(x, LIMIT, 1), F.lit("")))


def owner(x: Column) -> Column:
    """Whose task an instruction is. Of several names for one owner the first begins a word and the last ends one."""
    text = scoring_form(F.coalesce(x, F.lit("")))
    out = F.when(F.lit(False), "")
    for name, words in OWNERS:
        parts = [words[0]] if len(words) == 1 else words
        pattern = rf"(?<![a-z0-9_]){parts[0]}(?![a-z0-9_])" if len(parts) == 1 else "|".join([rf"(?<![a-z0-9_]){parts[0]}", *parts[1:-1], rf"{parts[-1]}(?![a-z0-9_])"])
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("")


def extractive_label(x: Column, most: int = 300) -> Column:
    """A candidate's text without its bullet or number, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), BULLET, "")), 1, most)


def layouts(docs: DataFrame) -> DataFrame:
    """Each document three times (arm, text): as it is, with white space narrowed, and as one line."""
    narrow = F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"\n{3,}", "\n\n")
    arms = F.array(F.struct(F.lit("none").alias("arm"), F.col("text")), F.struct(F.lit("whitespace").alias("arm"), narrow.alias("text")), F.struct(F.lit("rewrap").alias("arm"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")))
    return docs.select("doc_id", F.explode(arms).alias("a")).select("doc_id", "a.*")


def section_text(x: Column, names: list[str]) -> Column:
    """What stands under the first heading of a name, up to the next line of capitals with a colon; empty for none."""
    heads = "|".join(names)
    return F.trim(F.coalesce(F.regexp_extract(x, rf"(?is)(?:^|\n)\s*(?:{heads})\s*:?\s*\n(.*?)(?=\n\s*(?-i:[A-Z][A-Z /-]{{3,}}):|$)", 1), F.lit("")), F.lit(" \t\r\n"))


def support_words(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(T.lower(F.coalesce(x, F.lit(""))), T.but_words("./ \t\n\v\f\r"), " "), r"\s+", " "))
    return F.filter(F.split(bare, " "), lambda t: t != "")


def support(rows: DataFrame, key: str, value: str, quote: str) -> DataFrame:
    """(key, lexical, cue_aware) of lexical_support and cue_aware_support, for one row of each key.

    Words are made once and counted by key and word, so the work grows with the texts' length, not with the product of two lengths. Rows that
    are dealt by key already stay where they are.
    """
    words = rows.select(key, support_words(F.col(value)).alias("__v"), support_words(F.col(quote)).alias("__q"))
    cued = F.array_join("__q", " ").rlike(rf"(?<![a-z0-9_])(?:{SUPPORT_CUES})(?![a-z0-9_])")
    # the cue goes along as an element without a word: as a column beside the words it would be looked for once for each
    cue = F.array(F.struct(F.lit(None).cast("string").alias("word"), cued.cast("int").alias("n")))
    each = lambda x, n: F.transform(x, lambda t: F.struct(t.alias("word"), F.lit(n).alias("n")))
    long = words.select(key, F.explode(F.concat(cue, each(F.col("__v"), 1), each(F.array_distinct("__q"), 0))).alias("__x")).select(key, "__x.*")
    by = long.groupBy(key, "word").agg(F.sum("n").alias("__n"), (F.min("n") == 0).alias("__have"))
    word = F.col("word").isNotNull()
    sums = by.groupBy(key).agg(F.sum(F.when(word, F.col("__n"))).alias("__all"), F.sum(F.when(word & F.col("__have"), F.col("__n"))).alias("__hits"), (F.max(F.when(~word, F.col("__n"))) > 0).alias("__cued"))
    share = F.when(F.col("__all") > 0, F.coalesce("__hits", F.lit(0)) / F.col("__all")).otherwise(0.0)
    return sums.select(key, share.alias("lexical"), F.when(F.col("__cued"), 0.0).otherwise(share).alias("cue_aware"))


def lexical_support(value: Column, quote: Column) -> Column:
    """Share of the value's words, each as often as it stands there, that the quote has."""
    words, have = support_words(value), support_words(quote)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.array_contains(have, t))) / F.size(words)).otherwise(0.0)


def cue_aware_support(value: Column, quote: Column) -> Column:
    """lexical_support, but 0 where the quote has a cue of negation, history or condition."""
    return F.when(F.array_join(support_words(quote), " ").rlike(rf"(?<![a-z0-9_])(?:{SUPPORT_CUES})(?![a-z0-9_])"), 0.0).otherwise(lexical_support(value, quote))


def domain(x: Column) -> Column:
    """The broad domain of a domain's name, first match first; its own trimmed name where none fits, unknown for blank."""
    text = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, parts in (("medication", ["medication"]), ("diagnosis", ["diagnosis"]), ("procedure_or_test", ["procedure", "test"]), ("lab", ["lab"]), ("follow_up", ["follow"]), ("safety", ["safety"]), ("uncertain", ["uncertain"])):
        for part in parts:
            out = out.when(text.contains(part), name)
    return out.when(text == "", "unknown").otherwise(text)


def status_baselines(x: Column, speculation: str, pseudo: str) -> dict[str, Column]:
    """What three simple methods say of a sentence: always present; absent on a cue; possible or absent on a cue."""
    text = F.trim(F.regexp_replace(T.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))
    has = lambda t, p: t.rlike(rf"(?<![a-z0-9_])(?:{p})(?![a-z0-9_])")
    negated = has(F.regexp_replace(text, rf"(?<![a-z0-9_])(?:{pseudo})(?![a-z0-9_])", " "), BASELINE_NEGATION)
    return {"present_majority": F.lit("present"), "negex_style": F.when(negated, "absent").otherwise("present"), "context_style": F.when(has(text, speculation), "possible").when(negated, "absent").otherwise("present")}


# Cues by which a sentence's status is scored, each counted as often as it stands there.
SCORE_NEGATION = ["no", "not", "without", "denies?", "denied", "negative for", "no evidence of", "ruled out", "absence of"]
SCORE_SPECULATION = "possible possibly probable probably suspected|concern for|question of|may might could|cannot exclude|rule out|suggests? indicates? appears? likely possibility potentially whether"
SCORE_SPECULATION = [c for part in SCORE_SPECULATION.split("|") for c in ([part] if part in ("concern for", "question of", "cannot exclude", "rule out") else part.split())]


def status_scores(x: Column, detected: Column) -> dict[str, Column]:
    """Scores of present, absent and possible that add up to one, from what was detected and how many cues stand in the text."""
    text = T.lower(F.coalesce(x, F.lit("")))
    count = lambda cues: sum((F.regexp_count(text, F.lit(rf"(?<![a-z0-9_])(?:{c})(?![a-z0-9_])")) for c in cues), F.lit(0))
    neg, spec = count(SCORE_NEGATION), count(SCORE_SPECULATION)
    both = (neg > 0) & (spec > 0)
    pick = lambda present, absent, possible: F.when(detected == "present", present).when(detected == "absent", absent).otherwise(possible)
    raw = {
        "present": pick(F.lit(0.64), F.when(both, 0.30).otherwise(0.18), F.when(both, 0.30).otherwise(0.20)),
        "absent": pick(F.greatest(F.lit(0.18), 0.26 + neg * 0.08), 0.72 + F.least(F.lit(0.12), neg * 0.04), F.when(both, 0.48).otherwise(0.18 + neg * 0.04)),
        "possible": pick(F.greatest(F.lit(0.18), 0.26 + spec * 0.08), F.when(both, 0.48).otherwise(0.20 + spec * 0.04), 0.72 + F.least(F.lit(0.12), spec * 0.04)),
    }
    total = raw["present"] + raw["absent"] + raw["possible"]
    return {k: v / total for k, v in raw.items()}


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set of words that the other has; 0 where either is empty."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Length of the shorter text by the longer one's where one holds the other; else their words' overlap; 0 for an empty one."""
    words = lambda x: F.filter(F.split(x, "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(short == 0, 0.0).when(a.contains(b) | b.contains(a), short / long).otherwise(overlap(words(a), words(b)))


def grounded(rows: DataFrame, value: Column, sentence: Column, gold: Column, distractor: Column, least: float = 0.8) -> DataFrame:
    """All columns with `supported` and `reason`: whether a value is said by the gold sentence that it was matched with.

    distractor names what kind of trap the sentence is, or is null.
    """
    words, have = support_words(value), support_words(sentence)
    held = F.coalesce((F.size(words) > 0) & (F.size(have) > 0) & (F.size(F.filter(words, lambda w: F.array_contains(have, w))) / F.greatest(F.size(words), F.lit(1)) >= least), F.lit(False))
    reason = F.when(gold & held, "present_grounded").when(distractor.isNotNull(), F.concat(F.lit("distractor_"), distractor)).when(~held, "value_not_grounded").otherwise("non_gold_sentence")
    return rows.withColumn("reason", reason).withColumn("supported", F.col("reason") == "present_grounded")


# How urgently a claim is looked at by how its quote was missed.
STRESS_ORDER = ["abstain_low_overlap", "abstain_weak_overlap", "abstain_missing_quote", "label_span_recovered", "single_span_recovered", "multi_span_recovered", "normalized_single_span"]


def stress_tasks(claims: DataFrame, status: str, rate: str, words: str, ties: list[str], most: int) -> DataFrame:
    """The `most` claims to stress first: by how their quote was missed, then the worst and longest cases."""
    order = F.create_map(*(F.lit(x) for i, name in enumerate(STRESS_ORDER) for x in (name, i)))
    return claims.orderBy(F.coalesce(F.try_element_at(order, F.col(status)), F.lit(50)), F.col(rate), F.col(words).desc(), *ties).limit(most)


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule that is null for a row is broken."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), (~F.coalesce(v, F.lit(False))).cast("long").alias("n")) for k, v in rules.items()))).alias("r")).groupBy("r.rule").agg(F.sum("r.n").alias("rows"))


def rates(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by..., measure, n, hits, rate, low, high): the share of rows of each group for which a flag holds, with its interval; a null flag doesn't count."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in flags.items()))).alias("f")).select(*by, "f.*").dropna(subset=["x"])
    t = long.groupBy(*by, "measure").agg(F.count(F.lit(1)).alias("n"), F.count_if("x").alias("hits"))
    low, high = T.wilson(F.col("hits"), F.col("n"))
    return t.select(*by, "measure", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))
