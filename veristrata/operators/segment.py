"""Documents as lines, sentences and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veristrata.functions import text as T


def lines(x: Column) -> Column:
    """Trimmed non-blank lines in order."""
    return F.filter(F.transform(F.split(x, r"\r?\n"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def line_id(ordinal: Column) -> Column:
    """L and the ordinal in four digits, or as many as it has."""
    return F.concat(F.lit("L"), F.lpad(ordinal.cast("string"), F.greatest(F.lit(4), F.length(ordinal.cast("string"))), F.lit("0")))


def line_index(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, line_id, text): trimmed non-blank lines, numbered from 1 in order inside the document; no shuffle."""
    rows = docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("p", "text"))
    return rows.select("doc_id", (F.col("p") + 1).alias("ordinal"), line_id(F.col("p") + 1).alias("line_id"), "text")


#: The spaces of Unicode (category Zs); tabs and line ends aren't among them.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def sentences(x: Column) -> Column:
    """Pieces between . ! ? ; : or a line's end, with their mark, without the SPACES around them, blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"([^.!?;:\n]+[.!?;:]*)"), F.lit(1)), lambda s: F.trim(s, F.lit(SPACES))), lambda s: s != "")


def density(docs: DataFrame) -> DataFrame:
    """Counters of size and shape for each document."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    return docs.select(
        "doc_id", F.ceil(F.length("text") / 4).alias("tokens"), count("[A-Za-z0-9_]+").alias("words"), count("[0-9]+").alias("numbers"), count("\n").alias("line_breaks"),
        count("[A-Z]").alias("upper"), count("[.!?]").alias("stops"), count("[|]").alias("bars"), (F.length("text") > 15000).alias("is_long"), (F.length("text") < 2500).alias("is_sparse"),
    )


# Words and doses from which a document is complex, by profile; words that suffice with sections of labs and of procedures.
PROFILES = {"high_sensitivity": (1800, 18), "balanced": (1800, 18), "conservative": (2200, 24)}
COMBINED_WORDS = 1200
LAB_SECTION, PROCEDURE_SECTION = r"(?i)LABORATOR|PERTINENT RESULTS", r"(?i)PROCEDURE|OPERATIONS?"


def complexity(docs: DataFrame, profile: str = "high_sensitivity") -> DataFrame:
    """Six features of each document and its route: two stages for long or dose-rich ones, with the reasons.

    The profile high_sensitivity also takes documents of COMBINED_WORDS words that have sections of labs and of procedures.
    """
    words, doses = PROFILES[profile]
    count = lambda p: F.regexp_count("text", F.lit(p))
    rows = docs.select(
        "doc_id", count("[A-Za-z0-9_]+").alias("note_words"), count(f"(?i){T.DOSE}").alias("dose_mentions"), F.col("text").rlike(LAB_SECTION).alias("has_lab_section"),
        F.col("text").rlike(PROCEDURE_SECTION).alias("has_procedure_section"), count(r"\[\*\*").alias("deidentification_markers"), count(r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])").alias("numeric_tokens"),
    )
    rules = [(F.col("note_words") >= words, f"note_words>={words}"), (F.col("dose_mentions") >= doses, f"dose_mentions>={doses}")]
    if profile == "high_sensitivity":
        rules.append(((F.col("note_words") >= COMBINED_WORDS) & F.col("has_lab_section") & F.col("has_procedure_section"), f"note_words>={COMBINED_WORDS}+lab_section+procedure_section"))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in rules))), ";")
    return rows.withColumn("reasons", reasons).withColumn("route", F.when(F.col("reasons") != "", "two_stage_complex").otherwise("single_stage_standard"))


# Patterns by which a line announces a domain, whatever their case.
SIGNALS = {
    "medication_changes": r"\bdischarge medications?\b|\bmedications? on discharge\b|\bmedications?\s*:",
    "diagnosis_changes": r"\bdischarge diagnoses?\b|\bfinal diagnoses?\b|\bprincipal diagnoses?\b",
    "procedures_and_tests": r"\bmajor surgical or invasive procedure\b|\bprocedures?\b|\boperations?\b|\b(?:ct|mri|x-?ray|echocardiogram|ultrasound)\b",
    "labs": r"\bpertinent results?\b|\blaborator(?:y|ies)\b|\b(?:wbc|hemoglobin|hgb|creatinine|sodium|potassium)\b",
    "follow_up_actions": r"\bfollow\s*-?\s*up\b|\bdischarge instructions?\b|\bappointments?\b",
}


def ascii_bounds(pattern: str) -> str:
    """The pattern with every \\b as a boundary of ASCII words, whatever its case."""
    return "(?i)" + pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def has_word(x: Column, pattern: str) -> Column:
    """Whether x has the pattern between boundaries of ASCII words, whatever its case."""
    return x.rlike(T.bounded(pattern))


def signals(docs: DataFrame, domains: dict[str, str] = SIGNALS) -> DataFrame:
    """(doc_id, domain, matches, first_line) for each domain that a document's lines announce."""
    rows = line_index(docs)
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(ascii_bounds(p)), F.lit(d)) for d, p in domains.items())))
    return rows.select("doc_id", "ordinal", F.explode(found).alias("domain")).groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("matches"), F.min("ordinal").alias("first_line"))


def uncovered_signals(found: DataFrame, items: DataFrame) -> DataFrame:
    """Announced domains of a document for which items(doc_id, domain) has no row."""
    return found.join(items.select("doc_id", "domain"), ["doc_id", "domain"], "left_anti")


def sections(docs: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """line_index with the section each line stands in: the last line at or above it that the lexicon names, first match first, else unknown."""
    from pyspark.sql import Window

    named = F.coalesce(*(F.when(has_word(F.col("text"), p), F.lit(name)) for name, p in lexicon.items()))
    above = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line_index(docs).withColumn("section", F.coalesce(F.last(named, ignorenulls=True).over(above), F.lit("unknown")))


def pointed(pointers: DataFrame, docs: DataFrame, most: int = 12) -> DataFrame:
    """pointers(doc_id, first, last) with `status` and the `quote` of those lines (ordinals from 1, both inside).

    A reversed pointer is turned round. An ordinal that the document doesn't have is unknown_line, more than `most` lines are
    too_long, a document that isn't there is unknown_document; these have no quote. Lines are sliced from the row's own array, so the
    only shuffle is the join on doc_id.
    """
    rows = pointers.join(docs.select("doc_id", lines(F.coalesce("text", F.lit(""))).alias("__lines")), "doc_id", "left")
    low, high, n = F.least("first", "last"), F.greatest("first", "last"), F.size("__lines")
    status = (
        F.when(F.col("__lines").isNull(), "unknown_document").when(F.col("first").isNull() | F.col("last").isNull() | (low < 1) | (high > n), "unknown_line")
        .when(high - low + 1 > most, "too_long").when(F.col("first") > F.col("last"), "reversed").otherwise("as_given")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("quote", F.when(F.col("status").isin("reversed", "as_given"), F.array_join(F.slice("__lines", low.cast("int"), (high - low + 1).cast("int")), "\n"))).drop("__lines")


# What items that point at spans may say.
ASSERTIONS = ["present", "absent", "uncertain", "conditional", "historical"]
SUPPORT = ["supported", "insufficient_evidence", "not_found"]


def span_errors(ids: Column, known: Column, support: Column, assertion: Column, most: int = 3) -> Column:
    """Error codes of an item that points at spans: an array, empty for a valid item. A null `ids` isn't an array of spans."""
    unknown = F.transform(F.filter(ids, lambda s: ~F.array_contains(known, s)), lambda s: F.concat(F.lit("unknown_span_id:"), s))
    codes = [
        F.when(~F.coalesce(support.isin(SUPPORT), F.lit(False)), "invalid_support_status"),
        F.when(~F.coalesce(assertion.isin(ASSERTIONS), F.lit(False)), "invalid_assertion"),
        F.when(ids.isNull(), "span_ids_not_array"),
        F.when((F.size(ids) == 0) & (support == "supported"), "empty_supported_span_ids"),
        F.when(F.size(ids) > most, "too_many_span_ids"),
    ]
    return F.concat(F.array_compact(F.array(*codes)), F.coalesce(unknown, F.array().cast("array<string>")))


def span_policy(errors: Column, retries: Column, most: int = 2) -> Column:
    """What follows from an item's errors: accept, retry, or exhausted (the item then points at nothing and is not found)."""
    return F.when(F.size(errors) == 0, "accept").when(retries < most, "retry").otherwise("exhausted")
