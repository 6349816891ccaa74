"""Checks of extracted items: repeats, conflicts, near repeats, and what to do about them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def repeats(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Items whose keys an earlier item has, with the first one's `order` as first_at. Null keys never repeat."""
    first = items.groupBy(*keys).agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return items.join(first, keys).filter(F.col(order) > F.col("first_at"))


def conflicts(items: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Keys that occur in more than one state, with their number of states."""
    return items.groupBy(*keys).agg(F.count_distinct(state).alias("states")).filter("states > 1")


def recovery(codes: Column) -> Column:
    """What an item's blocking codes call for; nothing for none."""
    has = lambda c: F.array_contains(codes, c)
    only = lambda c: F.size(F.array_except(codes, F.array(F.lit(c)))) == 0
    return (
        F.when(codes.isNull() | (F.size(codes) == 0), "accept").when(only("empty_or_short_summary"), "summary_only_regeneration").when(only("duplicate_evidence_item"), "deterministic_duplicate_review")
        .when(has("source_quote_not_found") | has("empty_evidence_field"), "targeted_evidence_reextraction").when(has("medication_state_conflict"), "medication_reconciliation_reextraction")
        .otherwise("full_json_schema_reextraction")
    )


# Words left out when items are compared.
COMMON = {"the", "and", "with", "for", "from", "this", "that", "was", "were", "are", "sig", "daily"}


class _Item:
    """Normal forms of an item's label and quote."""

    def __init__(self, label: str | None, quote: str | None) -> None:
        plain = lambda x: " ".join(unicodedata.normalize("NFKC", x or "").lower().split())
        self.label, self.quote = plain(label), plain(quote)
        words = lambda x: {w for w in re.split("[^a-z0-9]+", x) if len(w) >= 3 and w not in COMMON}
        self.label_words, self.quote_words = words(self.label), words(self.quote)


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def why_same(a: _Item, b: _Item) -> str | None:
    """The rule by which b says what a says, or None."""
    labels, quotes = _overlap(a.label_words, b.label_words), _overlap(a.quote_words, b.quote_words)
    if a.quote and a.quote == b.quote and ((a.label and a.label == b.label) or labels >= 0.8):
        return "same_source_quote"
    short, long = sorted((a.quote, b.quote), key=len)
    inside = 0.0 if not short else len(short) / len(long) if short in long else quotes
    if inside >= 0.92 and labels >= 0.55:
        return "same_source_quote" if a.quote == b.quote else "contained_source_quote"
    if quotes >= 0.92 and labels >= 0.65:
        return "contained_source_quote" if inside >= 0.92 else "high_token_overlap"
    return None


def drop_near_repeats(items: DataFrame, group: list[str], order: str) -> DataFrame:
    """All items with kept_at (the `order` of the earlier kept item that says the same, null for kept ones) and reason.

    Items are compared inside a group (one list of one document, so its size is bounded by the document) with the kept ones before
    them. items has label and source_quote; order is distinct inside a group.
    """
    schema = items.schema
    names = [f.name for f in schema]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        kept: list[tuple[object, _Item]] = []
        at, why = [], []
        for o, label, quote in zip(part[order], part["label"], part["source_quote"], strict=True):
            item = _Item(label, quote)
            found = next(((k, w) for k, x in kept if (w := why_same(x, item))), (None, None))
            at.append(found[0])
            why.append(found[1])
            if found[1] is None:
                kept.append((o, item))
        return part[names].assign(kept_at=pd.array(at, dtype="Int64"), reason=pd.Series(why, index=part.index, dtype=object))

    return items.groupBy(*group).applyInPandas(one, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", kept_at long, reason string")
