"""ROUGE, source support and simple extractive notes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veristrata.functions import text as T


def rouge_n(rows: DataFrame, key: str, reference: str, candidate: str, n: int) -> DataFrame:
    """Clipped n-gram overlap of each row's two texts: overlap, sizes, precision, recall and F1."""
    grams = lambda c, name: rows.select(key, F.explode(T.ngrams(T.word_tokens(F.col(c)), n)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias(name))
    both = grams(reference, "r").join(grams(candidate, "c"), [key, "g"], "full").na.fill(0, ["r", "c"])
    t = rows.select(key).join(both.groupBy(key).agg(F.sum(F.least("r", "c")).alias("overlap"), F.sum("r").alias("n_reference"), F.sum("c").alias("n_candidate")), key, "left").na.fill(0)
    p, r = F.coalesce(T.ratio(F.col("overlap"), F.col("n_candidate")), F.lit(0.0)), F.coalesce(T.ratio(F.col("overlap"), F.col("n_reference")), F.lit(0.0))
    return t.select(key, "overlap", "n_reference", "n_candidate", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over one long integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(rows: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """ROUGE-L of each row's two texts; the subsequence is found in Arrow batches, tokens come from the JVM."""

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = np.array([lcs(list(a), list(b)) for a, b in zip(p["a"], p["b"], strict=True)], float)
            na, nb = p["a"].map(len).to_numpy(float), p["b"].map(len).to_numpy(float)
            yield pd.DataFrame({key: p[key], "lcs": n.astype("int64"), "f1": np.round(np.where(n > 0, 2 * n / np.maximum(na + nb, 1), 0), 6)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.coalesce(T.word_tokens(F.col(reference)), F.array().cast("array<string>")).alias("a"), F.coalesce(T.word_tokens(F.col(candidate)), F.array().cast("array<string>")).alias("b")).mapInPandas(scored, f"{key} {kind}, lcs long, f1 double")


def source_support(rows: DataFrame, key: str, source: str, note: str) -> DataFrame:
    """Share of the note's token and bigram occurrences that the source has."""
    t = rows.select(key, T.word_tokens(F.col(source)).alias("s"), T.word_tokens(F.col(note)).alias("t")).select(key, "t", F.array_distinct("s").alias("s"), T.ngrams(F.col("t"), 2).alias("t2"), F.array_distinct(T.ngrams(F.col("s"), 2)).alias("s2"))
    share = lambda a, b: F.round(F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(0.0), 6)
    return t.select(key, F.size("t").alias("tokens"), share("t", "s").alias("token_support"), share("t2", "s2").alias("bigram_support"))


def lead_tail(rows: DataFrame, key: str, source: str, reference: str) -> DataFrame:
    """The source's first and last words, as many as the reference has."""
    t = rows.select(key, T.word_tokens(F.col(source)).alias("s"), F.size(T.word_tokens(F.col(reference))).alias("n"))
    k = F.least(F.col("n"), F.size("s"))
    return t.select(key, F.array_join(F.slice("s", F.lit(1), k), " ").alias("lead"), F.array_join(F.slice("s", F.size("s") - k + 1, k), " ").alias("tail"))
