"""Predicted against gold items: scores, one-to-one assignment, agreement of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veristrata.functions import text as T


def candidates(predicted: DataFrame, gold: DataFrame, least: float = 0.72) -> DataFrame:
    """(record_id, prediction, gold, score) of pairs of a record and domain whose relaxed score is at least `least`.

    Both sides have record_id, domain, item_id, label, source_quote and assertion. The score is the best of the labels' Dice, the
    quotes' Dice where that is 0.95 or more, and 0.7 : 0.3 of both, less 0.12 where both name different assertions.
    """
    side = lambda df, p: df.select("record_id", "domain", F.col("item_id").alias(p), T.word_tokens(F.coalesce("label", F.lit(""))).alias(f"{p}_l"), T.word_tokens(F.coalesce("source_quote", F.lit(""))).alias(f"{p}_q"), F.coalesce("assertion", F.lit("unknown")).alias(f"{p}_a"))
    both = side(predicted, "prediction").join(side(gold, "gold"), ["record_id", "domain"])
    labels, quotes = T.dice(F.col("prediction_l"), F.col("gold_l")), T.dice(F.col("prediction_q"), F.col("gold_q"))
    off = (F.col("prediction_a") != F.col("gold_a")) & (F.col("prediction_a") != "unknown") & (F.col("gold_a") != "unknown")
    score = F.greatest(labels, F.when(quotes >= 0.95, quotes).otherwise(0.0), 0.7 * labels + 0.3 * quotes) - F.when(off, 0.12).otherwise(0.0)
    return both.withColumn("score", score).filter(F.col("score") >= least).select("record_id", "prediction", "gold", "score")


def assign(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs of most number, then highest total score, of any size, by shortest augmenting paths (n * n * m steps).

    A pair counts 1 + its score / (2 * pairs): no number of scores outweighs one pair more. Missing pairs cost nothing and are left out.
    """
    left, right = sorted({a for a, _, _ in edges}), sorted({b for _, b, _ in edges})
    if not edges:
        return []
    if len(left) > len(right):
        return sorted((a, b, s) for b, a, s in assign([(b, a, s) for a, b, s in edges]))
    row, column = {a: i for i, a in enumerate(left)}, {b: j for j, b in enumerate(right)}
    value = np.zeros((len(left), len(right)))
    share = 2 * len(left) * max(1.0, max(abs(e[2]) for e in edges))
    known = {}
    for a, b, s in edges:
        if s >= known.get((a, b), s):
            known[a, b] = s
            value[row[a], column[b]] = 1 + s / share
    n, m = value.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)  # column m stands for the row being placed
    for i in range(n):
        owner[m] = i
        least, way, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        j = m
        while owner[j] != -1:
            done[j] = True
            open_ = ~done[:m]
            cost = -value[owner[j]] - u[owner[j]] - v[:m]
            better = open_ & (cost < least)
            least[better], way[better] = cost[better], j
            nxt = int(np.where(open_, least, np.inf).argmin())
            step = least[nxt]
            u[owner[np.flatnonzero(done)]] += step
            v[done] -= step
            least[open_] -= step
            j = nxt
        while j != m:
            owner[j] = owner[way[j]]
            j = int(way[j])
    return sorted((left[owner[j]], right[j], known[left[owner[j]], right[j]]) for j in range(m) if owner[j] >= 0 and value[owner[j], j] > 0)


def assign_greedily(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs by descending score, ties to the smaller prediction, then gold."""
    out, used, taken = [], set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used and b not in taken:
            out.append((a, b, s))
            used.add(a)
            taken.add(b)
    return sorted(out)


def matches(pairs: DataFrame, greedy: bool = False) -> DataFrame:
    """The assigned ones among candidates(); a record's pairs are handled in one task, its size being one document's items. `greedy`: by descending score alone."""
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        p, g = sorted(part["prediction"].unique()), sorted(part["gold"].unique())
        at_p, at_g = {x: i for i, x in enumerate(p)}, {x: i for i, x in enumerate(g)}
        got = (assign_greedily if greedy else assign)([(at_p[a], at_g[b], s) for a, b, s in zip(part["prediction"], part["gold"], part["score"], strict=True)])
        return pd.DataFrame({"record_id": part["record_id"].iloc[0], "prediction": [p[a] for a, _, _ in got], "gold": [g[b] for _, b, _ in got], "score": [s for _, _, s in got]})

    return pairs.groupBy("record_id").applyInPandas(one, ", ".join(f"{n} {kind[n]}" for n in ("record_id", "prediction", "gold", "score")))


def matched_scores(predicted: DataFrame, gold: DataFrame, matched: DataFrame) -> DataFrame:
    """Per record: true and false positives, false negatives, precision, recall, F1 (0 where undefined)."""
    n = lambda df, name: df.groupBy("record_id").agg(F.count(F.lit(1)).alias(name))
    t = n(predicted, "p").join(n(gold, "g"), "record_id", "full").join(n(matched, "tp"), "record_id", "left").na.fill(0)
    zero = lambda a, b: F.round(F.coalesce(T.ratio(a, b), F.lit(0.0)), 6)
    return t.select("record_id", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), zero(F.col("tp"), F.col("p")).alias("precision"), zero(F.col("tp"), F.col("g")).alias("recall"), zero(2 * F.col("tp"), F.col("p") + F.col("g")).alias("f1"))


def run_agreement(rows: DataFrame, case: str, run: str, item: str, runs: list) -> DataFrame:
    """(first_run, second_run, cases, mean_jaccard, least_jaccard) of the items that each two runs give to a case.

    A case's item is one row with a flag for each run, so no run is joined with another; a case that neither run has doesn't count.
    """
    flags = rows.groupBy(case, item).agg(*(F.max((F.col(run) == r).cast("int")).alias(f"r{i}") for i, r in enumerate(runs)))
    two = [(i, j) for i in range(len(runs)) for j in range(i + 1, len(runs))]
    by = flags.groupBy(case).agg(*(F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"b{i}_{j}") for i, j in two), *(F.sum(F.greatest(f"r{i}", f"r{j}")).alias(f"u{i}_{j}") for i, j in two))
    long = by.select(F.explode(F.array(*(F.struct(F.lit(runs[i]).alias("first_run"), F.lit(runs[j]).alias("second_run"), T.ratio(F.col(f"b{i}_{j}"), F.col(f"u{i}_{j}")).alias("x")) for i, j in two))).alias("p")).select("p.*").dropna(subset=["x"])
    return long.groupBy("first_run", "second_run").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("x"), 6).alias("mean_jaccard"), F.round(F.min("x"), 6).alias("least_jaccard"))


def consensus(rows: DataFrame, case: str, run: str, item: str) -> DataFrame:
    """How many items of cases so many runs agree on."""
    return rows.groupBy(case, item).agg(F.count_distinct(run).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("items"))
