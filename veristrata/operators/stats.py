"""Rates, confusion, ranking quality, agreement and association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T


def running(rows: DataFrame, score: str, group: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """rows(score, group..., ...) with `__below` of each other column: its sum over the group's rows with a smaller or equal score.

    rows has one row for each score and group; a row with a null score has no place in the order and is left out. Scores may be any
    numbers: they are dealt to buckets between approximate quantiles. Sums run inside a bucket and are lifted by the totals of lower
    buckets, so no task sees all scores of a group.
    """
    group = group or []
    names = [c for c in rows.columns if c not in (score, *group)]
    rows = rows.filter(F.col(score).isNotNull())
    cuts = rows.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("c")).first()["c"] or []
    at = F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<double>")
    rows = rows.withColumn("__b", F.size(F.filter(at, lambda c: c < F.col(score))))
    total = rows.groupBy(*group, "__b").agg(*(F.sum(c).alias(c) for c in names))
    lower = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*group, "__b", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"__{c}") for c in names))
    inside = Window.partitionBy(*group, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*rows.columns, *(F.sum(c).over(inside).alias(f"{c}__in") for c in names)).join(total, [*group, "__b"])
    return rows.select(score, *group, *names, *((F.col(f"{c}__in") + F.col(f"__{c}")).alias(f"{c}__below") for c in names))


def confusion(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    return rows.groupBy(gold.alias("gold"), predicted.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class from confusion counts (zero denominators give 0)."""
    golds = counts.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("gold_n"))
    guesses = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("pred_n"))
    hits = counts.filter("gold = predicted").groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("tp"))
    rows = golds.join(guesses, "label", "full").join(hits, "label", "left").na.fill(0)
    p, r = F.coalesce(T.ratio(F.col("tp"), F.col("pred_n")), F.lit(0.0)), F.coalesce(T.ratio(F.col("tp"), F.col("gold_n")), F.lit(0.0))
    return rows.select("label", "tp", "gold_n", "pred_n", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the curve with ties counted half, from counts by distinct score."""
    by = rows.groupBy(score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = running(by, score)
    pairs = F.sum(F.col("pos") * (F.col("neg__below") - F.col("neg") + F.col("neg") / 2))
    return below.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), pairs.alias("w")).select("positives", "negatives", F.round(T.ratio(F.col("w"), F.col("positives") * F.col("negatives")), 6).alias("auc"))


def association(rows: DataFrame, features: dict[str, Column], outcome: Column) -> DataFrame:
    """2 x 2 counts, phi, risk difference and odds ratio (halves added) of each boolean feature, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.cast("int").alias("x")) for k, v in features.items())))
    t = rows.select(outcome.cast("int").alias("y"), pairs.alias("f")).groupBy("f.feature").agg(*(F.count_if((F.col("f.x") == x) & (F.col("y") == y)).cast("double").alias(f"n{x}{y}") for x in (1, 0) for y in (1, 0)))
    a, b, c, d = (F.col(n) for n in ("n11", "n10", "n01", "n00"))
    phi = T.ratio(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d)))
    risk = T.ratio(a, a + b) - T.ratio(c, c + d)
    return t.select("feature", *(F.col(n).cast("long").alias(n) for n in ("n11", "n10", "n01", "n00")), F.round(phi, 6).alias("phi"), F.round(risk, 6).alias("risk_difference"), F.round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)), 6).alias("odds_ratio"))


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Raw, positive and negative agreement of two raters, and Gwet's AC1."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("first"), F.count_if(~a & b).alias("second"), F.count_if(~a & ~b).alias("neither"))
    n, both, one, two, no = (F.col(c) for c in ("n", "n_both", "first", "second", "neither"))
    raw = T.ratio(both + no, n)
    p = (T.ratio(both + one, n) + T.ratio(both + two, n)) / 2
    chance = 2 * p * (1 - p)
    return t.select("n", "n_both", "first", "second", "neither", F.round(raw, 6).alias("raw"), F.round(T.ratio(2 * both, 2 * both + one + two), 6).alias("positive"), F.round(T.ratio(2 * no, 2 * no + one + two), 6).alias("negative"), F.round(T.ratio(raw - chance, 1 - chance), 6).alias("ac1"))


def paired(rows: DataFrame, case: str, arm: str, value: str, first: str, second: str) -> DataFrame:
    """Mean difference second - first over cases that have both arms, with a normal interval."""
    wide = rows.filter(F.col(arm).isin(first, second)).groupBy(case).agg(F.avg(F.when(F.col(arm) == first, F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == second, F.col(value))).alias("b")).dropna(subset=["a", "b"])
    t = wide.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("b") - F.col("a")).alias("m"), F.stddev_samp(F.col("b") - F.col("a")).alias("s"))
    half = 1.96 * F.col("s") / F.sqrt("cases")
    return t.select("cases", F.round("m", 4).alias("mean_delta"), F.round(F.col("m") - half, 4).alias("low"), F.round(F.col("m") + half, 4).alias("high"))


def diagnostic(rows: DataFrame, truth: Column, flag: Column, least_unsafe: int = 20, least_sensitivity: float = 0.9) -> DataFrame:
    """A judge's flags against the truth: the four counts, sensitivity, specificity, predictive values and whether they pass the gate."""
    t = rows.agg(F.count_if(truth & flag).alias("tp"), F.count_if(~truth & flag).alias("fp"), F.count_if(truth & ~flag).alias("fn"), F.count_if(~truth & ~flag).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    six = lambda a, b: F.round(T.ratio(a, b), 6)
    gate = (tp + fn >= least_unsafe) & F.coalesce(T.ratio(tp, tp + fn) >= least_sensitivity, F.lit(False))
    return t.select("tp", "fp", "fn", "tn", six(tp, tp + fn).alias("sensitivity"), six(tn, tn + fp).alias("specificity"), six(tp, tp + fp).alias("ppv"), six(tn, tn + fn).alias("npv"), gate.alias("released"))


def mcnemar(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Pairs on which two raters differ, the risk difference with its interval, and the exact two-sided p of a fair coin.

    The tail is summed over a sequence as long as the smaller discordant count, on one row.
    """
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    n, x, y = F.col("n"), F.col("only_first"), F.col("only_second")
    m, k = x + y, F.least(x, y)
    # log C(m, i) grows by log((m - i + 1) / i); (sum of terms, log of the last one)
    start = F.struct(F.exp(-m * F.log(F.lit(2.0))).alias("s"), (-m * F.log(F.lit(2.0))).alias("l"))
    step = lambda acc, i: F.struct((acc["s"] + F.exp(acc["l"] + F.log((m - i + 1) / i))).alias("s"), (acc["l"] + F.log((m - i + 1) / i)).alias("l"))
    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step)["s"]
    d = T.ratio(x - y, n)
    half = 1.96 * F.sqrt(m - (x - y) * (x - y) / n) / n
    return t.select("n", "only_first", "only_second", F.round(d, 6).alias("difference"), F.round(d - half, 6).alias("low"), F.round(d + half, 6).alias("high"), F.round(F.least(F.lit(1.0), 2 * tail), 6).alias("p"))


def together(rows: DataFrame, features: dict[str, Column], failures: dict[str, Column]) -> DataFrame:
    """How often each feature and failure occur in the same row; pairs that never do have no row."""
    named = lambda cs: F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in cs.items()))))
    own = rows.select(*(c.alias(f"f{i}") for i, c in enumerate(features.values())), *(c.alias(f"g{i}") for i, c in enumerate(failures.values())))
    own = own.withColumn("feature", named({k: F.col(f"f{i}") for i, k in enumerate(features)}))
    return own.withColumn("failure", named({k: F.col(f"g{i}") for i, k in enumerate(failures)})).groupBy("feature", "failure").agg(F.count(F.lit(1)).alias("n"))


def capped_risk(counts: dict[str, tuple[Column, float, float]]) -> Column:
    """Sum over signals of weight * count, no more than each one's cap; counts maps a name to (count, weight, cap)."""
    return sum((F.least(F.lit(float(cap)), F.coalesce(n, F.lit(0)) * float(w)) for n, w, cap in counts.values()), F.lit(0.0))


def selective(rows: DataFrame, accepted: Column, bad: Column) -> DataFrame:
    """Yield, risk among accepted, false acceptance, sensitivity of holding back, and safe acceptance."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & bad).alias("unsafe"), F.count_if(bad).alias("bad"))
    six = lambda a, b: F.round(T.ratio(a, b), 6)
    n, k, u, b = (F.col(c) for c in ("n", "accepted", "unsafe", "bad"))
    return t.select("n", "accepted", "unsafe", "bad", six(k, n).alias("yield"), six(u, k).alias("selective_risk"), six(u, b).alias("false_acceptance"), six(b - u, b).alias("sensitivity"), six(k - u, n - b).alias("safe_acceptance"))
