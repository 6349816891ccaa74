"""Thresholds with distribution-free guarantees, as counts over sorted scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T
from veristrata.operators.stats import running

BEYOND = 1 + 1e-9


def crc_threshold(rows: DataFrame, score: str, supported: Column, alphas: list[float]) -> DataFrame:
    """(alpha, lambda): the smallest threshold among 0, the scores and just above 1 with (n * risk + 1) / (n + 1) <= alpha.

    A row is a loss if it is accepted (score >= threshold) and not supported; losses at a threshold are the unsupported rows at or
    above it, so one pass of running counts over distinct scores serves all alphas.
    """
    spark = rows.sparkSession
    by = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(~supported).cast("long").alias("bad"), F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    at = running(by, "score").join(F.broadcast(total)).select("score", (F.col("all_bad") - F.col("bad__below") + F.col("bad")).alias("loss"), F.col("all_n").alias("n"))
    at = at.unionByName(total.select(F.lit(0.0).alias("score"), F.col("all_bad").alias("loss"), F.col("all_n").alias("n")))
    levels = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    best = at.join(F.broadcast(levels)).filter((F.col("loss") + 1.0) / (F.col("n") + 1) <= F.col("alpha")).groupBy("alpha").agg(F.min("score").alias("found"))
    return levels.join(best, "alpha", "left").select("alpha", F.coalesce("found", F.lit(BEYOND)).alias("threshold"))


def crc_evaluate(rows: DataFrame, score: str, supported: Column, thresholds: DataFrame) -> DataFrame:
    """Risk, coverage, recall of supported rows and false discoveries at each alpha's threshold."""
    accepted = F.col(score) >= F.col("threshold")
    t = rows.withColumn("__s", supported).join(F.broadcast(thresholds)).groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & ~F.col("__s")).alias("wrong"), F.count_if("__s").alias("good"))
    return t.select("alpha", "n", "accepted", F.round(F.col("wrong") / F.col("n"), 6).alias("risk"), F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), F.round(T.ratio(F.col("accepted") - F.col("wrong"), F.col("good")), 6).alias("recall"), F.round(T.ratio(F.col("wrong"), F.col("accepted")), 6).alias("fdr"))


def p_values(rows: DataFrame, key: str, score: str, is_null: Column) -> DataFrame:
    """(key, score, p) of each test row: (1 + null scores at or above its own) / (nulls + 1)."""
    by = rows.groupBy(F.col(score).alias("__score")).agg(F.count_if(is_null).cast("long").alias("m"))
    total = by.agg(F.sum("m").alias("all_m"))
    at = running(by, "__score").join(F.broadcast(total)).select("__score", ((1.0 + F.col("all_m") - F.col("m__below") + F.col("m")) / (F.col("all_m") + 1)).alias("p"))
    return rows.filter(~is_null).join(at, F.col(score) == F.col("__score")).select(key, score, "p")


def benjamini_hochberg(tests: DataFrame, key: str, q: float) -> DataFrame:
    """(key, p, selected): p-values at or below the largest p_k with p_k <= q * k / m. Counts by distinct p, so ties share a rank."""
    by = tests.groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    m = by.agg(F.sum("k").alias("m"))
    cut = running(by, "p").join(F.broadcast(m)).filter(F.col("p") <= q * F.col("k__below") / F.col("m")).agg(F.max("p").alias("cut"))
    return tests.join(F.broadcast(cut)).select(key, "p", F.coalesce(F.col("p") <= F.col("cut"), F.lit(False)).alias("selected"))


def ranked(rows: DataFrame, score: str, group: list[str], rank) -> DataFrame:
    """(group..., n, q): of each group's n scores the smallest one with at least rank(n) scores at or below it; null where there are fewer.

    Found from counts by distinct score, so a group's rows are never gathered.
    """
    by = rows.groupBy(F.col(score).alias("__score"), *group).agg(F.count(F.lit(1)).alias("__k"))
    n = by.groupBy(*group).agg(F.sum("__k").alias("n"))
    at = running(by, "__score", group).join(n, group)
    return n.join(at.filter(F.col("__k__below") >= rank(F.col("n"))).groupBy(*group).agg(F.min("__score").alias("q")), group, "left")


def quantiles(rows: DataFrame, score: str, alpha: float, group: list[str]) -> DataFrame:
    """Conformal quantile of each group: the ceil((n + 1)(1 - alpha))-th smallest score, infinite beyond n. Null scores count as the largest."""
    return ranked(rows, score, group, lambda n: F.ceil((n + 1) * (1 - alpha) - 1e-9)).select(*group, "n", F.coalesce("q", F.lit(math.inf)).alias("q"))


def risk_threshold(rows: DataFrame, risk: str, unsafe: Column, alpha: float) -> DataFrame:
    """The largest risk score up to which accepted rows' unsafe share stays within alpha (a later feasible one wins over gaps)."""
    by = rows.groupBy(F.col(risk).alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.count_if(unsafe).cast("long").alias("bad"))
    ok = running(by, "risk").filter(F.col("bad__below") <= alpha * F.col("n__below"))
    return ok.agg(F.max("risk").alias("threshold"), F.max("n__below").alias("accepted"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """Chance of at most k hits in n, by the continued fraction of the incomplete beta function; its cost doesn't grow with k or n."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    out = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * f / a
    return min(1.0, max(0.0, 1 - out if flip else out))


def clopper_pearson(errors: int, n: int, delta: float) -> float:
    """The upper bound of a rate that so many errors exceed with chance delta at most; 1 without trials or successes."""
    if n <= 0 or errors >= n:
        return 1.0
    low, high = errors / n, 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_cdf(errors, n, middle) > delta else (low, middle)
    return high


def bounded_threshold(rows: DataFrame, risk: str, unsafe: Column, target: float, delta: float = 0.05) -> DataFrame:
    """(threshold, accepted, bound): the largest risk score up to which the Clopper-Pearson bound of the unsafe share stays within the target.

    delta is shared out over the distinct scores (Bonferroni). Bounds are found in Arrow batches from running counts; nothing is gathered.
    """
    by = rows.groupBy(F.col(risk).alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.count_if(unsafe).cast("long").alias("bad"))
    at = running(by, "risk").join(F.broadcast(by.filter("risk is not null").agg(F.count(F.lit(1)).alias("tests"))))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = [clopper_pearson(k, n, delta / max(1, m)) for k, n, m in zip(part["k"].to_pylist(), part["n"].to_pylist(), part["tests"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["risk"], part["n"], pa.array(got, pa.float64())], ["risk", "n", "bound"])

    found = at.select(F.col("risk").cast("double").alias("risk"), F.col("n__below").cast("long").alias("n"), F.col("bad__below").cast("long").alias("k"), F.col("tests").cast("long").alias("tests")).mapInArrow(bound, "risk double, n long, bound double")
    return found.filter(F.col("bound") <= target).agg(F.max(F.struct("risk", "n", "bound")).alias("t")).select(F.col("t.risk").alias("threshold"), F.col("t.n").alias("accepted"), F.round("t.bound", 6).alias("bound"))


def fdr_report(rows: DataFrame, selected: Column, good: Column) -> DataFrame:
    """Tests, selected ones, false discoveries among them, power over the good ones and coverage."""
    t = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("selected"), F.count_if(selected & ~good).alias("false_selected"), F.count_if(good).alias("good"))
    six = lambda a, b: F.round(T.ratio(a, b), 6)
    return t.select("n", "selected", "false_selected", "good", F.coalesce(six(F.col("false_selected"), F.col("selected")), F.lit(0.0)).alias("fdr"), six(F.col("selected") - F.col("false_selected"), F.col("good")).alias("power"), six(F.col("selected"), F.col("n")).alias("coverage"))


def prediction_sets(rows: DataFrame, key: str, scores: dict[str, Column], truth: Column, calibration: Column, alpha: float, by_label: bool = True) -> DataFrame:
    """(key, truth, labels): for each row outside the calibration the labels whose 1 - score is within the quantile, in order of their names.

    by_label takes a quantile for each label from its own calibration rows; else there is one for all. scores maps labels to their scores.
    """
    rows = rows.select(key, truth.alias("truth"), calibration.alias("__cal"), *(c.alias(f"__{i}") for i, c in enumerate(scores.values())))
    own = F.coalesce(*(F.when(F.col("truth") == name, 1 - F.col(f"__{i}")) for i, name in enumerate(scores)))
    cal = rows.filter("__cal").select(F.col("truth") if by_label else F.lit("").alias("truth"), own.alias("s"))
    q = quantiles(cal, "s", alpha, ["truth"]).select(F.col("truth").alias("label"), "q")
    test = rows.filter("not __cal")
    long = test.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("label"), (1 - F.col(f"__{i}")).alias("s")) for i, n in enumerate(scores)))).alias("x")).select(key, "x.*")
    inside = (long.join(F.broadcast(q), "label") if by_label else long.join(F.broadcast(q.drop("label")))).filter("s <= q")
    sets = inside.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return test.select(key, "truth").join(sets, key, "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def stratified(rows: DataFrame, key: str, stratum: str, seed: str, share: float) -> DataFrame:
    """(key, stratum, first): the share of each stratum (rounded up) that comes first by a seeded hash; strata are never gathered."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("long")
    own = rows.select(key, stratum, h.alias("__h"))
    cut = ranked(own, "__h", [stratum], lambda n: F.ceil(n * share)).select(stratum, F.col("q").alias("__q"))
    return own.join(cut, stratum).select(key, stratum, (F.col("__h") <= F.col("__q")).alias("first"))


def _draws(state: int, n: int) -> tuple[list[float], int]:
    """n numbers of the generator that splits are drawn by, and its state behind them. Its products round as doubles do, so it can't be run ahead."""
    out = []
    for _ in range(n):
        state = int(state * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        out.append(state / 0x7FFFFFFF)
    return out, state


def repeated_splits(items: DataFrame, case: str, scores: list[str], supported: str, alphas: list[float], splits: int = 200, share: float = 0.5, seed: int = 0x1234567, most: int = 2_000_000) -> DataFrame:
    """(score, alpha, risk, coverage, recall, over): means over splits by case of what a threshold calibrated on one part does on the other.

    Cases are shuffled by one generator, split after split; the states in which splits begin are found first, then splits run apart. `over`
    is the share of splits whose risk is above alpha. The items are sent to the tasks; more than `most` raise. Null scores count as 0.
    """
    if items.count() > most:
        raise ValueError("too many items for repeated splits")
    rows = items.select(case, F.col(supported).cast("boolean").alias("__ok"), *(F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in scores)).toArrow().sort_by([(case, "ascending")])
    names, of = np.unique(rows[case].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    ok, n = rows["__ok"].to_numpy(zero_copy_only=False).astype(bool), len(names)
    values = {s: rows[s].to_numpy() for s in scores}
    state, begin = seed, []
    for s in scores:
        for a in alphas:
            for k in range(splits):
                begin.append((s, float(a), k, state))
                state = _draws(state, max(0, n - 1))[1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for s, alpha, start in zip(part["score"].to_pylist(), part["alpha"].to_pylist(), part["state"].to_pylist(), strict=True):
                order = list(range(n))
                for i, r in zip(range(n - 1, 0, -1), _draws(start, n - 1)[0], strict=True):
                    j = min(i, int(r * (i + 1)))
                    order[i], order[j] = order[j], order[i]
                cal = np.zeros(n, bool)
                cal[order[: int(n * share)]] = True
                cal, x = cal[of], values[s]
                if not cal.any() or cal.all():
                    out.append((None, None, None))
                    continue
                own, bad = x[cal], ~ok[cal]
                cuts = np.unique(np.append(own, [0.0, BEYOND]))
                at = np.sort(own[bad])
                loss = len(at) - np.searchsorted(at, cuts, "left")
                fine = cuts[(loss + 1) / (len(own) + 1) <= alpha]
                taken = x[~cal] >= (fine[0] if len(fine) else BEYOND)
                good = ok[~cal]
                out.append((float((taken & ~good).mean()), float(taken.mean()), float(taken[good].mean()) if good.any() else None))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([part["score"], part["alpha"], *(pa.array(list(c), pa.float64()) for c in columns)], ["score", "alpha", "risk", "coverage", "recall"])

    spark = items.sparkSession
    made = spark.createDataFrame(begin, "score string, alpha double, k int, state long").mapInArrow(split, "score string, alpha double, risk double, coverage double, recall double").dropna(subset=["risk"])
    six = lambda c: F.round(F.avg(c), 6)
    return made.groupBy("score", "alpha").agg(six("risk").alias("risk"), six("coverage").alias("coverage"), six("recall").alias("recall"), six((F.col("risk") > F.col("alpha")).cast("double")).alias("over"))


def logistic(x: np.ndarray, y: np.ndarray, epochs: int = 800, rate: float = 0.08, l2: float = 0.001) -> np.ndarray:
    """Weights by full-batch descent on the log loss; the first weight isn't held back."""
    w = np.zeros(x.shape[1])
    for _ in range(epochs):
        step = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -500, 500))) - y) / max(1, len(y))
        step[1:] += l2 * w[1:]
        w -= rate * step
    return w


def logistic_scores(rows: DataFrame, key: str, features: list[str], outcome: Column, calibration: Column, most: int = 200_000) -> DataFrame:
    """(key, calibration, outcome, probability) by a logistic regression on the calibration rows, standardised by their means and spreads.

    Features go in the order of their names, with `intercept` (always 1) among them. The model is fitted on the driver, on at most `most` rows (more raise); rows
    are scored by columns alone. Null features count as 0.
    """
    names = sorted([*features, "intercept"])
    rows = rows.select(key, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features), outcome.cast("double").alias("outcome"), calibration.alias("calibration")).withColumn("intercept", F.lit(1.0))
    got = rows.filter("calibration").select(*names, "outcome").limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError("too many calibration rows for one regression")
    x, y = np.stack([got[n].to_numpy() for n in names], axis=1) if got.num_rows else np.zeros((0, len(names))), got["outcome"].to_numpy()
    mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(names)), np.ones(len(names)))
    spread = np.where(spread > 0, spread, 1.0)
    k = names.index("intercept")
    mean[k], spread[k] = 0.0, 1.0
    w = logistic((x - mean) / spread, y)
    z = sum((((F.col(n) - float(m)) / float(s)) * float(v) for n, m, s, v in zip(names, mean, spread, w, strict=True)), F.lit(0.0))
    return rows.select(key, "calibration", "outcome", (1 / (1 + F.exp(-z))).alias("probability"))


def triage(scored: DataFrame, key: str, alpha: float, guard: Column | None = None) -> DataFrame:
    """(key, accepted, outcome): rows outside the calibration whose set of labels, by one quantile, is that of no escalation alone, and that no guard holds back."""
    own = F.when(F.col("outcome") == 1, 1 - F.col("probability")).otherwise(F.col("probability"))
    q = quantiles(scored.filter("calibration").select(F.lit(1).alias("__g"), own.alias("__s")), "__s", alpha, ["__g"]).select("q")
    rows = scored.filter("not calibration").join(F.broadcast(q), how="left").withColumn("q", F.coalesce("q", F.lit(math.inf)))
    held = F.lit(False) if guard is None else F.coalesce(guard, F.lit(False))
    return rows.select(key, ((F.col("probability") <= F.col("q")) & ~(1 - F.col("probability") <= F.col("q")) & ~held).alias("accepted"), "outcome")
