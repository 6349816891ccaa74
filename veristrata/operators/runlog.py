"""Run logs: completion, latency, pairing, cost, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T
from veristrata.operators.conformal import ranked


def summary(runs: DataFrame, model: str, value: str, failed: Column) -> DataFrame:
    """Runs, failures, completion with its Wilson interval and mean latency of each model."""
    t = runs.groupBy(model).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failed"), F.avg(value).alias("m"))
    low, high = T.wilson(F.col("n") - F.col("failed"), F.col("n"))
    return t.select(model, "n", "failed", F.round((F.col("n") - F.col("failed")) / F.col("n"), 6).alias("completion"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), F.round("m", 4).alias("mean_value"))


def percentiles(runs: DataFrame, model: str, value: str) -> DataFrame:
    """Nearest-rank P50 and P90 of each model's values, null ones left out."""
    own = runs.filter(F.col(value).isNotNull())
    at = lambda q, name: ranked(own, value, [model], lambda n: F.ceil(n * q)).select(model, F.col("q").alias(name))
    return at(0.5, "p50").join(at(0.9, "p90"), model)


def matched_volume(runs: DataFrame, case: str, arm: str, order: str, first: str, second: str) -> DataFrame:
    """Rows of each case's two arms cut to the smaller arm's count, in order."""
    own = runs.filter(F.col(arm).isin(first, second))
    sizes = own.groupBy(case).agg(F.count_if(F.col(arm) == first).alias("a"), F.count_if(F.col(arm) == second).alias("b")).select(case, F.least("a", "b").alias("k")).filter("k > 0")
    turn = F.row_number().over(Window.partitionBy(case, arm).orderBy(order))
    return own.withColumn("turn", turn).join(sizes, case).filter("turn <= k").drop("k")


def prefixes(runs: DataFrame, case: str, order: str, passed: Column, sizes: list[int]) -> DataFrame:
    """For each prefix length: cases with so many items, and those whose first items all pass."""
    turn = F.row_number().over(Window.partitionBy(case).orderBy(order))
    own = runs.select(case, passed.alias("ok"), turn.alias("turn")).filter(F.col("turn") <= max(sizes))
    own = own.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).filter("turn <= size")
    cases = own.groupBy(case, "size").agg(F.count(F.lit(1)).alias("n"), F.every("ok").alias("gate")).filter("n = size")
    return cases.groupBy("size").agg(F.count(F.lit(1)).alias("cases"), F.count_if("gate").alias("passed"))


def missing(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without a row (for completeness, and to resume where a run stopped)."""
    return expected.select(keys).distinct().join(done.select(keys), keys, "left_anti")


def cost(usage: DataFrame, prices: DataFrame, key: str, units: Column, price: str) -> DataFrame:
    """Priced and unpriced usage."""
    return usage.join(prices.select(key, price), key, "left").select("*", (units * F.col(price) / 1e6).alias("cost"))


def spread(rows: DataFrame, arm: str, count: Column, last: int = 4) -> DataFrame:
    """Rows of each arm by their count, `last` and more together, with their share of the arm."""
    by = rows.groupBy(arm, F.when(count >= last, f"{last}+").otherwise(count.cast("string")).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(arm)), 6))


def recovery_by_attempt(runs: DataFrame, case: str, order: str, passed: Column, most: int) -> DataFrame:
    """(attempt, recovered, so_far): cases whose first passing attempt is the first, second, ... of `most`."""
    turn = F.row_number().over(Window.partitionBy(case).orderBy(order))
    first = runs.select(case, passed.alias("ok"), turn.alias("attempt")).filter(F.col("attempt") <= most).groupBy(case).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("attempt")).dropna(subset=["attempt"])
    by = first.groupBy("attempt").agg(F.count(F.lit(1)).alias("recovered"))  # `most` rows at most
    return by.withColumn("so_far", F.sum("recovered").over(Window.orderBy("attempt")))


def classify(message: Column, classes: dict[str, str]) -> Column:
    """The first class one of whose substrings (separated by |) stands in the lower-cased message; other, or none for no message."""
    out = F.when(message.isNull() | (message == ""), "none")
    for name, parts in classes.items():
        hit = F.lit(False)
        for part in parts.split("|"):
            hit = hit | F.lower(message).contains(part)
        out = out.when(hit, name)
    return out.otherwise("other")


def allocate(rows: DataFrame, issues: dict[str, Column], routes: list[tuple[str, list[str]]], otherwise: str) -> DataFrame:
    """All columns with `issues`, the names whose rule holds, and `route`, the first one that any of its issues calls for."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in issues.items())))
    route = F.lit(otherwise)
    for name, names in reversed(routes):
        route = F.when(F.arrays_overlap("issues", F.array(*(F.lit(n) for n in names))), name).otherwise(route)
    return rows.withColumn("issues", found).withColumn("route", route)
