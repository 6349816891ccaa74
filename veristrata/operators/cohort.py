"""Who and what is reviewed: assignment, blinding, priorities, pairs, neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veristrata.functions import text as T
from veristrata.operators.sample import numbered


def fnv(x: Column) -> Column:
    """FNV-1a of 32 bits over a text's characters (those of one UTF-16 unit each), as a long."""
    return F.aggregate(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def reviewers(cases: DataFrame, key: str, seed: str, names: tuple[str, str], share: float) -> DataFrame:
    """(reviewer, key): cases in order of a seeded hash; both review the first share of them (rounded up), the others go to each in turn."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    own = cases.select(key, order.alias("__h"))
    both = own.count()
    doubled = int(np.ceil(both * share))
    own = numbered(own, [F.col("__h"), F.col(key)])
    who = F.when(F.col("position") < doubled, F.array(*(F.lit(n) for n in names))).when((F.col("position") - doubled) % 2 == 0, F.array(F.lit(names[0]))).otherwise(F.array(F.lit(names[1])))
    return own.select(F.explode(who).alias("reviewer"), key)


def by_risk(claims: DataFrame, key: str, domain: Column, changed: Column, literal: Column, most: int) -> DataFrame:
    """The `most` claims to review first: changed medications, claims that don't stand as they are, safety and follow-up, other findings; ties by FNV."""
    priority = F.when((domain == "medication") & changed, 0).when(~literal, 1).when(domain.isin("safety", "follow_up"), 2).when(domain.isin("diagnosis", "procedure_or_test", "lab"), 3).otherwise(4)
    return claims.select(key, priority.alias("priority"), fnv(F.col(key).cast("string")).alias("h")).orderBy("priority", "h", key).limit(most).drop("h")


def blinded(pairs: DataFrame, key: str) -> DataFrame:
    """pairs with `swapped`: whether the two sides of a pair are shown the other way round, by the parity of a hash."""
    return pairs.withColumn("swapped", F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int") % 2 == 1)


def paired_quota(cases: DataFrame, key: str, budget: int, pairs: int) -> DataFrame:
    """(key, outputs): which cases are reviewed with how many outputs: two for `pairs` cases at even positions of those that have two, one for
    further ones in order until the budget is used. cases has key and available."""
    both = cases.filter("available >= 2").count()
    wanted = min(pairs, both, budget // 2)
    own = numbered(cases.filter("available >= 2"), [F.col(key)])
    places = cases.sparkSession.range(max(0, wanted)).select(F.least(F.lit(both - 1), F.floor(F.col("id") * both / max(1, wanted))).alias("position")).distinct()
    chosen = own.join(F.broadcast(places), "position").select(key)
    left = budget - 2 * chosen.count()
    rest = cases.select(key).join(chosen, key, "left_anti").orderBy(key).limit(max(0, left)).withColumn("outputs", F.lit(1))
    return chosen.withColumn("outputs", F.lit(2)).unionByName(rest)


def preflight(cohort: DataFrame, used: DataFrame, key: str, subject: str) -> DataFrame:
    """One row of checks of a cohort: rows, distinct keys and subjects, overlap with used subjects, and whether all hold."""
    t = cohort.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_distinct(subject).alias("subjects"))
    overlap = cohort.join(used.select(subject).distinct(), subject, "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
    return t.join(overlap).withColumn("ready", (F.col("n") == F.col("keys")) & (F.col("n") == F.col("subjects")) & (F.col("overlap") == 0))


def tiers(cases: DataFrame, key: str, seen: dict[str, DataFrame]) -> DataFrame:
    """cases with `tier`: the first of the named tables that has the key, or untouched."""
    rows, tier = cases, F.when(F.lit(False), "")
    for i, (name, table) in enumerate(seen.items()):
        rows = rows.join(table.select(key).distinct().withColumn(f"__{i}", F.lit(True)), key, "left")
        tier = tier.when(F.col(f"__{i}"), name)
    return rows.withColumn("tier", tier.otherwise("untouched")).drop(*(f"__{i}" for i in range(len(seen))))


#: Vectors of a chunk; each two chunks are compared in a task of their own.
CHUNK = 2048


def neighbours(vectors: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, rank, neighbour, similarity): the k most similar other vectors of each by cosine, ties to the smaller key.

    Exact: every two chunks of CHUNK vectors are multiplied once in a task, which keeps the k best for each of their rows; so a task
    holds two chunks, and what is shuffled is k rows for each vector and chunk. The work grows with the square of the vectors. Keys are
    whole numbers; zero, null and repeated vectors take part, a zero one being like none (0).
    """
    n = vectors.count()
    chunks = max(1, -(-n // CHUNK))
    dealt = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(chunks)).alias("c")).filter("v is not null")
    units = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("id", "v", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))

    def best(names, table):
        _, i, j = table["c"].to_numpy(), names[0].as_py(), names[1].as_py()
        side, ids = table["c"].to_numpy(), table["id"].to_numpy()
        x = np.array(table["v"].to_pylist(), np.float64)
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.where(size > 0, x / np.where(size > 0, size, 1), 0)
        out = []
        for a, b in ((i, j),) if i == j else ((i, j), (j, i)):
            rows, others = np.flatnonzero(side == a), np.flatnonzero(side == b)
            like = x[rows] @ x[others].T
            like[ids[rows][:, None] == ids[others][None, :]] = -2
            order = np.lexsort((np.broadcast_to(ids[others], like.shape), -np.round(like, 12)), axis=1)[:, :k]
            at = np.repeat(np.arange(len(rows)), order.shape[1])
            got = like[at, order.ravel()]
            keep = got > -2
            out.append((ids[rows][at][keep], ids[others][order.ravel()][keep], got[keep]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"id": a, "neighbour": b, "similarity": s})

    found = units.groupBy("i", "j").applyInArrow(best, "id long, neighbour long, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("similarity", 12).desc(), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("id").alias(key), "rank", "neighbour", "similarity")


def event_rates(near: DataFrame, events: DataFrame, key: str, event: str, least: float = 0.001) -> DataFrame:
    """(key, rate): the share of a row's neighbours that have the event, weighed by similarity and at least `least`."""
    weight = F.greatest(F.col("similarity"), F.lit(0.0)) + least
    rows = near.join(events.select(F.col(key).alias("neighbour"), F.col(event).cast("double").alias("__e")), "neighbour")
    return rows.groupBy(key).agg((F.sum(weight * F.col("__e")) / F.sum(weight)).alias("rate"))


def hamming_range(prints: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, members, least, most): the Hamming distances between the members of each cluster; prints: doc_id, fp, clusters: id, root."""
    rows = clusters.join(prints.select(F.col("doc_id").alias("id"), "fp"), "id")
    size = rows.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("fp").alias("__d"))
    values = rows.select("root", "fp").distinct()
    far = values.join(values.select("root", F.col("fp").alias("__g")), "root").filter("fp < __g").select("root", F.bit_count(F.col("fp").bitwiseXOR(F.col("__g"))).alias("d"))
    d = far.groupBy("root").agg(F.min("d").alias("__l"), F.max("d").alias("__m"))
    least = F.when(F.col("members") > F.col("__d"), 0).otherwise(F.col("__l"))
    return size.join(d, "root", "left").select(F.col("root").alias("cluster"), "members", F.coalesce(least, F.lit(0)).alias("least"), F.coalesce("__m", F.lit(0)).alias("most"))


#: Steps of the generator that bootstrap draws come from, one after the other over all repeats.
_A, _C, _M = 1664525, 1013904223, 1 << 32


def _after(state: int, steps: int) -> int:
    """The generator's state so many steps on."""
    a, c, x, y = _A, _C, 1, 0
    while steps:
        if steps & 1:
            x, y = x * a % _M, (y * a + c) % _M
        a, c, steps = a * a % _M, (c * a + c) % _M, steps >> 1
    return (x * state + y) % _M


def bootstrap_f1(cases: DataFrame, order: str, repeats: int = 1000, seed: int = 20260721) -> DataFrame:
    """(low, high): the interval of F1 over cases drawn with replacement; cases has tp, fp, fn, in the order that names them.

    Each repeat starts from the generator's state where it would be after those before it, so repeats run apart and give the draws of
    one long run. The counts of all cases (24 bytes each) are sent to the tasks; beyond 4 million cases this raises.
    """
    if cases.count() > 4_000_000:
        raise ValueError("too many cases to be drawn from in one task")
    table = cases.select(order, F.col("tp").cast("long"), F.col("fp").cast("long"), F.col("fn").cast("long")).toArrow().sort_by([(order, "ascending")])
    counts = np.stack([table[c].to_numpy() for c in ("tp", "fp", "fn")])
    n = counts.shape[1]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = _jumps(n)
        for part in batches:
            out = []
            for r in part["id"].to_pylist():
                state = np.uint64(_after(seed, r * n))
                index = ((a * state + c) & np.uint64(_M - 1)) * np.uint64(n) >> np.uint64(32)
                tp, fp, fn = counts[:, index.astype(np.int64)].sum(axis=1).tolist()
                out.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(out, pa.float64())], ["id", "f1"])

    spark = cases.sparkSession
    if not n or repeats <= 0:
        return spark.createDataFrame([(None, None)], "low double, high double")
    values = spark.range(repeats).mapInArrow(drawn, "id long, f1 double").withColumn("k", F.row_number().over(Window.orderBy("f1")) - 1)
    at = lambda q: F.max(F.when(F.col("k") == int(q * (repeats - 1)), F.col("f1")))
    return values.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def micro_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn summed, with precision, recall and F1, for each level of a rollup of the columns (null: all)."""
    t = scores.rollup(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = T.ratio(F.col("tp"), F.col("tp") + F.col("fp")), T.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return t.select(*by, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"))


def exact_mcnemar(a: int, b: int) -> float:
    """Two-sided exact p of a fair coin that fell a and b times."""
    n, k = a + b, min(a, b)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def planned_sizes(spark: SparkSession, sizes: list[int], both: float, only_a: float, only_b: float, simulations: int = 1000, alpha: float = 0.05, seed: int = 20260618) -> DataFrame:
    """(n, power, half_width): for each number of pairs how often an exact McNemar test finds the difference, and the mean half-width of its interval."""

    def simulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for n in part["n"].to_pylist():
                a, state = _jumps(n), (seed + n) % _M
                found, width, p_of = 0, 0.0, {}
                for _ in range(simulations):
                    draws = (a[0] * np.uint64(state) + a[1]) & np.uint64(_M - 1)
                    state = int(draws[-1])
                    share = draws / _M
                    x, y = int(((share >= both) & (share < both + only_a)).sum()), int(((share >= both + only_a) & (share < both + only_a + only_b)).sum())
                    p = p_of.setdefault((min(x, y), max(x, y)), None) or exact_mcnemar(x, y)
                    p_of[min(x, y), max(x, y)] = p
                    found += bool(x + y) and p < alpha
                    d = (x - y) / n
                    width += 1.959963984540054 * math.sqrt(max(0.0, (x + y) / n - d * d) / n)
                out.append((found / simulations, width / simulations))
            yield pa.RecordBatch.from_arrays([part["n"], pa.array([p for p, _ in out], pa.float64()), pa.array([w for _, w in out], pa.float64())], ["n", "power", "half_width"])

    return spark.createDataFrame([(n,) for n in sizes], "n long").repartition(max(1, len(sizes))).mapInArrow(simulated, "n long, power double, half_width double")


def _jumps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of the generator's first n steps: state j steps on is a[j - 1] * state + c[j - 1]."""
    a, c = np.ones(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(n):
        a[j], c[j] = (_A * int(a[j - 1]) % _M, (_A * int(c[j - 1]) + _C) % _M) if j else (_A, _C)
    return a, c
