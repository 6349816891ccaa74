"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source are dealt to shards by a hash and laid end to end in each; every 16 words are a block. Blocks are granted
to sources one by one to the highest quotient target / (2 * granted + 1), then by the same rule to the source's shards, which gives
whole quotas per shard. Inside a shard the quota's whole passes take every block, and the rest picks blocks by a seeded step through
the shard. Only tables of sources and shards reach the driver; the number of shards has a bound whatever the input.
"""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import _shared

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 16
SEED = 20240229
#: Words of a shard, at least; and shards at most, besides one for each source.
SHARD_WORDS, SHARDS = 100_000, 100_000
SHARE, MOST_PASSES, WEIGHTS = 1.5, 2, (3, 1, 2)


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients vote / (2 * given + 1), no more than `most` each; ties go to the earlier one.

    The bulk is given by a quotient found by halving, the last few one by one; the result is that of giving all one by one.
    """
    v, cap = np.asarray(votes, np.float64), np.asarray(most, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(votes)
    given = lambda q: np.minimum(cap, np.floor((v / q + 1) / 2).astype(np.int64))  # noqa: E731  with a quotient of q at least
    low, high = 0.0, float(v.max()) * 2
    low = float(v[v > 0].min()) / (2 * float(cap.max()) + 3)
    for _ in range(200):
        q = math.sqrt(low * high)
        if given(q).sum() <= seats:
            high = q
        else:
            low = q
        if high <= low * (1 + 1e-12):
            break
    out = given(high)
    while out.sum() > seats:  # rounding at the edge
        out[int(np.argmax(out))] -= 1
    queue = [(-v[i] / (2 * int(out[i]) + 1), i) for i in range(len(v)) if out[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(queue, (-v[i] / (2 * int(out[i]) + 1), i))
    return out.tolist()


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_PASSES) -> list[float]:
    """Shares of the total by weight; a source stops at `most` times its size and the others share the excess by weight."""
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        rest, weight = total - sum(out), sum(weights[i] for i in free)
        above = [i for i in free if rest * weights[i] / weight > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in above:
            out[i] = float(most * sizes[i])
        free = [i for i in free if i not in set(above)]
    return out


def _coprime(n: int) -> int:
    """A step near the golden section of n that meets every residue."""
    a = max(1, round(n * 0.6180339887))
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= _shared.SENT_ROWS else table


def mix(docs: DataFrame, texts: bool = True) -> DataFrame:
    """All columns of docs with size, source_size, target, taken and the block columns that materialize() needs.

    docs has doc_id, text and source. A null text has size 0 and is taken 0 times; a null source is a source of its own, the last
    one. Equal rows are dealt alike. No document is taken more than twice over, and a source's taken words differ from its target by
    less than a block for each of its shards and one more. Columns of docs with the names of the new ones are replaced. No documents:
    no rows. Without `texts` the text column is read once, to be counted and hashed, and left out.
    """
    spark = docs.sparkSession
    new = {"size", "source_size", "target", "taken", "__key", "__hash", "__shard", "__start", "__passes", "__some", "__step", "__shift", "__blocks"}
    rows = docs.select(
        *(c for c in docs.columns if c not in new), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("__key"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("__hash"),
    )
    rows = rows if texts else rows.drop("text")
    rows = _shared.settle(rows, "mixing-sizes")
    per_source = sorted((r["__key"].encode(), r["__key"], r["size"]) for r in rows.groupBy("__key").agg(F.sum("size").alias("size")).collect())
    keys, sizes = [x[1] for x in per_source], [x[2] for x in per_source]
    total = sum(sizes)
    target = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(keys))], SHARE * total)
    words = max(SHARD_WORDS, -(-total // SHARDS))
    shards = {k: max(1, -(-n // words)) for k, n in zip(keys, sizes, strict=True)}
    of_source = spark.createDataFrame(list(zip(keys, sizes, target, [shards[k] for k in keys], strict=True)), "__key string, source_size long, target double, __shards long")
    rows = rows.join(_sent(of_source, len(keys)), "__key").withColumn("__shard", F.pmod(F.col("__hash"), F.col("__shards"))).drop("__shards")
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in keys}
    for r in rows.groupBy("__key", "__shard").agg(F.sum("size").alias("size")).collect():
        found[r["__key"]].append((r["__shard"], r["size"]))
    blocks = {k: [-(-n // BLOCK) for _, n in sorted(found[k])] for k in keys}
    quota = apportion(target, round(sum(target) / BLOCK), [MOST_PASSES * sum(blocks[k]) for k in keys])
    table = []
    for k, q in zip(keys, quota, strict=True):
        own = apportion([float(n) for _, n in sorted(found[k])], q, [MOST_PASSES * b for b in blocks[k]])
        for (shard, _), b, n in zip(sorted(found[k]), blocks[k], own, strict=True):
            passes, some = divmod(n, b) if b else (0, 0)
            table.append((k, shard, passes, some, _coprime(b) if b else 1, random.Random(f"{SEED}/{k}/{shard}").randrange(max(1, b)), max(1, b)))
    of_shard = spark.createDataFrame(table, "__key string, __shard long, __passes long, __some long, __step long, __shift long, __blocks long")
    rows = rows.join(_sent(of_shard, len(table)), ["__key", "__shard"])
    line = Window.partitionBy("__key", "__shard").orderBy("__hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__start", F.sum("size").over(line) - F.col("size"))
    end = F.col("__start") + F.col("size")
    part = F.aggregate(
        F.when(F.col("size") > 0, F.sequence(F.expr(f"__start div {BLOCK}"), F.expr(f"(__start + size - 1) div {BLOCK}"))).otherwise(F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda sum_, j: sum_ + F.when(picked(j), F.least(end, (j + 1) * BLOCK) - F.greatest(F.col("__start"), j * BLOCK)).otherwise(0),
    )
    return rows.withColumn("taken", F.col("__passes") * F.col("size") + part)


def picked(block: Column) -> Column:
    """Whether a block of the shard is taken once more than the shard's whole passes."""
    return F.pmod(block * F.col("__step") + F.col("__shift"), F.col("__blocks")) < F.col("__some")


def materialize(mixed: DataFrame) -> DataFrame:
    """The mix's rows: a row for each time that a document is taken, with the words of its taken blocks.

    A document taken whole keeps its text as it is; of one taken in part the words of the picked blocks are joined by single spaces,
    and n_chars follows. Documents of which nothing is taken have no row. Columns that mix() added are gone.
    """
    helpers = [c for c in mixed.columns if c.startswith("__")] + ["size", "source_size", "target", "taken"]
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    first, wanted = F.expr("__start"), F.col("taken") - F.col("__passes") * F.col("size")
    some = F.array_join(F.filter(words, lambda _, i: picked(F.floor((first + i) / BLOCK))), " ")
    rows = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(MOST_PASSES)))).filter((F.col("size") > 0) & ((F.col("__copy") <= F.col("__passes")) | ((F.col("__copy") == F.col("__passes") + 1) & (wanted > 0))))
    text = F.when((F.col("__copy") <= F.col("__passes")) | (wanted == F.col("size")), F.col("text")).otherwise(some)
    rows = rows.withColumn("text", text)
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(mixed.schema["n_chars"].dataType))
    return rows.drop(*helpers, "__copy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, texts=False).select("doc_id", "size", "source_size", "target", "taken")
