"""Toxicity by a factorization machine over hashed terms.

A text's features are the distinct terms it holds (runs of letters and digits, A-Z lower-cased, and the first bytes of longer ones,
which hold the stem of an inflected word), hashed to buckets. Beside a weight
each bucket has a short factor vector; the inner product of two vectors is the weight of both terms occurring together, so that an
insult next to a group mention can count for more than the two apart. All pairs of a text cost one pass over its terms:
sum of pairs = (square of the sum - sum of the squares) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _fit, _shared, _text as T

#: Labelled rows that the machine is fitted on, about; twice as many at most.
FIT_ROWS = 12_000
BITS = 18
FACTORS = 4
#: Bytes of the stems that count as terms too.
HEADS = (4, 5, 6)
#: A bucket that fewer fitted texts hold says nothing about other texts.
LEAST_TEXTS = 4
#: A bucket takes part if its share of toxic texts is so many standard errors from that of all texts, or if so large a part of the
#: texts hold it that its pairs can be told from chance.
CLEAR, COMMON = 3.5, 0.2
#: Buckets also take part in pairs: if the share of toxic texts among those that hold both is so many standard errors from what
#: their own shares add up to. Pairs are tried among so many of the most frequent buckets, if so many texts hold both.
CLEAR_PAIR, PAIRED, LEAST_BOTH = 6.5, 1_024, 8


@dataclass
class Machine:
    """`weight` and `factors` by bucket (zero: not used), and `bias`."""

    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def logit(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        v = self.factors[buckets]
        total, squares = T.summed(v, at), T.summed(v * v, at)
        return self.bias + T.summed(self.weight[buckets], at) + 0.5 * (total * total - squares).sum(axis=1)

    def packed(self) -> "Packed":
        used = np.flatnonzero(self.weight.astype(bool) | self.factors.any(axis=1))
        place = np.zeros(len(self.weight), np.int32)
        place[used] = np.arange(1, len(used) + 1)
        return Packed(place, Machine(self.weight[used], self.factors[used], self.bias))


@dataclass
class Packed:
    """The buckets in use alone; `place` has 1 + the row of each, or 0. Its size doesn't depend on the corpus."""

    place: np.ndarray
    machine: Machine

    def score(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = self.place[buckets]
        keep = row > 0
        z = self.machine.logit(row[keep] - 1, np.concatenate([[0], np.cumsum(keep)])[at])
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def terms(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each row's terms, and row offsets."""
    low = T.LOWER[data]
    starts, ends, first = T.runs(low, at, T.TERM)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64) << bits, np.diff(first))
    heads = [(starts, ends, row)]
    for n in HEADS:
        longer = ends - starts > n
        heads.append((starts[longer], starts[longer] + n, row[longer]))
    starts, ends, row = (np.concatenate(x) for x in zip(*heads, strict=True))
    key = row | (T.hashed(low, starts, ends) >> T.U(64 - bits)).astype(np.int64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(at)))


def telling_pairs(buckets: np.ndarray, at: np.ndarray, label: np.ndarray, held: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Buckets of pairs that say more together than apart, such as two words that are harmless alone."""
    rows, share = len(label), float(label.mean())
    often = np.flatnonzero((held >= LEAST_BOTH) & (held <= rows / 2))
    often = np.sort(often[np.argsort(-held[often], kind="stable")[:PAIRED]])
    place = np.full(len(held), -1)
    place[often] = np.arange(len(often))
    column = place[buckets]
    inside = column >= 0
    both, bad = np.zeros((2, len(often), len(often)), np.float32)
    row = np.repeat(np.arange(rows), np.diff(at))[inside]
    column = column[inside]
    for i in range(0, rows, 2_000):  # a part of the texts at a time
        j, k = np.searchsorted(row, [i, i + 2_000])
        x = np.zeros((min(2_000, rows - i), len(often)), np.float32)
        x[row[j:k] - i, column[j:k]] = 1
        both += x.T @ x
        bad += (x * label[i : i + 2_000, None]).T @ x
    own = toxic[often] / np.maximum(held[often], 1)
    wanted = np.clip(own[:, None] + own[None, :] - share, share / 4, 1 - share / 4)
    apart = np.abs(bad - wanted * both) / np.sqrt(wanted * (1 - wanted) * both + 1e-9)
    apart[(both < LEAST_BOTH) | np.eye(len(often), dtype=bool)] = 0
    return often[(apart >= CLEAR_PAIR).any(axis=0)]


def fit(buckets: np.ndarray, at: np.ndarray, label: np.ndarray, *, bits: int = BITS, k: int = FACTORS, epochs: int = 24, rate: float = 0.08, l2: float = 5e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss, in batches. No rows, or labels of one kind, give a constant score."""
    size = 1 << bits
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.0
    bias = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7))
    weight, factors = np.zeros(size, np.float32), np.zeros((size, k), np.float32)
    if len(label) and 0 < share < 1:
        held = np.bincount(buckets, minlength=size)
        toxic = np.bincount(buckets, np.repeat(label, np.diff(at)), size)
        sure = np.abs(toxic - share * held) >= CLEAR * np.sqrt(share * (1 - share) * held + 1e-9)
        used = (held >= LEAST_TEXTS) & (sure | (held >= COMMON * len(label)))
        used[telling_pairs(buckets, at, label, held, toxic)] = True
        factors[used] = rng.normal(0, 0.02, (int(used.sum()), k))
        keep = used[buckets]
        n = T.summed(keep.astype(np.int64), at)
        buckets, at = buckets[keep], np.concatenate([[0], np.cumsum(n)])
        g_w, g_v, g_b = np.full(size, 1e-6, np.float32), np.full((size, k), 1e-6, np.float32), 1e-6
        rows = np.arange(len(label))
        step = max(16, min(256, len(label) // 20))
        machine = Machine(weight, factors, bias)
        for epoch in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                size_of = at[part + 1] - at[part]
                to = np.concatenate([[0], np.cumsum(size_of)])
                own = buckets[np.arange(to[-1]) + np.repeat(at[part] - to[:-1], size_of)]
                machine.bias = bias
                miss = ((1 / (1 + np.exp(-np.clip(machine.logit(own, to), -30, 30)))) - label[part]).astype(np.float32)
                each = np.repeat(miss, size_of)
                v = factors[own]
                slope = each[:, None] * (np.repeat(T.summed(v, to), size_of, axis=0) - v)
                ids, inverse = np.unique(own, return_inverse=True)
                d_w = np.bincount(inverse, each, len(ids)).astype(np.float32) / len(part) + l2 * weight[ids]
                d_v = np.stack([np.bincount(inverse, slope[:, j], len(ids)) for j in range(k)], axis=1).astype(np.float32) / len(part) + 5 * l2 * factors[ids]
                g_w[ids] += d_w * d_w
                g_v[ids] += d_v * d_v
                weight[ids] -= rate * d_w / np.sqrt(g_w[ids])
                factors[ids] -= 0.3 * rate * d_v / np.sqrt(g_v[ids])
                d_b = float(miss.mean())
                g_b += d_b * d_b
                bias -= 0.5 * rate * d_b / g_b**0.5
    return Machine(weight, factors, bias)


def calibrated(buckets: np.ndarray, at: np.ndarray, label: np.ndarray, **settings) -> Machine:
    """fit() with its logits put on the scale that fits rows it hasn't seen: two machines fitted on a half each score the other half, and
    a slope and an offset are fitted to what they say. (Weights that are held back make scores too timid.)"""
    machine = fit(buckets, at, label, **settings)
    size = np.diff(at)
    half = np.arange(len(label)) % 2
    logit = np.zeros(len(label))

    def rows(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = np.concatenate([[0], np.cumsum(size[part])])
        return buckets[np.arange(to[-1]) + np.repeat(at[:-1][part] - to[:-1], size[part])], to

    if min((label[half == k] == y).sum() for k in (0, 1) for y in (0, 1)) < 5:
        return machine
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        logit[own] = fit(*rows(other), label[other], **settings).logit(*rows(own))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton, held towards no change
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([(logit * (label - p)).sum() - (a - 1), (label - p).sum() - b])
        h = np.array([[(w * logit * logit).sum() + 1, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.1, a + float(step[0])), b + float(step[1])
    return Machine(machine.weight * np.float32(a), machine.factors * np.float32(np.sqrt(a)), a * machine.bias + b)


def fit_machine(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, most: int = FIT_ROWS) -> Packed:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Ids may be of any kind."""
    _shared.small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            buckets, at = terms(data, at)
            yield pa.RecordBatch.from_arrays([part["key"], part["label"].cast(pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(buckets, pa.int32()))], ["key", "label", "terms"])

    rows = _fit.labelled_texts(docs, labels, label, 5, 0, most).mapInArrow(features, "key long, label int, terms array<int>").toArrow().sort_by([("key", "ascending")])
    lists = rows["terms"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return calibrated(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at, rows["label"].to_numpy().astype(np.float32)).packed()


def score_toxicity(docs: DataFrame, machine: Packed) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) for each row of docs(doc_id, text).

    Whole texts are scored; a null or empty one has no terms and gets the bias alone. Every input row gives one row, repeated ids and
    texts too; equal texts have equal scores. Other columns are ignored. An empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            score = machine.score(*terms(data, at))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    _shared.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (_fit.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, fit_machine(docs, labels))
