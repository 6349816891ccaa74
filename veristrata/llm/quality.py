"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad from its own and its neighbours' features and the labels beside it. Forward-backward
gives each line's chance of being good; the mean of these chances, weighted by the lines' bytes, is mapped to the document's score by
a logistic curve fitted on the same rows. Only documents carry labels: lines start with their document's label, and in bad documents
lines that the field holds for good are relabelled between the fits (one bad line stays at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _fit, _shared, _text as T

#: Labelled rows that the field is fitted on, about; twice as many at most.
FIT_ROWS = 2_500
#: Bytes of their texts, about, at most.
FIT_BYTES = 16 << 20
#: A document is kept (predicted 1) from this score on.
KEEP = 0.3

_CLASSES = [
    np.isin(np.arange(256), np.arange(0x41, 0x5B)),  # upper case
    np.isin(np.arange(256), np.arange(0x61, 0x7B)) | (np.arange(256) >= 0x80),  # other letters
    np.isin(np.arange(256), np.arange(0x30, 0x3A)),  # digits
    ~T.NOT_SPACE,
    np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~=+_<>{}[]\\/", np.uint8)),
    np.arange(256) == 0x21,  # exclamation marks
    np.arange(256) == 0x7C,  # bars
    np.isin(np.arange(256), np.frombuffer(b".,;:?'\"()-", np.uint8)),
]
_CUTS = (0.05, 0.3, 0.7)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line offsets into the bytes (a line holds its newline) and row offsets into the lines; an empty row has no line."""
    full = np.diff(at) > 0
    cut = np.zeros(len(data) + 1, bool)
    cut[1:][data == 0x0A] = True
    cut[at[:-1][full]] = True
    starts = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    return np.append(starts, len(data)), np.searchsorted(starts, at)


def features(data: np.ndarray, line_at: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """A row of features for each line: its own, the previous line's and the next one's (zero beyond the document)."""
    n, size = len(line_at) - 1, np.maximum(np.diff(line_at), 1).astype(np.float64)
    if not n:
        return np.zeros((0, 0), np.float32)
    starts, ends, first = T.runs(data, line_at)
    hashes = T.hashed(data, starts, ends)
    words = np.diff(first)
    line_of = np.repeat(np.arange(n, dtype=np.int64), words)
    key = np.sort((line_of << 40) | (hashes >> T.U(24)).astype(np.int64))
    distinct = np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] >> 40, minlength=n) if len(key) else np.zeros(n)
    whole = T.mix(T.summed(hashes * (T.U(2) * np.arange(1, len(hashes) + 1, dtype=np.uint64) - T.U(2) * np.repeat(first[:-1], words).astype(np.uint64) + T.U(1)), first) + words.astype(np.uint64))
    doc_of = np.repeat(np.arange(len(doc_at) - 1, dtype=np.int64), np.diff(doc_at))
    line_key = (doc_of << 40) | (whole >> T.U(24)).astype(np.int64)
    _, where, times = np.unique(line_key, return_inverse=True, return_counts=True)
    share = [np.add.reduceat(c[data].astype(np.int32), line_at[:-1]) / size for c in _CLASSES]
    letters = share[0] + share[1]
    numbers = [share[0] / np.maximum(letters, 1e-9), *share[2:7], 1 - distinct / np.maximum(words, 1), 1 - 1 / times[where], (words <= 2) * 1.0, 1 - letters]
    own = [x > c for x in numbers for c in _CUTS]
    own += numbers
    own += [np.log1p(size) / 8, np.minimum(size / np.maximum(words, 1), 30) / 15, share[7] * 5, np.ones(n)]
    own = np.stack(own, axis=1).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[doc_at[:-1][np.diff(doc_at) > 0]] = 0
    after[doc_at[1:][np.diff(doc_at) > 0] - 1] = 0
    return np.concatenate([own, before, after], axis=1)


def marginals(unary: np.ndarray, at: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's chance of being good, the expected counts of label pairs (2 x 2) and each document's log normaliser.

    unary: a line's log-odds of good; pair: log potentials of (label, next label). Documents run side by side, longest first.
    """
    n = len(unary)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # documents with more than t lines
    p = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
    e = np.stack([1 - p, p], axis=1)
    move = np.exp(pair)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
    begin = at[:-1][order]
    for t, k in enumerate(live):
        i = begin[:k] + t
        a = e[i] * (alpha[i - 1] @ move if t else 1)
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i, None]
    both = np.zeros((2, 2))
    for t in range(len(live) - 2, -1, -1):
        i = begin[: live[t + 1]] + t
        after = e[i + 1] * beta[i + 1] / scale[i + 1, None]
        beta[i] = after @ move.T
        both += move * (alpha[i].T @ after)
    log_z = T.summed(np.log(scale) + np.logaddexp(0, np.clip(unary, -30, 30)), at)
    return alpha[:, 1] * beta[:, 1], both, log_z


@dataclass
class Field:
    """`weight` by feature, `pair` log potentials, and the slope and offset of the curve from mean chance to score."""

    weight: np.ndarray
    pair: np.ndarray
    curve: tuple[float, float]

    def mean_chance(self, x: np.ndarray, line_at: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
        chance = marginals(x @ self.weight.astype(np.float32), doc_at, self.pair)[0] if len(x) and len(self.weight) else np.zeros(len(x))
        size = np.diff(line_at).astype(np.float64)
        return T.summed(chance * size, doc_at) / np.maximum(T.summed(size, doc_at), 1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        line_at, doc_at = lines(data, at)
        raw = self.mean_chance(features(data, line_at, doc_at), line_at, doc_at)
        return 1 / (1 + np.exp(-(self.curve[0] * raw + self.curve[1])))


def train(x: np.ndarray, y: np.ndarray, at: np.ndarray, *, steps: int = 80, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials that raise the labels' mean log likelihood, by Adam over all documents at once."""
    n, f = max(1, len(y)), x.shape[1]
    theta, m, v = np.zeros(f + 4), np.zeros(f + 4), np.zeros(f + 4)
    inner = np.ones(len(y), bool)
    inner[at[1:][np.diff(at) > 0] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(2 * y[i] + y[i + 1], minlength=4).reshape(2, 2)
    for step in range(1, steps + 1):
        chance, both, _ = marginals(x @ theta[:f].astype(np.float32), at, theta[f:].reshape(2, 2))
        g = np.concatenate([x.T @ (y - chance).astype(np.float32), (seen - both).ravel()]) / n - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:f], theta[f:].reshape(2, 2)


def fit(data: np.ndarray, at: np.ndarray, label: np.ndarray, *, rounds: int = 2) -> Field:
    """Fit on whole texts with their labels. No rows give a field that finds everything good."""
    parts, line_sizes, line_counts = [], [], []
    i = 0
    while i < len(at) - 1:  # a part of the texts at a time; only the features are held for all
        j = max(i + 1, int(np.searchsorted(at, at[i] + T.CHUNK_BYTES, "right")) - 1)
        own = data[at[i] : at[j]]
        part_at, counts = lines(own, at[i : j + 1] - at[i])
        if len(part_at) > 1:
            parts.append(features(own, part_at, counts))
        line_sizes.append(np.diff(part_at))
        line_counts.append(np.diff(counts))
        i = j
    x = np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)
    line_at, doc_at = (np.concatenate([[0], *(np.cumsum(np.concatenate(y))[None] if y else [])], axis=None) for y in (line_sizes, line_counts))
    if not len(x):
        return Field(np.zeros(0), np.zeros((2, 2)), (0.0, 3.0))
    doc_of = np.repeat(np.arange(len(at) - 1), np.diff(doc_at))
    y = label[doc_of].astype(np.int64)
    weight, pair = train(x, y, doc_at)
    for _ in range(rounds - 1):
        u = x @ weight.astype(np.float32)
        worst = np.full(len(label), np.inf)
        np.minimum.at(worst, doc_of, u)
        y = np.where(label[doc_of] == 1, 1, (u > 0) & (u > worst[doc_of])).astype(np.int64)
        weight, pair = train(x, y, doc_at)
    field = Field(weight, pair, (1.0, 0.0))
    raw = field.mean_chance(x, line_at, doc_at)
    a, b = 4.0, -1.0
    for _ in range(50):  # Newton on the two numbers of the curve, held towards the first guess
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([(raw * (label - p)).sum() - 0.1 * (a - 4), (label - p).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return Field(weight, pair, (max(a, 1e-3), b))


def fit_field(docs: DataFrame, labels: DataFrame, label: str = "quality", *, most: int = FIT_ROWS) -> Field:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id as text) mod 5 isn't 0. Ids may be of any kind."""
    rows = _fit.labelled_texts(docs, labels, label, 5, 0, most, FIT_BYTES).toArrow().sort_by([("key", "ascending")]).combine_chunks()
    text = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return fit(*T.flat(text), rows["label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of docs with `score` and `predicted` (1 if score >= 0.3) put in front, one row for each row.

    A null or empty text has no line, so its mean chance is 0 and it scores the lowest. One very long line is one line. Equal texts
    score alike. An empty table gives no rows. Columns of docs named score or predicted are replaced.
    """
    _shared.small_batches(docs.sparkSession)
    rest = [f for f in docs.schema if f.name not in ("score", "predicted")]
    names = ["score", "predicted", *(f.name for f in rest)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            score = field.score(data, at)
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array((score >= KEEP).astype(np.int32)), *(part[f.name] for f in rest)], names)

    return docs.select(*(f.name for f in rest)).mapInArrow(T.thrifty(scored), "score double, predicted int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs.select("doc_id", "text", (_fit.remainder(F.col("doc_id"), 5) == 0).alias("held_out")), fit_field(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
