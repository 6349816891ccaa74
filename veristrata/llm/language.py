"""Language of a text by hierarchical discrimination.

Linear support vector machines choose the language family first, one family against the rest. Within it, one machine for each pair of
its languages votes between closely related languages. All machines see the same features, the shares of hashed byte 2- and 3-grams,
so a text is one pass of table look-ups whatever the number of machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _fit, _shared, _text as T

#: Texts that the machines are fitted on, about; twice as many at most.
FIT_ROWS = 2_000
#: Languages that are learned, at most.
MOST_LANGS = 200
BITS = 12
#: Which languages are closely related; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNKNOWN = "und"


def grams(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams at each byte (A-Z lower-cased, digits as one, white space as one), padded by a space at a row's ends."""
    low = T.LOWER[data].astype(np.uint32)
    low[~T.NOT_SPACE[data]] = 0x20
    low[(low >= 0x30) & (low <= 0x39)] = 0x30
    n = len(low)
    one, two = np.full(n, 0x20, np.uint32), np.full(n, 0x20, np.uint32)
    one[:-1], two[:-2] = low[1:], low[2:]
    ends = at[1:][np.diff(at) > 0]
    one[ends - 1] = 0x20
    two[ends - 1] = 0x20
    two[ends[ends - 2 >= 0] - 2] = 0x20
    pair = low << np.uint32(8) | one
    fold = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(33 - bits)).astype(np.int32)
    return fold(pair), fold(pair << np.uint32(8) | two) + np.int32(1 << bits - 1)


def shares(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows x buckets: how often each bucket occurs, by the row's bytes."""
    two, three = grams(data, at, bits)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64) << bits, np.diff(at))
    count = np.bincount(np.concatenate([row + two, row + three]), minlength=(len(at) - 1) << bits).reshape(-1, 1 << bits)
    return (count / np.maximum(np.diff(at), 1)[:, None]).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, *, c: float = 4.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss (y is 1 or -1, classes weighed alike), by accelerated gradient."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b, w0, b0 = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    rate = 1 / (1 / c / 10 + 2 * float((each * (x * x).sum(axis=1)).sum() + 1))
    for k in range(steps):
        a = k / (k + 3)
        u, v = w + a * (w - w0), b + a * (b - b0)
        gap = np.maximum(0, 1 - y * (x @ u + np.float32(v)))
        g = -2 * each * y * gap
        w0, b0 = w, b
        w, b = u - np.float32(rate) * (x.T @ g + u / np.float32(c * 10)), v - rate * float(g.sum())
    return w, b


@dataclass
class Discriminator:
    """`table` has a column for each machine; `machines` are (label chosen if positive, label chosen if negative or None: the rest)."""

    langs: list[str]
    family: dict[str, str]
    machines: list[tuple[str, str | None]]
    table: np.ndarray
    offset: np.ndarray
    bits: int = BITS

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        two, three = grams(data, at, self.bits)
        size = np.maximum(np.diff(at), 1)
        out = np.empty((len(at) - 1, len(self.machines)))
        for j in range(len(self.machines)):
            column = np.ascontiguousarray(self.table[:, j])
            out[:, j] = T.summed((column[two] + column[three]).astype(np.float64), at) / size + self.offset[j]
        return out

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into langs, and the chance given to it, for each row."""
        n = len(at) - 1
        sure = 1 / (1 + np.exp(-3 * np.clip(self.margins(data, at), -10, 10)))
        families = sorted(set(self.family.values()))
        of_family = np.stack([sure[:, self.machines.index((f, None))] if (f, None) in self.machines else np.ones(n) for f in families], axis=1)
        chosen = of_family.argmax(axis=1)
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        for i, f in enumerate(families):
            rows = np.flatnonzero(chosen == i)
            own = [x for x in self.langs if self.family[x] == f]
            votes, chance = np.zeros((len(rows), len(own))), np.ones((len(rows), len(own)))
            for a, b in combinations(range(len(own)), 2):
                p = sure[rows, self.machines.index((own[a], own[b]))]
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                chance[:, a] = np.minimum(chance[:, a], p)
                chance[:, b] = np.minimum(chance[:, b], 1 - p)
            best = (votes + chance * 0.5).argmax(axis=1)
            lang[rows] = [self.langs.index(own[x]) for x in best]
            score[rows] = of_family[rows, i] * chance[np.arange(len(rows)), best]
        return lang, score


def fit(x: np.ndarray, lang: list[str], bits: int = BITS, families: dict[str, tuple[str, ...]] = FAMILIES) -> Discriminator:
    """Fit on the shares of some texts and their languages."""
    langs = sorted(set(lang))
    family = {a: next((f for f, own in families.items() if a in own), a) for a in langs}
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(1 << bits, np.float32)
    x *= scale
    machines, columns = [], []
    names = np.array(lang, object)
    groups = np.array([family[a] for a in lang], object)
    for f in sorted(set(groups)) if len(set(groups)) > 1 else []:
        machines.append((f, None))
        columns.append(svm(x, np.where(groups == f, 1, -1).astype(np.float32)))
    for f in sorted(set(groups)):
        for a, b in combinations([a for a in langs if family[a] == f], 2):
            rows = np.flatnonzero((names == a) | (names == b))
            machines.append((a, b))
            columns.append(svm(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32)))
    table = np.stack([w * scale for w, _ in columns], axis=1).astype(np.float32) if columns else np.zeros((1 << bits, 0), np.float32)
    return Discriminator(langs, family, machines, table, np.array([b for _, b in columns]), bits)


def fit_discriminator(docs: DataFrame, *, most: int = FIT_ROWS) -> Discriminator:
    """Fit on a bounded sample of the texts with a language, a letter, and crc32(doc_id as text) mod 4 other than 2.

    Each language has an equal share of the sample, or all its texts if these are fewer, so that a rare one is learned too; languages
    beyond the MOST_LANGS most frequent ones aren't learned. Ids may be of any kind; a text of more than 1 MB isn't fitted on.
    """
    _shared.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_fit.remainder(F.col("doc_id"), 4) != 2) & (F.octet_length("text") <= 1 << 20))
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()
    each = most / max(1, len(counts))
    odds = docs.sparkSession.createDataFrame([(r["lang"], int(1_000_003 * min(1.0, each / r["count"])) + 1) for r in counts], "lang string, odds long")
    chosen = rows.join(F.broadcast(odds), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < F.col("odds")).limit(2 * most)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text", 1 << 20):
            x = shares(data, at)
            yield pa.RecordBatch.from_arrays([part["key"], part["lang"], pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], ["key", "lang", "shares"])

    got = chosen.filter(F.col("text").rlike(r"\p{L}")).select(_fit.order_key().alias("key"), "lang", "text").mapInArrow(T.thrifty(shared), "key long, lang string, shares binary").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(T.flat(got["shares"].combine_chunks())[0], np.float32).reshape(-1, 1 << BITS).copy() if got.num_rows else np.zeros((0, 1 << BITS), np.float32)
    return fit(x, got["lang"].to_pylist())


def identify(docs: DataFrame, model: Discriminator) -> DataFrame:
    """All columns of docs with lang_pred and lang_score put in front, one row for each row.

    A text that is null or has no letter is `und` with score 0; so is every text if no language was learned. Whole texts count. Equal
    texts get equal answers. Columns of docs named lang_pred or lang_score are replaced. An empty table gives no rows.
    """
    _shared.small_batches(docs.sparkSession)
    rest = [f for f in docs.schema if f.name not in ("lang_pred", "lang_score")]
    names = ["lang_pred", "lang_score", *(f.name for f in rest)]
    letter = "_" * (1 + max([0, *(len(f.name) for f in rest)]))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            letters = part[letter].to_numpy(zero_copy_only=False).astype(bool)
            best, score = model.predict(data, at) if model.langs else (np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows))
            known = letters & bool(model.langs)
            lang = np.where(known, np.array(model.langs or [UNKNOWN], object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), *(part[f.name] for f in rest)], names)

    rows = docs.select(*(f.name for f in rest), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter))
    return rows.mapInArrow(T.thrifty(named), "lang_pred string, lang_score double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", (_fit.remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    return identify(rows, fit_discriminator(docs)).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
