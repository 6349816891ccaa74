"""Cross-entropy difference between matched n-gram models of a target and of the background.

The query's models are word pairs (word_statistics and word_score): the counts of pairs grow with the corpus, stay distributed, and
each document's pairs are sent to them. fit_model and score_difference are the same score by smaller models of bytes, as follows.

Both models are of one order over one vocabulary, the 256 bytes and an end mark, with the same interpolation; they differ in their
counts alone: the target's come from the target texts (the benchmark passages), the background's from all documents. Each byte of a
text, and its end, is a token with a loss under either model, and the mean difference of the losses is the document's score: below
zero, the text is more like the target than like the corpus. The counts cover every text; as the vocabulary is closed, the tables
that reach the tasks have at most 257 * 256 * 256 entries, whatever the corpus.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _shared, _text as T

#: Weights of the 3-gram, 2-gram and 1-gram estimates; the rest is spread evenly.
MIX = (0.55, 0.3, 0.12)
#: The end mark, and the space that stands before a text, as symbols.
END, SYMBOLS, START = 256, 257, 0x20


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3-grams as (first * 257 + second) * 257 + third, one for each byte and each row's end; and row offsets."""
    rows = len(at) - 1
    to = at + np.arange(rows + 1)
    third = np.full(to[-1], END, np.int32)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    third[inside] = T.LOWER[data]
    second, first = np.full(to[-1], START, np.int32), np.full(to[-1], START, np.int32)
    second[1:], first[2:] = third[:-1], third[:-2]
    second[to[:-1]] = START
    first[to[:-1]] = START
    after = to[:-1] + 1
    first[after[after < to[1:]]] = START
    return (first * SYMBOLS + second) * SYMBOLS + third, to


def counts(texts: DataFrame) -> DataFrame:
    """(gram, n): how often each 3-gram occurs in all texts of texts(text). Tasks add up before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            gram, where = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            return gram, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        for _, data, at in T.pieces(batches, "text"):
            held.append(np.unique(grams(data, at)[0], return_counts=True))
            if len(held) == 16:
                held = [added()]
        if held:
            gram, n = added()
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Losses in nats by 3-gram that occurs in either corpus; `grams` sorted. Others get theirs from the shorter estimates."""

    order3: dict[str, np.ndarray]

    @staticmethod
    def fit(gram: np.ndarray, n: np.ndarray) -> "Model":
        pair, first = gram % (SYMBOLS * SYMBOLS), gram % SYMBOLS
        one = np.bincount(first, n, SYMBOLS)
        two = np.bincount(pair, n, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
        low = MIX[2] * one / max(one.sum(), 1) + (1 - sum(MIX)) / SYMBOLS
        context = two.sum(axis=1, keepdims=True)
        low = low[None, :] + MIX[1] * two / np.maximum(context, 1)
        low += np.where(context == 0, MIX[1], 0) * one[None, :] / max(one.sum(), 1)
        head = gram // SYMBOLS
        heads, where = np.unique(head, return_inverse=True)
        return Model({"gram": gram, "p": MIX[0] * n / np.bincount(where, n)[where], "low": low, "heads": heads})

    def loss(self, gram: np.ndarray) -> np.ndarray:
        """-ln p of each 3-gram; where its two-symbol context never occurred, the 2-gram estimate takes the 3-gram's weight too."""
        own = self.order3
        spot = np.minimum(np.searchsorted(own["gram"], gram), max(len(own["gram"]) - 1, 0))
        p3 = np.where(own["gram"][spot] == gram, own["p"][spot], 0.0) if len(own["gram"]) else np.zeros(len(gram))
        low = own["low"][gram // SYMBOLS % SYMBOLS, gram % SYMBOLS]
        head = gram // SYMBOLS
        at = np.minimum(np.searchsorted(own["heads"], head), max(len(own["heads"]) - 1, 0))
        seen = own["heads"][at] == head if len(own["heads"]) else np.zeros(len(gram), bool)
        return -np.log(np.where(seen, p3 + low, low * (1 + MIX[0] / (1 - MIX[0]))))


def fit_model(texts: DataFrame) -> Model:
    """A model of all texts. Its table is bounded by the vocabulary, so it may be brought to the driver."""
    table = counts(texts).toArrow().sort_by([("gram", "ascending")])
    return Model.fit(table["gram"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.float64))


def score_difference(docs: DataFrame, target: Model, background: Model) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (mean nats a token) and score (their difference) of each row of docs(doc_id, text).

    A null or empty text has one token, its end. Whole texts count; equal texts score alike; extra columns are ignored. Models of no
    texts know nothing and give each token the same loss. An empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            gram, to = grams(data, at)
            kinds, where = np.unique(gram, return_inverse=True)
            kinds = kinds.astype(np.int64)
            n = np.diff(to)
            a, b = (np.add.reduceat(m.loss(kinds)[where], to[:-1]) / n for m in (target, background))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(a - b)], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, loss_target double, loss_background double, score double")


#: Words are hashed to so many bits; the mark at a text's end and the one before it follow as symbols.
WORD_BITS = 19
TEXT_END, TEXT_START = 1 << WORD_BITS, (1 << WORD_BITS) + 1
WIDTH = WORD_BITS + 1
#: Weights of the estimates by pair and by word; the rest is spread evenly over the words and the end.
WORD_MIX = (0.6, 0.35)
#: Pairs that make up more than 1 / HOT of the background, HOT of them at most, are scored where the texts are.
HOT = 200_000
#: Text bytes to a part of the counts, about, and parts at least, so that a pair's name inside its part has four bytes; distinct pairs
#: or tokens that a task holds before it sends them on.
PART_BYTES, LEAST_PARTS, HELD = 2 << 20, 256, 1 << 18
#: Parts of a nat that sums of losses are counted in.
SCALE = 1 << 30
#: Pairs in a row of the counts, at most, so that rows and the batches that hold them stay small.
ROW_PAIRS = 1 << 16


def word_pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word, and each row's end, with the word before it, as first << WIDTH | second; and row offsets."""
    low = T.LOWER[data]
    starts, ends, first = T.runs(low, at, T.TERM)
    to = first + np.arange(len(at))
    second, inside = np.full(to[-1], TEXT_END, np.int64), np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    second[inside] = (T.hashed(low, starts, ends) >> T.U(64 - WORD_BITS)).astype(np.int64)
    before = np.concatenate([[TEXT_START], second[:-1]])
    before[to[:-1]] = TEXT_START
    return before << WIDTH | second, to


_KEY = (1 << 2 * WIDTH) - 1
_TIMES = (0x9E3779B97F4A7C15 & _KEY | 1, 0xBF58476D1CE4E5B9 & _KEY | 1)


def _shuffled(x: np.ndarray, times: tuple[int, ...]) -> np.ndarray:
    """A bijection of the numbers of a pair's width; with the factors' inverses, last one first, it is undone."""
    x = x ^ (x >> T.U(WIDTH))
    for t in times:
        x = (x * T.U(t)) & T.U(_KEY)
        x ^= x >> T.U(WIDTH)
    return x


def _parted(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by part, the parts' offsets in it, and the keys' names inside their parts, in that order."""
    mixed = _shuffled(key.astype(np.uint64), _TIMES)
    part = (mixed % T.U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)), (mixed[order] // T.U(parts)).astype(np.uint32)


def _whole(name: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The keys that have these names in a part."""
    inverse = tuple(pow(t, -1, _KEY + 1) for t in reversed(_TIMES))
    return _shuffled(name.astype(np.uint64) * T.U(parts) + T.U(part), inverse).astype(np.int64)


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, where = np.unique(key, return_inverse=True)
    return kinds, np.bincount(where, n, len(kinds)).astype(np.int64)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _trimmed(out):
    """The result, after freed memory has gone back to the system; else workers keep what their largest group took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return out


@dataclass
class Words:
    """Counts of both corpora. `table` has rows of the pairs of a part and their counts, packed. `one` and `total` count the
    words of each corpus, a closed vocabulary; `hot` has the pairs and counts that are scored where the texts are."""

    table: DataFrame
    parts: int
    one: tuple[np.ndarray, np.ndarray]
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]


def _loss(one: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-ln p of each pair; after a word that never occurred, the estimate by word takes the pair's weight too."""
    first, second = key >> WIDTH, key & ((1 << WIDTH) - 1)
    low = WORD_MIX[1] * one[second] / max(one[:TEXT_START].sum(), 1) + (1 - sum(WORD_MIX)) / TEXT_START
    context = one[first]
    return -np.log(np.where(context > 0, WORD_MIX[0] * n / np.maximum(context, 1) + low, low / (1 - WORD_MIX[0])))


def word_statistics(target: DataFrame, background: DataFrame) -> Words:
    """Counts of all word pairs of target(text) and background(text). Tasks add up before the shuffle, and no pair is left out."""
    size = background.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(LEAST_PARTS, int(size / PART_BYTES))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            key, n = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            order, at, name = _parted(key, parts)
            n, used = n[order], np.flatnonzero(np.diff(at))
            blobs = [[x[at[p] : at[p + 1]].tobytes() for p in used] for x in (name, n)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["part", "key", "n"])

        for _, data, at in T.pieces(batches, "text"):
            held.append(np.unique(word_pairs(data, at)[0], return_counts=True))
            if sum(len(k) for k, _ in held) >= max(2 * HELD, 64 * parts):
                held[:] = [_merged(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                if len(held[0][0]) >= max(HELD, 32 * parts):
                    yield _trimmed(sent())
        if held:
            yield _trimmed(sent())

    def added(table):
        lists, part = [], table["part"][0].as_py()
        for k in (0, 1):
            own = table.filter(pc.equal(table["kind"], k))
            lists.append(_merged(_joined(own["key"], np.uint32), _joined(own["n"], np.int64)))
        kinds = np.union1d(lists[0][0], lists[1][0])
        both = [np.zeros(len(kinds), np.int64) for _ in lists]
        for out, (key, n) in zip(both, lists, strict=True):
            out[np.searchsorted(kinds, key)] = n
        blobs = [pa.array([x[i : i + ROW_PAIRS].tobytes() for i in range(0, len(x), ROW_PAIRS)], pa.binary()) for x in (kinds, *both)]
        return _trimmed(pa.table([pa.array([part] * len(blobs[0]), pa.int32()), *blobs], ["part", "key", "a", "b"]))

    rows = [d.select("text").mapInArrow(counted, "part int, key binary, n binary").withColumn("kind", F.lit(k)) for k, d in enumerate((target, background))]
    table = _shared.settle(rows[0].union(rows[1]).groupBy("part").applyInArrow(added, "part int, key binary, a binary, b binary"), "lm-pairs")

    def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.frombuffer(batch[c][i].as_py(), np.int64) for c in ("a", "b"))
        return _whole(np.frombuffer(batch["key"][i].as_py(), np.uint32), batch["part"][i].as_py(), parts), a, b

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TEXT_START + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                key, a, b = unpacked(batch, i)
                second, start = key & ((1 << WIDTH) - 1), key >> WIDTH == TEXT_START
                for k, n in enumerate((a, b)):
                    total[k] += np.bincount(second, n, TEXT_START + 1)
                    total[k, TEXT_START] += n[start].sum()
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(total[k, used].astype(np.int64)) for k in (0, 1))], ["word", "a", "b"])

    found = table.mapInArrow(ones, "word int, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    one = np.zeros((2, TEXT_START + 1))
    for k, c in enumerate("ab"):
        one[k, found["word"].to_numpy()] = found[c].to_numpy()
    least = max(1.0, one[1, :TEXT_START].sum() / HOT)

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = unpacked(batch, i)
                keep = got[2] > least
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in got], ["key", "a", "b"])

    hot = table.mapInArrow(common, "key long, a long, b long").toArrow().sort_by([("key", "ascending")])
    return Words(table, parts, (one[0], one[1]), tuple(hot[c].to_numpy() for c in ("key", "a", "b")))


def word_score(docs: DataFrame, words: Words) -> DataFrame:
    """As score_difference, by word pairs; tokens are the words and the text's end.

    A document's pairs that aren't hot are sent, packed, to the part that has their counts, and its losses by part are added up. Sums
    by part are whole numbers of SCALE a nat: so they add up to the same whatever the order, equal texts score alike, and tasks add up
    their parts before the shuffle.
    """
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), words.parts
    one, (hot, *of_hot) = words.one, words.hot
    of_hot = [_loss(o, hot, n) for o, n in zip(one, of_hot, strict=True)]
    total = f"row long, doc_id {kind}, n long, a double, b double"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, keys, rows = TaskContext.get().partitionId() << 40, [], []
        none = lambda n, t: pa.nulls(n, t)
        names = ["row", "doc_id", "n", "a", "b", "part", "key", "at"]

        def flushed(kind) -> pa.RecordBatch:
            key, row = np.concatenate(keys), np.concatenate(rows)
            keys.clear()
            rows.clear()
            order, at, name = _parted(key, parts)
            row, used = row[order], np.flatnonzero(np.diff(at))
            low = [int(row[at[p]]) for p in used]
            blobs = [[name[at[p] : at[p + 1]].tobytes() for p in used], [(row[at[p] : at[p + 1]] - x).astype(np.uint32).tobytes() for p, x in zip(used, low, strict=True)]]
            n = len(used)
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), none(n, kind), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.float64()), pa.array(used, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], names)

        for part, data, at in T.pieces(batches, "text"):
            key, to = word_pairs(data, at)
            n = np.diff(to)
            row = np.repeat(np.arange(len(n)), n)
            spot = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
            here = hot[spot] == key if len(hot) else np.zeros(len(key), bool)
            own = [np.bincount(row[here], x[spot[here]], len(n)).astype(float) if here.any() else np.zeros(len(n)) for x in of_hot]
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(base + np.arange(m)), part["doc_id"], pa.array(n, pa.int64()), pa.array(own[0]), pa.array(own[1]), pa.array((base + np.arange(m)) % parts, pa.int32()), none(m, pa.binary()), none(m, pa.binary())], names)
            keys.append(key[~here])
            rows.append(row[~here] + base)
            base += m
            if sum(map(len, keys)) >= max(HELD, 64 * parts):
                yield _trimmed(flushed(part["doc_id"].type))
        if keys:
            yield _trimmed(flushed(part["doc_id"].type))

    def joined(left, right):
        rows, sums = [], ([], [])
        blobs = pc.is_valid(left["key"])
        whole, left = left.filter(pc.invert(blobs)).select(["row", "doc_id", "n", "a", "b"]), left.filter(blobs)
        if right.num_rows:
            known = _joined(right["key"], np.uint32)
            order = np.argsort(known, kind="stable")
            known, n = known[order], [_joined(right[c], np.int64)[order] for c in "ab"]
        else:
            known, n = np.zeros(0, np.uint32), [np.zeros(0, np.int64)] * 2
        of = next((t["part"][0].as_py() for t in (left, right) if t.num_rows), 0)
        by_pair = [_loss(o, _whole(known, of, parts), x) for o, x in zip(one, n, strict=True)]
        for low, key, at in zip(left["row"].to_pylist(), left["key"].to_pylist(), left["at"].to_pylist(), strict=True):
            key, at = np.frombuffer(key, np.uint32), np.frombuffer(at, np.uint32).astype(np.int64)
            spot = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            here = known[spot] == key if len(known) else np.zeros(len(key), bool)
            used, where = np.unique(at, return_inverse=True)
            rows.append(used + low)
            for k in (0, 1):
                loss = np.where(here, by_pair[k][spot], _loss(one[k], _whole(key, of, parts), np.zeros(len(key)))) if not here.all() else by_pair[k][spot]
                sums[k].append(np.bincount(where, loss, len(used)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        whole_numbers = lambda x: np.rint(x * SCALE).astype(np.int64)
        row = cat(rows, np.int64)
        found = pa.table({"row": row, "doc_id": pa.nulls(len(row), whole["doc_id"].type), "n": pa.nulls(len(row), pa.int64()), **{c: whole_numbers(cat(s, float)) for c, s in zip("ab", sums, strict=True)}})
        own = pa.table({**{c: whole[c] for c in ("row", "doc_id", "n")}, **{c: whole_numbers(whole[c].to_numpy()) for c in "ab"}})
        return _trimmed(pa.concat_tables([own.cast(found.schema), found]).combine_chunks())

    packed = docs.select("doc_id", "text").mapInArrow(sent, f"{total}, part int, key binary, at binary")
    rows = packed.groupBy("part").cogroup(words.table.groupBy("part")).applyInArrow(joined, f"row long, doc_id {kind}, n long, a long, b long")
    rows = rows.groupBy("row").agg(F.max(F.struct(F.col("n"), "doc_id")).alias("doc"), *((F.sum(c) / SCALE).alias(c) for c in "ab"))
    rows = rows.select("doc.doc_id", F.col("doc.n").alias("n_tokens"), (F.col("a") / F.col("doc.n")).alias("loss_target"), (F.col("b") / F.col("doc.n")).alias("loss_background"))
    return rows.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    _shared.small_batches(spark)
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return word_score(docs, word_statistics(target, docs))
