"""Vectorised text primitives shared by the document operators.

Everything works on one flat byte buffer and row offsets, the layout Arrow hands over, so a batch of documents costs a few numpy
passes and no Python loop over characters or words. Hashes are 64-bit: a run's hash adds a fixed random number for each byte at its
place in the run, so two different words or word runs have equal hashes with probability about 2**-64 a pair, unless they were made
to collide by someone who knows the numbers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest number of text bytes worked on at once (a longer single text is taken whole).
CHUNK_BYTES = 1 << 18

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Odd multipliers by word position in a run of words.
RUN = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
#: ASCII letters and digits and every byte of a multi-byte character.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Places in a run that have random numbers of their own; beyond, they are mixed with the number of such spans before.
_SPAN = 64
_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 64, _SPAN * 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the row offsets into them; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()), b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most so many text bytes each, or one row; with their text as flat() gives it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = flat(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def hand_back() -> None:
    """Free memory that Arrow and the C library keep goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def thrifty(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task, after which hand_back(): its Python worker goes on to other stages, beside an executor's heap that has grown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        hand_back()

    return run


def runs(data: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a kind that stay inside a row, and for each row the index of its first run."""
    inside = kind[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[:1].any(), inside[-1:].any())
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    before, after = edge[:-1] & inside, edge[1:] & inside
    rows = at[:-1][np.diff(at) > 0]
    before[rows] = inside[rows]
    last = at[1:][np.diff(at) > 0] - 1
    after[last] = inside[last]
    starts, ends = np.flatnonzero(before), np.flatnonzero(after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Runs may begin at the same byte; otherwise they don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data))
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place -= np.maximum.accumulate(begin, out=begin)
    value = _RANDOM[(place & (_SPAN - 1)) << 8 | data]
    far = np.flatnonzero(place >= _SPAN)
    if len(far):
        value[far] = mix(value[far] + (place[far] // _SPAN).astype(np.uint64) * RUN[0])
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * RUN[4])


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's runs of k words (A-Z lower-cased; with fewer words the whole sequence), and row offsets."""
    low = LOWER[data]
    starts, ends, first = runs(low, at)
    words = hashed(low, starts, ends)
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.zeros(int(made.sum()), np.uint64)
    to = np.concatenate([[0], np.cumsum(made)])
    long = count >= k
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            h += words[j : len(words) - k + 1 + j] * RUN[j % 4] * U(2 * (j // 4) + 1)
        h = mix(h)
        at_word = np.arange(len(out)) + np.repeat(first[:-1] - to[:-1], made)
        whole = np.repeat(long, made)
        out[whole] = h[at_word[whole]]
    for r in np.flatnonzero(~long & (count > 0)):
        w = words[first[r] : first[r + 1]]
        j = np.arange(len(w))
        out[to[r]] = mix((w * RUN[j % 4] * (2 * (j // 4) + 1).astype(np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.array([len(w)], np.uint64) * RUN[4])[0]
    for r in np.flatnonzero(made > 1):
        out[to[r] : to[r + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[to[:-1][made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[to]


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values; an empty row has 0."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.diff(at) > 0
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out
