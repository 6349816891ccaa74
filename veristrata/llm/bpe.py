"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut into pieces by character class (the split pattern of the rank files), equal pieces are encoded once, and pieces of like
length share a matrix with a row each. In every round each row merges its leftmost pair of least rank: the ranks of neighbouring
pairs come from one open-addressed hash table, the merged position is closed up, and rows without a pair left drop out. A long piece
is folded into a matrix of its own, whose rows keep their least ranks, so that a round costs one row and not the whole piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _shared, _text as T

NONE = np.int32(0x7FFFFFFF)
#: Longer pieces are folded to rows of this width.
LONG_PIECE = 256
#: Pieces that a worker remembers between batches, and the longest of them in bytes.
REMEMBERED, LONGEST_REMEMBERED = 120_000, 64
#: Text bytes whose pieces are encoded together: equal ones cost once. A worker needs some 100 times as many while it does so.
TOGETHER = 1 << 18

_LETTER, _NUMBER, _OTHER, _WHITE, _BLANK = 0, 1, 2, 3, 4
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point: letter, number, other, white space, and the space character itself."""
    global _classes
    if _classes is None:
        out = np.full(0x110000, _OTHER, np.uint8)
        for begin in range(0, 0x110000, 0x1000):
            some = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(begin, begin + 0x1000))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, some):
                    out[begin + m.start() : begin + m.end()] = kind
        out[0x20] = _BLANK
        _classes = out
    return _classes


def split(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the pieces among the code points of some rows (`at`: row offsets), as this pattern finds them from left to right:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    A piece starts where the class changes. White space before something else gives up its last character, which joins what follows
    if it is a space and stands alone if not; an apostrophe that begins a piece takes the letters of a contraction with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[np.minimum(points, 0x10FFFF)]
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first[n] = True
    white = kind >= _WHITE
    group = np.where(white, _WHITE, kind)
    begin = first.copy()
    begin[1:n] |= group[1:] != group[:-1]
    # the last white space of a run that something follows in the same row
    ends = np.zeros(n, bool)
    ends[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    last = np.flatnonzero(ends)
    begin[last] = True
    joined = last[kind[last] == _BLANK]
    begin[joined + 1] = False
    # contractions: a lone apostrophe that begins a piece, and letters behind it
    mark = np.flatnonzero(begin[:n] & (points == 0x27))
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1]]
    if len(mark):
        a = points[mark + 1]
        b = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        begin[mark[two | three] + 1] = False
        for m, size in ((mark[two], 2), (mark[three], 3)):
            after = m + size
            begin[after[after < n]] = True
            begin[n] = True
    return np.flatnonzero(begin[:n])


class Vocabulary:
    """Ranks by token, the hash table of mergeable pairs, and the tokens' bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << T.U(32)) | np.array(right, np.uint64)
        self.shift = T.U(64 - max(4, int(np.ceil(np.log2(4 * len(keys) + 16)))))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size + 64, np.iinfo(np.uint64).max, np.uint64), np.full(size + 64, NONE, np.int32)
        self.probes = 1
        slot = self.slot(keys)
        for k, s, v in zip(keys.tolist(), slot.tolist(), made, strict=True):
            step = 0
            while self.keys[s + step] != np.iinfo(np.uint64).max:
                step += 1
            self.keys[s + step], self.values[s + step] = k, v
            self.probes = max(self.probes, step + 1)
        self.text: dict[bytes, list[int]] = {}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * T.U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, which is the merged id too; NONE if they don't merge."""
        keys = (left.astype(np.uint64) << T.U(32)) | right.astype(np.uint64)
        s = self.slot(keys)
        out = np.where(self.keys[s] == keys, self.values[s], NONE)
        for step in range(1, self.probes):
            missing = np.flatnonzero((out == NONE) & (self.keys[s + step - 1] != np.iinfo(np.uint64).max))
            if not len(missing):
                break
            hit = missing[self.keys[s[missing] + step] == keys[missing]]
            out[hit] = self.values[s[hit] + step]
        return out

    def merge_rows(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged rows of a padded matrix of byte ids, and their sizes; in every round a row's leftmost pair of least rank becomes one."""
        n, width = ids.shape
        out, out_size = ids.copy(), size.copy()
        row = np.arange(n)
        column = np.arange(width)
        pair = np.full((n, width), NONE, np.int32)
        if width > 1:
            inner = column[None, :-1] < size[:, None] - 1
            pair[:, :-1][inner] = self.rank(ids[:, :-1][inner], ids[:, 1:][inner])
        while len(row):
            best = pair.argmin(axis=1)
            here = np.arange(len(row))
            rank = pair[here, best]
            done = rank == NONE
            if done.any():
                out[row[done], : ids.shape[1]], out_size[row[done]] = ids[done], size[done]
                keep = ~done
                row, ids, size, pair, best, rank = row[keep], ids[keep], size[keep], pair[keep], best[keep], rank[keep]
                here = np.arange(len(row))
                if not len(row):
                    break
            ids[here, best] = rank
            # close the gap: everything behind the merged pair moves one to the left
            take = column[None, :-1] + (column[None, :-1] > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, take, 1)
            take_pair = column[None, :-1] + (column[None, :-1] > best[:, None])
            pair[:, :-1] = np.take_along_axis(pair, take_pair, 1)
            pair[:, -1] = NONE
            size = size - 1
            for where, ok in ((best - 1, best > 0), (best, best < size - 1)):
                r = here[ok]
                pair[r, where[ok]] = self.rank(ids[r, where[ok]], ids[r, where[ok] + 1])
            end = here[best >= size - 1]
            pair[end, best[end]] = NONE
            if size.max() < ids.shape[1] * 3 // 4:
                width = max(1, int(size.max()))
                ids, pair, column = ids[:, :width].copy(), pair[:, :width].copy(), column[:width]
        return out, out_size

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges for one long piece. pair[r, c] is the rank of the token at (r, c) with the one behind it, which may begin a later row."""
        width, n = LONG_PIECE, len(data)
        rows = -(-n // width)
        ids = np.zeros((rows, width), np.int32)
        ids.ravel()[:n] = self.of_byte[np.frombuffer(data, np.uint8)]
        pair = np.full((rows, width), NONE, np.int32)
        pair.ravel()[: n - 1] = self.rank(ids.ravel()[: n - 1], ids.ravel()[1:n])
        size = np.full(rows, width)
        size[-1] = n - (rows - 1) * width
        least = pair.min(axis=1)
        after, before = list(range(1, rows + 1)), list(range(-1, rows - 1))  # rows that aren't empty

        def close(r: int, c: int) -> None:
            k = size[r]
            ids[r, c : k - 1], pair[r, c : k - 1] = ids[r, c + 1 : k], pair[r, c + 1 : k]
            pair[r, k - 1] = NONE
            size[r] = k - 1
            if k == 1:
                if before[r] >= 0:
                    after[before[r]] = after[r]
                if after[r] < rows:
                    before[after[r]] = before[r]

        def refresh(r: int, c: int) -> None:
            """The rank of the pair that begins at (r, c)."""
            nxt = (r, c + 1) if c + 1 < size[r] else (after[r], 0)
            pair[r, c] = self.rank(ids[r, c : c + 1], ids[nxt[0], nxt[1] : nxt[1] + 1])[0] if nxt[0] < rows else NONE
            least[r] = pair[r].min()

        while True:
            r = int(least.argmin())
            if least[r] == NONE:
                return [x for k in range(rows) for x in ids[k, : size[k]].tolist()]
            c = int(pair[r].argmin())
            ids[r, c] = least[r]
            gone = (r, c + 1) if c + 1 < size[r] else (after[r], 0)
            close(*gone)
            if gone[0] != r:
                least[gone[0]] = pair[gone[0]].min()
            refresh(r, c)
            if c:
                refresh(r, c - 1)
            elif before[r] >= 0:
                refresh(before[r], size[before[r]] - 1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(size > LONG_PIECE):
            out[i] = self.merge_long(pieces[i])
        low = 0
        while low < LONG_PIECE:  # length buckets: 1-4, 5-8, 9-12, ... and wider ones for rare lengths
            high = low + max(4, low // 2)
            rows = np.flatnonzero((size > low) & (size <= min(high, LONG_PIECE)))
            for part in np.array_split(rows, max(1, len(rows) * high // 2_000_000)):
                if len(part):
                    flat = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
                    inside = np.arange(high)[None, :] < size[part, None]
                    ids = np.zeros(inside.shape, np.int32)
                    ids[inside] = self.of_byte[flat]
                    ids, n = self.merge_rows(ids, size[part].copy())
                    for i, x, k in zip(part.tolist(), ids.tolist(), n.tolist(), strict=True):
                        out[i] = x[:k]
            low = high
        return out

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[list[list[int]]]:
        """For each row the lists of its pieces' ids."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        wide = np.cumsum(np.concatenate([[0], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)]))
        starts = split(points, np.searchsorted(wide, at))
        a = wide[starts]
        b = np.append(a[1:], len(data)).astype(np.int64)
        _, where, same = np.unique(T.hashed(data, a, b), return_index=True, return_inverse=True)
        # pieces of one hash are compared by their bytes; one that differs from its hash's first piece stands for itself
        size, lead = b - a, where[same]
        owner = np.repeat(np.arange(len(a)), size)
        differs = size != size[lead]
        differs[owner[data != data[np.minimum((a[lead] - a)[owner] + np.arange(len(data)), len(data) - 1)]]] = True
        odd = np.flatnonzero(differs)
        same[odd] = len(where) + np.arange(len(odd))
        parts = [raw[a[i] : b[i]] for i in (*where.tolist(), *odd.tolist())]
        if len(self.text) > REMEMBERED:
            self.text.clear()
        new = [p for p in parts if p not in self.text]
        made = dict(zip(new, self.encode_pieces(new), strict=True))
        lists = [made[p] if p in made else self.text[p] for p in parts]
        self.text.update((p, x) for p, x in made.items() if len(p) <= LONGEST_REMEMBERED)
        got = list(map(lists.__getitem__, same.tolist()))
        first = np.searchsorted(a, at)
        for i in range(len(at) - 1):
            yield got[first[i] : first[i + 1]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once in each process; the file is installed on every machine."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(read_ranks(path))
    return _loaded[path]


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """All columns of docs with `ids` (array<int>) and `decoded` (binary, the decoded ids) put in front.

    Null and empty texts have no ids and decode to nothing. Every row gives one row; equal texts give equal ids. Columns of docs
    named ids or decoded are replaced. Whole texts are encoded, whatever their length.
    """
    _shared.small_batches(docs.sparkSession)
    rest = [f for f in docs.schema if f.name not in ("ids", "decoded")]
    names = ["ids", "decoded", *(f.name for f in rest)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for part, data, at in T.pieces(batches, "text", TOGETHER):
            ids = [[i for p in row for i in p] for row in own.encode(data, at)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary()), *(part[f.name] for f in rest)], names)

    return docs.select(*(f.name for f in rest)).mapInArrow(T.thrifty(coded), "ids array<int>, decoded binary, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: tokenize() without shipping the ids out of the Python worker."""
    _shared.small_batches(docs.sparkSession)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        spelled = [str(i) for i in range(len(own.tokens))]
        for part, data, at in T.pieces(batches, "text", TOGETHER):
            n, ids_sha, decoded_sha = [], [], []
            for row in own.encode(data, at):
                ids = [i for p in row for i in p]
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(T.thrifty(coded), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
