"""Media columns: ISO base media containers, their sample tables, and byte ranges of key frames.

parse() walks the nested boxes of a container and decodes each track's sample tables into codec, duration and the byte range of every
sample; payloads are never decoded. pack() writes a video track of uncompressed 24 x 24 frames of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _shared, _text as T

FRAME = 576
SIDE = 24
#: Each so-many-th frame can be decoded alone.
KEY_EVERY = 12
FRAMES_PER_CHUNK = 64
TIMESCALE = 25
#: Boxes that hold boxes, and how many bytes stand before these.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
DEEPEST = 16


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    #: sizes of the samples one by one, or none of them and (size of each, how many)
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    same: tuple[int, int] = (0, 0)
    chunk_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: (first chunk from 1, samples in a chunk) runs
    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    #: (number of samples, duration of each) runs
    times: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    #: key samples from 1; None: all
    keys: np.ndarray | None = None
    #: duration, size and flags of a fragment's samples where nothing else says
    usual: tuple[int, int, int] = (0, 0, 0)
    #: samples of fragments: (start, size, whether it is a key) arrays
    fragments: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    fragment_duration: int = 0

    def samples(self) -> int:
        return len(self.size) + self.same[1] + sum(len(f[0]) for f in self.fragments)

    def seconds_over(self) -> int:
        """The duration that the track states, or that of its fragments."""
        return self.duration or self.fragment_duration

    def _chunks(self) -> np.ndarray:
        """Samples of each chunk."""
        if not len(self.chunk_at) or not len(self.runs):
            return np.zeros(0, np.int64)
        until = np.append(self.runs[1:, 0] - 1, len(self.chunk_at))
        each = np.repeat(self.runs[:, 1], np.clip(until - (self.runs[:, 0] - 1), 0, len(self.chunk_at)))[: len(self.chunk_at)]
        left = (len(self.size) or self.same[1]) - np.concatenate([[0], np.cumsum(each)[:-1]])
        return np.clip(each, 0, np.maximum(left, 0))

    def starts(self, own: np.ndarray | None = None) -> np.ndarray:
        """Byte offset of each sample of the tables (or of those counted from 0): its chunk's offset and the sizes of the samples before it in the chunk."""
        each = self._chunks()
        n = int(each.sum())
        own = np.arange(n if len(self.size) or own is None else 0) if own is None else own
        if not n or not len(own):
            return np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(each)])
        of = np.searchsorted(first, own, "right") - 1
        if len(self.size):
            before = np.concatenate([[0], np.cumsum(self.size)])
            return self.chunk_at[of] + before[own] - before[first[of]]
        return self.chunk_at[of] + (own - first[of]) * self.same[0]

    def key_ranges(self) -> list[tuple[int, int]]:
        """(first byte, byte behind the last) of each key sample. Where all of a track's samples are keys, neighbours in the file are one range."""
        each = self._chunks()
        n = int(each.sum())
        if self.keys is None:
            before = np.concatenate([[0], np.cumsum(self.size)]) if len(self.size) else None
            last = np.cumsum(each)
            length = before[last] - before[last - each] if before is not None else each * self.same[0]
            parts = [(self.chunk_at[: len(each)], length)] if n else []
        else:
            own = self.keys[(self.keys >= 1) & (self.keys <= n)] - 1
            parts = [(self.starts(own), self.size[own] if len(self.size) else np.full(len(own), self.same[0]))]
        parts += [(start[key], size[key]) for start, size, key in self.fragments]
        out: list[tuple[int, int]] = []
        for start, size in parts:
            for x, k in zip(start.tolist(), size.tolist(), strict=True):
                if out and self.keys is None and not self.fragments and out[-1][1] == x:
                    out[-1] = (out[-1][0], x + k)
                elif k:
                    out.append((x, x + k))
        return out


@dataclass
class Media:
    brand: str = ""
    tracks: list[Track] = field(default_factory=list)
    #: What was wrong, in order; the rest was read all the same.
    errors: list[str] = field(default_factory=list)


def _ints(data: bytes, at: int, count: int, kind: str, errors: list[str], name: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if at + count * width > len(data):
        errors.append(f"{name}: table is cut short")
        count = max(0, (len(data) - at) // width)
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def parse(data: bytes) -> Media:
    """Boxes and sample tables of a container. Broken or cut boxes end their parent and are listed; nothing is raised."""
    out = Media()

    usual: dict[int, tuple[int, int, int]] = {}
    moof = [0]

    def fragment(kind: bytes, b: bytes, own: dict) -> None:
        """tfhd says what a fragment's samples share, trun has those that differ; a run without an offset goes on behind the one before it."""
        flags = struct.unpack_from(">I", b, 0)[0] & 0xFFFFFF
        if kind == b"tfhd":
            number, at = struct.unpack_from(">I", b, 4)[0], 8
            own["track"] = next((t for t in out.tracks if t.number == number), None)
            values = [None, *usual.get(number, (0, 0, 0))]
            own["at"] = moof[0]
            for i, (bit, kind_) in enumerate(((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I"))):
                if flags & bit:
                    value = struct.unpack_from(kind_, b, at)[0]
                    at += struct.calcsize(kind_)
                    if i == 0:
                        own["at"] = value
                    elif i > 1:
                        values[i - 1] = value
            own["usual"], own["next"] = values[1:], own["at"]
            return
        track = own.get("track")
        if track is None:
            out.errors.append("trun: no track")
            return
        count, at = struct.unpack_from(">I", b, 4)[0], 8
        start = own["next"]
        if flags & 1:
            start, at = own["at"] + struct.unpack_from(">i", b, at)[0], at + 4
        first = None
        if flags & 4:
            first, at = struct.unpack_from(">I", b, at)[0], at + 4
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        table = _ints(b, at, count * len(columns), ">u4", out.errors, "trun")
        if columns:
            count = len(table) // len(columns)
            table = table[: count * len(columns)].reshape(count, len(columns))
        elif not own["usual"][1] or count * own["usual"][1] > len(data):
            out.errors.append("trun: samples without sizes")
            return
        value = lambda bit, usual_: table[:, columns.index(bit)] if bit in columns else np.full(count, usual_, np.int64)
        size, marks = value(0x200, own["usual"][1]), value(0x400, own["usual"][2])
        if first is not None and count:
            marks = marks.copy()
            marks[0] = first
        own["next"] = start + int(size.sum())
        track.fragments.append((start + np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)[:count], size, marks & 0x10000 == 0))
        track.fragment_duration += int(value(0x100, own["usual"][0]).sum())

    def walk(at: int, end: int, depth: int, track: Track | dict | None) -> None:
        while at + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            elif size == 0:
                size = end - at
            if size < head or at + size > end:
                out.errors.append(f"{kind.decode('latin-1')}: size {size} at {at}")
                return
            body, stop = at + head, at + size
            if kind in NESTED and depth < DEEPEST:
                own = {} if kind == b"traf" else track
                if kind == b"moof":
                    moof[0] = at
                if kind == b"trak":
                    own = Track()
                    out.tracks.append(own)
                walk(body + NESTED[kind], stop, depth + 1, own)
            else:
                try:
                    if kind in (b"tfhd", b"trun") and isinstance(track, dict):
                        fragment(kind, data[body:stop], track)
                    elif not isinstance(track, dict):
                        table(kind, data[body:stop] if kind in (b"ftyp", b"tkhd", b"trex", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss") else b"", track)
                except struct.error:
                    out.errors.append(f"{kind.decode('latin-1')}: too short")
            at = stop

    def table(kind: bytes, b: bytes, track: Track | None) -> None:
        if kind == b"ftyp":
            out.brand = b[:4].decode("latin-1")
        elif kind == b"trex":
            number, _, *own = struct.unpack_from(">5I", b, 4)
            usual[number] = tuple(own)
        elif track is None:
            return
        elif kind == b"tkhd":
            track.number = struct.unpack_from(">I", b, 20 if b[:1] == b"\1" else 12)[0]
        elif kind == b"mdhd":
            track.timescale, track.duration = struct.unpack_from(">IQ", b, 20) if b[:1] == b"\1" else struct.unpack_from(">II", b, 12)
        elif kind == b"hdlr":
            track.handler = b[8:12].decode("latin-1")
        elif kind == b"stsd":
            if struct.unpack_from(">I", b, 4)[0]:
                track.codec = struct.unpack_from(">4s", b, 12)[0].decode("latin-1")
        elif kind == b"stsz":
            same, count = struct.unpack_from(">II", b, 4)
            if same:
                track.same = (same, count)
            else:
                track.size = _ints(b, 12, count, ">u4", out.errors, "stsz")
        elif kind in (b"stco", b"co64"):
            track.chunk_at = _ints(b, 8, struct.unpack_from(">I", b, 4)[0], ">u4" if kind == b"stco" else ">u8", out.errors, kind.decode())
        elif kind == b"stsc":
            track.runs = _ints(b, 8, 3 * struct.unpack_from(">I", b, 4)[0], ">u4", out.errors, "stsc")
            track.runs = track.runs[: len(track.runs) // 3 * 3].reshape(-1, 3)[:, :2]
        elif kind == b"stts":
            track.times = _ints(b, 8, 2 * struct.unpack_from(">I", b, 4)[0], ">u4", out.errors, "stts")
            track.times = track.times[: len(track.times) // 2 * 2].reshape(-1, 2)
        elif kind == b"stss":
            track.keys = _ints(b, 8, struct.unpack_from(">I", b, 4)[0], ">u4", out.errors, "stss")

    walk(0, len(data), 0, None)
    return out


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def pack(payload: bytes) -> bytes:
    """A container with one video track whose frames are the payload's blocks of 576 bytes."""
    frames = len(payload) // FRAME
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    full = bytes(4)
    chunks = -(-frames // FRAMES_PER_CHUNK)
    tail = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK if chunks > 1 else tail, 1)] + ([(chunks, tail, 1)] if chunks > 1 and tail != FRAMES_PER_CHUNK else [])
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", SIDE, SIDE, 72 << 16, 72 << 16), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, 33))

    def head(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = (first + np.arange(chunks, dtype=np.int64) * FRAME * FRAMES_PER_CHUNK).astype(">u8" if wide else ">u4")
        stbl = box(
            b"stbl", box(b"stsd", full, struct.pack(">I", 1), entry), box(b"stts", full, struct.pack(">III", 1, frames, 1)),
            box(b"stsc", full, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), box(b"stsz", full, struct.pack(">II", FRAME, frames)),
            box(b"co64" if wide else b"stco", full, struct.pack(">I", chunks), offsets.tobytes()), box(b"stss", full, struct.pack(">I", len(keys)), keys.tobytes()),
        )
        media = box(
            b"mdia", box(b"mdhd", full, struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), box(b"hdlr", full, bytes(4), b"vide", bytes(12), b"\0"),
            box(b"minf", box(b"vmhd", struct.pack(">I", 1), bytes(8)), box(b"dinf", box(b"dref", full, struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))), stbl),
        )
        track = box(b"trak", box(b"tkhd", struct.pack(">I", 7), struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), unity, struct.pack(">II", SIDE << 16, SIDE << 16)), media)
        movie = box(b"moov", box(b"mvhd", full, struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2)), track)
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ") + movie

    first = len(head(0)) + 8
    return head(first) + box(b"mdat", payload)


def read_samples(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order, as the tables place them."""
    each = track._chunks()
    last = np.cumsum(each)
    before = np.concatenate([[0], np.cumsum(track.size)]) if len(track.size) else None
    length = before[last] - before[last - each] if before is not None else each * track.same[0]
    parts = [data[a : a + n] for a, n in zip(track.chunk_at[: len(each)].tolist(), length.tolist(), strict=True)]  # a chunk's samples are neighbours
    return b"".join([*parts, *(data[a : a + n] for start, size, _ in track.fragments for a, n in zip(start.tolist(), size.tolist(), strict=True))])


RANGES = "array<struct<first:long,end:long>>"
MEDIA = f"brand string, codec string, timescale long, duration long, samples long, key_ranges {RANGES}, tracks array<struct<handler:string,codec:string,timescale:long,duration:long,samples:long,key_ranges:{RANGES}>>, errors array<string>"


def describe(rows: DataFrame, media: str) -> DataFrame:
    """All columns of rows but `media` (binary) with brand, tracks and errors in front, and codec, timescale, duration, samples and key_ranges of the first track.

    Every track is described, those whose samples stand in fragments too.

    Null and empty media have no track: empty codec, zero duration, no ranges. Broken containers give what could be read, and errors.
    Every row gives one row; other columns of these names are replaced.
    """
    names = ["brand", "codec", "timescale", "duration", "samples", "key_ranges", "tracks", "errors"]
    rest = [f for f in rows.schema if f.name not in (*names, media)]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    track_kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("key_ranges", kind)]))
    _shared.small_batches(rows.sparkSession)

    def said(t: Track) -> dict:
        return {"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.seconds_over(), "samples": t.samples(), "key_ranges": [{"first": a, "end": b} for a, b in t.key_ranges()]}

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [parse(x.as_py() or b"") for x in part[media]]
            every = [[said(t) for t in m.tracks] for m in found]
            first = [t[0] if t else said(Track()) for t in every]
            column = lambda c, k: pa.array([t[c] for t in first], k)
            made = [pa.array([m.brand for m in found], pa.string()), column("codec", pa.string()), *(column(c, pa.int64()) for c in ("timescale", "duration", "samples")), column("key_ranges", kind)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(every, track_kind), pa.array([m.errors for m in found], pa.list_(pa.string())), *(part[f.name] for f in rest)], [*names, *(f.name for f in rest)])

    return rows.select(media, *(f.name for f in rest)).mapInArrow(walked, MEDIA + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest))


def stored(docs: DataFrame) -> DataFrame:
    """Each text packed as a container, read back and digested; one row for each row of docs(doc_id, text), a null text counts as empty."""
    _shared.small_batches(docs.sparkSession)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in T.pieces(batches, "text"):
            raw = data.tobytes()
            out: list[list] = [[] for _ in range(7)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                size = max(FRAME, -(-(b - a) // FRAME) * FRAME)
                media = pack(raw[a:b] + b"\xff" * (size - (b - a)))
                track = parse(media).tracks[0]
                payload = read_samples(media, track)
                ranges = track.key_ranges()
                feature = f"{track.codec.strip()};{track.duration}/{track.timescale};{track.samples()};" + ",".join(f"{x}-{y}" for x, y in ranges)
                for column, value in zip(out, (b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
