"""Containers round-trip, tables place every sample, broken files don't raise."""

import hashlib
import random
import struct
import zlib

import pytest

from veristrata.llm import media as M


@pytest.mark.parametrize("frames", [1, 2, 12, 13, 64, 65, 200])
def test_round_trip(frames):
    payload = random.Random(frames).randbytes(frames * M.FRAME)
    data = M.pack(payload)
    got = M.parse(data)
    track = got.tracks[0]
    assert (got.brand, track.codec, track.handler, track.duration, track.timescale, got.errors) == ("isom", "raw ", "vide", frames, 25, [])
    assert M.read_samples(data, track) == payload
    ranges = track.key_ranges()
    assert len(ranges) == -(-frames // M.KEY_EVERY)
    for i, (a, b) in enumerate(ranges):
        assert data[a:b] == payload[i * M.KEY_EVERY * M.FRAME :][: M.FRAME]


def test_uneven_tables_match_a_slow_walk():
    rng = random.Random(3)
    sizes = [rng.randint(1, 9) for _ in range(30)]
    per_chunk, at, i, where = [3, 3, 5, 1, 5, 5, 8], [100, 300, 50, 700, 900, 20, 400], 0, []
    for n, c in zip(per_chunk, at):
        for s in sizes[i : i + n]:
            where.append(c)
            c += s
        i += n
    runs = [(1, 3), (3, 5), (4, 1), (5, 5), (7, 8)]
    full = bytes(4)
    stbl = M.box(b"stbl", M.box(b"stsz", full, struct.pack(">II", 0, 30), *(struct.pack(">I", s) for s in sizes)), M.box(b"co64", full, struct.pack(">I", 7), *(struct.pack(">Q", c) for c in at)), M.box(b"stsc", full, struct.pack(">I", 5), *(struct.pack(">III", a, b, 1) for a, b in runs)), M.box(b"stss", full, struct.pack(">III", 2, 4, 9)))
    track = M.parse(M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.box(b"minf", stbl))))).tracks[0]
    assert track.starts().tolist() == where
    assert track.key_ranges() == [(where[3], where[3] + sizes[3]), (where[8], where[8] + sizes[8])]


def test_broken_files():
    data = M.pack(bytes(M.FRAME * 3))
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(data[: rng.randint(0, 700)])
        for _ in range(rng.randint(0, 6)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        for track in M.parse(bytes(bad)).tracks:
            if track.samples() < 10000:
                track.key_ranges()


def test_query(spark):
    docs = spark.createDataFrame([(1, "é" * 300, 1), (2, None, 1), (3, "", 2), (3, "", 2), (None, "x" * 576, 2)], "doc_id long, text string, feature int")
    rows = M.stored(docs).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: "é" * 300, 2: "", 3: "", None: "x" * 576}[r["doc_id"]].encode()
        payload = text + b"\xff" * ((-len(text)) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(M.pack(payload)).hexdigest()
    assert M.stored(docs.limit(0)).count() == 0


def test_describe(spark):
    rows = spark.createDataFrame([(1, bytearray(M.pack(bytes(M.FRAME * 13))), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id long, m binary, codec string")
    got = {r["id"]: r for r in M.describe(rows, "m").collect()}
    assert got[1]["samples"] == 13 and len(got[1]["key_ranges"]) == 2 and got[2]["codec"] == "" and got[3]["key_ranges"] == []


def test_every_track_and_constant_sizes(spark):
    """Two tracks: one of PCM samples whose table says a size once, however many there are, and one with a key."""
    full = bytes(4)
    n = 5_000_000_000 // 4

    def track(number, handler, codec, *tables):
        stbl = M.box(b"stbl", M.box(b"stsd", full, struct.pack(">I", 1), M.box(codec, bytes(20))), *tables)
        media = M.box(b"mdia", M.box(b"mdhd", full, struct.pack(">IIII", 0, 0, 48000, 77)), M.box(b"hdlr", full, bytes(4), handler, bytes(12)), M.box(b"minf", stbl))
        return M.box(b"trak", M.box(b"tkhd", full, struct.pack(">III", 0, 0, number), bytes(70)), media)

    sound = track(1, b"soun", b"sowt", M.box(b"stsz", full, struct.pack(">II", 4, n)), M.box(b"co64", full, struct.pack(">IQQ", 2, 1000, 1000 + 4 * (n // 2))), M.box(b"stsc", full, struct.pack(">IIII", 1, 1, n // 2, 1)))
    sight = track(2, b"vide", b"avc1", M.box(b"stsz", full, struct.pack(">IIII", 0, 2, 7, 9)), M.box(b"stco", full, struct.pack(">II", 1, 50)), M.box(b"stsc", full, struct.pack(">IIII", 1, 1, 2, 1)), M.box(b"stss", full, struct.pack(">II", 1, 2)))
    rows = spark.createDataFrame([(1, bytearray(M.box(b"moov", sound, sight)))], "id int, m binary")
    got = M.describe(rows, "m").first()
    assert [(t["handler"], t["codec"], t["samples"]) for t in got["tracks"]] == [("soun", "sowt", n), ("vide", "avc1", 2)] and got["codec"] == "sowt"
    assert [tuple(r) for r in got["tracks"][0]["key_ranges"]] == [(1000, 1000 + 4 * (n // 2) * 2)] and [tuple(r) for r in got["tracks"][1]["key_ranges"]] == [(57, 66)]


def test_fragments():
    full = bytes(4)
    trak = M.box(b"trak", M.box(b"tkhd", full, struct.pack(">III", 0, 0, 3), bytes(70)), M.box(b"mdia", M.box(b"mdhd", full, struct.pack(">IIII", 0, 0, 1000, 0))))
    head = M.box(b"moov", trak, M.box(b"mvex", M.box(b"trex", full, struct.pack(">5I", 3, 1, 40, 5, 0x10000))))

    def moof(offset):
        one = M.box(b"trun", struct.pack(">III", 0x705, 3, offset), struct.pack(">I", 0), struct.pack(">9I", 10, 4, 0x10000, 10, 6, 0x10000, 20, 8, 0))
        two = M.box(b"trun", struct.pack(">II", 0, 2))
        return M.box(b"moof", M.box(b"traf", M.box(b"tfhd", struct.pack(">II", 0x20000, 3)), one, two))

    size = len(moof(0))
    data = head + moof(size + 8) + M.box(b"mdat", b"aaaabbbbbbccccccccdddddeeeee")
    got = M.parse(data)
    track = got.tracks[0]
    assert got.errors == [] and track.samples() == 5 and track.seconds_over() == 10 + 10 + 20 + 80
    assert [data[a:b] for a, b in track.key_ranges()] == [b"aaaa", b"cccccccc"] and M.read_samples(data, track) == b"aaaabbbbbbccccccccdddddeeeee"
    assert M.parse(M.box(b"moof", M.box(b"traf", M.box(b"trun", struct.pack(">II", 0, 1))))).errors == ["trun: no track"]
