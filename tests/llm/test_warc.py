"""Archives round-trip; damage costs only what it touches."""

import hashlib
import random
import time

from veristrata.llm import warc as W


def archive(payloads, plain=False):
    made = [W.record("response", [("WARC-Record-ID", f"<urn:page:{i}>")], p) for i, p in enumerate(payloads)]
    return made if plain else [W.member(m) for m in made]


def test_round_trip_and_damage():
    rng = random.Random(6)
    payloads = [rng.randbytes(rng.randint(0, 400)) + b"WARC/1.0\n\x1f\x8b\x08" for _ in range(40)]
    for plain in (False, True):
        parts = archive(payloads, plain)
        data = b"".join(parts)
        assert [f.block for f in W.read(data)] == payloads
        starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        for _ in range(60):
            hurt = rng.sample(range(40), rng.randint(1, 5))
            bad = bytearray(data)
            for i in hurt:
                bad[rng.randrange(starts[i] + 30, starts[i + 1] - 12)] ^= 0xFF
            found = list(W.read(bytes(bad)))
            assert sum(f.length for f in found) == len(data)
            good = {f.offset for f in found if f.type == "response"}
            assert {starts[i] for i in range(40) if i not in hurt} <= good
            assert any(f.type == "gap" for f in found) or plain
        # bytes lost or added in the middle
        cut = data[: starts[10] + 15] + data[starts[10] + 25 : starts[20]] + b"junk" + data[starts[20] :]
        found = list(W.read(cut))
        assert [f.block for f in found if f.type == "response"] == payloads[:10] + payloads[11:]
        assert len([f for f in found if f.type == "gap"]) == 2 and all(f.reason for f in found if f.type == "gap")
    assert list(W.read(b"")) == [] and [f.type for f in W.read(b"nothing here")] == ["gap"]


def test_members_of_several_records():
    rng = random.Random(8)
    payloads = [rng.randbytes(rng.randint(100, 900)) for _ in range(30)]
    parts = archive(payloads, True)
    blocks = lambda data: [f.block for f in W.read(data) if f.type == "response"]
    gaps = lambda data: [f.reason for f in W.read(data) if f.type == "gap"]
    bad = bytearray(parts[12])
    bad[-60] ^= 0xFF
    one = W.member(b"".join([*parts[:12], bytes(bad), *parts[13:]]))
    assert blocks(one) == payloads[:12] + payloads[13:] and len(gaps(one)) == 1 and "digest" in gaps(one)[0]
    whole, after = W.member(b"".join(parts)), W.member(archive([b"after"], True)[0])
    assert blocks(whole + after) == [*payloads, b"after"] and not gaps(whole + after)
    cut = whole[: len(whole) * 2 // 3]
    assert len(blocks(cut)) >= 17 and blocks(cut) == payloads[: len(blocks(cut))] and gaps(cut)
    # a wrong checksum costs nothing that has a digest
    wrong = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert blocks(wrong + after) == [*payloads, b"after"] and gaps(wrong + after)
    assert sum(f.length for f in W.read(wrong + after)) == len(wrong + after)


def test_query(spark):
    big, small = "<p>" + "é" * 90, "<p>short"
    rows = [(7, "u", big, 1), (3, "u", big, 1), (9, None, big, 2), (9, None, big, 2), (4, "a\r\nb", small, 1), (5, "", small, 1), (6, "x", None, 1), (None, "x", big, 1), (3, "u", big, 1), (8, "u", "x" * 50_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = W.read_archives(W.write_archives(W.deduplicated(pages))).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [h for i, _, h, _ in rows if i == r["page_id"]][0] or ""
        assert r["payload_bytes"] == len(own.encode()) and r["payload_digest"] == hashlib.sha256(own.encode()).hexdigest()
        assert r["refers_to"] == (3 if own == big and r["page_id"] != 3 else None)
        assert r["type"] == ("revisit" if r["refers_to"] else "response")
        if r["type"] == "response":
            assert bytes(r["payload"]) == own.encode()
    named = pages.filter("page_id in (3, 7)").selectExpr("concat('p/', page_id) as page_id", "url", "html")
    got = W.read_archives(W.write_archives(W.deduplicated(named)), page_id="string").collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in got) == [("p/3", None), ("p/3", None), ("p/7", "p/3")]
    assert W.read_archives(W.write_archives(W.deduplicated(pages.limit(0)))).count() == 0


def test_large_archives_take_linear_time():
    payloads = [bytes([i % 251]) * 300_000 + random.Random(i).randbytes(20_000) for i in range(400)]
    for plain in (False, True):
        data = b"".join(archive(payloads, plain))
        began = time.process_time()
        assert sum(1 for f in W.read(data) if f.type == "response") == 400
        assert time.process_time() - began < 8
