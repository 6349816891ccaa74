"""Choices against a window-by-window walk; the next document against a sorted list."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from veristrata.llm import winnowing as Wn


def walk(hashes):
    """Positions and run hashes chosen by the definition."""
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1)
    runs = []
    for i in range(max(1, len(hashes) - 3) if hashes else 0):
        x = 0
        own = hashes[i : i + 4]
        for j, h in enumerate(own):
            x ^= rot(h, len(own) - 1 - j) if len(own) == 4 else 0
        runs.append(x if len(own) == 4 else None)
    return runs


def test_choices(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["x" * 100, "", None, " \n ", "One", "ONE two", "a b c", "a a a a a a a a a a a a a a a a a a a a"]
    units = [re.findall(r"\S{1,16}", (t or "").lower()) for t in texts]
    words = sorted({u for us in units for u in us})
    hashed = {r["w"]: r["h"] % 2**64 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    rows = Wn.with_choices(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "c").select("i", Wn.fingerprint("c").alias("f")).collect()
    for r in rows:
        us = [hashed[u] for u in units[r["i"]]]
        runs = walk(us)
        got = [(x["hash"], x["position"]) for x in r["f"]]
        if len(us) < 4:
            assert len(got) == (1 if us else 0)
            continue
        want = []
        for a in range(max(1, len(runs) - 7)):
            window = [(x >> 31, -(a + j)) for j, x in enumerate(runs[a : a + 8])]
            best = min(window)
            if (best[0], -best[1]) not in want:
                want.append((best[0], -best[1]))
        assert got == want, texts[r["i"]]


def test_query(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 300)
    rows = [(ids[i], " ".join(rng.choice(["der", "die", "é𝒳", "zwei", "x%d" % rng.randrange(50)]) for _ in range(rng.randint(0, 80))), i) for i in range(300)]
    rows += [(-5, None, 1), (10**7, "", 1), (None, "null id here and more", 1), (3, "same text", 0), (3, "same text", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chosen int").repartition(5)
    got = Wn.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    long = [r for r in got if r["n_chars"] > 120]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.35 and all(0 <= r["near_next"] <= 1 for r in got)
    assert Wn.fingerprints(docs.limit(0)).count() == 0
    one = Wn.fingerprints(docs.filter("doc_id = 10000000")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["fingerprint"] == one[0]["positions"] == ""


def test_match_guarantee_and_positions(spark):
    """Any passage of w + k - 1 units in two texts leaves them a hash in common, and the positions point at it in both."""
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(10**6)
    rows, spots = [], []
    for i in range(40):
        passage = [word() for _ in range(Wn.W + Wn.K - 1)]
        a, b = ([word() for _ in range(rng.randint(0, 40))] for _ in range(2))
        spots.append((len(a), len(b)))
        rows += [(2 * i, " ".join(a + passage + [word() for _ in range(9)])), (2 * i + 1, " ".join(b + passage))]
    got = {r["doc_id"]: list(zip(r["fingerprint"].split(), map(int, r["positions"].split()))) for r in Wn.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, b) in enumerate(spots):
        assert any(h == g and p - a == q - b and 0 <= p - a < Wn.W for h, p in got[2 * i] for g, q in got[2 * i + 1])
