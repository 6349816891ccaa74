"""Apportionment against one-by-one giving; the mix against its rules."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from veristrata.llm import mixing as M


def one_by_one(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if out[i] < most[i] and votes[i] > 0]
        if not free:
            break
        out[max(free, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_apportion():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 7)
        votes = [rng.choice([0, 1, 2, 5, rng.random() * 100]) for _ in range(n)]
        most = [rng.randint(0, 60) for _ in range(n)]
        seats = rng.randint(0, 150)
        assert M.apportion(votes, seats, most) == one_by_one(votes, seats, most)


def test_targets():
    assert M.targets([100, 100, 100], [3, 1, 2], 450) == [200.0, 250 / 3, 500 / 3]
    got = M.targets([10, 1000, 5], [3, 1, 2], 1522.5)
    assert got[0] == 20 and got[2] == 10 and abs(sum(got) - 1522.5) < 1e-9
    assert M.targets([], [], 0) == []


def test_mix(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("w%d" % j for j in range(rng.randint(0, 90))), rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]), i, "x") for i in range(600)]
    rows += [(600, None, "a", 1, "x"), (601, "", "a", 1, "y"), (None, "one two", "a", 1, "y"), (5, "again again", "b", 1, "y"), (5, "again again", "b", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, taken string").repartition(3)
    monkeypatch.setattr(M, "SHARD_WORDS", 3000)
    mixed = M.mix(docs)
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, M.mix(docs.repartition(7), texts=False).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    assert len(got) == len(rows)
    total, taken, sizes = sum(r["size"] for r in got), defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
    target = {r["source"]: r["target"] for r in got}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    order = sorted([s for s in target if s is not None]) + [None]
    assert [target[s] for s in order] == M.targets([sizes[s] for s in order], [3, 1, 2, 3, 1, 2][: len(order)], 1.5 * total)
    for s, t in target.items():
        assert abs(taken[s] - t) <= 16 * (2 + -(-sizes[s] // 3000)), s
    # the rows of the mix have just the taken words
    made = M.materialize(M.mix(docs.drop("size", "taken").withColumn("n_chars", F.length("text").cast("long"))))
    assert made.columns == ["doc_id", "text", "source", "n_chars"]
    words = defaultdict(int)
    for r in made.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert len(r["text"]) == r["n_chars"]
    want = defaultdict(int)
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(words)
    assert M.mix(docs.limit(0)).count() == 0
