"""Losses against models counted with dictionaries."""

import math
import random
from collections import Counter

from veristrata.llm import lm_score as L


def slow(texts):
    one, two, ctx, three, head = Counter(), Counter(), Counter(), Counter(), Counter()

    def walk(t):
        s = [32, 32, *(t or "").encode().lower(), L.END]
        return [(s[i - 2], s[i - 1], s[i]) for i in range(2, len(s))]

    for t in texts:
        for a, b, c in walk(t):
            one[c] += 1
            two[b, c] += 1
            ctx[b] += 1
            three[a, b, c] += 1
            head[a, b] += 1
    total = sum(one.values())

    def loss(t):
        out = []
        for a, b, c in walk(t):
            uni = one[c] / max(total, 1)
            p = L.MIX[2] * uni + (1 - sum(L.MIX)) / L.SYMBOLS + L.MIX[1] * (two[b, c] / ctx[b] if ctx[b] else uni)
            p = p + L.MIX[0] * three[a, b, c] / head[a, b] if head[a, b] else p * (1 + L.MIX[0] / (1 - L.MIX[0]))
            out.append(-math.log(p))
        return sum(out) / len(out)

    return loss


def test_scores(spark):
    rng = random.Random(1)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
    docs = [(i, make("abcd é"), 1.0) for i in range(60)] + [(60, None, 1.0), (61, "", 1.0), (62, "Zzz", 0.0), (62, "Zzz", 0.0), (None, make("xy"), 0.0)]
    target = [(make("ab "),) for _ in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double").repartition(3)
    goal = spark.createDataFrame(target, "text string")
    got = L.score_difference(df, L.fit_model(goal), L.fit_model(df)).collect()
    a, b = slow([t for t, in target]), slow([t for _, t, _ in docs])
    want = sorted((str(d), round(a(t), 9), round(b(t), 9), round(a(t) - b(t), 9)) for d, t, _ in docs)
    near = sorted((str(r["doc_id"]), round(r["loss_target"], 9), round(r["loss_background"], 9), round(r["score"], 9)) for r in got)
    assert len(near) == len(want) and all(x[0] == y[0] and all(abs(p - q) < 1e-8 for p, q in zip(x[1:], y[1:])) for x, y in zip(near, want))
    none = L.fit_model(goal.limit(0))
    assert {round(r["score"], 12) for r in L.score_difference(df, none, none).collect()} == {0.0}
    assert L.score_difference(df.limit(0), none, none).count() == 0


def test_probabilities_sum_to_one(spark):
    import numpy as np

    m = L.fit_model(spark.createDataFrame([("abcabd",), ("b",)], "text string"))
    for a, b in ((97, 98), (32, 97), (120, 121), (120, 98)):
        assert abs(np.exp(-m.loss((np.int64(a) * 257 + b) * 257 + np.arange(257))).sum() - 1) < 1e-9


def test_word_pairs(spark, monkeypatch):
    """Word-pair losses against dictionaries, with and without hot pairs; what is gathered grows with the corpus."""
    rng = random.Random(3)
    make = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "delta,", "naïve", f"w{rng.randrange(400)}"]) for _ in range(n))
    docs = [(i, make(rng.randint(0, 40))) for i in range(80)] + [(80, None), (81, ""), (82, "alpha beta gamma"), (82, "alpha beta gamma"), (None, "zeta")]
    target = [make(12) for _ in range(6)]

    def walk(t):
        w = ["<", *"".join(c if c.isalnum() else " " for c in (t or "").lower()).split(), ">"]
        return list(zip(w, w[1:]))

    def slow(texts):
        two, one, head = Counter(), Counter(), Counter()
        for t in texts:
            for a, b in walk(t):
                two[a, b] += 1
                one[b] += 1
                head[a] += 1

        def loss(t):
            out = []
            for a, b in walk(t):
                p = L.WORD_MIX[1] * one[b] / max(sum(one.values()), 1) + (1 - sum(L.WORD_MIX)) / L.TEXT_START
                out.append(-math.log(L.WORD_MIX[0] * two[a, b] / head[a] + p if head[a] else p / (1 - L.WORD_MIX[0])))
            return sum(out) / len(out)

        return loss

    a, b = slow(target), slow([t for _, t in docs])
    want = sorted((str(d), len(walk(t)), a(t), b(t)) for d, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for hot, held in ((L.HOT, L.HELD), (20, 50)):
        monkeypatch.setattr(L, "HOT", hot)
        monkeypatch.setattr(L, "HELD", held)
        words = L.word_statistics(spark.createDataFrame([(t,) for t in target], "text string"), df)
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["loss_target"], r["loss_background"]) for r in L.word_score(df, words).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(p - q) < 1e-9 for x, y in zip(got, want) for p, q in zip(x[2:], y[2:]))
    assert L.word_score(df.limit(0), words).count() == 0
    size = lambda rows: sum(len(r["key"]) for r in L.word_statistics(df.limit(0), rows).table.collect())
    assert size(df) > 2 * size(df.filter("doc_id < 20"))


def test_batches_without_a_hot_pair(spark, monkeypatch):
    """Texts come one by one; some have hot pairs and some none."""
    monkeypatch.setattr(L, "HOT", 30)
    docs = spark.createDataFrame([(i, "alpha beta") for i in range(6)] + [(7, "zeta eta"), (8, ""), (9, "alpha beta")], "doc_id long, text string").coalesce(1)
    words = L.word_statistics(docs.select("text"), docs)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {r["doc_id"]: r["score"] for r in L.word_score(docs, words).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(words.hot[0]) and len(got) == 9 and all(abs(x) < 1e-8 for x in got.values())
