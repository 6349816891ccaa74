"""The three classifiers' arithmetic against plain versions, and what they can learn."""

from itertools import combinations, product

import numpy as np
import pyarrow as pa

from veristrata.llm import _text as T, language, quality, toxicity


def test_machine_counts_every_pair():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(rng.normal(size=50), rng.normal(size=(50, 3)), 0.7)
    rows = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    want = [0.7 + sum(m.weight[i] for i in r) + sum(m.factors[i] @ m.factors[j] for i, j in combinations(r.tolist(), 2)) for r in rows]
    assert np.allclose(m.logit(np.concatenate(rows).astype(np.int64), at), want)


def test_machine_learns_what_only_pairs_tell():
    """Two words that are about as frequent in clean texts as in toxic ones, and toxic together."""
    rng = np.random.default_rng(1)
    rows = []
    a, b = (rng.random(8000) < 0.15 for _ in range(2))
    for i in range(8000):
        words = ["w%d" % x for x in rng.zipf(1.3, 40) % 2000] + ["kettle"] * int(a[i]) + ["meadow"] * int(b[i])
        rows.append((" ".join(words), int(rng.random() < (0.95 if a[i] and b[i] else 0.13 if a[i] ^ b[i] else 0.235))))
    label = np.array([y for _, y in rows], np.float32)
    assert abs(label[a].mean() - label.mean()) < 0.06 and abs(label[b].mean() - label.mean()) < 0.06
    m = toxicity.fit(*toxicity.terms(*T.flat(pa.array([t for t, _ in rows[:6000]]))), label[:6000]).packed()
    score = m.score(*toxicity.terms(*T.flat(pa.array([t for t, _ in rows[6000:]]))))
    together = (a & b)[6000:]
    assert (score[together] >= 0.5).mean() > 0.8 and (score[~together] >= 0.5).mean() < 0.02


def test_calibration_is_a_scale_of_the_logit():
    rng = np.random.default_rng(4)
    rows = [(" ".join(["w%d" % x for x in rng.integers(0, 300, 20)] + ["vile"] * int(y)), int(y) if rng.random() < 0.9 else 0) for y in rng.random(900) < 0.3]
    label = np.array([y for _, y in rows], np.float32)
    data = toxicity.terms(*T.flat(pa.array([t for t, _ in rows])))
    plain, scaled = (f(*data, label).logit(*data) for f in (toxicity.fit, toxicity.calibrated))
    slope, offset = np.polyfit(plain, scaled, 1)
    assert slope > 0 and np.allclose(scaled, slope * plain + offset, atol=1e-3)
    few = toxicity.calibrated(*(x[:0] for x in data[:1]), np.zeros(1, np.int64), np.zeros(0, np.float32))
    assert np.isfinite(few.bias)


def test_field_against_all_labelings():
    rng = np.random.default_rng(2)
    sizes = [1, 0, 2, 5, 8, 3]
    at = np.concatenate([[0], np.cumsum(sizes)])
    unary, pair = rng.normal(size=at[-1]), rng.normal(size=(2, 2))
    chance, both, log_z = quality.marginals(unary, at, pair)
    want_both = np.zeros((2, 2))
    for d, n in enumerate(sizes):
        u = unary[at[d] : at[d + 1]]
        ways = list(product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(u[i] for i in range(n) if w[i]) + sum(pair[w[i], w[i + 1]] for i in range(n - 1))) for w in ways])
        assert np.isclose(log_z[d], np.log(weight.sum()))
        weight /= weight.sum()
        for i in range(n):
            assert np.isclose(chance[at[d] + i], sum(p for p, w in zip(weight, ways, strict=True) if w[i]))
        for i in range(n - 1):
            for p, w in zip(weight, ways, strict=True):
                want_both[w[i], w[i + 1]] += p
    assert np.allclose(both, want_both)


def test_discriminator_against_a_loop():
    rng = np.random.default_rng(3)
    texts, langs = [], []
    for lang, letters in (("en", "abcde"), ("de", "cdefg"), ("nl", "efghi"), ("fr", "pqrst"), ("xx", "uvw")):
        for _ in range(30):
            texts.append(" ".join("".join(rng.choice(list(letters), 5)) for _ in range(12)))
            langs.append(lang)
    model = language.fit(language.shares(*T.flat(pa.array(texts))), langs)
    odd = [*texts[::7], "a", "ab uv", "", "é", "  abc  pqr "]
    data, at = T.flat(pa.array(odd))
    got, score = model.predict(data, at)
    families = sorted(set(model.family.values()))
    assert families == ["germanic", "romance", "xx"]
    for i, text in enumerate(odd):
        x = language.shares(*T.flat(pa.array([text])))[0].astype(np.float64)
        sure = {m: 1 / (1 + np.exp(-3 * np.clip(x @ model.table[:, j].astype(np.float64) + model.offset[j], -10, 10))) for j, m in enumerate(model.machines)}
        family = max(families, key=lambda f: sure[f, None])
        own = [x for x in model.langs if model.family[x] == family]
        votes = {a: 0 for a in own}
        chance = {a: 1.0 for a in own}
        for a, b in combinations(own, 2):
            votes[a if sure[a, b] >= 0.5 else b] += 1
            chance[a], chance[b] = min(chance[a], sure[a, b]), min(chance[b], 1 - sure[a, b])
        best = max(own, key=lambda a: votes[a] + chance[a] / 2)
        assert model.langs[got[i]] == best and np.isclose(score[i], sure[family, None] * chance[best], atol=1e-4)


def test_ids_of_any_kind_and_rare_languages(spark):
    rows = [(f"id-{i}", f"the quick words of number {i} " * 3, "en", "x") for i in range(300)] + [(f"rare-{i}", f"zzyx qqarl vvum {i} " * 3, "zz", "x") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, __letter string")
    model = language.fit_discriminator(docs, most=40)
    assert model.langs == ["en", "zz"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert got["id-7"] == "en" and got["rare-3"] == "zz"
    labels = spark.createDataFrame([(f"id-{i}", i % 2, i % 2) for i in range(300)], "doc_id string, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_field(docs, labels)).count() == toxicity.score_toxicity(docs, toxicity.fit_machine(docs, labels)).count() == 312
