"""Components against brute force over all pairs."""

import random
import re
import time

import numpy as np
import pytest

from veristrata.llm import _text as T, ngram_join as J


def brute(rows, words=4, num=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                at[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(top(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def made(seed, families):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    shared = [[word() for _ in range(60)] for _ in range(3)]
    rows = [(None, "one two three four five"), (100, None), (101, ""), (102, " \t\n"), (103, "A b"), (104, "a  B"), (105, "x"), (105, "x"), (106, "ONE two three Four five"), (107, "b a")]
    for size in families:
        base = [word() for _ in range(size)]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                k = rng.random()
                i = rng.randrange(len(own))
                if k < 0.5:
                    own[i] = word()
                elif k < 0.75:
                    own.insert(i, word())
                elif len(own) > 1:
                    del own[i]
            if rng.random() < 0.3:
                own += rng.choice(shared)
            rows.append((1000 + len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def check(spark, rows, parts=3, rule=J.RULE):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("doc_id", "text", "1 as node", "2 as component_id")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.join_documents(docs, rule).collect())
    assert got == brute(rows, rule.words, rule.num)


def test_against_all_pairs(spark):
    check(spark, made(1, [random.Random(9).choice([1, 3, 5, 8, 12, 20, 33, 50, 80, 120, 300]) for _ in range(70)]))


def test_five_words(spark):
    check(spark, made(4, [random.Random(7).choice([1, 5, 9, 10, 15, 25, 60, 150]) for _ in range(60)]), rule=J.NEAR)


def test_cut_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(J, "LEADERS", 2)
    monkeypatch.setattr(J, "REMEMBERED", 5)
    monkeypatch.setattr(J, "HEAPED", 0)
    check(spark, made(2, [10, 30, 30, 60, 100] * 3))
    monkeypatch.setattr(J, "GROUP", 3)
    monkeypatch.setattr(J, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(J, "CONTRACTED", 4)
    check(spark, made(3, [10, 30, 30, 60, 100] * 3), rule=J.NEAR)


def test_large_groups_and_common_shingles(spark, monkeypatch):
    for name, value in (("GROUP", 3), ("SEEN", 1), ("OFTEN", 2), ("COUNTED", 100)):
        monkeypatch.setattr(J, name, value)
    check(spark, made(6, [10, 30, 30, 60, 100] * 4), rule=J.NEAR)


def test_words_that_a_polynomial_confuses(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)])
    assert len(set(T.hashed(*flat([word, word.translate(str.maketrans("ab", "ba")), word + "a"])).tolist())) == 3


def flat(words):
    raw = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]]), ends


def test_empty(spark):
    assert J.join_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule", [J.RULE, J.NEAR])
def test_every_link_shares_a_key(rule):
    """Sets at the edge of the threshold, of all sizes, share a prefix shingle and pass by their bitmaps."""
    rng = np.random.default_rng(3)
    missed = pairs = 0
    at = lambda x: np.array([0, len(x)])
    for n in [4, 5, 6, 7, 8, 9, 10, 12, 13, 17, 20, 25, 31, 40, 57, 80, 111, 200, 451, 520, 1030, 1200, 2100]:
        for _ in range(60):
            common = rule.least(n)
            m = int(rng.integers(common, n + 1))
            both = common if m == common else -(-rule.num * (n + m) // (100 + rule.num))
            a = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.sort(np.concatenate([rng.permutation(a)[:both], rng.integers(0, 2**63, m - both, dtype=np.uint64)]))
            if 100 * both < rule.num * (n + m - both) or not len(np.setxor1d(a, b)):
                continue
            pairs += 1
            often = rng.permutation(np.union1d(a, b))[: int(rng.integers(0, n))]
            order = J.Order(often, rng.integers(1, 9, len(often)))
            ka, kb = (order.prefixes(x, at(x), rule)[0] for x in (a, b))
            missed += not len(np.intersect1d(ka, kb))
            own = J.Bitmaps(np.array([n, m]), J.bitmaps(np.concatenate([a, b]), np.array([0, n, n + m])), rule)
            missed += not own.passing(np.array([0, 1]), np.array([1, 0])).all()
    assert pairs > 400 and not missed


def test_many_near_copies_take_seconds():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 2**63, 31, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 31, 1)), rng.integers(0, 2**63, 1, dtype=np.uint64)])) for _ in range(8000)]
    began = time.process_time()
    assert len(J.search(sets)) == 7999
    assert time.process_time() - began < 8


def test_search_matches_all_pairs():
    rng = random.Random(8)
    for _ in range(40):
        base = [rng.getrandbits(63) for _ in range(rng.randint(3, 60))]
        sets = []
        for _ in range(rng.randint(2, 25)):
            own = {x if rng.random() > 0.06 else rng.getrandbits(63) for x in base if rng.random() > 0.03} or {1}
            sets.append(np.array(sorted(own), np.uint64))
        top = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 85 * len(a | b):
                    top = [top[j] if t == top[i] else t for t in top]
        got = list(range(len(sets)))
        for i, j in J.search(sets):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert 100 * len(a & b) >= 85 * len(a | b)
            got = [got[j] if t == got[i] else t for t in got]
        same = lambda x: [[p == q for q in x] for p in x]
        assert same(got) == same(top)
