"""Every query with SQL gives the SQL's rows; operators on small tables."""

import math
import os
import random

import duckdb
import pytest

from veristrata.functions import text as T
from veristrata.operators import cluster, conformal, provenance, rouge, segment
from veristrata.plans import catalogue
from veristrata.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    shown = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall())


def test_rouge_l(spark):
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 20))] for _ in range(2))
        assert rouge.lcs(a, b) == slow(a, b)
    row = rouge.rouge_l(spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, None, "x")], "k int, a string, b string"), "k", "a", "b").orderBy("k").collect()
    assert [(r["lcs"], r["f1"]) for r in row] == [(2, 0.666667), (0, 0.0)]


def test_taxonomy_classes(spark):
    docs = spark.createDataFrame([(1, "Aspirin 81 mg was started for chest pain.\nFollow up in clinic."), (2, "unrelated words entirely here")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "aspirin 81 MG was started"), (2, "Aspirin, 81 mg was started for chest"), (3, "chest pain aspirin clinic"), (4, "zebra giraffe lion")], "item_id int, text string")
    got = {r["item_id"]: r["category"] for r in provenance.miss_taxonomy(items, docs).collect()}
    assert got == {1: "exact", 2: "normalized", 3: "noncontiguous", 4: "low_overlap"}


def test_lines(spark):
    rows = segment.line_index(spark.createDataFrame([(1, " a \r\n\r\n\t\nb"), (2, None), (3, "")], "doc_id int, text string")).orderBy("doc_id", "ordinal").collect()
    assert [(r["doc_id"], r["ordinal"], r["line_id"], r["text"]) for r in rows] == [(1, 1, "L0001", "a"), (1, 2, "L0002", "b")]


def test_connected(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9), (9, 3), (20, 21)], "a int, b int")
    assert {r["id"]: r["root"] for r in cluster.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


@pytest.mark.parametrize("chunk", [cluster.CHUNK, 50])
def test_large_buckets(spark, monkeypatch, chunk):
    """Copies and near copies by the hundred, in buckets of any size, against all pairs."""
    monkeypatch.setattr(cluster, "CHUNK", chunk)
    rng = random.Random(4)
    near = rng.getrandbits(64)
    prints = [near] * 230 + [near ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(150)] + [rng.getrandbits(56) << 8 | 7 for _ in range(250)] + [2**64 - 1] * 2
    rows = [(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)]
    shares = lambda x: any(not x >> 8 * b & 255 for b in range(8))
    want = {(i, j, x.bit_count()) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (x := prints[i] ^ prints[j]).bit_count() <= 10 and shares(x)}
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = [tuple(r) for r in cluster.hamming_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want
    root = list(range(len(prints)))
    for _ in range(2):
        for i, j, _ in sorted(want):
            root[j] = root[i] = min(root[i], root[j])
    want = {i: root[i] for i in {x for i, j, _ in want for x in (i, j)}}
    assert {r["id"]: r["root"] for r in cluster.near_clusters(df).collect()} == want and len(want) >= 382


def test_risk_control_on_average(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    risks = []
    for _ in range(6):
        rows = []
        for i in range(400):
            good = rng.random() < 0.6
            rows.append((i, min(1.0, max(0.0, rng.gauss(0.72, 0.14) if good else rng.gauss(0.38, 0.18))), good))
        cal, test = spark.createDataFrame(rows[:200], "i int, s double, ok boolean"), rows[200:]
        lam = conformal.crc_threshold(cal, "s", F.col("ok"), [0.1]).first()["threshold"]
        risks.append(sum(s >= lam and not ok for _, s, ok in test) / len(test))
    assert sum(risks) / len(risks) <= 0.12


def test_wilson(spark):
    from pyspark.sql import functions as F

    low, high = T.wilson(F.col("h"), F.col("n"))
    r = spark.createDataFrame([(0, 10)], "h int, n int").select(low.alias("l"), high.alias("h")).first()
    assert abs(r["l"]) < 1e-12 and round(r["h"], 4) == 0.2775 and math.isfinite(r["h"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('case_id,text,Note\n1,"say ""hi"", you",n1\n2,,n2\n')
    got = readers.as_records(readers.read_records(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r["record_id"], r["source_text"], r["reference_text"]) for r in got] == [("1", 'say "hi", you', "n1")]
    (tmp_path / "b.json").write_text('{"records": [{"id": "x", "src": "s", "tgt": "t"}]}')
    got = readers.as_records(readers.read_records(spark, str(tmp_path / "b.json"))).collect()
    assert [tuple(r) for r in got] == [("x", "s", "t")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and os.path.isdir(SF)
