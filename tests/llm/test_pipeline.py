"""The pipeline's stages on a small fixture against plain versions, and op10 against its SQL."""

import collections

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tiktoken.load
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute
from veristrata.llm import _shared, _text, language, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what each stage leaves, as run() makes them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "x", 0), (10_003, "word " * 40_000, "en", "x", 200_000)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in P.STAGES:
        out.append(_shared.settle(stage(spark, out[-1], SF), f"test-{name.replace(' ', '-').lower()}"))
    return out


def flat(text):
    return _text.flat(pa.array([text], pa.string()))


def test_filters(spark, stages):
    """Rejected documents go and no others, by the models applied to each text alone."""
    field = quality.fit_field(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in stages[0].collect() if field.score(*flat(r["text"] or ""))[0] >= quality.KEEP}
    assert {r["doc_id"] for r in stages[1].collect()} == want and 0 < len(want) < stages[0].count()
    model = language.fit_discriminator(stages[1])
    want = {r["doc_id"] for r in stages[1].filter(F.col("text").rlike(r"\p{L}")).collect() if model.predict(*flat(r["text"]))[1][0] >= P.LEAST_CERTAIN}
    assert {r["doc_id"] for r in stages[2].collect()} == want
    assert all(s.columns == P.COLUMNS for s in stages[1:5])


def test_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {d for d, _, c in brute(rows, 5, 80) if d == c}
    kept = [str(r["doc_id"]) for r in stages[3].collect()]
    assert set(kept) == want and len(kept) == len(want) < len(rows)


COPIES = [
    (1, "a b c d e f g h", "en", "x", 15), (1, "a b c d e f g h", "de", "x", 15), (1, "other words of the very same id", "en", "x", 31), (None, "a b c d e f g h", "en", "x", 15), (2, "A B C D E F G H", "en", "x", 15),
    (None, "words without an id at all", None, None, 26), (None, "words without an id at all", None, None, 26), (3, None, None, None, None), (4, "", None, None, 0), (3, None, None, None, None),
]


def test_repeated_ids_and_texts(spark, stages):
    docs = spark.createDataFrame(COPIES, stages[0].schema).withColumn("group", F.lit(1)).withColumn("text_key", F.lit("x"))
    got = sorted((str(r["doc_id"]), str(r["text"]), str(r["lang"])) for r in P.one_of_each_group(spark, docs, SF).collect())
    assert got == [("1", "a b c d e f g h", "de"), ("1", "other words of the very same id", "en"), ("3", "None", "None"), ("4", "", "None"), ("None", "words without an id at all", "None")]


def test_empty_tables(spark, stages):
    for _, stage in P.STAGES:
        assert stage(spark, stages[0].limit(0), SF).count() == 0


def test_mix(stages):
    before, after = {r["doc_id"]: r for r in stages[3].collect()}, collections.defaultdict(list)
    for r in stages[4].collect():
        after[r["doc_id"]].append(r)
    size = lambda x: len(x.split())
    sizes, taken = collections.Counter(), collections.Counter()
    for d, r in before.items():
        sizes[r["source"]] += size(r["text"])
        own = sum(size(x["text"]) for x in after[d])
        taken[r["source"]] += own
        assert own <= 2 * size(r["text"]) and len(after[d]) <= 2
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    goal = mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - t) <= 48 for s, t in zip(order, goal, strict=True)) and set(after) <= set(before)


def test_tokens(stages):
    ranks = tiktoken.load.load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = collections.Counter((r["doc_id"], tuple(known.encode_ordinary(r["text"]))) for r in stages[4].collect())
    assert mixed == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in stages[5].collect())


def test_warc_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.QUERIES["op10_warc"](spark, SF)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op10_warc']})").fetchall()))
