"""Ids equal the public library's, and decode to the text."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from veristrata.llm import _text as T, bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: MB that a worker takes besides its modules, at most and once it is done.
MOST_MB, LEFT_MB = 105, 75


@pytest.fixture(scope="module")
def coders():
    return bpe.vocabulary(PATH), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(own, texts):
    data, at = T.flat(pa.array(texts, pa.string()))
    return [[i for p in row for i in p] for row in own.encode(data, at)]


def test_matches_library(coders):
    own, library = coders
    rng = random.Random(5)
    parts = ["'s", "'", "'re", "'ll", "'LL", "'d", " ", "  ", "\n", "\t ", "  ", "　", "\x1c", "don't", "naïve", "Straße", "日本語", "😀", "é", "12", "½", "٣", "!!", "$$$", "a", "the", "und", ".", "''", "x'sy", "\r\n", "\x85", "᠎", "​", "'t'm", " '", " 's", "\n's", "'ve "]
    texts = [None, "", " ", "  ", "\n\n", "'", "a" * 700, "ab" * 2000, "é" * 300, "x" * 255 + "y"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for text, got in zip(texts, ids_of(own, texts), strict=True):
        assert got == library.encode_ordinary(text or ""), repr(text)
        assert own.decode(got) == (text or "").encode()


def test_pieces_that_share_a_hash(coders, monkeypatch):
    """Words that a polynomial hash confuses, in either order, and any words under a hash that confuses all."""
    own, library = coders
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    want = lambda texts: [library.encode_ordinary(t) for t in texts]
    for texts in ([word, other], [other, word], [other + " " + word, word + "x"]):
        assert ids_of(own, texts) == want(texts)
    monkeypatch.setattr(bpe.T, "hashed", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["one two three", "two  one", "a", "two three one"]
    assert ids_of(own, texts) == want(texts)


def test_long_pieces(coders):
    own, library = coders
    rng = random.Random(11)
    texts = ["".join(rng.choice("abethinrs") for _ in range(n)) for n in (257, 511, 512, 513, 1025, 5000)] + ["=" * 3001, "abc" * 900, "日本" * 700]
    assert ids_of(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_query_rows(spark, coders):
    docs = spark.createDataFrame([(1, "Hello  world", "x"), (2, None, "x"), (2, "", None), (None, "Hello  world", "x")], "doc_id long, text string, ids string")
    rows = bpe.digests(docs, PATH).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 3, 3] or len(rows) == 4
    assert len({r["ids_sha256"] for r in rows}) == 2
    whole = bpe.tokenize(docs, PATH).collect()
    assert [bytes(r["decoded"]) for r in whole if r["doc_id"] == 1] == [b"Hello  world"]
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_rank_table_is_exact(coders):
    own, _ = coders
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(own.tokens), 20000), rng.integers(0, 300, 20000)
    got = own.rank(a, b)
    for x, y, r in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert own.ranks.get(own.tokens[x] + own.tokens[y], int(bpe.NONE)) == r


MEMORY = """
import pathlib, random, re, sys, threading, time
import pyarrow as pa
from pyspark.sql import types
from veristrata.llm import bpe

def private():
    return int(re.search(r"RssAnon:\\s+(\\d+)", pathlib.Path("/proc/self/status").read_text())[1]) / 1024

class Docs:  # hands out the function that the tasks run
    sparkSession = property(lambda self: self)
    conf = property(lambda self: self)
    set = lambda self, *a: None
    schema = types.StructType([types.StructField("text", types.StringType())])
    select = lambda self, *a: self
    mapInArrow = lambda self, work, schema: work

rng = random.Random(3)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(30_000)]
def batches():
    for _ in range(4):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choices(words, k=150)) for _ in range(1000)])], ["text"])

base, most, ended = private(), [0], []
def watch():
    while not ended:
        most[0] = max(most[0], private())
        time.sleep(0.002)
threading.Thread(target=watch, daemon=True).start()
for out in bpe.tokenize(Docs(), sys.argv[1])(batches()):
    pass
ended.append(1)
print(most[0] - base, private() - base)
"""


def test_worker_stays_small():
    """Two of these stand beside an executor's heap, and stay for the stages behind."""
    said = subprocess.run([sys.executable, "-c", MEMORY, PATH], capture_output=True, text=True, check=True, env=os.environ | {"OMP_NUM_THREADS": "1"}, cwd=Path(bpe.__file__).parents[2])
    most, left = map(float, said.stdout.split())
    assert most < MOST_MB and left < LEFT_MB, (most, left)
