"""The corpus pipeline: stages from documents to token ids, each written as Parquet and read again by whoever runs them.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veristrata.llm import _shared, bpe, language, mixing, ngram_join, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is unknown, or named with less certainty than this, is rejected.
LEAST_CERTAIN = 0.15


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field keeps (score >= 0.3); it is fitted on the labelled ones among those given.

    A null or empty text scores the lowest; without labelled rows the field scores every text alike, and high. A row is judged on its
    own text, whole however long: repeated rows and texts share their fate, and null ids don't matter. An empty table gives no rows;
    columns other than those of documents are left out.
    """
    field = quality.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.select(COLUMNS), field).filter("predicted = 1").select(COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a score of LEAST_CERTAIN or more.

    Texts that are null, empty or without a letter have no language and go; so do all where no row has a language to learn. Equal
    texts share their fate, whole however long; ids don't matter. An empty table gives no rows; columns other than those of documents are left out.
    """
    named = language.identify(docs.select(COLUMNS), language.fit_discriminator(docs))
    return named.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_CERTAIN)).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link through shared shingles (five words, 0.8 or more) the one with the smallest id (null last), once.

    Rows that share an id but not a text are documents of their own. Of rows with equal ids and texts one stays, that with the least
    other columns. Null, empty and blank texts link with nothing: each id with such a text stays, once. An empty table gives no rows;
    columns other than those of documents are left out.
    """
    rows = docs.select(COLUMNS).withColumn("text_key", ngram_join.text_key(F.col("text")))
    same = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["text_key"] == other["text_key"])
    gone = _shared.sent(_shared.settle(ngram_join.repeated(docs), "pipeline-repeated"))
    again = _shared.settle(rows.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "pipeline-equal")
    again = _shared.sent(again)
    if again.isEmpty():
        return rows.join(gone, same(gone), "left_anti").select(COLUMNS)
    rest = [c for c in COLUMNS if c != "doc_id"]
    once = rows.join(again, same(again), "left_semi").join(gone, same(gone), "left_anti").groupBy("doc_id", "text_key").agg(F.min(F.struct(*rest)).alias("r"))
    kept = rows.join(gone, same(gone), "left_anti").join(again, same(again), "left_anti")
    return kept.select(COLUMNS).unionByName(once.select("doc_id", "r.*").select(COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: documents as often, and as far, as the sources' targets take them.

    Null and blank texts have no words and go. A null source is a source like any other. Repeated rows are taken one by one, whatever
    their ids. Ties of sources go to the earlier one by code point. An empty table gives no rows; columns other than those of documents are left out.
    """
    return mixing.materialize(mixing.mix(docs.select(COLUMNS))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each row of the mix.

    Null and empty texts have no ids; whole texts are encoded, however long. Every row gives one row, and equal texts equal ids; null
    ids and sources pass through. An empty table gives no rows.
    """
    coded = bpe.tokenize(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", good_quality), ("language ID", known_language), ("n-gram Jaccard join", one_of_each_group), ("mixing to target weights", mixed), ("byte-level BPE", token_ids)]

#: Learned models, a graph search and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are settled in the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _shared.settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
