"""Bounded, repeatable samples of labelled rows to fit small models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import _shared


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows chosen by a hash of the key and never more than twice as many, the same ones in each run while ids are distinct."""
    total = rows.count()
    if total > most:
        rows = rows.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_003)) < F.lit(int(1_000_003 * most / total) + 1))
    return rows.limit(2 * most)


def order_key() -> Column:
    """What fitted rows are sorted by, whatever kind of id they have: a hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, most_bytes: int = 128 << 20) -> DataFrame:
    """(key, text, label) of at most 2 * `most` labelled rows outside the held-out remainder, of about `most_bytes` at most.

    The labels are sampled first; so only their bounded rows are sent to the documents, which aren't shuffled. Rows without a
    label or a document are left out, and a label given twice counts once, at its highest. A text of more than a sixteenth of
    `most_bytes` isn't fitted on; of texts that are too many bytes together, a share is taken by their key.
    """
    train = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
    train = sample(train, F.col("doc_id"), most).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 16).join(F.broadcast(train), "doc_id").limit(2 * most)
    rows = _shared.settle(rows.select(order_key().alias("key"), "text", "label"), "fit-texts")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return rows if size <= most_bytes else rows.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.lit(int(1_000_003 * most_bytes / size)))
