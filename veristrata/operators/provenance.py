"""Anchoring quotes in sources: containment, coverage, the taxonomy of misses, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T
from veristrata.operators.cluster import settle

#: Token coverage from which a quote counts as scattered, drifted, weakly covered.
SCATTERED, DRIFTED, WEAK = 0.92, 0.72, 0.45


#: Ids of documents, or tokens of items, that are sent to every task; beyond, the join shuffles.
SENT_IDS = 200_000


def held(rows: DataFrame) -> DataFrame:
    """A settled table that the driver must not gather to send it: Spark goes by the size of its files, in which millions of equal keys take a few MB."""
    return rows.hint("merge")


def shared_tokens(items: DataFrame, docs: DataFrame, form=T.normal_loose) -> DataFrame:
    """(item_id, doc_id, shared, n_tokens): distinct content tokens that an item's text shares with each document.

    Both sides meet on tokens. A document's tokens that no item has go before anything is shuffled when the items' tokens are SENT_IDS
    at most; counts are pre-aggregated. `form` gives a text's normal_loose() form.
    """
    tokens = lambda df, key: df.select(key, F.explode(F.array_distinct(T.content_words(F.array_distinct(F.split(form(F.col("text")), " "))))).alias("token"))
    own = settle(tokens(items, "item_id"), "item-tokens")
    sent = F.broadcast(own) if own.count() <= SENT_IDS else held(own)
    size = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return sent.join(tokens(docs, "doc_id"), "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared")).join(size, "item_id")


def contained(items: DataFrame, docs: DataFrame, form=T.normal_exact) -> DataFrame:
    """(item_id, doc_id) of each item whose normalised text stands in the document's, as whole words or not. An empty one stands nowhere.

    The words of a contained text but the first and the last are whole words of the document, so an item meets only the documents that
    have the rarest of them. An item of one or two words has none; it meets the documents that have the rarest three characters in a
    row of it (of a shorter one: all of it). Rarity is counted over the documents, for the items' words and characters alone; which
    documents have these is settled once. Only the documents that an item meets are read again and normalised for the comparison.
    """
    quotes = items.select("item_id", form(F.col("text")).alias("quote")).filter("quote != ''")
    sources = docs.select("doc_id", form(F.col("text")).alias("source"))
    words, characters = F.split("quote", " "), F.split("quote", "")

    def grams(x: Column, size: Column) -> Column:
        """Runs of 1 to 3 characters of an array, by its size."""
        behind = lambda n: F.slice(x, F.lit(n + 1), F.greatest(F.size(x) - n, F.lit(0)))
        glued = lambda a, b: F.concat(a, b)
        two, three = F.zip_with(x, behind(1), glued), F.zip_with(F.zip_with(x, behind(1), glued), behind(2), glued)
        return F.array_distinct(F.filter(F.when(size >= 3, three).when(size == 2, two).otherwise(x), lambda g: g.isNotNull()))

    inner = F.when(F.size(words) >= 3, F.array_distinct(F.slice(words, F.lit(2), F.size(words) - 2)))
    keys = quotes.select("item_id", "quote", F.explode(F.when(inner.isNotNull(), F.transform(inner, lambda w: F.struct(F.lit(0).alias("size"), w.alias("key")))).otherwise(F.transform(grams(characters, F.length("quote")), lambda g: F.struct(F.least(F.lit(3), F.length("quote")).alias("size"), g.alias("key"))))).alias("k")).select("item_id", "quote", "k.*")
    sizes = [r["size"] for r in keys.select("size").distinct().collect()]
    parts = [sources.select("doc_id", F.lit(n).alias("size"), F.explode(F.array_distinct(F.split("source", " ")) if n == 0 else grams(F.split("source", ""), F.lit(n))).alias("key")) for n in sizes]
    if not parts:
        return quotes.join(sources).select("item_id", "doc_id").limit(0)
    have = parts[0]
    for other in parts[1:]:
        have = have.unionByName(other)
    have = settle(have.join(keys.select("size", "key").distinct(), ["size", "key"]), "quote-keys")
    df = have.groupBy("size", "key").agg(F.count(F.lit(1)).alias("df"))
    rarest = keys.join(df, ["size", "key"], "left").groupBy("item_id", "quote").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "size", "key")).alias("r")).filter("r.df > 0")
    pairs = settle(held(have).join(rarest.select("item_id", "quote", "r.size", "r.key"), ["size", "key"]).select("item_id", "quote", "doc_id"), "quote-pairs")
    ids = pairs.select("doc_id").distinct()
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    met = docs.join(F.broadcast(ids) if few else held(ids), "doc_id", "left_semi").select("doc_id", form(F.col("text")).alias("source"))
    return met.join(held(pairs), "doc_id").filter(F.col("source").contains(F.col("quote"))).select("item_id", "doc_id").distinct()


def classify(exact: Column, loose: Column, covered: Column) -> Column:
    return F.when(exact, "exact").when(loose, "normalized").when(covered >= SCATTERED, "noncontiguous").when(covered >= DRIFTED, "pointer_drift").when(covered >= WEAK, "weak_overlap").otherwise("low_overlap")


def miss_taxonomy(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, category, coverage, doc_id): how each item is anchored in its best document, by category, then coverage, then id.

    The loose form of every text is made and settled once, for the words and for the tokens.
    """
    loose = lambda df, key: settle(df.select(key, T.normal_loose(F.col("text")).alias("text")), f"loose-{key}")
    bare_items, bare_docs, same = loose(items, "item_id"), loose(docs, "doc_id"), lambda x: x
    near = shared_tokens(bare_items, bare_docs, same).withColumn("coverage", F.col("shared") / F.col("n_tokens"))
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("coverage").desc(), "doc_id"))
    top = near.withColumn("rank", best).filter("rank = 1").select("item_id", F.col("doc_id").alias("top_doc"), "coverage")
    found = lambda rows, name: rows.groupBy("item_id").agg(F.min("doc_id").alias(name))
    rows = items.select("item_id").join(top, "item_id", "left").join(found(contained(items, docs), "exact_doc"), "item_id", "left").join(found(contained(bare_items, bare_docs, same), "loose_doc"), "item_id", "left")
    covered = F.coalesce("coverage", F.lit(0.0))
    return rows.select("item_id", classify(F.col("exact_doc").isNotNull(), F.col("loose_doc").isNotNull(), covered).alias("category"), covered.alias("coverage"), F.coalesce("exact_doc", "loose_doc", "top_doc").alias("doc_id"))


def summarise(rows: DataFrame, category: str = "category") -> DataFrame:
    """Counts, shares and Wilson bounds of each category."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    out = rows.groupBy(category).agg(F.count(F.lit(1)).alias("items")).join(F.broadcast(n))
    low, high = T.wilson(F.col("items"), F.col("total"))
    return out.select(category, "items", F.round(F.col("items") / F.col("total"), 6).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def word_bucket(words: Column) -> Column:
    return F.when(words < 1000, "<1000").when(words < 2000, "1000-1999").when(words < 4000, "2000-3999").otherwise("4000+")


def gate_rates(rows: DataFrame, bucket: str, case: str, passed: str) -> DataFrame:
    """Per bucket: cases, items, items passed, and cases all of whose items passed."""
    cases = rows.groupBy(bucket, case).agg(F.every(passed).alias("gate"), F.count(F.lit(1)).alias("items"), F.count_if(passed).alias("passed"))
    return cases.groupBy(bucket).agg(F.count(F.lit(1)).alias("cases"), F.sum("items").alias("items"), F.sum("passed").alias("passed"), F.count_if("gate").alias("gated_cases"))
