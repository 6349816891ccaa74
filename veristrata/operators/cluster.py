"""Exact groups, SimHash neighbours by bands, connected groups, TF-IDF."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veristrata.functions import text as T


def exact_groups(docs: DataFrame, form=T.normal_cluster) -> DataFrame:
    """(digest, copies, first_id) of each group of equal normalised texts with more than one."""
    return docs.groupBy(F.sha2(form(F.col("text")), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def simhash(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash over all word trigrams; with `most`, over those at a stride that keeps to about so many.

    Each trigram's first eight SHA-256 bytes vote on every bit, and a tie counts as one; so a text without a trigram has all ones.
    Trigrams are exploded and the votes on two bits at a time summed in halves of a long, before anything is shuffled.
    """
    words = F.filter(F.split(T.normal_cluster(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w"), F.monotonically_increasing_id().alias("row"))
    grams = T.ngrams(F.col("w"), 3)
    if most is not None:
        stride = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.size("w") - 2) / most))
        grams = F.filter(grams, lambda _, i: i % stride == 0)
    rows = rows.select("doc_id", "row", F.explode_outer(grams).alias("g"))
    rows = rows.select("doc_id", "row", F.conv(F.substring(F.sha2("g", 256), 1, 16), 16, -10).cast("long").alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"v{b}") for b in range(32)]
    rows = rows.groupBy("row", "doc_id").agg(F.count("h").alias("n"), *votes)
    value = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{b}", 32)
        for half, bit in ((low, b), (high, b + 32)):
            value = value.bitwiseOR(F.when(F.coalesce(half, F.lit(0)) * 2 >= F.col("n"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return rows.select("doc_id", value.alias("fp"))


#: Fingerprints of a bucket are dealt out to chunks of about so many; each pair of chunks is compared by itself.
CHUNK = 2048


def bands_for(most: int) -> list[tuple[int, int]]:
    """(first bit, bits) of most + 1 bands of a fingerprint: two that differ in `most` bits agree on one of them at least."""
    cuts = [64 * i // (most + 1) for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _near_prints(nodes: DataFrame, most: int, schema: str, found) -> DataFrame:
    """found(values, i, j, distance) of each pair of chunks of nodes(fp), distinct: places of the pairs that share a band and differ in `most` bits.

    All pairs of a bucket are compared, however large it is: its chunks meet two by two, each two in a group of their own. A pair that
    shares several bands is found at its first.
    """
    cut = bands_for(most)
    bands = nodes.select("fp", F.posexplode(F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND((1 << n) - 1) for a, n in cut])).alias("band", "value"))
    # no more rows than bands have values
    sizes = bands.groupBy("band", "value").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = bands.join(F.broadcast(sizes), ["band", "value"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("band", "value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp")

    def compared(key, table):
        band, one, two = key[0].as_py(), key[2].as_py(), key[3].as_py()
        fp, side = table["fp"].to_numpy(), table["own"].to_numpy()
        values = np.concatenate([np.sort(fp[side == one]), np.sort(fp[side == two])]) if one != two else np.sort(fp)
        left, start = (int((side == one).sum()), int((side == one).sum())) if one != two else (len(values), 0)
        bits, hits = values.view(np.uint64), []
        for at in range(0, left, 256):
            x = bits[at : min(at + 256, left), None] ^ bits[None, start:]
            a, b = np.nonzero(np.bitwise_count(x) <= most)
            x = x[a, b]
            a, b = a + at, b + start
            new = a < b
            for k in range(band):
                new &= (x >> np.uint64(cut[k][0])) & np.uint64((1 << cut[k][1]) - 1) != 0
            hits.append((a[new], b[new], np.bitwise_count(x[new]).astype(np.int32)))
        return found(values, *(np.concatenate(c) if hits else np.zeros(0, np.int64) for c in zip(*hits, strict=True)))

    return dealt.groupBy("band", "value", "one", "two").applyInArrow(compared, schema)


def hamming_pairs(prints: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, distance) of all fingerprints that differ in `most` bits at the most; equal ones are pairs too.

    Distinct values are compared, then their documents are joined to the pairs of values.
    """
    prints = settle(prints.select("doc_id", "fp"), "prints")

    def pairs(values, i, j, distance):
        return pa.table({"fa": values[i], "fb": values[j], "distance": distance})

    near = _near_prints(prints.select("fp").distinct(), most, "fa long, fb long, distance int", pairs)
    left, right = prints.select(F.col("doc_id").alias("x"), F.col("fp").alias("fa")), prints.select(F.col("doc_id").alias("y"), F.col("fp").alias("fb"))
    equal = left.join(right, F.col("fa") == F.col("fb")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0).alias("distance"))
    other = near.join(left, "fa").join(right, "fb").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return equal.union(other).distinct()


def near_clusters(prints: DataFrame, most: int = 10) -> DataFrame:
    """(id, root): smallest id connected by hamming_pairs to each document that has a pair.

    Values are connected, so that copies add no edges and a group compared gives one edge for each value at most; then each document takes
    the root of its value. Values that share a repeated id are connected too.
    """
    prints = settle(prints.select("doc_id", "fp").filter("doc_id is not null"), "prints")
    def stars(values, i, j, _):
        root = np.arange(len(values))
        while len(i):
            low = np.minimum(root[i], root[j])
            if (low == root[i]).all() and (low == root[j]).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
        far = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[root[far]], "b": values[far]})

    near = _near_prints(prints.select("fp").distinct(), most, "a long, b long", stars)
    twice = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").select("doc_id", "a")
    same = prints.join(twice, "doc_id").select("a", F.col("fp").alias("b")).filter("a <> b")
    roots = connected(near.union(same)).select(F.col("id").alias("fp"), F.col("root").alias("value"))
    rows = settle(prints.join(roots, "fp", "left").select("doc_id", F.coalesce("value", "fp").alias("value")), "values")
    first = rows.groupBy("value").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("last")).filter("root < last").select("value", "root")
    return rows.join(first, "value").select(F.col("doc_id").alias("id"), "root").distinct()


def settle(df: DataFrame, name: str = "connected") -> DataFrame:
    """The rows, written under the folder in spark.checkpoint.dir and read again; where that is unset, beside the warehouse, in local mode alone."""
    spark = df.sparkSession
    conf = spark.sparkContext.getConf()
    base, master = conf.get("spark.checkpoint.dir"), conf.get("spark.master", "local")
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): smallest id connected to each id of edges(a, b), by alternating large and small stars, in rounds that grow with the logarithm of the ids.

    Minima are pre-aggregated and settled, so no node's edges are gathered and a hot node's rows can be split in the join.
    """
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    now = settle(edges.select(pair("a", "b").alias("e")).select("e.*").distinct())
    ids = settle(now.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    mark = None
    while True:
        own = now.filter("a != b")
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = settle(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct())
        lower = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        now = settle(large.join(lower, "a").select(F.explode(F.array(pair("b", "m"), pair("a", "m"))).alias("e")).select("e.*").filter("a != b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return ids.join(now.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        mark = seen


# Words left out when notes are compared.
COMMON = (
    "the and for with that this was were are his her had has have from not but she you all can out one two patient patients date name hospital last first discharge admission service history past medical "
    "present illness"
).split()
#: Terms of the vocabulary: the most frequent ones.
TERMS = 5000


def term_words(x: Column) -> Column:
    """Words of three characters or more that aren't among COMMON."""
    bare = F.regexp_replace(F.regexp_replace(T.lower(x), r"\[\*\*.*?\*\*\]", " "), f"{T.but_words('%./+-')}+", " ")
    return F.filter(F.split(bare, " "), lambda t: (F.length(t) >= 3) & ~t.isin(COMMON))


def terms(words: Column) -> Column:
    """The words, and pairs of neighbouring ones joined by an underscore."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit("_"), b)))


def tfidf(docs: DataFrame, least: int = 3, most: float = 0.85, vocabulary: int | None = TERMS) -> DataFrame:
    """(doc_id, token, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) of the vocabulary's terms in each document.

    The vocabulary has the terms that `least` documents and no more than a share `most` of all have; of these the most frequent ones, as many as
    `vocabulary` says (None: all), ties to the earlier term. It is settled first, and sent to every task where Spark's own size estimate allows,
    so that only its terms are counted by document. Terms are counted by row where no two rows share an id.
    """
    words = docs.select("doc_id", term_words(F.col("text")).alias("words"))
    each = words.select("doc_id", terms(F.col("words")).alias("terms"))
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()
    seen = each.select(F.explode(F.array_distinct("terms")).alias("token")) if once else each.select("doc_id", F.explode("terms").alias("token")).distinct()
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).filter((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))
    if vocabulary is not None:
        df = df.orderBy(F.col("df").desc(), "token").limit(vocabulary)
    df = settle(df.withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    tf = each.select("doc_id", F.explode("terms").alias("token")).join(df.select("token", "term"), "token").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).join(df, "term")
    weight = (1 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1)
    return tf.select("doc_id", "token", weight.alias("weight"))


def tfidf_top(docs: DataFrame, top: int = 5) -> DataFrame:
    """(doc_id, rank, token, weight): heaviest terms of each document, weights to six places, ties to the earlier term."""
    rows = tfidf(docs).withColumn("weight", F.round("weight", 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "token"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("doc_id", "rank", "token", "weight")
