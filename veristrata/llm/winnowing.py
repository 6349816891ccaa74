"""Document fingerprints by winnowing, with SQL functions alone.

Units are words (runs of non-blank characters, lower-cased, longer ones in pieces of 16). A cyclic polynomial gives the 64-bit hash of
each run of k = 4 units; being a shift and an exclusive or, it doubles: runs of two from single hashes, runs of four from runs of two.
Every window of w = 8 run hashes gives up its least one, the rightmost of equal ones, and distinct choices with their positions are
the fingerprint. Minima double in the same way. Any passage of w + k - 1 = 11 units in two texts leaves them a hash in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K, W = 4, 8
#: Bits of a choice that hold its position (counted down, so that of equal hashes the rightmost is least). A string has at most 2^31
#: bytes and a unit takes two at least, so every position fits.
POSITION_BITS = 30
_LAST = (1 << POSITION_BITS) - 1
#: Buckets of neighbouring ids for each shuffle partition, and at most.
BUCKETS, MOST_BUCKETS = 4, 2_000


def _left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _behind(column: str, n: int) -> Column:
    """The array without its first n elements."""
    return F.slice(column, F.lit(n + 1), F.greatest(F.size(column) - n, F.lit(0)))


def with_choices(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with `out`: the text's choices in order of position, each a long of 33 hash bits over 30 position bits. Null or blank: none.

    A text of fewer than k units is one run; one of fewer than w runs is one window.
    """
    h, g, n = f"__{out}_h", f"__{out}_g", f"__{out}_n"
    rows = rows.withColumn(h, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\S{1,16})"), F.lit(1)), lambda x: F.xxhash64(x)))
    rows = rows.withColumn(n, F.size(h))
    span = 1
    while span < K:
        rows = rows.withColumn(h, F.when(F.size(h) > span, F.zip_with(h, _behind(h, span), lambda a, b: F.when(b.isNull(), a).otherwise(_left(a, span).bitwiseXOR(b)))).otherwise(F.col(h)))  # noqa: B023
        span *= 2
    # runs that end behind the text aren't whole: only the first n - k + 1 count; a short text's first run holds all its units
    rows = rows.withColumn(g, F.transform(F.slice(h, F.lit(1), F.when(F.col(n) == 0, 0).otherwise(F.greatest(F.col(n) - (K - 1), F.lit(1)))), lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - (63 - POSITION_BITS)), POSITION_BITS).bitwiseOR((F.lit(_LAST) - i).cast("long"))))
    rows = rows.withColumn(n, F.size(g))
    span = 1
    while span < W:
        rows = rows.withColumn(g, F.when(F.size(g) > span, F.zip_with(g, _behind(g, span), lambda a, b: F.least(a, b))).otherwise(F.col(g)))
        span *= 2
    rows = rows.withColumn(out, F.array_distinct(F.slice(g, F.lit(1), F.when(F.col(n) == 0, 0).otherwise(F.greatest(F.col(n) - (W - 1), F.lit(1))))))
    return rows.drop(h, g, n)


def hashes(choices: str) -> Column:
    return F.transform(choices, lambda x: F.shiftrightunsigned(x, POSITION_BITS))


def fingerprint(choices: str) -> Column:
    """array<struct<hash, position>>: the choices taken apart."""
    return F.transform(choices, lambda x: F.struct(F.shiftrightunsigned(x, POSITION_BITS).alias("hash"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).alias("position")))


def spelled(choices: str) -> Column:
    """The fingerprint's hashes in hexadecimal, in order of position."""
    return F.array_join(F.transform(choices, lambda x: F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS)))), " ")


def placed(choices: str) -> Column:
    """The positions of the fingerprint's hashes: the number of the first unit of each chosen run, counted from 0."""
    return F.array_join(F.transform(choices, lambda x: (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string")), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def with_next(rows: DataFrame, key: str, tie: Column, carried: list[str]) -> DataFrame:
    """rows with next_<c> for each carried column: its value in the next row by descending key; the first row follows the last.

    Rows are dealt to buckets between approximate quantiles of the key, which are keys that occur. A bucket's first row is laid behind
    the bucket before it as well, and the very first row behind the last bucket; so each bucket is ordered on its own and no task
    sees all rows. Rows of a null key come last; rows with one key are ordered by `tie`.
    """
    spark = rows.sparkSession
    n = min(MOST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    top, cuts = rows.agg(F.max(key), F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n)).first()
    cuts = sorted(set(cuts or []), reverse=True)
    kind = rows.schema[key].dataType
    at = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{kind.simpleString()}>")
    bucket = F.when(F.col(key).isNull(), len(cuts)).otherwise(F.size(F.filter(at, lambda c: c >= F.col(key))))
    place = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    rows = rows.withColumn("__b", bucket)
    places = F.array_compact(F.array(place(F.col("__b"), 0), F.when(F.array_contains(at, F.col(key)), place(F.col("__b") - 1, 1)), F.when(F.col(key).eqNullSafe(F.lit(top).cast(kind)), place(F.lit(len(cuts)), 2))))
    rows = rows.withColumn("__tie", tie).withColumn("__p", F.explode(places))
    order = Window.partitionBy("__p.bucket").orderBy((F.col("__p.ghost") == 2).asc(), F.col(key).desc_nulls_last(), F.col("__p.ghost"), "__tie")
    rows = rows.withColumn("__next", F.lead(F.struct(*carried)).over(order)).filter("__p.ghost = 0")
    return rows.select(*(c for c in rows.columns if not c.startswith("__")), *(F.col(f"__next.{c}").alias(f"next_{c}") for c in carried))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of an edited text: its last third replaced by the start of the next document.

    docs has doc_id and text; a null text is empty. The next document is that with the next smaller doc_id (of equal ids, ordered by
    a hash of the text), and the first one's after the last. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    and positions and edited_positions, which go with the hashes of the fingerprints one by one; one row for each row; extra columns are ignored. Equal texts have equal fingerprints; an empty one has an empty fingerprint.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_choices(rows, "text", "chosen"), "doc_id", F.xxhash64("text"), ["text", "chosen"])
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("__cut", F.expr("cast(n_chars div 3 as int)"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - __cut)"), F.expr("left(next_text, __cut)"))).drop("next_text")
    rows = with_choices(rows, "edited", "edited_chosen")
    own, edited, follower = ("__own", "__edited", "__next")
    rows = rows.withColumn(own, F.array_distinct(hashes("chosen"))).withColumn(edited, F.array_distinct(hashes("edited_chosen"))).withColumn(follower, F.array_distinct(hashes("next_chosen")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelled("chosen").alias("fingerprint"), spelled("edited_chosen").alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, follower).alias("near_next"),
        placed("chosen").alias("positions"), placed("edited_chosen").alias("edited_positions"),
    )


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
