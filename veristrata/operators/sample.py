"""Samples that don't depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veristrata.operators.cluster import settle


def hash_cohort(rows: DataFrame, key: str, subject: str, excluded: DataFrame, seed: str, n: int) -> DataFrame:
    """The n first rows by a hash of seed and key, one for each subject, without excluded subjects."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    own = rows.join(excluded, subject, "left_anti").select(key, subject, order.alias("h"))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy(subject).orderBy("h", key))).filter("r = 1")
    return first.orderBy("h", key).limit(n).select(key, subject)


def round_robin(rows: DataFrame, key: str, stratum: str, n: int) -> DataFrame:
    """n rows taken from the strata in turn, smallest keys first."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return rows.select(key, stratum).withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def even_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(position, key): the rows at positions floor(i * n / k) of the keys' order, keys being of any kind that has one.

    Rows are ranged by the key and numbered inside their range; the ranges' sizes are added up. No task orders all rows.
    """
    own = numbered(rows.select(key), [F.col(key)])
    n = rows.count()
    wanted = rows.sparkSession.range(k).select(F.floor(F.col("id") * n / k).alias("position")).distinct()
    return own.join(wanted, "position").select("position", key)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `position` from 0 in an order, in two levels: Spark ranges the rows, each range is numbered by itself, and the ranges' sizes are added up.

    The numbered ranges are settled, as ranging once more might cut elsewhere.
    """
    rows = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    own = settle(rows.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order))), "numbered")
    before = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"))  # a row for each partition
    before = before.select("__part", (F.sum("__k").over(Window.orderBy("__part")) - F.col("__k")).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__n") - 1).drop("__part", "__n", "__before")
