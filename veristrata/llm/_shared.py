"""Tables written once to the folder that all executors share, in place of lineage that a lost executor would have to replay."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one beside the warehouse, in local mode alone: a cluster must name it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/../checkpoints"
    return base.rstrip("/")


#: Rows and bytes that a Python worker is handed at once (one longer row is handed over whole); the defaults allow a gigabyte of long texts.
BATCH_ROWS, BATCH_BYTES = 10_000, "1m"


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for two workers beside an executor's heap.

    A DataFrame's batches are made when it runs, so the setting has to stay; every operator with Python code makes it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def settle(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows, written as Parquet under a name of their own and read again."""
    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.options(**options).parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.settled_at = path
    return out


#: Rows of a settled table of a few numbers each that are sent to every task; a longer one is joined by a shuffle.
SENT_ROWS = 500_000


def sent(table: DataFrame) -> DataFrame:
    """A settled table, to be sent to every task if it has SENT_ROWS rows at most."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again, for instance once what was made of them is settled."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
