"""Session defaults and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def builder(name: str = "framewake") -> SparkSession.Builder:
    """A session whose results don't depend on the machine's time zone, with adaptive plans."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are dealt by ``key`` to as many tasks as the session works with, for work that is done a row at a time.

    Rows of one row group are one task else, however much is done for each; a number that is told isn't coalesced.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).repartition(n, key)


def tasks_of(df: DataFrame, rows: int) -> int:
    """Tasks for ``df``, which is settled: as many as the session works with, or more, so that one has about ``rows`` rows."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(n, df.count() // rows + 1)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    name = ts if isinstance(ts, str) else None
    column = F.col(name) if name else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), column)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``.

    If it is unset and all runs on one machine, as in tests, a temporary folder; on a cluster that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="framewake-")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that several uses don't work it out again and no lost executor matters."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
