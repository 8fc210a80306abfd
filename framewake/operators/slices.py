"""Order within a long key without one task that holds it: a key is cut into slices, and what a slice needs of those before it is carried to it.

Only a row for each slice is ever ordered by key alone; the rows themselves meet slice by slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: places of a slice where they are octets of a file
WIDTH = 1 << 20


def slice_of(at: str | Column, width: int = WIDTH) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width)).cast("long")


def carry(df: DataFrame, keys: Sequence[str], slice_: str, values: dict[str, Column]) -> DataFrame:
    """``df`` with the greatest of each of ``values`` over the earlier slices of its key, null if there is none; keys aren't null.

    ``df`` is read twice, so it should be cheap or settled. A struct that begins with the order tells the last row.
    """
    ends = df.groupBy(*keys, slice_).agg(*[F.max(v).alias(name) for name, v in values.items()])
    w = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, slice_, *[F.max(name).over(w).alias(name) for name in values])
    return df.join(before, [*keys, slice_])


def numbered(df: DataFrame, keys: Sequence[str], slice_: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: rows of each key numbered from 0. Slices follow one another in ``order``; ``df`` is read twice."""
    counts = df.groupBy(*keys, slice_).agg(F.count("*").alias("__count"))
    w = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, slice_, F.coalesce(F.sum("__count").over(w), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, slice_).orderBy(*order))
    return df.join(before, [*keys, slice_]).withColumn(name, F.col("__before") + own - 1).drop("__before")


def ranged(df: DataFrame, order: Sequence[str], slice_: str) -> DataFrame:
    """``df`` with slices of about one size, whatever the values are; they are drawn from the rows, so the table is written down."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settle(df.repartitionByRange(n, *order).withColumn(slice_, F.spark_partition_id().cast("long")), "ranges")
