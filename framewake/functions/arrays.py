"""Multi-dimensional arrays and covariance packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def element(values: Column, row: Column, column: Column, columns: Column) -> Column:
    """An element of a row-major matrix, from 0; null outside it."""
    at = row * columns + column
    return F.when((column >= 0) & (column < columns) & (row >= 0), F.get(values, at.cast("int")))


def run_length_expand(n: Column, default: Column, patches: Column) -> Column:
    """An array of ``n`` values: ``default``, overlaid by patches (value, start, length), of which the last one wins."""
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.coalesce(F.try_element_at(F.filter(patches, lambda p: (i >= p["start"]) & (i < p["start"] + p["length"])), F.lit(-1))["value"], default),
    )


def covariance_pairs(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, covariance, correlation) of every pair of columns, i <= j, in one pass over the rows."""
    pairs = [(i, j) for k, i in enumerate(columns) for j in columns[k:]]
    sums = df.groupBy(*keys).agg(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.covar_samp(i, j).alias("covariance"), F.corr(i, j).alias("correlation")).alias(f"__{n}") for n, (i, j) in enumerate(pairs)])
    return sums.select(*keys, F.explode(F.array(*[F.col(f"__{n}") for n in range(len(pairs))])).alias("__p")).select(*keys, "__p.*")
