"""Carry-forward state with expiry and clears (report on change).

A tag's state at a row is its last touch, an update or a clear, at or before the row in order. It is visible if that touch
is an update no older than the time to live; an age of just the limit is still visible. Closed-form windows, one shuffle and
one sort for all tags of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, tags: Mapping[str, Column], value: Column, ttl: int) -> DataFrame:
    """Add a column for each tag: its visible value at each row. ``tags``: name to the condition that a row updates it.

    A row that updates a tag with a null value clears it. ``ttl`` is in the unit of ``ts``.
    """
    seen = _rows(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, updates in tags.items():
        touch = F.last(F.when(updates, F.struct(F.col(ts).alias("at"), value.alias("value"))), ignorenulls=True).over(seen)
        df = df.withColumn(f"__{name}", touch)
    for name in tags:
        df = df.withColumn(name, F.when(F.col(ts) - F.col(f"__{name}.at") <= ttl, F.col(f"__{name}.value"))).drop(f"__{name}")
    return df


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, updates: Column, clears: Column, value: Column, ttl: int) -> DataFrame:
    """One tag's state at each row: state_value, state_at, expired (at the first row past its time), cleared (at the row that clears it)."""
    w = _rows(keys, order)
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    touch = F.when(clears, F.struct(F.col(ts).alias("at"), F.lit(True).alias("clear"), F.lit(None).cast("double").alias("value"))).when(
        updates, F.struct(F.col(ts).alias("at"), F.lit(False).alias("clear"), value.cast("double").alias("value"))
    )
    df = df.withColumn("__t", F.last(touch, ignorenulls=True).over(seen))
    live = ~F.col("__t.clear") & (F.col(ts) - F.col("__t.at") <= ttl)
    df = df.withColumn("__old", F.coalesce(~F.col("__t.clear") & (F.col(ts) - F.col("__t.at") > ttl), F.lit(False)))
    df = df.withColumn("__live", F.coalesce(live, F.lit(False)))
    was_old, was_live = F.coalesce(F.lag("__old").over(w), F.lit(False)), F.coalesce(F.lag("__live").over(w), F.lit(False))
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.when(F.col("__live"), F.col("__t.value")).alias("state_value"), F.when(F.col("__live"), F.col("__t.at")).alias("state_at"),
        (F.col("__old") & ~was_old).alias("expired"), (F.coalesce(clears, F.lit(False)) & was_live).alias("cleared"),
    )


def latest_records(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: a keyed table after its upserts. Partial maxima keep hot keys off a single task."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return last.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def generations(df: DataFrame, keys: Sequence[str], order: Sequence[str], declared: str) -> DataFrame:
    """Add generation: it goes up when a key's declared count differs from the one before."""
    w = _rows(keys, order)
    changed = F.coalesce((F.col(declared) != F.lag(declared).over(w)).cast("long"), F.lit(0))
    return df.withColumn("__c", changed).withColumn("generation", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")
