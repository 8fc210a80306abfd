"""Queues with a constant service time, and slot schedules, as running maxima (a max-plus scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaky_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], arrival: str, service: int, capacity: int) -> DataFrame:
    """Serve arrivals one by one: departure, fullness (items waiting once this one is in), overflow, busy_start.

    departure_i = max(arrival_i, departure_{i-1}) + service, which is service * (i + 1) + max over j <= i of
    (arrival_j - service * j). An item that arrives just as the one before departs starts a new busy period.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(w) - 1)
    top = F.max(F.col(arrival) - service * F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("departure", (top + service * (F.col("__i") + 1)).cast("long")).drop("__i")
    waiting = F.ceil((F.col("departure") - F.col(arrival)) / F.lit(service)).cast("long")
    last = F.lag("departure").over(w)
    return df.select("*", waiting.alias("fullness"), (waiting > capacity).alias("overflow"), (last.isNull() | (F.col(arrival) >= last)).alias("busy_start"))


def rate_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], arrival: str, slot: int, start: int) -> DataFrame:
    """Give each arrival the next slot at or after it: slot, and the slots left idle (null-filled) before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(w) - 1)
    due = F.ceil((F.col(arrival) - start) / F.lit(slot)).cast("long")
    top = F.max(due - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("slot", (top + F.col("__i")).cast("long")).drop("__i")
    return df.withColumn("idle_before", F.col("slot") - F.coalesce(F.lag("slot").over(w), F.lit(-1)) - 1)


def scheduled(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, start: int, interval: int) -> DataFrame:
    """Polls of a schedule without drift: emits, missed slots before it, and how late, for polls that find a new slot due."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("due", F.floor((F.col(at) - start) / F.lit(interval)).cast("long"))
    high = F.coalesce(F.max("due").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    df = df.withColumn("__high", high).where("due > __high")
    late = F.col(at) - start - F.col("due") * interval
    return df.select("*", (F.col("due") - F.col("__high") - 1).alias("missed"), late.alias("late_by")).drop("__high")


def occupancy(df: DataFrame, keys: Sequence[str], enter: str, leave: str) -> DataFrame:
    """(key, at, level, underflow): items inside after each change; at equal times entries come before removals."""
    ins = df.select(*keys, F.col(enter).alias("at"), F.lit(1).alias("__step"))
    outs = df.select(*keys, F.col(leave).alias("at"), F.lit(-1).alias("__step"))
    steps = ins.union(outs).groupBy(*keys, "at").agg(F.sum(F.when(F.col("__step") > 0, 1).otherwise(0)).alias("entered"), F.sum(F.when(F.col("__step") < 0, 1).otherwise(0)).alias("left"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("level", F.sum(F.col("entered") - F.col("left")).over(w)).withColumn("underflow", F.col("level") < 0)
