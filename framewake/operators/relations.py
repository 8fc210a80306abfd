"""Preference, integrity, hierarchy overlay and packet flow over keyed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preferred(df: DataFrame, chain: Mapping[str, str], value: str, source: str) -> DataFrame:
    """Add ``value``, the first present column of ``chain`` (column to name), and ``source``, its name."""
    pick = F.coalesce(*[F.col(c) for c in chain])
    which = F.lit(None).cast("string")
    for column, name in reversed(list(chain.items())):
        which = F.when(F.col(column).isNotNull(), name).otherwise(which)
    return df.withColumn(value, pick).withColumn(source, which)


def dangling(df: DataFrame, dimension: DataFrame, column: str, key: str, issue: str) -> DataFrame:
    """Rows whose ``column`` isn't a ``key`` of ``dimension``, with an issue. A null refers to nothing and isn't one."""
    known = dimension.select(F.col(key).alias("__k")).distinct()
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__k"), "left_anti").withColumn("issue", F.lit(issue))


def overlay(parents: DataFrame, children: DataFrame, on: Sequence[str], fields: Sequence[str], deleted: str) -> DataFrame:
    """Children with the fields they don't set taken from their parent, unless named in their ``deleted`` array.

    A parent's fields are in columns of the same names; a tree of any depth is overlaid level by level.
    """
    above = parents.select(*on, *[F.col(f).alias(f"__{f}") for f in fields])
    out = children.join(above, list(on), "left")
    for f in fields:
        gone = F.coalesce(F.array_contains(deleted, f), F.lit(False))
        out = out.withColumn(f, F.when(~gone, F.coalesce(F.col(f), F.col(f"__{f}")))).drop(f"__{f}")
    return out


def order_views(df: DataFrame, order: str, cancelled: int = 32767) -> DataFrame:
    """Add view: current (0), planned (above), historical (below) or cancelled."""
    o = F.col(order)
    return df.withColumn("view", F.when(o == cancelled, "cancelled").when(o == 0, "current").when(o > 0, "planned").when(o < 0, "historical"))


def conflicts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Orders that several rows of a key claim, and how many do."""
    return df.groupBy(*keys, order).agg(F.count("*").alias("claims")).where("claims > 1")


def processor_chain(df: DataFrame, order: str, stages: Sequence[Column]) -> DataFrame:
    """Run packets through stages, each an expression over ``packet`` that gives an array of packets (none drops it).

    ``df`` has a struct column packet. The result has (order, pos, packet): outputs keep their inputs' order, and each
    stage's output feeds the next. Nothing is shuffled.
    """
    out = df.select(F.col(order).alias("order"), F.array().cast("array<int>").alias("pos"), "packet")
    for stage in stages:
        out = out.select("order", "pos", F.posexplode(stage).alias("__at", "packet"))
        out = out.select("order", F.concat("pos", F.array("__at")).alias("pos"), "packet")
    return out
