"""Aggregates that reports are made of: inventories, coalesced findings, rollups, timelines, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def density_timeline(df: DataFrame, at: str, label: str, bins: int, top: int, start: int, duration: int) -> DataFrame:
    """Detections by time bin: bin, total, labels (the ``top`` most frequent, as label=count, by count then name), other_count.

    bin = min(bins - 1, floor((at - start) / duration * bins)), and 0 if the duration is not positive. Only bins with
    detections appear. Counts are exact, and parts and others add up to the total.
    """
    place = F.least(F.lit(bins - 1), F.floor((F.col(at) - start) / F.lit(float(duration)) * bins)) if duration > 0 else F.lit(0)
    counts = df.groupBy(place.cast("long").alias("bin"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    rank = F.when(F.col("label").isNotNull(), F.row_number().over(Window.partitionBy("bin").orderBy(F.col("label").isNull(), F.desc("n"), "label")))
    ranked = counts.withColumn("rank", rank)
    kept = F.col("rank") <= top
    name = F.concat_ws("=", "label", F.col("n").cast("string"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept, F.struct("rank", name.alias("name"))))), lambda x: x["name"]), ",")
    return ranked.groupBy("bin").agg(F.sum("n").alias("total"), listed.alias("labels"), F.sum(F.when(kept, 0).otherwise(F.col("n"))).alias("other_count"))


def tag_inventory(df: DataFrame, packet: str, tag: str, zero_length: Column, issue: Column) -> DataFrame:
    """For each tag: packets it is in, occurrences, zero-length items, items with an issue."""
    return df.groupBy(F.col(tag).alias("tag")).agg(
        F.countDistinct(packet).alias("packets"), F.count("*").alias("occurrences"),
        F.count(F.when(zero_length, 1)).alias("zero_length"), F.count(F.when(issue, 1)).alias("issues"),
    )


def stream_stats(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], ts: str) -> DataFrame:
    """For each stream: packets, first and last in arrival order, earliest and latest, regressions, repeats, largest gap forward."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    step = df.withColumn("__d", F.col(ts) - F.lag(ts).over(w))
    return step.groupBy(*keys).agg(
        F.count("*").alias("packets"), F.min_by(ts, F.struct(*arrival)).alias("first_ts"), F.max_by(ts, F.struct(*arrival)).alias("last_ts"),
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count(F.when(F.col("__d") < 0, 1)).alias("regressions"),
        F.count(F.when(F.col("__d") == 0, 1)).alias("duplicates"), F.coalesce(F.max(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("max_gap"),
    )


def coalesce_findings(df: DataFrame, key: Sequence[str], offset: str, cap: int | None = None, is_error: Column | None = None) -> DataFrame:
    """Findings that are the same become one with count, first_offset and last_offset.

    With ``cap`` the first ones stay, errors before others, in the order of their first offset.
    """
    out = df.groupBy(*key).agg(F.count("*").alias("count"), F.min(offset).alias("first_offset"), F.max(offset).alias("last_offset"))
    if cap is None:
        return out
    order = [F.when(is_error, 0).otherwise(1)] if is_error is not None else []
    return out.orderBy(*order, F.col("first_offset").asc_nulls_last(), *key).limit(cap)


def rollup_report(df: DataFrame, levels: Sequence[str], error: Column) -> DataFrame:
    """Totals at every level down the hierarchy: level (how many levels are given), findings, errors, ok."""
    out = df.rollup(*levels).agg(F.grouping_id().alias("__g"), F.count("*").alias("findings"), F.count(F.when(error, 1)).alias("errors"))
    given = F.lit(len(levels)) - F.bit_count("__g")
    return out.select(*levels, given.cast("long").alias("level"), "findings", "errors", (F.col("errors") == 0).alias("ok"))


def coverage(streams: DataFrame, required: DataFrame, seen: DataFrame, keys: Sequence[str], name: str, ts: str, now: int, limit: int) -> DataFrame:
    """For each stream and required item: last_seen, age, and status MISSING, OVERDUE (older than ``limit``) or CURRENT.

    ``required`` is a list of requirements, which is small by nature; it is multiplied with the streams.
    """
    last = seen.groupBy(*keys, name).agg(F.max(ts).alias("last_seen"))
    wanted = streams.select(*keys).distinct().withColumn("__all", F.lit(1)).join(F.broadcast(required.select(name).withColumn("__all", F.lit(1))), "__all").drop("__all")
    out = wanted.join(last, [*keys, name], "left").withColumn("age", F.lit(now) - F.col("last_seen"))
    return out.withColumn("status", F.when(F.col("last_seen").isNull(), "MISSING").when(F.col("age") > limit, "OVERDUE").otherwise("CURRENT"))


def stage_metrics(df: DataFrame, stage: str, duration: str, status: Column, order: Sequence[str]) -> DataFrame:
    """For each stage: started, succeeded, failed, total and longest duration, and the last failure's duration."""
    failed = status == "failed"
    return df.groupBy(F.col(stage).alias("stage")).agg(
        F.count("*").alias("started"), F.count(F.when(~failed, 1)).alias("succeeded"), F.count(F.when(failed, 1)).alias("failed"),
        F.sum(duration).alias("total_duration"), F.max(duration).alias("max_duration"), F.max_by(duration, F.when(failed, F.struct(*order))).alias("last_failed_duration"),
    )
