"""Presentation and calendar times of a stream, its audio, and how many records of a keyed table can be seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: the least common multiple of 32,000, 44,100 and 48,000 samples a second: ticks in this unit are whole numbers
AUDIO_UNIT = 14_112_000


def utc_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, leap: Column, correction: Column, clears: tuple[Column, Column], ttl: int) -> DataFrame:
    """Add utc_us: the time less the leap seconds and with the correction that hold at the row.

    Both hold for ``ttl`` after they were told, or until a row clears them; without leap seconds utc_us is null, without a
    correction it is 0. A row whose time is below an earlier one has no utc_us, and tells nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    top = F.max(ts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("__forward", F.coalesce(F.col(ts) >= top, F.col(ts).isNotNull()))
    for name, value, clear in (("__leap", leap, clears[0]), ("__fix", correction, clears[1])):
        told = F.when(F.col("__forward") & (clear | value.isNotNull()), F.struct(F.when(~clear, value.cast("long")).alias("value"), F.col(ts).alias("at")))
        out = out.withColumn(name, F.last(told, ignorenulls=True).over(seen))
    held = lambda name: F.when(F.col(ts) - F.col(f"{name}.at") <= ttl, F.col(f"{name}.value"))
    utc = F.when(F.col("__forward"), F.col(ts) + F.coalesce(held("__fix"), F.lit(0)) - held("__leap") * 1_000_000)
    return out.withColumn("utc_us", utc).drop("__forward", "__leap", "__fix")


def audio_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], anchor: str, samples: str, rate: str, discontinuity: Column) -> DataFrame:
    """Add presented: the time of each audio frame in 90 kHz ticks, its last anchor and the exact durations since.

    Null before the first anchor, and after a discontinuity until the next one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = F.col(samples) * 90_000 * F.expr(f"{AUDIO_UNIT} div `{rate}`")
    out = df.withColumn("__before", F.coalesce(F.sum(lasts).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mark = F.when(F.col(anchor).isNotNull(), F.struct(F.col(anchor).alias("ticks"), F.col("__before").alias("from"))).when(discontinuity, F.struct(F.lit(None).cast("long").alias("ticks"), F.lit(0).cast("long").alias("from")))
    out = out.withColumn("__mark", F.last(mark, ignorenulls=True).over(upto))
    return out.withColumn("presented", F.col("__mark.ticks") + (F.col("__before") - F.col("__mark.from")) / AUDIO_UNIT).drop("__before", "__mark")


def audio_stats(df: DataFrame, keys: Sequence[str], samples: str, rate: str, channels: str, presented: str) -> DataFrame:
    """Of each audio stream: frames, samples, seconds, timed frames, frames of unknown channels, and the rates and channel counts seen."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.sum(samples).alias("samples"), (F.sum(F.col(samples) * F.expr(f"{AUDIO_UNIT} div `{rate}`")) / AUDIO_UNIT).alias("seconds"),
        F.count(presented).alias("timed"), F.count_if(F.col(channels).isNull()).alias("unknown_channels"),
        F.sort_array(F.collect_set(rate)).alias("rates"), F.sort_array(F.collect_set(channels)).alias("channel_counts"),
    )


def target_counts(df: DataFrame, stream: Sequence[str], target: str) -> DataFrame:
    """observations and targets, the distinct ids, of each stream; rows without an id are observations only."""
    return df.groupBy(*stream).agg(F.count("*").alias("observations"), F.count_distinct(target).alias("targets"))


def visible_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, record: str, clears: Column, ttl: int) -> DataFrame:
    """Add visible: how many records of a keyed table can be seen after each row.

    A row tells ``record`` (null: none), or clears the table. A record is seen until a row later than ``ttl`` after its last
    telling, or a clear. Each telling is an interval: one scan by stream and record, one by stream; no pairs are made. ``ts``
    must not fall in the given order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    at = F.struct(F.col(ts).alias("t"), F.lit(0).alias("after"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    shape = [F.lit(None).cast(df.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(order)]
    rows = df.withColumn("__at", at).withColumn("__clear", F.coalesce(clears, F.lit(False)))
    rows = rows.withColumn("__wiped", F.min(F.when(F.col("__clear"), F.col("__at"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    told = rows.where(F.col(record).isNotNull() & ~F.col("__clear"))
    again = F.lead("__at").over(Window.partitionBy(*keys, record).orderBy(*order))
    late = F.struct((F.col(ts) + ttl).alias("t"), F.lit(1).alias("after"), *shape)
    ends = told.withColumn("__again", again).select(*keys, F.least("__again", "__wiped", late).alias("__at"), F.lit(-1).alias("__d"))
    both = rows.drop("__wiped", "__clear").withColumn("__d", F.when(F.col(record).isNotNull() & ~F.coalesce(clears, F.lit(False)), 1).otherwise(0)).withColumn("__row", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    # rows of one place: what ends there is taken off with what begins
    total = F.sum("__d").over(Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("visible", total).where("__row").select(*df.columns, "visible")
