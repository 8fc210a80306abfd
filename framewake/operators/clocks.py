"""Wrapped clocks, cadences, counters and sequence numbers as window scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join


def _rows(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def unwrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], ticks: str, modulus: int, name: str = "unwrapped") -> DataFrame:
    """Add ``name``: a clock that wraps at ``modulus`` made continuous, each step the nearest in either direction.

    A step of exactly half the modulus is ambiguous: ambiguous is true there, and the step is taken backward.
    """
    w = _rows(keys, order)
    half = modulus // 2
    raw = F.pmod(F.col(ticks) - F.lag(ticks).over(w) + half, F.lit(modulus)) - half
    df = df.withColumn("__d", F.coalesce(raw, F.lit(0))).withColumn("__first", F.first(ticks).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.col("__first") + F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, total).withColumn("ambiguous", F.col("__d") == -half).drop("__d", "__first")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], reset: Column, name: str = "segment") -> DataFrame:
    """Add ``name``: how many rows so far, this one included, declared a discontinuity."""
    return df.withColumn(name, F.sum(F.when(reset, 1).otherwise(0)).over(_rows(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def cadence(df: DataFrame, keys: Sequence[str], order: Sequence[str], ticks: str, limit: int, reset: Column) -> DataFrame:
    """Rows that come too late or go back: elapsed since the row before in the same segment, and code.

    interval: more than ``limit``, the limit itself is fine; regression: less than nothing.
    """
    cut = segments(df, keys, order, reset)
    w = Window.partitionBy(*keys, "segment").orderBy(*order)
    timed = cut.withColumn("elapsed", F.col(ticks) - F.lag(ticks).over(w))
    code = F.when(F.col("elapsed") > limit, "interval").when(F.col("elapsed") < 0, "regression")
    return timed.withColumn("code", code).where("code is not null")


def continuity(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, raw: str, *, modulus: int = 16,
    counted: Column | None = None, reset: Column | None = None,
) -> DataFrame:
    """Rows that count, with expected and continuity: first, ok, duplicate (the same counter and the same octets again), or error.

    Rows for which ``counted`` is false, such as null packets and those without payload, are left out and move no counter;
    ``reset``, a declared discontinuity, starts anew even on such a row.
    """
    cut = segments(df, keys, order, F.lit(False) if reset is None else reset, "__segment")
    if counted is not None:
        cut = cut.where(counted)
    w = _rows([*keys, "__segment"], order)
    before = F.lag(counter).over(w)
    again = (F.col(counter) == before) & (F.col(raw) == F.lag(raw).over(w))
    expected = (before + 1) % modulus
    kind = F.when(before.isNull(), "first").when(again, "duplicate").when(F.col(counter) == expected, "ok").otherwise("error")
    return cut.select("*", expected.alias("expected"), kind.alias("continuity")).drop("__segment")


def missing_slots(df: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Slots without a row between a key's first and last: key and slot. A row is made for each slot missing, gap by gap."""
    w = _rows(keys, [slot])
    seen = df.where(F.col(slot).isNotNull()).select(*keys, slot).distinct().withColumn("__next", F.lead(slot).over(w))
    gaps = seen.where(F.col("__next") > F.col(slot) + 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col(slot) + 1, F.col("__next") - 1)).alias(slot))


def sequence_audit(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str) -> DataFrame:
    """Arrivals by an unwrapped sequence number: verdict ok, late (at or below the highest before it) or loss, and lost.

    What is expected never moves back, so a late row changes nothing after it.
    """
    high = F.max(seq).over(_rows(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    verdict = F.when(high.isNull() | (F.col(seq) == high + 1), "ok").when(F.col(seq) <= high, "late").otherwise("loss")
    df = df.withColumn("verdict", verdict)
    return df.withColumn("lost", F.when(F.col("verdict") == "loss", F.col(seq) - high - 1).otherwise(F.lit(0)).cast("long"))


def unwrap_highest(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str, modulus: int) -> DataFrame:
    """Add unwrapped, each number taken the nearest way to the highest before it, and high, that highest; null at a key's first row.

    Rows of a key are streamed in their order and only the highest is held; where the nearest way to the row before
    is that to the highest too, as all but everywhere, a whole run is done in one step.
    """
    half, width = modulus // 2, len(keys)
    rows = df.select(*keys, F.struct(*df.columns).alias("__row"), F.col(seq).cast("long").alias("__seq"), *[F.col(o).alias(f"__o{k}") for k, o in enumerate(order)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{k}" for k in range(len(order))]).select("__row", "__seq", *keys)

    def run_of(s: np.ndarray, high: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        out, before, at = np.empty(len(s), np.int64), np.full(len(s), -1, np.int64), 0
        if high is None:
            out[0], high, at = s[0], int(s[0]), 1
        while at < len(s):
            part = s[at:]
            first = high + (part[0] - high + half) % modulus - half
            u = first + np.concatenate([[0], np.cumsum((np.diff(part) + half) % modulus - half)])
            top = np.maximum(high, np.concatenate([[high], np.maximum.accumulate(u)[:-1]]))
            right = top + (part - top + half) % modulus - half
            wrong = np.flatnonzero(u != right)
            n = int(wrong[0]) + 1 if len(wrong) else len(part)
            u[n - 1] = right[n - 1]
            out[at : at + n], before[at : at + n] = u[:n], top[:n]
            high, at = max(high, int(u[:n].max())), at + n
        return out, before, high

    def run(batches):
        last, high = None, None
        for batch in batches:
            owners = list(zip(*(batch.column(2 + k).to_pylist() for k in range(width))))
            s = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            out, before = np.empty(len(s), np.int64), np.full(len(s), -1, np.int64)
            edges = [0, *[k for k in range(1, len(owners)) if owners[k] != owners[k - 1]], len(owners)]
            fresh = np.zeros(len(s), bool)
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if owners[i] != last:
                    last, high, fresh[i] = owners[i], None, True
                out[i:j], before[i:j], high = run_of(s[i:j], high)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(before, mask=fresh)], ["__row", "unwrapped", "high"])

    kind = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(run, f"__row {kind}, unwrapped long, high long").select("__row.*", "unwrapped", "high")


def rtp_audit(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str, modulus: int = 65_536) -> DataFrame:
    """Arrivals of wrapped sequence numbers: unwrapped, and verdict ok, duplicate (seen before), late (below the highest) or loss, with lost.

    A number is unwrapped against the highest before it, the nearest way, so a row that comes late moves nothing.
    """
    near = unwrap_highest(df, keys, order, seq, modulus)
    times = F.row_number().over(_rows([*keys, "unwrapped"], order))
    high = F.col("high")
    near = near.withColumn("__times", times)
    verdict = (
        F.when(F.col("__times") > 1, "duplicate").when(high.isNull() | (F.col("unwrapped") == high + 1), "ok")
        .when(F.col("unwrapped") < high, "late").otherwise("loss")
    )
    near = near.withColumn("verdict", verdict)
    lost = F.when(F.col("verdict") == "loss", F.col("unwrapped") - high - 1).otherwise(F.lit(0)).cast("long")
    return near.withColumn("lost", lost).drop("high", "__times")


def regressions(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, discontinuity: Column) -> DataFrame:
    """Rows whose time goes back, or jumps without a declared discontinuity: add code regression or undeclared_repeat."""
    step = F.col(ts) - F.lag(ts).over(_rows(keys, order))
    code = F.when(~discontinuity & (step < 0), "regression").when(~discontinuity & (step == 0), "undeclared_repeat")
    return df.withColumn("code", code).where("code is not null")


def bounded_cadence(df: DataFrame, keys: Sequence[str], order: Sequence[str], low: str, high: str, limit: int, reset: Column | None = None) -> DataFrame:
    """Intervals between events whose times are known only to lie in [low, high], as between two clock readings.

    Events are to come more often than once in ``limit``. Add verdict: compliant if even the longest possible interval is below
    ``limit``, excessive if even the shortest isn't, else indeterminate; unverifiable where a bound is missing; first at a
    key's first row, and at a row of ``reset``, where the clock begins anew.
    """
    cut = segments(df, keys, order, F.lit(False) if reset is None else reset, "__segment")
    w = _rows([*keys, "__segment"], order)
    shortest, longest = F.col(low) - F.lag(high).over(w), F.col(high) - F.lag(low).over(w)
    first = F.row_number().over(w) == 1
    verdict = (
        F.when(first, "first").when(shortest.isNull() | longest.isNull(), "unverifiable").when(longest < limit, "compliant")
        .when(shortest >= limit, "excessive").otherwise("indeterminate")
    )
    return cut.withColumn("verdict", verdict).drop("__segment")


def overdue_tables(
    clocks: DataFrame, tables: DataFrame, keys: Sequence[str], order: str, ticks: str, pid: str, table: str, limit: int, modulus: int, reset: Column,
) -> DataFrame:
    """Tables proven to have stayed away for ``limit`` ticks: keys, table, told_at, clock_at (places), shortest, longest.

    clocks: keys, ``order``, ``ticks`` (wrapped at ``modulus``), ``pid``. tables: keys, ``order``, ``table``. A table came between
    the clock readings before and after it. At a reading before which it didn't come again, the time since is at least from the upper
    bound of its last coming; the first reading at which that is ``limit`` or more is told, once until it comes again. A
    discontinuity (``reset``), another pid and a clock that goes back begin anew: what came before isn't held against what comes after.
    """
    w = _rows(keys, [order])
    step = F.pmod(F.col(ticks) - F.lag(ticks).over(w) + modulus // 2, F.lit(modulus)) - modulus // 2
    c = clocks.withColumn("__step", step).withColumn("__new", F.lag(ticks).over(w).isNull() | F.coalesce(reset, F.lit(False)) | (F.lag(pid).over(w) != F.col(pid)) | (F.col("__step") < 0))
    c = c.withColumn("__segment", F.sum(F.col("__new").cast("long")).over(w)).withColumn("__time", F.sum(F.when(F.col("__new"), 0).otherwise(F.col("__step"))).over(w)).withColumn("__n", F.row_number().over(w))
    c = c.select(*keys, F.col(order).alias("__o"), F.struct(F.col("__segment").alias("segment"), F.col("__time").alias("time"), F.col("__n").alias("n"), F.col(order).alias("at")).alias("c"), F.lit(None).cast("string").alias("table"))
    t = tables.select(*keys, F.col(order).alias("__o"), F.lit(None).cast(c.schema["c"].dataType).alias("c"), F.col(table).alias("table"))
    both = Window.partitionBy(*keys).orderBy("__o", F.col("c").isNotNull())
    seen = c.union(t).withColumn("low", F.last("c", ignorenulls=True).over(both.rowsBetween(Window.unboundedPreceding, -1))).withColumn("high", F.first("c", ignorenulls=True).over(both.rowsBetween(1, Window.unboundedFollowing)))
    came = seen.where("table is not null and low.segment = high.segment").groupBy(*keys, "table", F.col("high.n").alias("n")).agg(F.max_by(F.struct(F.col("__o").alias("told_at"), "low", "high"), "__o").alias("t"))
    asked = c.select(*keys, F.col("c.n").alias("n"), "c").join(came.select(*keys, "table").distinct(), list(keys))
    last = came.select(*keys, "table", F.col("n").alias("__m"), "t")
    out = asof_join(asked, last, [*keys, "table"], "n", "__m", prefix="__").where("__t is not null and __t.high.segment = c.segment and ____m < n")
    out = out.withColumn("shortest", F.col("c.time") - F.col("__t.high.time")).withColumn("longest", F.col("c.time") - F.col("__t.low.time")).where(F.col("shortest") >= limit)
    once = F.row_number().over(Window.partitionBy(*keys, "table", "____m").orderBy("n"))
    return out.withColumn("__k", once).where("__k = 1").select(*keys, "table", F.col("__t.told_at").alias("told_at"), F.col("c.at").alias("clock_at"), "shortest", "longest")
