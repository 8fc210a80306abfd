"""As-of joins: the latest, the exactly equal or the nearest row of another table within a tolerance.

Both sides are laid over one another and scanned once by key, so no pair of rows is ever formed: one shuffle, one sort.
At equal times a right row counts as before a left one, so tolerances and equality are inclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, right_order: Sequence[str]) -> DataFrame:
    taken = F.struct(F.col(right_ts).alias("__ts"), *[F.col(c) for c in right.columns if c not in keys and c != right_ts])
    a = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), taken.alias("__r"), F.struct(*right_order).alias("__o"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, *,
    tolerance: int | None = None, mode: str = "latest", right_order: Sequence[str] = (), prefix: str = "right_",
) -> DataFrame:
    """Every left row with the columns of its right row, named with ``prefix``; nulls where there is none.

    mode: latest (at or before), nearest (either side, the earlier of equal distances), or exact. Right rows without a
    time never match. Of right rows at one time the last by ``right_order`` is taken.
    """
    right = right.where(F.col(right_ts).isNotNull())
    both = _over(left, right, keys, left_ts, right_ts, right_order or [right_ts])
    w = Window.partitionBy(*keys).orderBy("__t", "__side", "__o")
    back = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    scanned = both.withColumn("__back", back)
    gap = F.col("__t") - F.col("__back.__ts")
    if mode == "nearest":
        ahead = F.first("__r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        scanned = scanned.withColumn("__ahead", ahead)
        later = F.col("__ahead.__ts") - F.col("__t")
        scanned = scanned.withColumn("__m", F.when(F.col("__back").isNull() | (later < gap), F.col("__ahead")).otherwise(F.col("__back")))
    else:
        scanned = scanned.withColumn("__m", F.col("__back"))
    distance = F.abs(F.col("__t") - F.col("__m.__ts"))
    limit = 0 if mode == "exact" else tolerance
    chosen = F.col("__m") if limit is None else F.when(distance <= limit, F.col("__m"))
    out = scanned.where("__side = 1").select("__l.*", chosen.alias("__m"))
    rest = [c for c in right.columns if c not in keys and c != right_ts]
    return out.select(*left.columns, F.col("__m.__ts").alias(prefix + right_ts), *[F.col(f"__m.{c}").alias(prefix + c) for c in rest])


def asof_all(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, order: Sequence[str], *,
    tolerance: int | None = None, mode: str = "latest", name: str = "matches",
) -> DataFrame:
    """Every left row with the time of its right rows, as ``asof_join`` chooses it, and all of them by ``order`` in the array ``name``.

    Left rows without a time, or none in reach, have a null time and an empty array. Right rows without a time never match.
    """
    rest = [*order, *[c for c in right.columns if c not in keys and c != right_ts and c not in order]]
    at_once = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, right_ts).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    out = asof_join(left, at_once, keys, left_ts, right_ts, tolerance=tolerance, mode=mode, prefix="matched_")
    return out.withColumn(name, F.coalesce(f"matched_{name}", F.array().cast(at_once.schema[name].dataType))).drop(f"matched_{name}")


def correlate(
    frames: DataFrame, metadata: DataFrame, keys: Sequence[str], pts: str, ts: str, order: Sequence[str], *,
    offset: int = 0, tolerance: int | None = 63_000, mode: str = "latest", rate: int = 90_000,
) -> DataFrame:
    """Frames with effective_pts (unwrapped ``pts`` and ``offset``), metadata (all packets of the time chosen) and derived_ts.

    derived_ts is the frame's own ``ts`` if it has one, else the chosen packets' last ``ts`` and the ticks since, rounded to
    microseconds with halves away from zero. Asynchronous metadata, whose ``pts`` is null, is never chosen.
    """
    timed = frames.withColumn("effective_pts", F.col(pts) + offset)
    out = asof_all(timed, metadata, keys, "effective_pts", pts, order, tolerance=tolerance, mode=mode, name="metadata")
    ticks = (F.col("effective_pts") - F.col(f"matched_{pts}")).cast("decimal(30,0)") * 1_000_000
    since = F.round(ticks / F.lit(rate), 0).cast("long")
    return out.withColumn("derived_ts", F.coalesce(F.col(ts), F.try_element_at("metadata", F.lit(-1))[ts] + since))


def bracket(points: DataFrame, clock: DataFrame, keys: Sequence[str], ts: str, clock_ts: str) -> DataFrame:
    """Each point with the clock readings around it: before (at or before) and after (strictly after); nulls beyond the ends."""
    a = points.select(*keys, F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*points.columns).alias("__l"))
    b = clock.select(*keys, F.col(clock_ts).alias("__t"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side")
    mark = F.when(F.col("__side") == 0, F.col("__t"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("before", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return both.where("__side = 1").select("__l.*", "before", "after")
