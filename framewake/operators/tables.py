"""Keyed tables that a stream repeats: visibility, references to them, order rules, changes of sets, and seeking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import let, settle, tasks_of
from .asof import asof_join

#: packets of a task in which each of them meets its stream's ids
TASK_PACKETS = 50_000


def visible_references(refs: DataFrame, records: DataFrame, clears: DataFrame, keys: Sequence[str], id_: str, ts: str, ttl: int, order: Sequence[str] = ()) -> DataFrame:
    """``refs`` (keys, id, ts, ...) with record_at, when the record referred to was last told, and known: whether it is visible.

    A record is visible while it is no older than ``ttl`` and its stream's table hasn't been cleared after it; at one time a
    clear comes before the records told with it. Each side is scanned once, by stream and id or by stream; no pairs are made.
    """
    told = records.select(*keys, id_, F.col(ts).alias("record_at")).distinct()
    out = asof_join(refs, told, [*keys, id_], ts, "record_at", tolerance=ttl, prefix="__")
    wiped = clears.select(*keys, F.col(ts).alias("clear_at")).distinct()
    out = asof_join(out, wiped, keys, ts, "clear_at", prefix="__")
    known = F.col("__record_at").isNotNull() & (F.col("__clear_at").isNull() | (F.col("__record_at") >= F.col("__clear_at")))
    return out.select(*refs.columns, F.when(known, F.col("__record_at")).alias("record_at"), known.alias("known"))


def active_issues(refs: DataFrame, records: DataFrame, clears: DataFrame, keys: Sequence[str], id_: str, ts: str, ttl: int, reserved: tuple[int, int], custom: int) -> DataFrame:
    """References to ids that are reserved, or custom and not visible: the columns of ``refs`` and issue (reserved, undefined)."""
    seen = visible_references(refs, records, clears, keys, id_, ts, ttl)
    issue = F.when(F.col(id_).between(*reserved), "reserved").when((F.col(id_) >= custom) & ~F.col("known"), "undefined")
    return seen.withColumn("issue", issue).where("issue is not null").select(*refs.columns, "issue")


def count_restarts(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, declared: str, ttl: int, cleared: Column | None = None) -> DataFrame:
    """Add restart: why a declared table begins anew at a row.

    count: the row tells another count than the last one told, which is no older than ``ttl`` and hasn't been cleared since;
    expired: this is the first row at which the last count told, or not at all in between, is older than ``ttl``; cleared: the row clears
    the table. Rows without a count leave it as it is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    wipes = F.coalesce(cleared, F.lit(False)) if cleared is not None else F.lit(False)
    word = F.when(wipes, F.struct(F.lit(None).cast(df.schema[declared].dataType).alias("n"), F.col(ts).alias("at"))).when(F.col(declared).isNotNull(), F.struct(F.col(declared).alias("n"), F.col(ts).alias("at")))
    df = df.withColumn("__w", F.last(word, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__before", F.lag(ts).over(w))
    held, at = F.col("__w.n").isNotNull(), F.col("__w.at")
    old = held & (F.col(ts) - at > ttl)
    first = old & (F.col("__before") - at <= ttl)
    restart = F.when(wipes, "cleared").when(first, "expired").when(held & ~old & (F.col(declared) != F.col("__w.n")), "count")
    return df.withColumn("restart", restart).drop("__w", "__before")


def missing_records(df: DataFrame, keys: Sequence[str], declared: str, id_: str) -> DataFrame:
    """For each key of a table's generation: total, missing (ids below the declared count that aren't there), complete."""
    got = df.groupBy(*keys).agg(F.max(declared).alias("total"), F.sort_array(F.collect_set(id_)).alias("__ids"))
    wanted = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    got = got.withColumn("missing", F.array_except(wanted, F.col("__ids").cast("array<bigint>")))
    return got.withColumn("complete", F.size("missing") == 0).drop("__ids")


def states_at(packets: DataFrame, records: DataFrame, clears: DataFrame, keys: Sequence[str], seq: str, ts: str, id_: str, value: str, ttl: int) -> DataFrame:
    """The table that a stream's records make, at each packet: keys, ``seq``, id, value, told (in this packet) and before.

    packets: keys, seq (their order), ts. records: those and id, value. clears: keys, seq. A record is there while it is no
    older than ``ttl`` and no clear stands after it. before: the value that its id had until this packet, null if none was left.
    Packets go to their stream once, with their records and clears, and meet its ids there, in tasks of a bounded number of
    packets; ids of a stream are few, so work grows with the packets.
    """
    own = records.groupBy(*keys, seq).agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(ts).alias("at"), F.col(value).alias("value"))).alias("__words"))
    wiped = clears.select(*keys, seq).distinct().withColumn("__clear", F.lit(True))
    both = packets.select(*keys, seq, ts, F.lit(True).alias("__asked")).join(own, [*keys, seq], "full").join(wiped, [*keys, seq], "full")
    both = settle(both, "states")
    both = both.repartition(tasks_of(both, TASK_PACKETS), *keys)
    ids = both.select(*keys, F.explode("__words.id").alias("id")).groupBy(*keys).agg(F.sort_array(F.collect_set("id")).alias("__all"))
    upto = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    wide = both.withColumn("__c", F.last(F.when(F.col("__clear"), F.col(seq)), ignorenulls=True).over(upto)).join(ids, list(keys))
    wide = wide.select(*keys, seq, ts, "__asked", "__c", "__words", F.explode("__all").alias(id_))
    word = let(F.try_element_at(F.filter("__words", lambda x: x["id"] == F.col(id_)), F.lit(-1)), lambda x: F.when(x.isNotNull(), F.struct(F.col(seq).alias("s"), x["at"].alias("at"), x["value"].alias("value"))))
    wide = wide.select(*keys, seq, ts, "__asked", "__c", id_, word.alias("__word"))
    w = Window.partitionBy(*keys, id_).orderBy(seq)
    last = F.last("__word", ignorenulls=True)
    wide = wide.withColumn("__l", last.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__p", last.over(w.rowsBetween(Window.unboundedPreceding, -1)))
    live = lambda x: (F.col(ts) - F.col(f"{x}.at") <= ttl) & (F.col("__c").isNull() | (F.col(f"{x}.s") > F.col("__c")))
    told = F.col("__word").isNotNull()
    before = F.when(told, F.when(live("__p"), F.col("__p.value"))).otherwise(F.col("__l.value"))
    return wide.where(F.col("__asked") & live("__l")).select(*keys, seq, id_, F.col("__l.value").alias(value), told.alias("told"), before.alias("before"))


def order_issues(
    packets: DataFrame, records: DataFrame, clears: DataFrame, keys: Sequence[str], seq: str, ts: str, id_: str, order: str, ttl: int, cancelled: int = 32767,
) -> DataFrame:
    """Violations of waypoint orders at each packet: keys, ``seq``, id, order, code; tables as in ``states_at``, a packet has an id once.

    duplicate_order: several waypoints that are there claim an order that isn't the cancelled one. historical_not_decreasing: a
    waypoint that this packet makes historical (below 0, and not below before) has an order that isn't below those of all other
    historical ones that are there, leaving out those that become so in this packet.
    """
    s = states_at(packets, records, clears, keys, seq, ts, id_, order, ttl)
    became = F.col("told") & (F.col(order) < 0) & (F.col("before").isNull() | (F.col("before") >= 0))
    at = Window.partitionBy(*keys, seq)
    s = s.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, seq, order))).withColumn("__low", F.min(F.when((F.col(order) < 0) & ~became, F.col(order))).over(at))
    codes = F.array_compact(F.array(
        F.when((F.col("__n") > 1) & (F.col(order) != cancelled), "duplicate_order"), F.when(became & (F.col(order) >= F.col("__low")), "historical_not_decreasing"),
    ))
    return s.select(*keys, seq, id_, order, F.explode(codes).alias("code"))


def set_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], items: str) -> DataFrame:
    """Add added, removed and kept: the array ``items`` of each row against the row before."""
    before = F.coalesce(F.lag(items).over(Window.partitionBy(*keys).orderBy(*order)), F.array().cast(df.schema[items].dataType))
    df = df.withColumn("__b", before)
    return df.withColumns({"added": F.sort_array(F.array_except(items, "__b")), "removed": F.sort_array(F.array_except("__b", items)), "kept": F.sort_array(F.array_intersect(items, "__b"))}).drop("__b")


def start_at(df: DataFrame, keys: Sequence[str], ts: str, start: int) -> DataFrame:
    """Rows from ``start`` on, and before them each key's last row at or before it, which tells the state there. Ties all stay."""
    w = Window.partitionBy(*keys)
    from_ = F.coalesce(F.max(F.when(F.col(ts) <= start, F.col(ts))).over(w), F.lit(start))
    return df.withColumn("__from", from_).where(F.col(ts) >= F.col("__from")).drop("__from")


def interleave(media: DataFrame, metadata: DataFrame, keys: Sequence[str], due: str) -> DataFrame:
    """Rows of both in one order: slot, kind and ref. At one time metadata goes before media. ref: the row's own place, column ``ref``."""
    both = media.select(*keys, F.col(due).alias("due"), F.lit("media").alias("kind"), "ref").union(metadata.select(*keys, F.col(due).alias("due"), F.lit("metadata").alias("kind"), "ref"))
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy("due", (F.col("kind") == "media"), "ref")) - 1
    return both.withColumn("slot", slot.cast("long"))


def effective_fields(items: DataFrame, keys: Sequence[str], tag: str, chains: Sequence[Sequence[int]]) -> DataFrame:
    """Items without those that a preferred representation of the same quantity supersedes. chains: tags, the preferred first."""
    place = {t: (k, n) for k, chain in enumerate(chains) for n, t in enumerate(chain)}
    pick = lambda i: F.coalesce(*[F.when(F.col(tag) == t, p[i]) for t, p in place.items()])
    w = Window.partitionBy(*keys, "__chain")
    ranked = items.withColumn("__chain", pick(0)).withColumn("__place", pick(1))
    ranked = ranked.withColumn("__best", F.min("__place").over(w))
    return ranked.where(F.col("__chain").isNull() | (F.col("__place") == F.col("__best"))).drop("__chain", "__place", "__best")


def expectation_issues(df: DataFrame, expected: Sequence[tuple[str, Column, float]]) -> Column:
    """Names of columns that don't match what is expected: equal within a tolerance, or both null."""
    wrong = [F.when(~F.coalesce(F.abs(F.col(c) - e) <= tolerance, F.col(c).isNull() & e.isNull()), c) for c, e, tolerance in expected]
    return F.array_compact(F.array(*wrong))


def byte_times(bytes_: DataFrame, clock: DataFrame, keys: Sequence[str], offset: str, ticks: str) -> DataFrame:
    """``bytes_`` with at_ticks: when each octet arrives, interpolated between the clock readings around it; null beyond the ends."""
    mark = F.when(F.col("__side") == 0, F.struct("__o", "__t"))
    a = bytes_.select(*keys, F.col(offset).alias("__o"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__t"), F.struct(*bytes_.columns).alias("__l"))
    b = clock.select(*keys, F.col(offset).alias("__o"), F.lit(0).alias("__side"), F.col(ticks).cast("long").alias("__t"))
    w = Window.partitionBy(*keys).orderBy("__o", "__side")
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("__p", F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    p, n = F.col("__p"), F.col("__n")
    at = p["__t"] + F.floor((F.col("__o") - p["__o"]) * (n["__t"] - p["__t"]) / (n["__o"] - p["__o"]))
    return both.where("__side = 1").select("__l.*", at.cast("long").alias("at_ticks"))


def integrity(relations: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """References that point to nothing, of several relations (name, rows with ref, its column, dimension, its key): relation, ref, rows.

    Each is a left anti join against the distinct keys; rows are counted on both sides of the shuffle.
    """
    parts = []
    for name, rows, column, dimension, key in relations:
        known = dimension.select(F.col(key).alias("__k")).distinct()
        bad = rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__k"), "left_anti")
        parts.append(bad.groupBy(F.col(column).cast("string").alias("ref")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "ref", "rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
