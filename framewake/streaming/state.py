"""Streaming forms over unbounded input: keyed carry-forward state and waiting metadata with timers, windows, de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: keyed state with timers and maps is kept by this provider
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(stream: DataFrame, key: str, ts: str, lateness: str, processor: StatefulProcessor, schema: str, by_row: bool = False) -> DataFrame:
    """Run ``processor`` over the rows of each key with event-time timers; ``ts`` is in microseconds.

    by_row: it takes and gives rows, which for many keys of few rows costs far less than a data frame for each. Rows later than ``lateness`` behind the newest time seen may be dropped. The processor gets the time as column __at too.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.withColumn("__at", F.timestamp_micros(F.col(ts))).withWatermark("__at", lateness)
    grouped = timed.groupBy(key)
    run = grouped.transformWithState if by_row else grouped.transformWithStateInPandas
    return run(processor, schema, "append", "EventTime")


class Carry(StatefulProcessor):
    """The value of a row's tag before it. State, read and written once for a key and batch: the newest time, and the last touch of each tag."""

    def __init__(self, columns: tuple[str, str, str, str, str], types: dict[str, str], ttl: int):
        self.columns, self.types, self.ttl = columns, types, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "newest long, touched array<struct<tag string, value double, at long>>")

    def keep(self, newest: int, touched: list[tuple]) -> None:
        self.held.update((newest, touched))
        # in milliseconds, after the last moment at which the first tag to go is visible
        self.handle.registerTimer((min(at for _, _, at in touched) + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        k, order, ts, tag, value = self.columns
        told_row = Row(k, order, ts, tag, "before", "late")
        newest, held = self.held.get() or (None, [])
        touched = {name: (v, at) for name, v, at in held}
        last, told = newest, False
        for at, n, name, v in sorted(((r[ts], r[order], r[tag], r[value]) for r in rows), key=lambda r: r[:2]):
            late = newest is not None and at < newest
            before = None
            if not late:
                was = touched.get(name)
                if was is not None and at - was[1] <= self.ttl:
                    before = was[0]
                touched[name], last, told = (v, at), at, True
            yield told_row(key[0], n, at, name, before, late)
        # a row older than the newest touches nothing and is told nothing, so what the newest can't see is of no use
        if told:
            self.keep(last, [(name, v, at) for name, (v, at) in touched.items() if last - at <= self.ttl])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = self.held.get()
        left = [t for t in held[1] if t[2] + self.ttl >= now] if held else []
        if not left:
            self.held.clear()
        elif len(left) < len(held[1]):
            self.keep(held[0], [tuple(t) for t in left])
        yield from ()

    def close(self) -> None:
        return None


def streaming_carry(stream: DataFrame, key: str, order: str, ts: str, tag: str, value: str, ttl: int, lateness: str = "1 hour") -> DataFrame:
    """The value of each arriving row's tag before it, if still visible: key, order, ts, tag, before, late.

    Rows of a batch are taken in the order of time; a row older than the key's newest is late: it is returned as such and
    touches nothing, or is dropped if it is later than ``lateness``. A tag leaves the state by a timer once the
    watermark is past the last moment it can be visible, and a key with its last tag, whether the key returns or not.
    """
    types = dict(stream.dtypes)
    out = f"{key} {types[key]}, {order} {types[order]}, {ts} long, {tag} string, before double, late boolean"
    return with_timers(stream, key, ts, lateness, Carry((key, order, ts, tag, value), types, ttl), out, by_row=True)


class MediaClock(StatefulProcessor):
    """Metadata waits until its key's first media time is known, or until a timer says that it never will be in time."""

    def __init__(self, key: str, patience: int, rate: int, modulus: int):
        self.key, self.patience, self.rate, self.modulus = key, patience, rate, modulus

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "pts long, first long, last long")
        self.pending = handle.getListState("pending", "ref long, pts long, at long")

    def project(self, key, found: pd.DataFrame, start: int | None, first: int) -> pd.DataFrame:
        half = self.modulus // 2
        by_clock = pd.Series(float("nan"), index=found.index)
        if start is not None:
            by_clock = ((found["pts"] - start + half) % self.modulus - half) / self.rate
        seconds = by_clock.fillna((found["at"] - first) / 1e6).clip(lower=0.0)
        return pd.DataFrame({self.key: key[0], "ref": found["ref"].astype("int64"), "seconds": seconds, "by_clock": by_clock.notna()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        all_ = pd.concat(list(rows)).sort_values(["at", "ref"], kind="stable")
        start, first, _ = self.start.get() if self.start.exists() else (None, None, None)
        media = all_[all_["media"] & all_["pts"].notna()]
        if start is None and len(media):
            start = int(media["pts"].iloc[0])
        own = all_[~all_["media"]][["ref", "pts", "at"]]
        if len(own):
            first = int(own["at"].iloc[0]) if first is None else first
        last = int(all_["at"].max())
        self.start.update((start, first, last))
        self.handle.registerTimer((last + self.patience) // 1000 + 1)
        if start is None:
            if len(own):
                self.pending.appendList([(int(r), None if pd.isna(p) else int(p), int(t)) for r, p, t in own.itertuples(index=False)])
            return
        held = pd.DataFrame(list(self.pending.get()), columns=["ref", "pts", "at"])
        self.pending.clear()
        own = pd.concat([held.astype({"pts": "float64"}), own.astype({"pts": "float64"})]) if len(held) else own
        if len(own):
            yield self.project(key, own.reset_index(drop=True), start, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.start.exists():
            return
        start, first, last = self.start.get()
        if (last + self.patience) // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():
            return  # something has come since
        held = pd.DataFrame(list(self.pending.get()), columns=["ref", "pts", "at"])
        self.pending.clear()
        self.start.clear()
        if len(held):
            yield self.project(key, held.astype({"pts": "float64"}), start, first)

    def close(self) -> None:
        return None


def live_samples(stream: DataFrame, key: str, patience: int, lateness: str, rate: int = 90_000, modulus: int = 1 << 33) -> DataFrame:
    """When each metadata row is to be shown: key, ref, seconds, by_clock. stream: key, ref, media (boolean), pts, at (microseconds).

    seconds: from the key's first media time, by the presentation time unwrapped to the nearest; without one, or where no
    media time comes, from the key's first metadata time; never below 0. Metadata before the first media time waits for
    it. A key of which nothing has come for ``patience`` microseconds, by the watermark, is finished: what waits is told without the clock,
    and the key leaves the state.
    """
    types = dict(stream.dtypes)
    return with_timers(stream, key, "at", lateness, MediaClock(key, patience, rate, modulus), f"{key} {types[key]}, ref long, seconds double, by_clock boolean")


def windowed(stream: DataFrame, ts: str, width: str, lateness: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates of tumbling windows, told once, when the watermark has passed their end: keys, start, end, aggregates.

    Rows later than ``lateness`` behind the newest time may be dropped, and no window is kept beyond that.
    """
    grouped = stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), *keys).agg(*aggregates)
    return grouped.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in grouped.columns if c != "window" and c not in keys])


def distinct_within(stream: DataFrame, ts: str, lateness: str, keys: list[str]) -> DataFrame:
    """The first row of each key among those less than ``lateness`` apart; a key leaves the state once the watermark passes it."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now, into Parquet files, and read them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_the_end(stream: DataFrame, end: DataFrame, shape: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Run ``shape`` over all of ``stream`` and then over ``end``, rows whose time lets every timer before them fire.

    Both are written to one folder, ``end`` when the stream has been taken, so that the watermark moves on as it would with time.
    """
    spark = stream.sparkSession
    # a folder that a stream has written takes no files of others, so the rows are copied
    run_once(stream, f"{path}/taken", f"{path}/state-in").write.parquet(f"{path}/in")
    source = spark.readStream.schema(stream.schema).parquet(f"{path}/in")
    found = shape(source)
    going = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state-out").outputMode("append").start()
    try:
        going.processAllAvailable()
        for _ in range(2):  # the watermark of one batch holds in the next
            end.select(*stream.columns).write.mode("append").parquet(f"{path}/in")
            going.processAllAvailable()
    finally:
        going.stop()
    return spark.read.schema(found.schema).parquet(f"{path}/out")
