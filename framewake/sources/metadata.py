"""Metadata streams: access unit cells, fragments, keyed packets, checked local sets, and the whole way from a file to values."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import running_sum_16
from ..operators.slices import carry, slice_of
from ..session import settle, tasks_of
from . import klv, programs, stream_files, transport
from .registry import decode_fields, registry

#: the key of the local set of the registry
LOCAL_SET_KEY = "060E2B34020B01010E01030101000000"
#: packets whose items one task gathers
TASK_PACKETS = 50_000


def _spread(df: DataFrame, raw: str, cut: Callable[[bytes], list[tuple]], names: list[str], kinds: list[pa.DataType], ddl: str) -> DataFrame:
    """The rows that ``cut`` makes of each row's octets, with the row's other columns; nothing is shuffled."""
    keys = [c for c in df.columns if c != raw]

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                found = [(i, *row) for i, data in enumerate(part.column(len(keys)).to_pylist()) for row in cut(data or b"")]
                if found:
                    at, *columns = zip(*found)
                    kept = [part.column(c).take(pa.array(at, pa.int64())) for c in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(columns, kinds)]], [*keys, *names])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*keys, raw).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", " + ddl)


def _cells(data: bytes) -> list[tuple]:
    found, at, before = [], 0, None
    while at < len(data):
        if len(data) - at < 5:
            return [*found, (len(found), None, None, None, None, None, "truncated")]
        service, sequence, flags = data[at], data[at + 1], data[at + 2]
        size = int.from_bytes(data[at + 3 : at + 5], "big")
        issue = "reserved" if flags & 15 != 15 else "truncated" if at + 5 + size > len(data) else "sequence" if before is not None and sequence != before + 1 & 255 else None
        if issue in ("reserved", "truncated"):
            return [*found, (len(found), service, sequence, None, None, None, issue)]
        found.append((len(found), service, sequence, flags >> 6, bool(flags & 16), data[at + 5 : at + 5 + size], issue))
        at, before = at + 5 + size, sequence
    return found


def unit_cells(df: DataFrame, raw: str = "payload") -> DataFrame:
    """Access unit wrappers to cells: the row's other columns, cell, service, sequence, fragment, random_access, data, issue.

    fragment: 3 a complete unit, 2 its first, 1 its last, 0 another part. issue: truncated and reserved end a wrapper; sequence,
    a number that doesn't follow the one before in its wrapper.
    """
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    return _spread(df, raw, _cells, ["cell", "service", "sequence", "fragment", "random_access", "data", "cell_issue"], kinds, "cell int, service int, sequence int, fragment int, random_access boolean, data binary, cell_issue string")


def _packets(data: bytes) -> list[tuple]:
    found, at = [], 0
    while at < len(data):
        try:
            if data[at : at + 4] != b"\x06\x0e\x2b\x34":
                return [*found, (len(found), at, None, None, None, "key")]
            size, start = klv._ber(data, at + 16)
            if start + size > len(data):
                raise ValueError
        except (ValueError, IndexError):
            return [*found, (len(found), at, None, None, None, "truncated")]
        found.append((len(found), at, data[at : at + 16], data[start : start + size], data[at : start + size], None))
        at = start + size
    return found


def keyed_packets(df: DataFrame, raw: str = "data") -> DataFrame:
    """Octets to packets of a 16-octet key, a length and a value: the row's other columns, n, at, key, value, packet, klv_issue.

    klv_issue: key, where no universal label begins, and truncated; either ends its row.
    """
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
    return _spread(df, raw, _packets, ["n", "at", "key", "value", "packet", "klv_issue"], kinds, "n int, at long, key binary, value binary, packet binary, klv_issue string")


def synchronous_units(pes: DataFrame) -> DataFrame:
    """Access units of synchronous metadata: file, program, pid, service, offset, pts, random_access, data, issue.

    Fragments of a service are put together in order. issue: of a PES packet stream_id, pts, dts or alignment; of a cell
    its own, or service, if no descriptor declares it, or lost, if numbers of a pid don't follow one another from packet to
    packet; of a unit fragment, if its first or last part is missing, or pts, if its parts have several. A unit of a bad
    packet or cell has no data.
    """
    wrong = (
        F.when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("stream_id") != 0xFC, "stream_id").when(F.col("pts").isNull(), "pts")
        .when(F.col("dts").isNotNull(), "dts").when(~F.col("aligned"), "alignment")
    )
    p = pes.where("carriage = 'synchronous'").withColumn("issue", wrong)
    bad = p.where("issue is not null").select("file", "program", "pid", F.lit(None).cast("int").alias("service"), F.col("first_offset").alias("offset"), "pts", F.lit(None).cast("boolean").alias("random_access"), F.lit(None).cast("binary").alias("data"), "issue")
    c = unit_cells(p.where("issue is null").select("file", "program", "pid", "first_offset", "pts", "services", "payload"))
    # a null service is a group of its own; a unit begins at a first or whole part, or behind a last or whole one
    place = lambda after: F.struct("first_offset", "cell", F.lit(after).alias("after"))
    first, done = F.when(F.col("fragment").isin(2, 3) | F.col("fragment").isNull(), place(0)), F.when(F.col("fragment").isin(1, 3), place(1))
    c = settle(c.withColumns({"__service": F.coalesce("service", F.lit(-1)), "__slice": slice_of("first_offset")}), "cells")
    c = carry(c, ["file", "pid"], "__slice", {"__prior": F.struct("first_offset", "cell", "sequence")})
    c = carry(c, ["file", "pid", "__service"], "__slice", {"__open": F.greatest(first, done)})
    by_pid = Window.partitionBy("file", "pid", "__slice").orderBy("first_offset", "cell")
    number = F.when(F.row_number().over(by_pid) == 1, F.col("__prior.sequence")).otherwise(F.lag("sequence").over(by_pid))
    lost = F.col("sequence") != (number + 1) % 256
    issue = F.when(F.col("cell_issue").isNotNull(), F.col("cell_issue")).when(~F.array_contains("services", F.col("service")), "service").when(lost, "lost")
    by_service = Window.partitionBy("file", "pid", "__service", "__slice").orderBy("first_offset", "cell")
    begun, ended = F.max(first).over(by_service.rowsBetween(Window.unboundedPreceding, 0)), F.max(done).over(by_service.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("cell_issue", issue).withColumn("__unit", F.greatest("__open", begun, ended))
    parts = F.sort_array(F.collect_list(F.struct("first_offset", "cell", "fragment", "random_access", "pts", "data")))
    u = c.groupBy("file", "program", "pid", "service", "__unit").agg(F.min("first_offset").alias("offset"), F.min("pts").alias("pts"), F.max("pts").alias("__last"), parts.alias("p"), F.min_by("cell_issue", F.when(F.col("cell_issue").isNotNull(), F.struct("first_offset", "cell"))).alias("issue"))
    n = F.size("p")
    first, last = F.element_at("p", 1)["fragment"], F.element_at("p", -1)["fragment"]
    whole = ((n == 1) & (first == 3)) | ((n > 1) & (first == 2) & (last == 1))
    issue = F.coalesce("issue", F.when(~whole, "fragment").when(F.col("pts") != F.col("__last"), "pts"))
    u = u.withColumn("issue", issue)
    good = u.select("file", "program", "pid", "service", "offset", "pts", F.element_at("p", 1)["random_access"].alias("random_access"), F.when(F.col("issue").isNull() | F.col("issue").isin("lost", "sequence"), transport.joined(F.col("p"), "data")).alias("data"), "issue")
    return good.union(bad)


def asynchronous_units(pes: DataFrame) -> DataFrame:
    """Octets of asynchronous metadata from each aligned PES packet to the next: the columns of ``synchronous_units``.

    What comes before a pid's first aligned packet is left out. issue: stream_id, unbounded (no packet length), pts.
    """
    wrong = (
        F.when(F.col("issue").isNotNull(), F.col("issue")).when(F.col("stream_id") != 0xBD, "stream_id").when(F.col("packet_length") == 0, "unbounded")
        .when(F.col("pts").isNotNull() | F.col("dts").isNotNull(), "pts")
    )
    p = pes.where("carriage = 'asynchronous'").withColumn("issue", wrong)
    empty = F.lit(None).cast("int").alias("service"), F.lit(None).cast("boolean").alias("random_access")
    bad = p.where("issue is not null").select("file", "program", "pid", empty[0], F.col("first_offset").alias("offset"), "pts", empty[1], F.lit(None).cast("binary").alias("data"), "issue")
    g = p.where("issue is null and octet_length(payload) > 0").select("file", "program", "pid", "first_offset", "payload", slice_of("first_offset").alias("__slice"), F.when(F.col("aligned"), F.col("first_offset")).alias("__start"))
    w = Window.partitionBy("file", "pid", "__slice").orderBy("first_offset").rowsBetween(Window.unboundedPreceding, 0)
    g = carry(g, ["file", "pid"], "__slice", {"__before": F.col("__start")}).withColumn("__unit", F.coalesce(F.max("__start").over(w), "__before")).where("__unit is not null")
    g = g.groupBy("file", "program", "pid", "__unit").agg(F.min("first_offset").alias("offset"), F.sort_array(F.collect_list(F.struct("first_offset", "payload"))).alias("p"))
    good = g.select("file", "program", "pid", empty[0], "offset", F.lit(None).cast("long").alias("pts"), empty[1], transport.joined(F.col("p"), "payload").alias("data"), F.lit(None).cast("string").alias("issue"))
    return good.union(bad)


def metadata_packets(pes: DataFrame) -> DataFrame:
    """Keyed packets of all metadata streams: file, program, pid, service, offset, pts, random_access, n, key, value, packet, issue."""
    units = settle(synchronous_units(pes).union(asynchronous_units(pes)), "units")
    k = keyed_packets(units)
    told = units.where("data is null").select("file", "program", "pid", "service", "offset", "pts", "random_access", F.lit(None).cast("int"), *[F.lit(None).cast("binary")] * 3, "issue")
    return k.select("file", "program", "pid", "service", "offset", "pts", "random_access", "n", "key", "value", "packet", F.coalesce("klv_issue", "issue").alias("issue")).union(told)


def packet_issue(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Items of each packet of the registry's local set (``keys``, value, packet) and why it isn't valid: ``keys``, items, and issue, null for a valid one.

    In this order: empty; truncated; item_143, not at the root; amend_and_segment; checksum_place, as the last item of two octets;
    time_place, first if it is there; time_missing; version_missing; repeated, of a tag that may not; checksum. A packet is
    checked in its row, so nothing is shuffled or sorted.
    """
    p = klv.local_set_lists(packets.select(*keys, "packet", F.col("value").alias("raw")))
    first, last = F.get("items", F.lit(0))["tag"], F.try_element_at("items", F.lit(-1))
    has = lambda tag: F.exists("items", lambda i: F.coalesce(i["tag"] == tag, F.lit(False)))
    single = F.filter(F.transform("items", lambda i: i["tag"]), lambda t: ~t.isin(100, 101, 102, 115))
    told = F.conv(F.hex(last["raw"]), 16, 10).cast("long")
    summed = running_sum_16(F.substring("packet", 1, 1 << 30).substr(F.lit(1), F.octet_length("packet") - 2))
    issue = (
        F.when(F.size("items") == 0, "empty").when(F.exists("items", lambda i: i["issue"].isNotNull()), "truncated").when(has(143), "item_143").when(has(100) & has(101), "amend_and_segment")
        .when((last["tag"] != 1) | (F.octet_length(last["raw"]) != 2), "checksum_place").when(has(2) & (first != 2), "time_place")
        .when(~has(2), "time_missing").when(~has(65), "version_missing").when(F.size(single) != F.size(F.array_distinct(single)), "repeated").when(summed != told, "checksum")
    )
    return p.select(*keys, "items", issue.alias("issue"))


def local_set_values(packets: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Typed items of the valid packets of the registry's local set among ``packets``, which are settled (``keys``, key, value, packet).

    Packets are dealt by ``keys`` to tasks of a bounded number of them, and their items stay there: what gathers the items of
    a packet by ``keys`` needs no other shuffle, and holds no more when there are more packets.
    """
    good = packet_issue(packets.where(F.hex("key") == LOCAL_SET_KEY), keys).where("issue is null").select(*keys, "items")
    good = good.repartition(tasks_of(packets, TASK_PACKETS), *keys)
    return decode_fields(good.select(*keys, F.inline("items")).drop("issue"), tags)


def scan_transport(spark: SparkSession, path: str, program: int | None = None) -> DataFrame:
    """From transport files to typed metadata items: file, program, pid, offset, n, service, pts, and the columns of ``decode_fields``.

    Three passes read ranges of the files, and each makes rows of the pids it is for alone: program associations, the program
    maps they name, and metadata; of video no packet ever becomes a row. Pids, a few for each file, choose the next pass's
    packets; metadata, a small part of a stream, is written to the shared folder in between.
    """
    stream_files.register(spark)
    packets = lambda pids: transport.parse_packets(
        spark.read.format("transport").option("path", path).option("pids", ",".join(map(str, sorted(pids)))).load().select("file", "offset", "raw")
    ).where("issue is null").select("file", F.col("pid").cast("long").alias("pid"), "offset", "pusi", "payload")
    pat = settle(programs.parse_pat(programs.sections(packets([0]))), "pat")
    wanted = pat.where("issue is null and current").select("file", F.col("pmt_pid").alias("pid")).distinct()
    # pids are 13 bits wide, so there are 8,192 at most
    maps = {r[0] for r in wanted.select("pid").distinct().collect()}
    pmt = programs.parse_pmt(programs.sections(packets(maps or {transport.NULL_PID}).join(wanted, ["file", "pid"], "left_semi")))
    # a stream begins with a map that has it and ends with its program's next one, whether that has it or not
    streams = settle(programs.stream_spans(pmt).where("kind = 'metadata'"), "streams")
    own = {r[0] for r in streams.select("pid").distinct().collect()}
    pes = settle(programs.demultiplex(packets(own or {transport.NULL_PID}), streams, program), "pes")
    found = settle(metadata_packets(pes).where("key is not null"), "found")
    return local_set_values(found, registry(spark), ["file", "program", "pid", "offset", "n", "service", "pts"])
