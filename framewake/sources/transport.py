"""Transport streams as tables: packets, their headers, and packetised elementary streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codecs import pts_decode
from ..operators.slices import carry, slice_of
from ..session import let, settle

#: fixed by the transport stream format
PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF


def _octet(raw: Column, at: int) -> Column:
    return F.conv(F.hex(raw.substr(at, 1)), 16, 10).cast("int")


#: packets of a range that one task reads at a time
RANGE_PACKETS = 1 << 18
#: octets of a range that are held at a time
BLOCK = 2 << 20
#: packets before a range that are read at first to be in step where it begins
LEAD = 16


def _in_step(octets: np.ndarray, at: int, end: int, depth: int = 4) -> int:
    """The first place from ``at`` on where sync octets stand, there and a packet's length apart after it, as far as the data goes; or ``end``.

    The search goes on in blocks that grow, so that it costs no more than what it passes over.
    """
    size = 4 * PACKET
    while at < end:
        stop = min(at + size, end)
        found = at + np.flatnonzero(octets[at:stop] == SYNC)
        for k in range(1, depth + 1):
            after = found + k * PACKET
            found = found[(after >= len(octets)) | (octets[np.minimum(after, len(octets) - 1)] == SYNC)]
        if len(found):
            return int(found[0])
        at, size = stop, 2 * size
    return end


def _run(octets: np.ndarray, at: int, end: int) -> int:
    """How many sync octets follow one another from ``at``, a packet's length apart, before ``end``."""
    n, size = 0, 64
    while at + n * PACKET < end:
        here = octets[at + n * PACKET : min(at + (n + size) * PACKET, end) : PACKET] == SYNC
        if not here.all():
            return n + int(np.argmin(here))
        n, size = n + len(here), 2 * size
    return n


def _followed(octets: np.ndarray, end: int, at: int, since: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int | None]:
    """What ``find_packets`` finds, and how it goes on after ``end``: the place where the next packet is due, or a search goes on, and where that began.

    ``since`` is such a beginning, before ``at``, or None where a packet is due.
    """
    places, lost, passed = [], [], 0
    while at < end:
        if since is not None or octets[at] != SYNC:
            begun = at if since is None else since
            at = _in_step(octets, at + 1 if since is None else at, end)
            if at >= end:
                since = begun
                break
            passed, since = at - begun, None
        n = _run(octets, at, end)
        places.append(at + PACKET * np.arange(n))
        lost.append(np.zeros(n, np.int64))
        lost[-1][0] = passed
        at, passed = at + PACKET * n, 0
    none = np.empty(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *lost]), at, since


def find_packets(octets: np.ndarray, end: int, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of all whole packets that start from ``at`` on, where one is due, and before ``end``, and the octets passed over before each one.

    While sync octets follow one another, a run is taken in one step; only where one is missing is the next searched.
    """
    return _followed(octets, min(end, len(octets) - PACKET + 1), at)[:2]


def _settled(octets: np.ndarray, until: int) -> int | None:
    """A place before ``until`` where a packet begins, whatever is before ``octets``; None if more than one place may.

    What is before can only have left a packet due at one of the first places, or a search that goes on. All of these are
    followed until they are at the same place: octets that look like sync octets may keep two apart for long.
    """
    end = len(octets) - PACKET + 1
    open_ = {int(k) for k in np.flatnonzero(octets[:PACKET] == SYNC)} | {_in_step(octets, PACKET, end)}
    while (at := min(open_)) < min(until, end):
        if len(open_) == 1:
            return at
        open_.remove(at)
        due = at + PACKET
        open_.add(due if due < end and octets[due] == SYNC else _in_step(octets, due + 1, end))
    return None


def range_blocks(file, start: int, end: int, size: int | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Of an open file, block by block: octets, the place of their first, and places and lost of the packets that begin in [start, end).

    The packets are those that a reading of the whole file finds: as much before the range is read as makes its first place
    sure, and each block goes on where the one before it ended. A block and what makes the first one sure is all that is held.
    """
    size = size or BLOCK
    lead, stop = LEAD, min(start + size, end)
    while True:
        begin = max(0, start - lead * PACKET)
        file.seek(begin)
        octets = np.frombuffer(file.read(stop + 5 * PACKET - begin), np.uint8)
        first = _settled(octets, start - begin) if begin else 0
        if first is not None or len(octets) <= start - begin:
            break
        lead *= 4
    at, since = first or 0, None
    while True:
        places, lost, at, since = _followed(octets, min(stop - begin, len(octets) - PACKET + 1), at, since)
        own = places >= start - begin
        yield octets, begin, places[own], lost[own]
        if stop >= end:
            return
        stop, moved = min(stop + size, end), at
        begin, at, since = begin + moved, 0, None if since is None else since - moved
        file.seek(begin)
        octets = np.frombuffer(file.read(max(0, stop + 5 * PACKET - begin)), np.uint8)


def packet_column(octets: np.ndarray, places: np.ndarray) -> pa.Array:
    """The packets at ``places`` as a binary column, copied in one step."""
    ends = pa.array(np.arange(0, (len(places) + 1) * PACKET, PACKET, dtype=np.int32))
    raw = np.lib.stride_tricks.sliding_window_view(octets, PACKET)[places]
    return pa.Array.from_buffers(pa.binary(), len(places), [None, ends.buffers()[1], pa.py_buffer(raw)])


def read_packets(spark: SparkSession, path: str, range_packets: int = RANGE_PACKETS) -> DataFrame:
    """(file, offset, discarded, raw) of every packet of the files at ``path``.

    A file is cut into ranges of whole packets, read by tasks of their own, so neither its size nor a row's limit matters.
    Where the sync octet is missing, a range looks on for the next place where it recurs at a packet's length; discarded
    counts the octets passed over before a packet. A packet belongs to the range it starts in; a range is in step with the
    packets before it. A last partial packet is
    left out; an empty file has no rows.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    size = range_packets * PACKET
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    ranges = files.where("length > 0").select("file", "length", F.explode(starts).alias("start")).repartition(F.col("file"), F.col("start"))

    def run(batches):
        for batch in batches:
            for name, length, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                store, where = filesystem.FileSystem.from_uri(name)
                with store.open_input_file(where) as f:
                    for octets, begin, at, lost in range_blocks(f, start, min(start + size, length)):
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at + begin), pa.array(lost), packet_column(octets, at)], ["file", "offset", "discarded", "raw"])

    return ranges.mapInArrow(run, "file string, offset long, discarded long, raw binary")


def parse_packets(packets: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the header fields of each packet, its payload, and issue: why it is malformed (sync, control, field, pcr).

    Of an adaptation field: discontinuity, random_access, pcr, opcr, splice_countdown and private_data.
    """
    r = F.col(raw)
    number = lambda start, n: F.conv(F.hex(r.substr(start, n)), 16, 10).cast("long")
    # the first six octets are read as one number, and the six of a clock as another
    out = packets.withColumn("__h", number(F.lit(1), F.lit(6)))
    octet = lambda k: F.shiftright("__h", 8 * (6 - k)).bitwiseAND(255).cast("int")
    out = out.withColumns({"__4": octet(5), "__5": octet(6)})
    out = out.withColumns({
        "sync_lost": octet(1) != SYNC, "tei": octet(2) >= 128, "pusi": F.shiftright(octet(2), 6) % 2 == 1,
        "pid": F.shiftright("__h", 24).bitwiseAND(0x1FFF).cast("int"), "scrambling": F.shiftright(octet(4), 6), "afc": F.shiftright(octet(4), 4) % 4, "cc": octet(4) % 16,
    })
    has_field = F.col("afc") >= 2
    length = F.when(has_field, F.col("__4") + 1).otherwise(0)
    flagged = has_field & (F.col("__4") > 0)
    flag = lambda bit: flagged & (F.shiftright("__5", bit) % 2 == 1)
    at = lambda k: number(k.cast("int"), F.lit(1)).cast("int")

    def clock(start: Column) -> Column:
        return let(number(start.cast("int"), F.lit(6)), lambda b: F.shiftright(b, 15) * 300 + b.bitwiseAND(511))

    opcr_at = F.lit(7) + F.when(flag(4), 6).otherwise(0)
    splice_at = opcr_at + F.when(flag(3), 6).otherwise(0)
    private_at = splice_at + F.when(flag(2), 1).otherwise(0)
    countdown = F.when(flag(2), at(splice_at))
    needed = private_at - 6 + F.when(flag(1), at(private_at) + 1).otherwise(0)
    issue = (
        F.when(F.col("sync_lost"), "sync").when(F.col("afc") == 0, "control")
        .when(has_field & (F.col("__4") > F.when(F.col("afc") == 3, 182).otherwise(183)), "field").when(flagged & (needed > F.col("__4")), "field")
    )
    fine = issue.isNull()
    return out.withColumns({
        "discontinuity": F.coalesce(flagged & (F.col("__5") >= 128), F.lit(False)), "random_access": F.coalesce(flag(6), F.lit(False)),
        "pcr": F.when(fine & flag(4), clock(F.lit(7))), "opcr": F.when(fine & flag(3), clock(opcr_at)),
        "splice_countdown": F.when(fine, F.when(countdown > 127, countdown - 256).otherwise(countdown)),
        "private_data": F.when(fine & flag(1), r.substr((private_at + 1).cast("int"), at(private_at))),
        "payload": F.when(F.col("afc") % 2 == 1, r.substr(length + 5, F.lit(PACKET))), "issue": issue,
    }).drop("__h", "__4", "__5")


def joined(parts: Column, field: str) -> Column:
    """The octets of an array of structs' ``field``, one after another."""
    return F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p[field]))


def assemble_pes(packets: DataFrame, keys: Sequence[str] = ("file", "pid"), order: str = "offset") -> DataFrame:
    """Packets to PES packets: keys, first_offset, packets and data, for each start and what follows it.

    What comes before a stream's first start is left out. A PES packet gathers its own packets only; ``keys`` must tell
    files apart as well as streams. ``order`` is a whole number. A packet belongs to the last start, which slices carry on.
    """
    own = packets.where(F.col("payload").isNotNull() & (F.col("pid") != NULL_PID)).withColumns({"__slice": slice_of(order), "__start": F.when(F.col("pusi"), F.col(order))})
    own = carry(settle(own.select(*keys, order, "__slice", "__start", "payload"), "packets"), keys, "__slice", {"__before": F.col("__start")})
    w = Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__pes", F.coalesce(F.max("__start").over(w), "__before")).where("__pes is not null")
    parts = own.groupBy(*keys, "__pes").agg(F.min(order).alias("first_offset"), F.count("*").alias("packets"), F.sort_array(F.collect_list(F.struct(order, "payload"))).alias("__p"))
    return parts.select(*keys, "first_offset", "packets", joined(F.col("__p"), "payload").alias("data"))


def parse_pes(pes: DataFrame, data: str = "data") -> DataFrame:
    """Add stream_id, packet_length, aligned, pts, dts, payload (without the header, and cut at the length if one is told) and issue.

    issue: start_code, header (too short, or its marker bits wrong), truncated (fewer octets than told), timestamp.
    """
    d = F.col(data)
    o = lambda k: _octet(d, k)
    number = lambda k, n: F.conv(F.hex(d.substr(k, n)), 16, 10).cast("long")
    # stream ids without the optional header
    bare = o(4).isin(0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
    told = number(5, 2)
    start = F.when(bare, F.lit(7)).otherwise(o(9) + 10)
    end = F.when(told == 0, F.octet_length(d)).otherwise(told + 6)
    clocks = F.shiftright(o(8), 6)
    pts, dts = pts_decode(d.substr(10, 5)), pts_decode(d.substr(15, 5))
    has_pts, has_dts = ~bare & (clocks >= 2), ~bare & (clocks == 3)
    issue = (
        F.when((F.octet_length(d) < 6) | (F.hex(d.substr(1, 3)) != "000001"), "start_code")
        .when(~bare & ((F.octet_length(d) < 9) | (F.shiftright(o(7), 6) != 2)), "header").when((told > 0) & (F.octet_length(d) < told + 6), "truncated")
        .when(~bare & ((clocks == 1) | (has_pts & ((o(9) < 5) | pts.isNull())) | (has_dts & ((o(9) < 10) | dts.isNull()))), "timestamp")
        .when(start - 1 > end, "header")
    )
    ok = issue.isNull()
    return pes.withColumns({
        "stream_id": F.when(ok, o(4)), "packet_length": F.when(ok, told), "aligned": F.when(ok, ~bare & (F.shiftright(o(7), 2) % 2 == 1)),
        "pts": F.when(ok & has_pts, pts), "dts": F.when(ok & has_dts, dts),
        "payload": F.when(ok, d.substr(start.cast("int"), (end - start + 1).cast("int"))), "issue": issue,
    })


def build_packet(pid: Column, cc: Column, pusi: Column, payload: Column, pcr: Column | None = None, discontinuity: Column | None = None) -> Column:
    """A packet of 188 octets. The payload is cut, or padded by an adaptation field's stuffing."""
    head = F.concat(F.lit("47"), F.lpad(F.hex((F.when(pusi, 0x4000).otherwise(0) + pid).cast("long")), 4, "0"))
    flags = (F.when(discontinuity, 128).otherwise(0) if discontinuity is not None else F.lit(0)) + (F.when(pcr.isNotNull(), 16).otherwise(0) if pcr is not None else F.lit(0))
    clock = F.lit("")
    if pcr is not None:
        base, extra = F.floor(pcr / F.lit(300)).cast("long"), pcr % 300
        bits = F.shiftright(base, 1)
        low = (base % 2) * 32768 + 0x7E00 + extra
        clock = F.when(pcr.isNotNull(), F.concat(F.lpad(F.hex(bits), 8, "0"), F.lpad(F.hex(low.cast("long")), 4, "0"))).otherwise("")
    field = F.concat(F.lpad(F.hex(flags.cast("long")), 2, "0"), clock)
    room = 183 - F.length(field) / 2
    body = F.hex(F.substring(payload, 1, 170))
    stuffing = F.repeat(F.lit("FF"), (room - F.length(body) / 2).cast("int"))
    length = F.lpad(F.hex((183 - F.length(body) / 2).cast("long")), 2, "0")
    return F.unhex(F.concat(head, F.lpad(F.hex((F.lit(0x30) + cc).cast("long")), 2, "0"), length, field, stuffing, body))
