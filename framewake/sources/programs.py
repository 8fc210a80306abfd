"""Programs of a transport stream: sections, program tables, and elementary streams with their kinds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import mpeg2_crc32
from ..operators.slices import numbered, slice_of
from ..session import settle
from .transport import NULL_PID, assemble_pes, joined, parse_pes

# Stream types of video and of audio
VIDEO = (0x01, 0x02, 0x10, 0x1B, 0x20, 0x21, 0x24, 0x42)
AUDIO = (0x03, 0x04, 0x0F, 0x11, 0x1C, 0x2D)


def _sections(data: bytes, longest: int) -> list[tuple[bytes | None, str | None]]:
    found, at = [], 0
    while at < len(data) and data[at] != 0xFF:
        if len(data) - at < 3:
            return [*found, (None, "incomplete")]
        size = (data[at + 1] & 15) << 8 | data[at + 2]
        if size > longest:
            return [*found, (None, "length")]
        if at + 3 + size > len(data):
            return [*found, (None, "incomplete")]
        found.append((data[at : at + 3 + size], None))
        at += 3 + size
    if data[at:].strip(b"\xff"):
        found.append((None, "stuffing"))
    return found


def sections(packets: DataFrame, file: str = "file", order: str = "offset", longest: int = 1021) -> DataFrame:
    """Packets of section streams to sections: file, pid, offset (of the packet that a section's run starts in), n, section, issue.

    A start packet's pointer says where the run before ends and the next begins; a run holds one section or more and then
    stuffing. issue: pointer (beyond its packet), incomplete, length, stuffing. What comes before a first start is left out.
    """
    p = packets.where(F.octet_length("payload") > 0)
    pointer = F.when(F.col("pusi"), F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int"))
    size = F.octet_length("payload")
    bad = pointer > size - 1
    rest = F.struct(F.lit(0).alias("starts"), F.when(F.col("pusi"), F.when(bad, F.lit(b"")).otherwise(F.col("payload").substr(F.lit(2), pointer))).otherwise(F.col("payload")).alias("data"), F.lit(None).cast("string").alias("issue"))
    begin = F.struct(F.lit(1).alias("starts"), F.when(bad, F.lit(b"")).otherwise(F.col("payload").substr(pointer + 2, size)).alias("data"), F.when(bad, "pointer").alias("issue"))
    pieces = p.select(file, "pid", order, F.posexplode(F.when(F.col("pusi"), F.array(rest, begin)).otherwise(F.array(rest))).alias("k", "e")).select(file, "pid", order, "k", "e.*")
    w = Window.partitionBy(file, "pid").orderBy(order, "k").rowsBetween(Window.unboundedPreceding, 0)
    runs = pieces.withColumn("run", F.sum("starts").over(w)).where("run > 0")
    parts = F.sort_array(F.collect_list(F.struct(order, "k", "data")))
    runs = runs.groupBy(file, "pid", "run").agg(F.min(order).alias("offset"), F.max("issue").alias("issue"), parts.alias("p"))

    def cut(batches):
        for batch in batches:
            out = [
                (i, n, section, issue)
                for i, (data, told) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
                for n, (section, issue) in enumerate([(None, told)] if told else _sections(data, longest))
            ]
            if out:
                at, n, section, issue = zip(*out)
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int32()), pa.array(section, pa.binary()), pa.array(issue, pa.string())], ["file", "pid", "offset", "n", "section", "issue"])

    kind = dict(packets.dtypes)
    out = runs.select(file, "pid", "offset", joined(F.col("p"), "data").alias("data"), "issue")
    return out.mapInArrow(cut, f"file {kind[file]}, pid {kind['pid']}, offset {kind[order]}, n int, section binary, issue string")


def _number(raw: Column, at: int | Column, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at.cast("int")
    return F.conv(F.hex(raw.substr(at, F.lit(n))), 16, 10).cast("long")


def _common(tables: DataFrame, table_id: int, least: int) -> DataFrame:
    s = F.col("section")
    told = _number(s, 2, 2)
    issue = (
        F.when(_number(s, 1, 1) != table_id, "table_id").when(F.octet_length(s) < least, "short").when(told % 4096 + 3 != F.octet_length(s), "length")
        .when(F.shiftright(told, 15) % 2 != 1, "syntax").when(mpeg2_crc32(s) != 0, "crc")
    )
    return tables.withColumns({
        "extension": _number(s, 4, 2), "version": F.shiftright(_number(s, 6, 1), 1) % 32, "current": _number(s, 6, 1) % 2 == 1,
        "issue": F.coalesce("issue", issue),
    })


def parse_pat(tables: DataFrame) -> DataFrame:
    """Program association sections to rows file, offset, version, current, program, pmt_pid, issue; a bad section is one row.

    The network's entry, program 0, is left out. issue: table_id, short, length, syntax, crc, loop, duplicate, or why there is no section.
    """
    t = _common(tables, 0, 12)
    n = F.octet_length("section") - 12
    loop = F.transform(F.sequence(F.lit(0), (F.greatest(n, F.lit(4)) / 4).cast("int") - 1), lambda k: _number(F.col("section"), 9 + 4 * k, 4))
    loop = F.when(F.col("issue").isNull() & (n >= 4) & (n % 4 == 0), loop).otherwise(F.array().cast("array<bigint>"))
    programs = F.transform(loop, lambda x: F.shiftright(x, 16))
    t = t.withColumn("issue", F.coalesce("issue", F.when(n % 4 != 0, "loop").when(F.size(F.array_distinct(programs)) < F.size(programs), "duplicate")))
    entries = F.filter(F.transform(loop, lambda x: F.struct(F.shiftright(x, 16).alias("program"), (x % 8192).alias("pmt_pid"))), lambda e: e["program"] != 0)
    t = t.select("file", "offset", "version", "current", "issue", F.explode_outer(F.when(F.col("issue").isNull(), entries)).alias("e"))
    return t.where("e is not null or issue is not null").select("file", "offset", "version", "current", "e.program", "e.pmt_pid", "issue")


def _descriptors(data: bytes) -> list[tuple[int, bytes]] | None:
    found, at = [], 0
    while at < len(data):
        if len(data) - at < 2 or at + 2 + data[at + 1] > len(data):
            return None
        found.append((data[at], data[at + 2 : at + 2 + data[at + 1]]))
        at += 2 + data[at + 1]
    return found


def _streams(section: bytes) -> tuple[int | None, list, str | None]:
    """The clock's pid and (type, pid, descriptors) of a program map section."""
    clock, end = (section[8] & 0x1F) << 8 | section[9], len(section) - 4
    at = 12 + ((section[10] & 15) << 8 | section[11])
    if at > end or _descriptors(section[12:at]) is None:
        return clock, [], "descriptors"
    streams = []
    while at < end:
        if end - at < 5:
            return clock, [], "stream_header"
        stop = at + 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
        own = _descriptors(section[at + 5 : stop]) if stop <= end else None
        if own is None:
            return clock, [], "descriptors"
        streams.append((section[at], (section[at + 1] & 0x1F) << 8 | section[at + 2], own))
        at = stop
    return clock, streams, None


_PMT = "file string, pmt_pid long, offset long, program long, version long, current boolean, pcr_pid int, streams array<struct<stream_type int, pid int, descriptors array<struct<tag int, data binary>>>>, issue string"


def parse_pmt(tables: DataFrame) -> DataFrame:
    """Program map sections to rows file, pmt_pid, offset, program, version, current, pcr_pid, streams, issue.

    streams: (stream_type, pid, descriptors (tag, data)). issue: table_id, short, length, syntax, crc, descriptors, stream_header.
    """
    t = _common(tables, 2, 16).select(F.col("file").cast("string").alias("file"), F.col("pid").cast("long").alias("pmt_pid"), F.col("offset").cast("long").alias("offset"), F.col("extension").alias("program"), "version", "current", "section", "issue")

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                section, issue = row.pop("section"), row.pop("issue")
                clock, streams, wrong = (None, [], None) if issue else _streams(section)
                own = [{"stream_type": k, "pid": p, "descriptors": [{"tag": t, "data": x} for t, x in d]} for k, p, d in streams]
                yield pa.RecordBatch.from_pylist([row | {"pcr_pid": clock, "streams": own, "issue": issue or wrong}], schema=schema)

    stream = pa.struct([("stream_type", pa.int32()), ("pid", pa.int32()), ("descriptors", pa.list_(pa.struct([("tag", pa.int32()), ("data", pa.binary())])))])
    schema = pa.schema([("file", pa.string()), ("pmt_pid", pa.int64()), ("offset", pa.int64()), ("program", pa.int64()), ("version", pa.int64()), ("current", pa.bool_()), ("pcr_pid", pa.int32()), ("streams", pa.list_(stream)), ("issue", pa.string())])
    return t.mapInArrow(cut, _PMT)


def metadata_format(data: Column) -> Column:
    """The metadata format identifier of a metadata descriptor's octets, as text; null if it has none."""
    skip = F.when(F.hex(data.substr(1, 2)) == "FFFF", 7).otherwise(3)
    return F.when(F.hex(data.substr(skip, F.lit(1))) == "FF", F.hex(data.substr((skip + 1).cast("int"), F.lit(4))))


def service_id(data: Column) -> Column:
    """The metadata service of a metadata descriptor's octets."""
    skip = F.when(F.hex(data.substr(1, 2)) == "FFFF", 7).otherwise(3)
    return F.conv(F.hex(data.substr(skip + F.when(F.hex(data.substr(skip, F.lit(1))) == "FF", 5).otherwise(1), F.lit(1))), 16, 10).cast("int")


def elementary_streams(pmt: DataFrame) -> DataFrame:
    """Streams of current, well-formed program maps: file, program, pid, from_offset, stream_type, kind, carriage, services.

    kind: metadata, video, audio or data. carriage: asynchronous (private data registered as KLVA) or synchronous (metadata in
    access units whose descriptor names KLVA); services: the metadata services declared by such descriptors.
    """
    klva = "4B4C5641"
    s = pmt.where("issue is null and current").select("file", "program", F.col("offset").alias("from_offset"), F.explode("streams").alias("s")).select("file", "program", "from_offset", "s.*")
    registered = F.exists("descriptors", lambda d: (d["tag"] == 0x05) & (F.hex(d["data"].substr(1, 4)) == klva))
    named = F.filter("descriptors", lambda d: (d["tag"] == 0x26) & (metadata_format(d["data"]) == klva))
    carriage = F.when((F.col("stream_type") == 0x06) & registered, "asynchronous").when((F.col("stream_type") == 0x15) & (F.size(named) > 0), "synchronous")
    kind = F.when(carriage.isNotNull(), "metadata").when(F.col("stream_type").isin(*VIDEO), "video").when(F.col("stream_type").isin(*AUDIO), "audio").otherwise("data")
    return s.select("file", "program", "pid", "from_offset", "stream_type", kind.alias("kind"), carriage.alias("carriage"), F.transform(named, lambda d: service_id(d["data"])).alias("services"))


def program_tables(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Program association rows and program map rows of parsed packets (file, offset, pid, pusi, payload)."""
    pat = settle(parse_pat(sections(packets.where("pid = 0"))), "pat")
    # a row for each program of a file: its size is known from the table, so Spark broadcasts it only where it is small
    wanted = settle(pat.where("issue is null and current").select("file", F.col("pmt_pid").alias("pid")).distinct(), "maps")
    maps = packets.where("pid <> 0").join(wanted, ["file", "pid"], "left_semi")
    return pat, parse_pmt(sections(maps))


def stream_spans(pmt: DataFrame) -> DataFrame:
    """``elementary_streams`` with until_offset: where the program's next current map stands, null for its last.

    A map that a program repeats unchanged begins no new span; one that no longer has a stream ends it.
    """
    maps = pmt.where("issue is null and current")
    w = Window.partitionBy("file", "program").orderBy("offset")
    fresh = F.lag("streams").over(w).isNull() | (F.lag("streams").over(w) != F.col("streams"))
    changed = maps.withColumn("__new", fresh).where("__new")
    ends = changed.withColumn("until_offset", F.lead("offset").over(w)).select("file", "program", F.col("offset").alias("from_offset"), "until_offset")
    kept = changed.drop("__new")
    return elementary_streams(kept).withColumn("pid", F.col("pid").cast("long")).join(ends, ["file", "program", "from_offset"])


def demultiplex(packets: DataFrame, streams: DataFrame, program: int | None = None) -> DataFrame:
    """PES packets with the stream that is active where they start: its columns and those of ``parse_pes``.

    A stream's packets before its first program map, after a map of its program that no longer has it, and pids that no map
    names, are left out; ``streams`` of ``stream_spans`` say where they end, those of ``elementary_streams`` go on to the pid's next.
    A PES packet that is cut off by the end of its stream is left out with it. ``program`` keeps one program.
    """
    streams = streams if program is None else streams.where(F.col("program") == program)
    if "until_offset" not in streams.columns:
        streams = streams.withColumn("until_offset", F.lit(None).cast("long"))
    told = ("program", "stream_type", "kind", "carriage", "services")
    # of streams that begin at one place the last program's counts; each goes on to the pid's next, or ends before
    spans = streams.where("from_offset is not null").groupBy("file", "pid", F.col("from_offset").cast("long").alias("__span")).agg(F.max_by(F.struct("until_offset", *told), "program").alias("s"))
    following = F.lead("__span").over(Window.partitionBy("file", "pid").orderBy("__span"))
    spans = settle(spans.withColumn("__end", F.least("s.until_offset", following)), "spans")
    last = spans.where("__end is null").select("file", "pid", F.col("__span").alias("__last"))
    pieces = F.sequence(slice_of("__span"), slice_of(F.col("__end") - 1))
    ended = spans.where("__end > __span").select("file", "pid", F.col("__span").alias("__own"), "__end", F.explode(pieces).alias("__slice"))
    own = packets.where(F.col("pid") != NULL_PID).select("file", "pid", "offset", "pusi", "payload").withColumn("__slice", slice_of("offset"))
    own = own.join(spans.select("file", "pid").distinct(), ["file", "pid"], "left_semi").join(last, ["file", "pid"], "left")
    a, b = own.alias("a"), ended.alias("b")
    same = (F.col("a.file") == F.col("b.file")) & (F.col("a.pid") == F.col("b.pid")) & (F.col("a.__slice") == F.col("b.__slice"))
    own = a.join(b, same & (F.col("a.offset") >= F.col("b.__own")) & (F.col("a.offset") < F.col("b.__end")), "left").select("a.*", "b.__own")
    active = own.withColumn("__span", F.coalesce(F.when(F.col("offset") >= F.col("__last"), F.col("__last")), "__own")).where("__span is not null")
    # of a stream that ends and begins again, packets of two spans aren't put together
    pes = parse_pes(assemble_pes(active.select("file", "pid", "offset", "pusi", "payload", "__span"), ["file", "pid", "__span"]))
    kept = [c for c in pes.columns if c != "__span"]
    return pes.join(spans, ["file", "pid", "__span"]).select(*kept, *[F.col(f"s.{c}").alias(c) for c in told])


def clock_events(packets: DataFrame, pmt: DataFrame) -> DataFrame:
    """A row for each program that a packet's clock reading is for: file, program, pid, offset, pcr, opcr, discontinuity.

    A pid may clock several programs.
    """
    clocks = pmt.where("issue is null and current").select("file", "program", F.col("pcr_pid").alias("pid"), F.col("offset").alias("since"))
    w = Window.partitionBy("file", "program").orderBy("since")
    clocks = clocks.withColumn("until", F.lead("since").over(w))
    own = packets.where("pcr is not null").join(clocks, ["file", "pid"])
    own = own.where((F.col("offset") >= F.col("since")) & (F.col("until").isNull() | (F.col("offset") < F.col("until"))))
    return own.select("file", "program", "pid", "offset", "pcr", "opcr", "discontinuity")


def declaration_issues(pmt: DataFrame) -> DataFrame:
    """What is wrong with the declaration of metadata streams in program maps: file, program, pid, code.

    For streams of access units (type 0x15): metadata_descriptor (none), metadata_format_identifier (none names KLVA),
    metadata_service_id_duplicate, metadata_std_descriptor_count (not one). For private data (0x06) whose registration isn't
    KLVA though a metadata descriptor is there: registration_descriptor.
    """
    s = pmt.where("issue is null and current").select("file", "program", F.explode("streams").alias("s")).select("file", "program", "s.*")
    tagged = lambda t: F.filter("descriptors", lambda d: d["tag"] == t)
    sync, described = F.col("stream_type") == 0x15, tagged(0x26)
    services = F.transform(described, lambda d: service_id(d["data"]))
    klva = F.exists(described, lambda d: F.coalesce(metadata_format(d["data"]) == "4B4C5641", F.lit(False)))
    registered = F.exists(tagged(0x05), lambda d: F.hex(d["data"].substr(1, 4)) == "4B4C5641")
    codes = F.array_compact(F.array(
        F.when(sync & (F.size(described) == 0), "metadata_descriptor"), F.when(sync & (F.size(described) > 0) & ~klva, "metadata_format_identifier"),
        F.when(sync & (F.size(F.array_distinct(services)) < F.size(services)), "metadata_service_id_duplicate"),
        F.when(sync & (F.size(tagged(0x27)) != 1), "metadata_std_descriptor_count"),
        F.when((F.col("stream_type") == 0x06) & (F.size(described) > 0) & ~registered, "registration_descriptor"),
    ))
    return s.select("file", "program", "pid", F.explode(codes).alias("code"))


def build_section(table_id: int, extension: Column, version: Column, body: Column) -> Column:
    """A whole section of a table, with its length and checksum, around the octets of its body."""
    size = F.octet_length(body) + 9
    head = F.unhex(F.concat(
        F.lit(f"{table_id:02X}"), F.lpad(F.hex((F.lit(0xB000) + size).cast("long")), 4, "0"), F.lpad(F.hex(extension.cast("long")), 4, "0"),
        F.lpad(F.hex((F.lit(0xC1) + version * 2).cast("long")), 2, "0"), F.lit("0000"),
    ))
    whole = F.concat(head, body)
    return F.concat(whole, F.unhex(F.lpad(F.hex(mpeg2_crc32(whole)), 8, "0")))


def packet_counters(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add cc: each stream's packets numbered modulo 16, as a multiplexer does. The first of ``order`` is a whole number; ``df`` is read twice."""
    cut = df.withColumn("__slice", slice_of(order[0]))
    return numbered(cut, keys, "__slice", order, "cc").drop("__slice").withColumn("cc", (F.col("cc") % 16).cast("int"))
