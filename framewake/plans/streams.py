"""Queries from transport packets to typed metadata. The packets are built from the events, so that SQL can tell what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import slices
from ..session import scratch, settle, table
from ..sources import metadata, programs, registry, transport
from .timed import E, events

QUERIES, ORACLE_SQL = {}, {}
SYNC, ASYNC = 0x102, 0x103
_PTS = "ts_us * 9 // 100 % 8589934592"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hex(c, n):
    return F.lpad(F.hex(c.cast("long")), 2 * n, "0")


def _octets(c, n):
    return F.unhex(_hex(c, n))


def _item(tag: int, value):
    return F.concat(_octets(F.lit(tag), 1), codecs.ber_length(F.octet_length(value).cast("long")), value)


def local_sets(spark, sf_dir, files: int = 3) -> DataFrame:
    """A keyed packet for each event; every eleventh has a wrong checksum."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    items = F.concat(
        _item(2, _octets(F.col("ts_us"), 8)), _item(5, _octets(i * 37 % 65_536, 2)), _item(10, F.col("event_type").cast("binary")), _item(13, _octets(i * 7919 % (1 << 32), 4)),
        _item(39, _octets(i % 256, 1)), F.when(i % 3 == 0, _item(56, F.lit(b""))).otherwise(_item(56, _octets(i % 200, 1))), _item(65, F.lit(b"\x13")), _item(96, _octets(i * 101 % (1 << 23), 3)),
    )
    start = F.concat(F.unhex(F.lit(metadata.LOCAL_SET_KEY)), codecs.ber_length(F.octet_length(items).cast("long") + 4), items, F.lit(b"\x01\x02"))
    e = e.select("event_id", "ts_us", F.concat(F.lit("f"), (F.col("user_id") % files).cast("string")).alias("file"), start.alias("start"))
    summed = codecs.running_sum_16(F.col("start")) + F.when(i % 11 == 0, 1).otherwise(0)
    return e.select("event_id", "ts_us", "file", F.concat("start", _octets(summed % 65_536, 2)).alias("klv"))


def _program_map(file, order):
    """Rows for the two tables at the start of a file."""
    body = "E101F000" "1BE101F000" "15E102F016" "26090100FF4B4C5641000F" "2709C00000C00000C00000" "06E103F006" "05044B4C5641" "0FE104F000"
    pat = programs.build_section(0, F.lit(7), F.lit(1), F.unhex(F.lit("0001E100")))
    pmt = programs.build_section(2, F.lit(1), F.lit(3), F.unhex(F.lit(body)))
    one = lambda pid, at, section: F.struct(F.lit(pid).cast("long").alias("pid"), (order + at).cast("long").alias("at"), F.lit(True).alias("pusi"), F.concat(F.lit(b"\x00"), section).alias("payload"))
    return [one(0, 0, pat), one(0x100, 1, pmt)]


def raw_packets(spark, sf_dir, files: int = 3) -> DataFrame:
    """Packets (file, offset, raw) of transport streams that carry the local sets; offset is their order.

    Even events are synchronous, every sixth in two fragments; odd ones asynchronous, every fifth in two PES packets. PES
    packets of every fourth event take two packets. Other pids and null packets lie between.
    """
    sets = local_sets(spark, sf_dir, files)
    i = F.col("event_id")
    part = lambda a, n=F.lit(1 << 20): F.col("klv").substr(a, n)
    cut = F.when(i % 6 == 0, 20).when((i % 2 == 1) & (i % 5 == 0), 30)
    c = sets.withColumn("k", F.explode(F.when(cut.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    c = c.withColumns({"fragment": F.when(cut.isNull(), 3).when(F.col("k") == 0, 2).otherwise(1), "data": F.when(cut.isNull(), F.col("klv")).when(F.col("k") == 0, part(F.lit(1), cut)).otherwise(part(cut + 1))})
    c = c.withColumns({"odd": i % 2, "__slice": slices.slice_of("event_id", 1 << 16)})
    c = slices.numbered(c, ["file", "odd"], "__slice", ["event_id", "k"], "sequence").withColumn("sequence", F.col("sequence") % 256)
    unit = F.concat(_octets(F.lit(0), 1), _octets(F.col("sequence"), 1), _octets(F.col("fragment") * 64 + 31, 1), _octets(F.octet_length("data"), 2), F.col("data"))
    pts = codecs.pts_encode(F.expr("ts_us * 9 div 100") % (1 << 33))
    sync = F.concat(F.unhex(F.concat(F.lit("000001FC"), _hex(F.octet_length("unit") + 8, 2), F.lit("848005"))), pts, F.col("unit"))
    plain = F.concat(F.unhex(F.concat(F.lit("000001BD"), _hex(F.octet_length("data") + 3, 2), F.when(F.col("k") == 0, "840000").otherwise("800000"))), F.col("data"))
    c = c.withColumn("unit", unit).withColumn("pes", F.when(i % 2 == 0, sync).otherwise(plain))
    pid = F.when(i % 2 == 0, SYNC).otherwise(ASYNC).cast("long")
    at = (i + 10) * 16 + F.col("k") * 4
    # place 0 the PES packet or its beginning, 1 its rest, 2 another pid's packet
    part_ = F.col("p")
    payload = F.when(part_ == 2, F.col("data")).when(part_ == 1, F.col("pes").substr(51, 1 << 20)).when(i % 4 == 0, F.col("pes").substr(1, 50)).otherwise(F.col("pes"))
    body = c.withColumn("p", F.explode(F.when(i % 4 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(2)))))
    body = body.select("file", F.when(part_ == 2, F.lit(0x1F0).cast("long")).otherwise(pid).alias("pid"), (at + part_).alias("at"), (part_ != 1).alias("pusi"), payload.alias("payload"))
    heads = sets.select("file").distinct().select("file", F.explode(F.array(*_program_map(F.col("file"), F.lit(0)))).alias("r")).select("file", "r.*")
    all_ = programs.packet_counters(body.union(heads), ["file", "pid"], ["at"])
    raw = transport.build_packet(F.col("pid"), F.col("cc"), F.col("pusi"), F.col("payload"))
    path = scratch(spark, "packets")
    all_.select("file", F.col("at").alias("offset"), raw.alias("raw")).write.parquet(path)
    return spark.read.schema("file string, offset long, raw binary").parquet(path)


def stream_packets(spark, sf_dir) -> DataFrame:
    """Parsed packets (file, offset, pid, pusi, payload, ...) of the streams of ``raw_packets``."""
    return transport.parse_packets(raw_packets(spark, sf_dir)).withColumn("pid", F.col("pid").cast("long"))


def _demultiplexed(spark, sf_dir):
    packets = stream_packets(spark, sf_dir)
    _, pmt = programs.program_tables(packets)
    streams = programs.elementary_streams(pmt).withColumn("pid", F.col("pid").cast("long"))
    return settle(programs.demultiplex(packets, settle(streams, "streams")), "pes")


@query("""
SELECT f.file, CAST(1 AS BIGINT) AS program, s.pid, s.stream_type, s.kind, s.carriage FROM (SELECT DISTINCT 'f' || CAST(user_id % 3 AS VARCHAR) AS file FROM events) f,
(VALUES (CAST(257 AS BIGINT), 27, 'video', NULL), (258, 21, 'metadata', 'synchronous'), (259, 6, 'metadata', 'asynchronous'), (260, 15, 'audio', NULL)) s(pid, stream_type, kind, carriage)
""")
def psi_tables(spark, sf_dir):
    _, pmt = programs.program_tables(stream_packets(spark, sf_dir))
    out = programs.elementary_streams(pmt)
    return out.select("file", "program", F.col("pid").cast("long").alias("pid"), "stream_type", "kind", "carriage")


@query(f"""
WITH c AS (SELECT 'f' || CAST(user_id % 3 AS VARCHAR) AS file, CASE WHEN event_id % 2 = 0 THEN 258 ELSE 259 END AS pid, CASE WHEN event_id % 2 = 0 THEN {_PTS} END AS pts,
  CASE WHEN event_id % 6 = 0 OR (event_id % 2 = 1 AND event_id % 5 = 0) THEN 2 ELSE 1 END AS n FROM {E})
SELECT file, CAST(pid AS BIGINT) AS pid, CAST(sum(n) AS BIGINT) AS packets, min(pts) AS first_pts, max(pts) AS last_pts FROM c GROUP BY ALL
""")
def demux_streams(spark, sf_dir):
    pes = _demultiplexed(spark, sf_dir).where("issue is null")
    return pes.groupBy("file", "pid").agg(F.count("*").alias("packets"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"))


_GOOD = f"(SELECT * FROM {E} WHERE event_id % 11 <> 0)"
_WIDE = f"""
SELECT ts_us AS precision_time, event_id * 37 % 65536 * 360.0 / 65535 AS heading, event_type AS designation,
  CASE WHEN event_id * 7919 % 4294967296 = 2147483648 THEN NULL ELSE -90 + ((CASE WHEN event_id * 7919 % 4294967296 >= 2147483648 THEN event_id * 7919 % 4294967296 - 4294967296 ELSE event_id * 7919 % 4294967296 END) + 2147483647) * 180.0 / 4294967294 END AS latitude,
  CAST(CASE WHEN event_id % 256 >= 128 THEN event_id % 256 - 256 ELSE event_id % 256 END AS DOUBLE) AS temperature, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 200 AS DOUBLE) END AS speed,
  CASE WHEN event_id % 3 = 0 THEN 'unknown' END AS speed_special, event_id * 101 % 8388608 / 4.0 AS width, {{}} AS pts FROM {_GOOD}
"""


@query(_WIDE.format(f"CASE WHEN event_id % 2 = 0 THEN {_PTS} END"))
def metadata_items(spark, sf_dir):
    found = settle(metadata.metadata_packets(_demultiplexed(spark, sf_dir)).where("key is not null"), "found")
    keys = ["file", "program", "pid", "offset", "n", "pts"]
    values = metadata.local_set_values(found, registry.registry(spark), keys)
    one = lambda tag, column: F.max(F.when(F.col("tag") == tag, F.col(column)))
    wide = values.groupBy(*keys).agg(
        one(2, "exact").cast("long").alias("precision_time"), one(5, "num").alias("heading"), one(10, "txt").alias("designation"), one(13, "num").alias("latitude"),
        one(39, "num").alias("temperature"), one(56, "num").alias("speed"), one(56, "special").alias("speed_special"), one(96, "num").alias("width"),
    )
    return wide.drop("file", "program", "pid", "offset", "n")


@query(f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'checksum' END AS issue FROM {E}")
def packet_checks(spark, sf_dir):
    k = settle(metadata.keyed_packets(local_sets(spark, sf_dir).select("event_id", F.col("klv").alias("data"))), "found")
    return metadata.packet_issue(k, ["event_id"]).drop("items")


@query(f"""
WITH g AS (SELECT 'f' || CAST(user_id % 3 AS VARCHAR) AS file, event_id, {_PTS} AS pts FROM {_GOOD} WHERE event_id % 2 = 0)
SELECT file, round((pts - min(pts) OVER (PARTITION BY file)) / 90000.0, 6) AS time_seconds, row_number() OVER (PARTITION BY file ORDER BY pts, event_id) AS sample FROM g
""")
def timeline(spark, sf_dir):
    found = settle(metadata.metadata_packets(_demultiplexed(spark, sf_dir)).where("key is not null and pts is not null"), "found")
    keys = ["file", "program", "pid", "offset", "n", "pts"]
    t = metadata.local_set_values(found, registry.registry(spark), keys).where("tag = 2")
    t = slices.ranged(t.select("file", "pts", "offset"), ["file", "pts", "offset"], "__slice")
    first = t.groupBy("file").agg(F.min("pts").alias("first"))
    t = slices.numbered(t, ["file"], "__slice", ["pts", "offset"], "n").join(first, "file")
    seconds = F.round((F.col("pts") - F.col("first")) / 90_000.0, 6)
    return t.select("file", seconds.alias("time_seconds"), (F.col("n") + 1).alias("sample"))


@query("""
WITH n AS (SELECT n_nationkey AS program, n_nationkey % 5 AS k FROM nation)
SELECT program, code FROM n, (VALUES (1, 'metadata_descriptor'), (1, 'metadata_std_descriptor_count'), (2, 'metadata_format_identifier'), (3, 'metadata_service_id_duplicate'), (4, 'registration_descriptor')) c(k, code) WHERE n.k = c.k
""")
def declaration_codes(spark, sf_dir):
    klva, std = "26090100FF4B4C5641000F", "2709C00000C00000C00000"
    bodies = [
        f"15E102F016{klva}{std}", "15E102F000", f"15E102F01626090100FF41424344000F{std}", f"15E102F021{klva}{klva}{std}", f"06E103F00B{klva}",
    ]
    k = (F.col("n_nationkey") % 5).cast("int")
    body = F.unhex(F.concat(F.lit("E101F000"), F.get(F.array(*map(F.lit, bodies)), k)))
    section = programs.build_section(2, F.col("n_nationkey"), F.lit(0), body)
    t = table(spark, sf_dir, "nation").select(F.lit("f").alias("file"), F.lit(0x100).alias("pid"), F.col("n_nationkey").alias("offset"), F.lit(0).alias("n"), section.alias("section"), F.lit(None).cast("string").alias("issue"))
    return programs.declaration_issues(programs.parse_pmt(t)).select("program", "code")


@query("SELECT p.program, 7 * event_id AS pcr, event_id AS at_ FROM events, (VALUES (CAST(1 AS BIGINT)), (2)) p(program) WHERE p.program = 1 OR event_id >= 500")
def program_clocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    packets = e.select(F.lit("f").alias("file"), F.lit(257).alias("pid"), F.col("event_id").alias("offset"), (F.col("event_id") * 7).alias("pcr"), F.lit(None).cast("long").alias("opcr"), F.lit(False).alias("discontinuity"))
    pmt = spark.createDataFrame([("f", 1, -1), ("f", 2, 500)], "file string, program long, offset long").withColumns({"pcr_pid": F.lit(257), "current": F.lit(True), "issue": F.lit(None).cast("string")})
    return programs.clock_events(packets, pmt).select("program", "pcr", F.col("offset").alias("at_"))
