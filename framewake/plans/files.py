"""Queries over transport files that are written from the events: batches, streams, and the way from files to items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, settle
from ..sources import metadata, programs, stream_files, transport
from .streams import _PTS, _WIDE, raw_packets

QUERIES, ORACLE_SQL = {}, {}
FILES = 40


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def transport_files(spark, sf_dir, garbage: bool = False) -> str:
    """A folder of transport files, one for each fortieth of the users; with octets between packets that are none."""
    stream_files.register(spark)
    rows = raw_packets(spark, sf_dir, FILES)
    if garbage:
        n = F.row_number().over(Window.partitionBy("file").orderBy("offset")) - 1
        junk = F.when(n % 97 == 50, F.unhex(F.repeat(F.lit("00"), (n % 60 + 1).cast("int")))).otherwise(F.lit(b""))
        rows = rows.select("file", "offset", F.concat(junk, F.col("raw")).alias("raw"))
    path = scratch(spark, "files")
    rows = rows.repartition("file").sortWithinPartitions("file", "offset").select(F.concat("file", F.lit(".ts")).alias("file"), "raw")
    rows.write.format("transport").option("path", path).mode("append").save()
    return path


#: packets of the files in their order: file, n, pid, pusi, at
_PACKETS = f"""
WITH e AS (SELECT event_id AS i, 'f' || CAST(user_id % {FILES} AS VARCHAR) || '.ts' AS file FROM events),
c AS (SELECT *, CASE WHEN i % 2 = 0 THEN 258 ELSE 259 END AS own, unnest(CASE WHEN i % 6 = 0 OR (i % 2 = 1 AND i % 5 = 0) THEN [0, 1] ELSE [0] END) AS k FROM e),
r AS (
  SELECT file, (i + 10) * 16 + k * 4 + p.p AS place, CASE WHEN p.p = 2 THEN 496 ELSE own END AS pid, p.p <> 1 AS pusi FROM c, (VALUES (0), (1), (2)) p(p) WHERE p.p <> 1 OR i % 4 = 0
  UNION ALL SELECT DISTINCT file, h.h, h.h * 256, true FROM e, (VALUES (0), (1)) h(h)
), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place) - 1 AS n FROM r)
"""


def _told(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "offset", "discarded", "pid", "pusi", "cc")


_TOLD = """
SELECT file, 188 * n + {sum} AS "offset", CAST({own} AS BIGINT) AS discarded, CAST(pid AS INTEGER) AS pid, pusi, CAST((row_number() OVER (PARTITION BY file, pid ORDER BY place) - 1) % 16 AS INTEGER) AS cc FROM o
"""
_JUNK = "CASE WHEN n % 97 = 50 THEN n % 60 + 1 ELSE 0 END"


@query(_PACKETS + _TOLD.format(sum="0", own="0"))
def file_packets(spark, sf_dir):
    path = transport_files(spark, sf_dir)
    return _told(spark.read.format("transport").option("path", path).option("rangePackets", 1000).load())


@query(_PACKETS + _TOLD.format(sum=f"CAST(sum({_JUNK}) OVER (PARTITION BY file ORDER BY place) AS BIGINT)", own=_JUNK))
def file_packets_garbage(spark, sf_dir):
    path = transport_files(spark, sf_dir, garbage=True)
    return _told(spark.read.format("transport").option("path", path).option("rangePackets", 333).load())


@query("SELECT * FROM (" + _PACKETS + _TOLD.format(sum="0", own="0") + ") WHERE pid IN (258, 496) AND file <> 'f1.ts'")
def file_packets_filtered(spark, sf_dir):
    """The pids reach the reader; files are told apart by the rest of their names, after it."""
    path = transport_files(spark, sf_dir)
    found = spark.read.format("transport").option("path", path).load().where(F.col("pid").isin(258, 496))
    return _told(found).where("file <> 'f1.ts'")


@query(_PACKETS + _TOLD.format(sum=f"CAST(sum({_JUNK}) OVER (PARTITION BY file ORDER BY place) AS BIGINT)", own=_JUNK))
def file_packets_stream(spark, sf_dir):
    """The files with garbage, as a stream that takes chunks of no whole number of packets."""
    path = transport_files(spark, sf_dir, garbage=True)
    stream = spark.readStream.format("transport").option("path", path).option("chunkOctets", 1 << 20 | 77).load()
    out = scratch(spark, "stream")
    going = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).start()
    try:
        going.processAllAvailable()
    finally:
        going.stop()
    return _told(spark.read.schema(stream.schema).parquet(out))


@query(_WIDE.format(f"CASE WHEN event_id % 2 = 0 THEN {_PTS} END"))
def file_items(spark, sf_dir):
    """From files to typed items, in three passes over just the pids that matter."""
    values = metadata.scan_transport(spark, transport_files(spark, sf_dir, garbage=True))
    one = lambda tag, column: F.max(F.when(F.col("tag") == tag, F.col(column)))
    wide = values.groupBy("file", "program", "pid", "offset", "n", "service", "pts").agg(
        one(2, "exact").cast("long").alias("precision_time"), one(5, "num").alias("heading"), one(10, "txt").alias("designation"), one(13, "num").alias("latitude"),
        one(39, "num").alias("temperature"), one(56, "num").alias("speed"), one(56, "special").alias("speed_special"), one(96, "num").alias("width"),
    )
    return wide.drop("file", "program", "pid", "offset", "n", "service")


#: programs 1 and 2 of each user; their maps, and pids, come from events: signup has 300 and 301, view 300, error neither
_SPANS = """
WITH m AS (SELECT user_id, event_id, 1 + event_id % 2 AS program, event_type FROM events WHERE event_type IN ('signup', 'view', 'error')),
s AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id, program ORDER BY event_id) AS until FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id, program ORDER BY event_id) AS before FROM m) WHERE before IS DISTINCT FROM event_type),
o AS (SELECT user_id, event_id, 100 * (2 + program) + k AS pid, program, until FROM s, (VALUES (0), (1)) p(k) WHERE event_type = 'signup' OR (event_type = 'view' AND k = 0)),
p AS (SELECT user_id, event_id AS at, 300 + 100 * (event_id // 3 % 2) + event_id % 2 AS pid FROM events WHERE event_type IN ('click', 'purchase'))
SELECT p.user_id, p.at, CAST(p.pid AS BIGINT) AS pid, CAST(o.program AS BIGINT) AS program FROM p JOIN o ON o.user_id = p.user_id AND o.pid = p.pid AND p.at >= o.event_id AND (o.until IS NULL OR p.at < o.until)
"""


@query(_SPANS)
def demux_spans(spark, sf_dir):
    """Streams of two programs that maps name, drop and name again: a packet after a map without its pid is in no program."""
    from .timed import events

    e = events(spark, sf_dir)
    program = F.col("event_id") % 2 + 1
    maps = e.where("event_type in ('signup', 'view', 'error')")
    pids = F.when(F.col("event_type") == "signup", F.array(F.lit(0), F.lit(1))).when(F.col("event_type") == "view", F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    streams = F.transform(pids, lambda k: F.struct(F.lit(0x1B).alias("stream_type"), (100 * (2 + program) + k).cast("int").alias("pid"), F.array().cast("array<struct<tag:int,data:binary>>").alias("descriptors")))
    pmt = maps.select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("offset"), program.alias("program"), F.lit(0).alias("version"), F.lit(True).alias("current"),
        F.lit(0).alias("pcr_pid"), streams.alias("streams"), F.lit(None).cast("string").alias("issue"),
    )
    pes = F.unhex(F.concat(F.lit("000001E0"), F.lit("0000"), F.lit("800000"), F.hex(F.lit(b"x"))))
    pid = 300 + 100 * (F.floor(F.col("event_id") / 3) % 2) + F.col("event_id") % 2
    packets = e.where("event_type in ('click', 'purchase')").select(F.col("user_id").cast("string").alias("file"), pid.cast("long").alias("pid"), F.col("event_id").alias("offset"), F.lit(True).alias("pusi"), pes.alias("payload"))
    out = programs.demultiplex(packets, settle(programs.stream_spans(pmt), "spans"))
    return out.select(F.col("file").cast("long").alias("user_id"), F.col("first_offset").alias("at"), "pid", "program")
