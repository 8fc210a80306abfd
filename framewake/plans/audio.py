"""Queries over audio streams that the orders fill, cut into packets and damaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import settle, table
from ..sources import audio

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: of each frame: the stream (a customer's orders), its kind, length, and the octets passed over before it; one between two gaps can't be told from them
_FRAMES = """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_custkey % 3 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f AS (SELECT *, CASE t WHEN 0 THEN 20 + k % 300 WHEN 1 THEN 144 * list_extract([32, 48, 56, 64], CAST(1 + k % 4 AS BIGINT)) * 1000 // list_extract([44100, 48000, 32000], CAST(1 + k % 3 AS BIGINT)) + k % 2
  ELSE 144 * list_extract([8, 16, 24, 32], CAST(1 + k % 4 AS BIGINT)) * 1000 // list_extract([22050, 24000, 16000], CAST(1 + k % 3 AS BIGINT)) + k % 2 END AS length,
  CASE WHEN n > 1 AND k % 11 = 0 THEN 1 + k % 40 ELSE 0 END AS passed FROM o),
a AS (SELECT *, CAST(sum(length + passed) OVER (PARTITION BY c ORDER BY k) AS BIGINT) - length AS place, coalesce(lead(passed) OVER (PARTITION BY c ORDER BY k), 0) AS next_passed FROM f),
p AS (SELECT * EXCLUDE passed, place - coalesce(lag(place + length) OVER (PARTITION BY c ORDER BY k), 0) AS passed FROM a WHERE passed = 0 OR next_passed = 0)
"""


def streams(spark, sf_dir):
    """A stream for each customer with orders, a frame for each: ADTS, MPEG-1 or MPEG-2 layer II; cut to 97 octets."""
    k, t = F.col("o_orderkey"), F.col("o_custkey") % 3
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    pick = lambda values, m: F.get(F.array(*map(F.lit, values)), (k % m).cast("int"))
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    size = 20 + k % 300
    adts = F.concat(F.lit("FFF9"), F.hex((0x40 + (k % 13) * 4).cast("long")), two(F.lit(0x80) + F.shiftright(size, 11)), two(F.shiftright(size, 3).bitwiseAND(255)), two((size % 8) * 32), two(F.lit(0xFC) + k % 4))
    adts = F.rpad(adts, (2 * size).cast("int"), "0")
    length = lambda rates, per: F.floor(144 * pick(rates, 4) * 1000 / pick(per, 3)) + k % 2
    layer = lambda mark, index, rates, per: F.rpad(F.concat(F.lit(mark), two(pick(index, 4) * 16 + (k % 3) * 4 + (k % 2) * 2), F.when(k % 5 == 0, "C0").otherwise("00")), (2 * length(rates, per)).cast("int"), "0")
    one, other = layer("FFFD", [1, 2, 3, 4], [32, 48, 56, 64], [44100, 48000, 32000]), layer("FFF5", [1, 2, 3, 4], [8, 16, 24, 32], [22050, 24000, 16000])
    frame = F.when(t == 0, adts).when(t == 1, one).otherwise(other)
    junk = F.when((k != F.col("first")) & (k % 11 == 0), F.repeat(F.lit("00"), (1 + k % 40).cast("int"))).otherwise("")
    whole = o.join(first, "o_custkey").select("o_custkey", "o_orderkey", F.concat(junk, frame).alias("hex")).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "hex"))).alias("p"))
    whole = settle(whole.select("o_custkey", F.unhex(F.array_join(F.col("p.hex"), "")).alias("raw")), "audio")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / 97).cast("int") - 1), lambda n: F.col("raw").substr(n * 97 + 1, F.lit(97)))
    kind = F.when(t == 0, audio.ADTS).when(t == 1, audio.MPEG1).otherwise(audio.MPEG2)
    return whole.select("o_custkey", kind.alias("stream_type"), F.posexplode(cut).alias("n", "payload")).withColumn("pts", F.col("n").cast("long") * 3600)


@query(_FRAMES + """
SELECT c AS o_custkey, place AS "offset", CAST(place // 97 AS INTEGER) AS n, CASE WHEN row_number() OVER (PARTITION BY c, place // 97 ORDER BY place) = 1 THEN place // 97 * 3600 END AS pts, CAST(length AS BIGINT) AS length,
  CAST(CASE t WHEN 0 THEN list_extract([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350], CAST(1 + k % 13 AS BIGINT)) WHEN 1 THEN list_extract([44100, 48000, 32000], CAST(1 + k % 3 AS BIGINT))
    ELSE list_extract([22050, 24000, 16000], CAST(1 + k % 3 AS BIGINT)) END AS INTEGER) AS sample_rate, CAST(CASE t WHEN 0 THEN 1024 * (k % 4 + 1) ELSE 1152 END AS INTEGER) AS samples,
  CAST(CASE t WHEN 0 THEN 2 ELSE CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END END AS INTEGER) AS channels, CAST(passed AS BIGINT) AS passed FROM p
""")
def audio_frame_rows(spark, sf_dir):
    found = audio.audio_frames(streams(spark, sf_dir), ["o_custkey"], "n")
    return found.where("issue is null").select("o_custkey", "offset", "n", "pts", "length", "sample_rate", "samples", "channels", "passed")
