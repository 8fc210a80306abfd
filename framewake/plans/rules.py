"""Queries of network payloads and field rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import relations
from ..session import table
from ..sources import network
from .timed import E, events

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hex(c, n):
    return F.lpad(F.hex(c.cast("long")), 2 * n, "0")


@query("""SELECT event_id, event_type = 'click' AS marker, event_id % 128 AS payload_type, event_id % 65536 AS seq_no, event_id * 3003 % 4294967296 AS rtp_ts, user_id AS ssrc,
  CASE WHEN event_id % 50 <> 7 THEN event_type END AS payload, CASE WHEN event_id % 50 = 7 THEN 'version' END AS issue FROM events""")
def rtp_packets(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    first = F.when(i % 50 == 7, 64).otherwise(128) + i % 3 + F.when(i % 4 == 0, 16).otherwise(0) + F.when(i % 5 == 0, 32).otherwise(0)
    raw = F.unhex(F.concat(
        _hex(first, 1), _hex(F.when(F.col("event_type") == "click", 128).otherwise(0) + i % 128, 1), _hex(i % 65_536, 2), _hex(i * 3003 % (1 << 32), 4), _hex(F.col("user_id"), 4),
        F.repeat(F.lit("0000000A"), (i % 3).cast("int")), F.when(i % 4 == 0, "BEDE0001AABBCCDD").otherwise(""), F.hex(F.col("event_type").cast("binary")), F.when(i % 5 == 0, "000003").otherwise(""),
    ))
    out = network.parse_rtp(e.select("event_id", raw.alias("raw")))
    return out.select("event_id", "marker", "payload_type", "seq_no", "rtp_ts", "ssrc", F.col("payload").cast("string").alias("payload"), "issue")


@query(f"""
WITH p AS (SELECT event_id, user_id, ts_us, ts_us * 9 // 100 AS t FROM {E} WHERE event_type <> 'view'),
r AS (SELECT user_id, ts_us AS at_us, ts_us // 1000000 * 1000000 AS ntp, ts_us * 9 // 100 % 4294967296 AS base FROM {E} WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.t, r.ntp, r.base FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.ts_us >= r.at_us),
s AS (SELECT *, ((t % 4294967296 - base + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS step FROM j)
SELECT event_id, ntp + CAST(floor(CAST(step AS DECIMAL(20, 0)) * 1000000 / 90000) AS BIGINT) AS utc_us FROM s
""")
def rtcp_clock_map(spark, sf_dir):
    e = events(spark, sf_dir)
    ticks = F.expr("ts_us * 9 div 100") % (1 << 32)
    raw = F.unhex(F.concat(F.lit("80C80006"), _hex(F.col("user_id"), 4), _hex(F.expr("ts_us div 1000000") + 2_208_988_800, 4), F.lit("00000000"), _hex(ticks, 4), F.lit("0000000000000000")))
    reports = network.parse_sender_report(e.where("event_type = 'view'").select("ts_us", raw.alias("raw"))).select(F.col("ssrc").alias("user_id"), "ts_us", "ntp_us", "rtp_ts")
    packets = e.where("event_type <> 'view'").select("event_id", "user_id", "ts_us", ticks.alias("t"))
    return network.wall_clock(packets, reports, "user_id", "ts_us", "t", 90_000).select("event_id", "utc_us")


@query("""
SELECT c_custkey, c_name AS session, m.media_no, m.media, CAST(5000 + c_custkey % 100 * 2 + m.media_no AS INTEGER) AS port, CAST(95 + m.media_no AS INTEGER) AS format, CASE WHEN m.media_no = 1 THEN 'MP2T' ELSE 'smpte336m' END AS encoding, CAST(90000 AS BIGINT) AS clock_rate
FROM customer, (SELECT 1 AS media_no, 'video' AS media UNION ALL SELECT 2, 'application') m WHERE m.media_no = 1 OR c_custkey % 2 = 0
""")
def sdp_sessions(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    port = 5000 + k % 100 * 2
    one = F.concat(F.lit("m=video "), (port + 1).cast("string"), F.lit(" RTP/AVP 96\r\na=rtpmap:96 MP2T/90000\r\n"))
    two = F.when(k % 2 == 0, F.concat(F.lit("m=application "), (port + 2).cast("string"), F.lit(" RTP/AVP 97\r\na=rtpmap:97 smpte336m/90000\r\n"))).otherwise("")
    text = F.concat(F.lit("v=0\r\no=- 1 1 IN IP4 0.0.0.0\r\ns="), F.col("c_name"), F.lit("\r\nt=0 0\r\n"), one, two)
    return network.parse_sdp(c.select("c_custkey", text.alias("sdp"))).drop("sdp")


@query("SELECT event_id, event_id * 47 % 1800 AS length, CASE WHEN event_id * 47 % 1800 = 0 THEN 'empty' WHEN event_id * 47 % 1800 % 188 <> 0 THEN 'partial' WHEN event_id * 47 % 1800 > 1316 THEN 'too_many' END AS issue FROM events")
def udp_boundaries(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 47 % 1800).alias("length")).withColumn("issue", network.datagram_issue(F.col("length")))


@query("""SELECT event_id, coalesce(nullif(concat_ws(' + ', CASE WHEN event_id % 2 = 1 THEN 'icing' END, CASE WHEN event_id // 2 % 2 = 1 THEN 'slant' END, CASE WHEN event_id // 4 % 2 = 1 THEN 'hot' END), ''), 'none')
  || ' (0x' || upper(printf('%02x', event_id % 8)) || ')' AS flags, event_id % 256 < 128 AS locked, event_id % 128 >= 64 AS discontinuity, event_id % 64 >= 32 AS reverse FROM events""")
def flag_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", fields.flag_names(F.col("event_id") % 8, ["icing", "slant", "hot"]).alias("flags"), fields.time_status(F.col("event_id") % 256).alias("t"))
    return e.select("event_id", "flags", "t.locked", "t.discontinuity", "t.reverse")


@query("""SELECT o_orderkey, o_orderkey % 65536 // 4096 AS station, o_orderkey % 4096 // 256 AS substation, o_orderkey % 256 // 16 AS type, o_orderkey % 16 AS variant,
  regexp_matches(CAST(o_orderkey AS VARCHAR), '^[1-8]{3,4}$') AS laser_ok FROM orders""")
def nibble_packs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", fields.weapon_load(F.col("o_orderkey") % 65_536).alias("w"), fields.laser_code_valid(F.col("o_orderkey")).alias("laser_ok"))
    return o.select("o_orderkey", "w.*", "laser_ok")


@query("""
WITH c AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'two' WHEN 1 THEN 'three' WHEN 2 THEN 'numeric' ELSE 'other' END AS method, CASE WHEN n_nationkey % 7 <> 0 THEN '//' || substr(n_name, 1, CAST(2 + n_nationkey % 2 AS BIGINT)) END AS code FROM nation)
SELECT n_nationkey, code, CASE WHEN code IS NULL THEN 'missing' WHEN method = 'other' THEN 'method'
  WHEN NOT CASE method WHEN 'two' THEN regexp_matches(substr(code, 3), '^[A-Z]{2}$') WHEN 'three' THEN regexp_matches(substr(code, 3), '^[A-Z]{3}$') ELSE regexp_matches(substr(code, 3), '^[0-9]{3}$') END THEN 'format' END AS issue FROM c
""")
def security_codes(spark, sf_dir):
    k = F.col("n_nationkey")
    method = F.element_at(F.array(*map(F.lit, ["two", "three", "numeric", "other"])), (k % 4 + 1).cast("int"))
    code = F.when(k % 7 != 0, F.concat(F.lit("//"), F.col("n_name").substr(F.lit(1), (2 + k % 2).cast("int"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", code.alias("code"), fields.country_code_issue(code, method).alias("issue"))


@query("""
WITH a AS (SELECT event_id, event_id % 40 AS id FROM events), d AS (SELECT DISTINCT event_id % 40 AS id FROM events WHERE event_id % 3 = 0 AND event_id % 40 < 30)
SELECT event_id, id, CASE WHEN id BETWEEN 7 AND 20 THEN 'reserved' ELSE 'undefined' END AS issue FROM a WHERE id BETWEEN 7 AND 20 OR (id > 20 AND id NOT IN (SELECT id FROM d))
""")
def record_tables(spark, sf_dir):
    active = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40).alias("id"))
    known = active.where("event_id % 3 = 0 and id < 30").select("id")
    reserved = active.withColumn("issue", fields.record_id_issue(F.col("id"))).where("issue is not null")
    return reserved.union(relations.dangling(active.where("id > 20"), known, "id", "id", "undefined"))


@query("SELECT l_orderkey, l_linenumber, ((l_linenumber * 97.25 + l_quantity * 11.5) % 360.0) AS end_, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) AS percent FROM lineitem")
def view_domains(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    end = fields.normalised_end(F.col("l_linenumber") * 97.25, F.col("l_quantity") * 11.5)
    return line.select("l_orderkey", "l_linenumber", end.alias("end_"), fields.percent(F.col("l_discount")).alias("percent"))


@query("""SELECT l_orderkey, l_linenumber, round(1.5 + 2.0 * l_linenumber + 0.25 * l_quantity + 0.125 * l_linenumber * l_quantity, 6) AS power,
  round((2.0 * l_quantity + 1.0) * 0.5 - 3.0, 6) AS x FROM lineitem""")
def image_models(spark, sf_dir):
    x, _ = fields.transform_chain(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), [(2.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0), (0.5, 0.0, -3.0, 0.0, 1.0, 0.0, 0.0, 0.0)])
    power = fields.polynomial(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"), [[1.5, 0.25], [2.0, 0.125]])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(power, 6).alias("power"), F.round(x, 6).alias("x"))


@query("SELECT c_custkey, c_custkey % 360 - 180 > 175 AS crosses FROM customer")
def antimeridian(spark, sf_dir):
    start = (F.col("c_custkey") % 360 - 180).cast("double")
    lon = F.array(start, F.when(start + 5 > 180, start + 5 - 360).otherwise(start + 5), F.when(start + 5 > 180, start + 5 - 360).otherwise(start + 5), start)
    return table(spark, sf_dir, "customer").select("c_custkey", fields.crosses_antimeridian(lon).alias("crosses"))
