"""Queries of packs of records, labels, places, masks, presentation times and watermarked streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, records
from ..functions import targets as targets_
from ..operators import presentation
from ..session import dealt, let, micros, scratch, table
from ..sources import klv, registry, targets
from ..streaming import state
from .timed import DAY, E, events

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _octets(c, n):
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))


def _told(value):
    """A value with its length before it."""
    return let(value, lambda v: F.concat(codecs.ber_length(F.octet_length(v).cast("long")), v))




@query(f"""
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id END AS id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS command,
  CASE WHEN event_id % 7 <> 0 AND event_id % 3 = 0 THEN ts_us END AS at_us, CASE WHEN event_id % 7 = 0 THEN 'malformed' END AS issue FROM {E}
""")
def control_commands(spark, sf_dir):
    i = F.col("event_id")
    raw = F.concat(codecs.ber_oid(i), _told(F.col("event_type").cast("binary")), F.when(i % 3 == 0, _octets(F.col("ts_us"), 8)).otherwise(F.lit(b"")), F.when(i % 7 == 0, F.lit(b"\x01")).otherwise(F.lit(b"")))
    return records.commands(events(spark, sf_dir).select("event_id", raw.alias("raw")), "raw")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 THEN p_partkey || ',' || p_partkey * 31 END AS ids,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 11 = 0 THEN 'malformed' END AS issue FROM part
""")
def identifier_lists(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.concat(codecs.ber_oid(k), codecs.ber_oid(k * 31), F.when(k % 5 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")), F.when(k % 11 == 0, F.lit(b"\x81")).otherwise(F.lit(b"")))
    found = records.id_lists(dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")), "raw", zero_alone=True)
    return found.withColumn("ids", F.when(F.col("issue").isNull(), F.array_join("ids", ",")))


@query("""
WITH c AS (SELECT *, c_custkey % 18 BETWEEN 1 AND 15 AS good FROM customer)
SELECT c_custkey, CASE WHEN good THEN c_custkey % 18 END AS method, CASE WHEN good THEN c_mktsegment END AS overflight,
  CASE WHEN good AND c_custkey % 3 = 0 THEN '' WHEN good AND c_custkey % 3 = 1 THEN 'US' END AS operator,
  CASE WHEN good AND c_custkey % 6 = 1 THEN 'Ö' END AS manufacture, CASE WHEN NOT good THEN 'malformed' END AS issue FROM c
""")
def country_packs(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.concat(
        F.lit(b"\x01"), _octets(k % 18, 1), _told(F.col("c_mktsegment").cast("binary")),
        F.when(k % 3 == 0, F.lit(b"\x00")).when(k % 3 == 1, F.lit(b"\x02US")).otherwise(F.lit(b"")), F.when(k % 6 == 1, F.lit("\x02Ö".encode())).otherwise(F.lit(b"")),
    )
    found = records.countries(dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", raw.alias("raw")), "raw")
    return found.withColumn("method", F.col("method").cast("long"))


@query("""
WITH p AS (SELECT *, p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AS good, 1 + p_partkey % 4 AS total FROM part),
r AS (SELECT *, unnest(range(0, CASE WHEN p_partkey % 2 = 0 THEN total ELSE 1 END)) AS id FROM p WHERE good)
SELECT p_partkey, total, id, p_partkey % 5 AS kind, p_name AS name, NULL AS issue FROM r
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'malformed' FROM p WHERE NOT good
""")
def payload_lists(spark, sf_dir):
    k = F.col("p_partkey")
    total = 1 + k % 4
    kind = F.when(k % 13 == 0, 5).otherwise(k % 5).cast("long")
    one = lambda j: _told(F.concat(codecs.ber_oid(F.when(k % 17 == 0, j + total).otherwise(j)), codecs.ber_oid(kind), _told(F.col("p_name").cast("binary"))))
    many = F.sequence(F.lit(0).cast("long"), F.when(k % 2 == 0, total - 1).otherwise(0).cast("long"))
    raw = F.aggregate(F.transform(many, one), codecs.ber_oid(total), lambda done, x: F.concat(done, x))
    return records.payloads(dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")), "raw")


@query("""
WITH p AS (SELECT *, p_partkey * 37 % 4096 AS status, p_partkey * 37 % 256 < 128 AND p_partkey % 19 <> 0 AS good FROM part)
SELECT p_partkey, p_partkey % 4 AS station, p_partkey % 3 AS hardpoint, carriage, 300 AS store, status % 256 AS general, status // 256 % 2 = 1 AS fuze, status // 512 % 2 = 1 AS laser,
  status // 1024 % 2 = 1 AS target, status // 2048 % 2 = 1 AS armed, p_type AS name, NULL AS issue FROM p, (VALUES (1), (2)) c(carriage) WHERE good
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM p WHERE NOT good
""")
def weapon_stores(spark, sf_dir):
    k = F.col("p_partkey")
    one = lambda carriage: _told(F.concat(codecs.ber_oid(k % 4), codecs.ber_oid(k % 3), codecs.ber_oid(carriage), codecs.ber_oid(F.lit(300)), codecs.ber_oid(k * 37 % 4096), _told(F.col("p_type").cast("binary"))))
    raw = F.concat(one(F.lit(1)), one(F.when(k % 19 == 0, 1).otherwise(2)))
    found = records.stores(dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")), "raw")
    return found.select("p_partkey", "station", "hardpoint", "carriage", "store", records.engagement(F.col("status")).alias("e"), "name", "issue").select("p_partkey", "station", "hardpoint", "carriage", "store", "e.*", "name", "issue")


@query("""
WITH c AS (SELECT p_partkey AS k, p_partkey * 104729 % 1509949440 / 8388608.0 - 90 AS la, p_partkey * 15485863 % 1509949440 / 4194304.0 - 180 AS lo, p_partkey * 31 % 5068800 / 512.0 - 900 AS h,
  (p_partkey + 1) * 104729 % 1509949440 / 8388608.0 - 90 AS lb, (p_partkey + 1) * 15485863 % 1509949440 / 4194304.0 - 180 AS lp FROM part)
SELECT k AS p_partkey, k % 6 >= 4 AS malformed, CASE WHEN k % 6 < 3 THEN la END AS takeoff_latitude, CASE WHEN k % 6 < 3 THEN lo END AS takeoff_longitude, CASE WHEN k % 6 = 1 THEN h END AS takeoff_height,
  CASE k % 6 WHEN 0 THEN la WHEN 1 THEN lb WHEN 3 THEN lb END AS recovery_latitude, CASE k % 6 WHEN 0 THEN lo WHEN 1 THEN lp WHEN 3 THEN lp END AS recovery_longitude FROM c
""")
def airbases(spark, sf_dir):
    k = F.col("p_partkey")
    at = lambda n: F.concat(_octets(n * 104729 % 1509949440, 4), _octets(n * 15485863 % 1509949440, 4))
    kind = (k % 6).cast("int")
    raw = (
        F.when(kind == 0, _told(at(k))).when(kind == 1, F.concat(_told(F.concat(at(k), _octets(k * 31 % 5068800, 3))), _told(at(k + 1)))).when(kind == 2, F.concat(_told(at(k)), F.lit(b"\x00")))
        .when(kind == 3, F.concat(F.lit(b"\x00"), _told(at(k + 1)))).when(kind == 4, F.concat(_told(at(k)), _told(at(k)))).otherwise(_told(F.concat(at(k), F.lit(b"\x00"))))
    )
    b = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")).select("p_partkey", records.bases(F.col("raw")).alias("b"))
    return b.select(
        "p_partkey", F.col("b").isNull().alias("malformed"), F.col("b.takeoff.latitude").alias("takeoff_latitude"), F.col("b.takeoff.longitude").alias("takeoff_longitude"),
        F.col("b.takeoff.height").alias("takeoff_height"), F.col("b.recovery.latitude").alias("recovery_latitude"), F.col("b.recovery.longitude").alias("recovery_longitude"),
    )


@query("""
WITH c AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, CASE WHEN k % 4 < 3 THEN k * 104729 % 1509949440 / 8388608.0 - 90 END AS latitude, CASE WHEN k % 4 < 3 THEN k * 15485863 % 1509949440 / 4194304.0 - 180 END AS longitude,
  CASE WHEN k % 4 < 3 THEN k % 19901 - 900.0 END AS height, CASE WHEN k % 4 IN (1, 2) THEN k % 20800 / 32.0 END AS sigma_u, CASE WHEN k % 4 = 2 THEN k % 32768 / 16384.0 - 1 END AS rho_nu FROM c
""")
def target_locations(spark, sf_dir):
    k = F.col("p_partkey")
    sigma, rho = _octets(k % 20800, 2), _octets(k % 32768, 2)
    raw = F.concat(
        _octets(k * 104729 % 1509949440, 4), _octets(k * 15485863 % 1509949440, 4), _octets(k % 19901, 2),
        F.when(k % 4 == 3, F.lit(b"\x00")).when(k % 4 == 0, F.lit(b"")).otherwise(F.concat(sigma, sigma, sigma)), F.when(k % 4 == 2, F.concat(rho, rho, rho)).otherwise(F.lit(b"")),
    )
    found = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")).select("p_partkey", records.location(F.col("raw")).alias("l"))
    return found.select("p_partkey", "l.latitude", "l.longitude", "l.height", "l.sigma_u", "l.rho_nu")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 28800 / 16.0 - 900 END AS east, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_partkey % 20800 / 32.0 END AS sigma_e,
  CASE WHEN p_partkey % 4 = 2 THEN p_partkey % 32768 / 16384.0 - 1 END AS rho_en FROM part
""")
def target_motion(spark, sf_dir):
    k = F.col("p_partkey")
    v, sigma, rho = _octets(k % 28800, 2), _octets(k % 20800, 2), _octets(k % 32768, 2)
    raw = F.concat(v, v, v, F.when(k % 4 == 3, F.lit(b"\x00")).when(k % 4 == 0, F.lit(b"")).otherwise(F.concat(sigma, sigma, sigma)), F.when(k % 4 == 2, F.concat(rho, rho, rho)).otherwise(F.lit(b"")))
    found = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")).select("p_partkey", records.motion(F.col("raw")).alias("m"))
    return found.select("p_partkey", "m.east", "m.sigma_e", "m.rho_en")


#: labels by turns: a key, a label of category 4, another prefix, too short, a hole, leading zeros in an identifier, a long and an open identifier
_LABELS = [
    "060E2B34020B01010E01030101000000", "060E2B34040101010E01030101000000", "060E2B35020B01010E01030101000000", "060E2B34020B01010E010301010000",
    "060E2B34020B01010E01000101000000", "060E2B34020B01010E80010101000000", "060E2B34020B0101818203000000000E", "060E2B34020B01010E8182000E010181",
]


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 4 END AS category, CASE p_partkey % 8 WHEN 0 THEN '0E01030101' WHEN 1 THEN '0E01030101' END AS designator,
  CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN false END AS key FROM part
""")
def universal_labels(spark, sf_dir):
    raw = F.unhex(F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 8).cast("int")))
    found = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", records.universal_label(raw).alias("u"))
    return found.select("p_partkey", "u.category", "u.designator", "u.key")


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 4 AND p_partkey % 3 = 2 THEN 'empty' END, CASE WHEN p_partkey % 5 = 2 THEN 'contour_short' END, CASE WHEN p_partkey % 5 = 3 THEN 'contour_bounds' END,
  CASE WHEN p_partkey % 5 = 1 THEN 'contour_order' END, CASE WHEN p_partkey % 3 = 1 THEN 'run_bounds' END) AS issues FROM part
""")
def mask_checks(spark, sf_dir):
    k = F.col("p_partkey")
    p = k % 40 * 64 + k % 50 + 1
    square = [p, p + 3, p + 131, p + 128]
    contour = F.when(k % 5 == 0, F.array(*square)).when(k % 5 == 1, F.array(*square[::-1])).when(k % 5 == 2, F.array(*square[:2])).when(k % 5 == 3, F.array(p, p + 3, F.lit(5000).cast("long")))
    run = lambda n: F.array(F.struct(F.lit(3000).cast("long").alias("start"), F.lit(n).cast("long").alias("length")))
    runs = F.when(k % 3 == 0, run(73)).when(k % 3 == 1, run(74))
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(records.mask_issues(contour, runs, F.lit(64), F.lit(48)), ",").alias("issues"))


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, ts_us - CASE WHEN event_id % 13 = 0 THEN {DAY} ELSE 0 END AS t FROM {E}),
f AS (SELECT *, coalesce(t >= max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM e),
h AS (SELECT *, last_value(CASE WHEN ok AND event_type IN ('signup', 'error') THEN event_id END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN ok AND event_type IN ('view', 'click') THEN event_id END IGNORE NULLS) OVER w AS b
  FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT h.event_id, CASE WHEN h.ok AND a.event_type = 'signup' AND h.t - a.t <= {3 * DAY} THEN h.t - (37 + h.user_id % 2) * 1000000 + CASE WHEN b.event_type = 'view' AND h.t - b.t <= {3 * DAY} THEN b.event_id % 1000 ELSE 0 END END AS utc_us
FROM h LEFT JOIN e a ON a.event_id = h.a LEFT JOIN e b ON b.event_id = h.b
""")
def utc_times(spark, sf_dir):
    is_ = lambda t: F.col("event_type") == t
    e = events(spark, sf_dir).withColumn("t", F.col("ts_us") - F.when(F.col("event_id") % 13 == 0, DAY).otherwise(0))
    leap, fix = F.when(is_("signup"), 37 + F.col("user_id") % 2), F.when(is_("view"), F.col("event_id") % 1000)
    return presentation.utc_times(e, ["user_id"], ["event_id"], "t", leap, fix, (is_("error"), is_("click")), 3 * DAY).select("event_id", "utc_us")


def _frames(spark, sf_dir):
    i, rates = F.col("event_id"), F.array(F.lit(32_000), F.lit(44_100), F.lit(48_000))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(i % 2 == 0, 1024).otherwise(1152).cast("long").alias("samples"), F.get(rates, (F.col("user_id") % 3).cast("int")).cast("long").alias("rate"), F.when(i % 5 > 0, i % 2 + 1).alias("channels"), F.when(i % 10 == 0, i * 9000).alias("anchor"))
    return presentation.audio_times(e, ["user_id"], ["event_id"], "anchor", "samples", "rate", i % 37 == 0)


_FRAMES = """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 1024 ELSE 1152 END AS samples, CASE user_id % 3 WHEN 0 THEN 32000 WHEN 1 THEN 44100 ELSE 48000 END AS rate,
  CASE WHEN event_id % 5 > 0 THEN event_id % 2 + 1 END AS channels, CASE WHEN event_id % 10 = 0 THEN event_id * 9000 END AS anchor FROM events),
s AS (SELECT *, last_value(CASE WHEN event_id % 10 = 0 OR event_id % 37 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS mark FROM e),
t AS (SELECT *, CASE WHEN mark % 10 = 0 THEN mark * 9000 + 90000.0 * (sum(samples) OVER (PARTITION BY user_id, mark ORDER BY event_id) - samples) / rate END AS presented FROM s)
"""


@query(_FRAMES + "SELECT event_id, round(presented, 6) AS presented FROM t")
def audio_times(spark, sf_dir):
    return _frames(spark, sf_dir).select("event_id", F.round("presented", 6).alias("presented"))


@query(_FRAMES + """
SELECT user_id, count(*) AS frames, CAST(sum(samples) AS BIGINT) AS samples, sum(samples) / CAST(any_value(rate) AS DOUBLE) AS seconds, count(presented) AS timed, count(*) - count(channels) AS unknown_channels,
  CAST(any_value(rate) AS VARCHAR) AS rates, coalesce(array_to_string(list_sort(list(DISTINCT channels) FILTER (WHERE channels IS NOT NULL)), ','), '') AS channel_counts FROM t GROUP BY user_id
""")
def audio_stats(spark, sf_dir):
    found = presentation.audio_stats(_frames(spark, sf_dir), ["user_id"], "samples", "rate", "channels", "presented")
    return found.withColumns({c: F.array_join(c, ",") for c in ("rates", "channel_counts")})


@query("SELECT user_id, count(*) AS observations, count(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END) AS targets FROM events GROUP BY user_id")
def target_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("target", F.when(F.col("event_type") != "error", F.col("event_type")))
    return presentation.target_counts(e, ["user_id"], "target")


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS n FROM {E}),
c AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY user_id ORDER BY n), 0) AS wiped FROM e)
SELECT c.event_id, count(DISTINCT r.event_type) AS visible FROM c LEFT JOIN e r ON r.user_id = c.user_id AND r.n <= c.n AND r.n > c.wiped AND r.event_type <> 'error' AND c.ts_us - r.ts_us <= {DAY} GROUP BY c.event_id
""")
def visible_records(spark, sf_dir):
    """Records of a keyed table, by event type, that can be seen after each event; an error clears the table."""
    out = presentation.visible_counts(events(spark, sf_dir), ["user_id"], ["ts_us", "event_id"], "ts_us", "event_type", F.col("event_type") == "error", DAY)
    return out.select("event_id", "visible")


@query(f"""
WITH b AS (SELECT event_type, ts_us // {DAY} * {DAY} AS start_us FROM {E})
SELECT event_type, start_us, count(*) AS n FROM b WHERE start_us + {DAY} <= (SELECT max(ts_us) - 3600000000 FROM {E}) GROUP BY ALL
""")
def streaming_windows(spark, sf_dir):
    """Events of each type and day, told when the watermark, an hour behind, has passed the day."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.select("event_type", F.timestamp_micros(micros("ts")).alias("at"))
    days = state.windowed(stream, "at", "1 day", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return state.run_once(days.select("event_type", F.unix_micros("start").alias("start_us"), "n"), scratch(spark, "stream"), scratch(spark, "state"))


def _item(tag: int, value):
    return F.concat(F.lit(bytes([tag])), _told(value))


def _target_sets(spark, sf_dir):
    """A moving-target set for each part, of one to three targets; every eleventh repeats a target."""
    k = F.col("p_partkey")

    def target(j):
        items = F.concat(_item(1, _octets(k % 60_000 + 65_536, 3)), _item(5, _octets((k + j) % 120, 1)), _item(10, _octets(k * 7919 % 5033164, 3)), _item(12, _octets(k % 19901, 2)), _item(23, _octets((k + j) % 6, 1)))
        return _told(F.concat(codecs.ber_oid(F.when(k % 11 == 0, 1).otherwise(j)), items))

    series = F.aggregate(F.transform(F.sequence(F.lit(1).cast("long"), 1 + k % 3), target), F.lit(b""), lambda done, x: F.concat(done, x))
    raw = F.concat(_item(2, _octets(k * 1_000_003, 8)), _item(5, _octets(k % 200 + 1, 1)), _item(8, _octets(k % 2 * 1920, 2)), _item(11, _octets(k % 23040, 2)), _item(101, series))
    return klv.local_set_items(dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", raw.alias("raw")), "raw", ("p_partkey",))


@query("""
SELECT p_partkey, p_partkey * 1000003 AS at_us, CAST(p_partkey % 200 + 1 AS DOUBLE) AS total, CASE WHEN p_partkey % 2 = 1 THEN 1920.0 END AS width, p_partkey % 23040 / 128.0 AS view,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS issues FROM part
""")
def target_sets(spark, sf_dir):
    values = registry.decode_fields(_target_sets(spark, sf_dir).drop("issue"), registry.registry(spark, targets.SET_TAGS))
    one = lambda tag, column="num": F.max(F.when(F.col("tag") == tag, F.col(column)))
    return values.groupBy("p_partkey").agg(one(2, "exact").cast("long").alias("at_us"), one(5).alias("total"), one(8).alias("width"), one(11).alias("view"), F.count("issue").alias("issues"))


@query("""
WITH t AS (SELECT p_partkey AS k, unnest(range(1, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 2 + p_partkey % 3 END)) AS j FROM part)
SELECT k AS p_partkey, j AS target_id, k % 60000 + 65536.0 AS centroid, CASE WHEN (k + j) % 120 <= 100 THEN CAST((k + j) % 120 AS DOUBLE) END AS confidence, round((k * 7919 % 5033164 - 0.6) / 131072.0 - 19.2, 9) AS latitude_offset,
  k % 19901 - 900.0 AS height, CASE WHEN (k + j) % 6 < 5 THEN CAST((k + j) % 6 AS DOUBLE) END AS status,
  CASE WHEN (k + j) % 120 > 100 THEN 1 ELSE 0 END + CASE WHEN (k + j) % 6 = 5 THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN k % 3 ELSE 0 END AS issues FROM t
""")
def target_series(spark, sf_dir):
    series = _target_sets(spark, sf_dir).where("tag = 101").select("p_partkey", "raw")
    values = registry.decode_fields(targets.target_items(series, "raw"), registry.registry(spark, targets.TARGET_TAGS))
    found = targets.pivot_targets(values, ["p_partkey"], {"centroid": 1, "confidence": 5, "latitude_offset": 10, "height": 12, "status": 23})
    return found.withColumn("latitude_offset", F.round("latitude_offset", 9))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 1 THEN 'total_mismatch' END, CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 > 0 THEN 'total_required' END,
  CASE WHEN p_partkey % 5 IN (1, 2) THEN 'time_mismatch' END, CASE WHEN p_partkey % 5 = 3 AND p_partkey % 7 > 0 AND p_partkey % 4 > 0 THEN 'time_required' END, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 0 THEN 'source' END,
  CASE WHEN p_partkey % 13 = 0 THEN 'width' END, CASE WHEN p_partkey % 7 <= 1 AND p_partkey % 9 = 0 THEN 'height' END, CASE WHEN p_partkey % 4 = 3 AND p_partkey % 3 = 0 THEN 'offsets' END) AS issues FROM part
""")
def target_contexts(spark, sf_dir):
    k, long = F.col("p_partkey"), lambda x: F.lit(x).cast("long")
    frame = k * 1000
    issues = targets_.context_issues(
        F.when(k % 2 == 0, k % 50), k % 50 + F.when(k % 3 == 2, 1).otherwise(0), F.when(k % 3 == 1, k % 50 + 1).otherwise(k % 50), F.when(k % 5 != 3, frame + F.when((k % 5).isin(1, 2), 7).otherwise(0)), frame,
        frame + F.when(k % 4 == 3, 81).otherwise(k % 4), k % 7 == 0, k % 11 == 0, k % 2 == 1, (long(1920), F.when(k % 7 <= 1, long(1080))),
        (F.when(k % 13 == 0, 1280).otherwise(1920), F.when(k % 9 == 0, 720).otherwise(1080)), F.lit(40), k % 3 == 0,
    )
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(issues, ",").alias("issues"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 1 THEN 'order' END, CASE WHEN p_partkey % 4 = 1 THEN 'boundary' END, CASE WHEN p_partkey % 103 > 100 THEN 'confidence' END,
  CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 <> 1 THEN 'history' END) AS issues FROM part
""")
def target_tracks(spark, sf_dir):
    k = F.col("p_partkey")
    issues = targets_.tracker_issues(F.when(k % 5 > 0, k), F.when(k % 5 == 1, k - 1).otherwise(k), F.when(k % 4 > 0, k % 4), k % 103, F.when(k % 3 > 0, k % 3 % 2), k % 2 == 1)
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.array_join(issues, ",").alias("issues"))
