"""Queries of codecs, geometry, arrays, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, codecs, geometry
from ..session import micros, scratch, table
from ..sources import files, klv, transport
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


_N = "l_orderkey * l_linenumber * 37"


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_orderkey") * F.col("l_linenumber") * 37).cast("long").alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, {_N} AS n, CAST(CASE WHEN {_N} < 128 THEN 1 WHEN {_N} < 256 THEN 2 WHEN {_N} < 65536 THEN 3 WHEN {_N} < 16777216 THEN 4 ELSE 5 END AS BIGINT) AS octets,
  CASE WHEN {_N} < 128 THEN upper(printf('%02x', CAST({_N} AS BIGINT))) WHEN {_N} < 256 THEN upper(printf('81%02x', CAST({_N} AS BIGINT))) WHEN {_N} < 65536 THEN upper(printf('82%04x', CAST({_N} AS BIGINT)))
  WHEN {_N} < 16777216 THEN upper(printf('83%06x', CAST({_N} AS BIGINT))) ELSE upper(printf('84%08x', CAST({_N} AS BIGINT))) END AS form FROM lineitem""")
def ber_len(spark, sf_dir):
    raw = _line(spark, sf_dir).withColumn("raw", codecs.ber_length(F.col("n")))
    return raw.select("l_orderkey", "l_linenumber", codecs.ber_length_decode(F.col("raw")).alias("n"), F.octet_length("raw").cast("long").alias("octets"), F.hex("raw").alias("form"))


@query(f"""SELECT l_orderkey, l_linenumber, {_N} AS n, CAST(CASE WHEN {_N} < 128 THEN 1 WHEN {_N} < 16384 THEN 2 WHEN {_N} < 2097152 THEN 3 WHEN {_N} < 268435456 THEN 4 ELSE 5 END AS BIGINT) AS octets FROM lineitem""")
def ber_oid(spark, sf_dir):
    raw = _line(spark, sf_dir).withColumn("raw", codecs.ber_oid(F.col("n")))
    return raw.select("l_orderkey", "l_linenumber", codecs.ber_oid_decode(F.col("raw")).alias("n"), F.octet_length("raw").cast("long").alias("octets"))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, CAST(floor((l_extendedprice / 1000.0 - -900.0) * 65536.0) AS BIGINT) AS code FROM lineitem WHERE l_extendedprice / 1000.0 BETWEEN -900 AND 19000)
SELECT l_orderkey, l_linenumber, code, code / 65536.0 + -900.0 AS value FROM e
""")
def imap_roundtrip(spark, sf_dir):
    # a range below 2^15 in four octets: a scale of 2^(8 * 4 - 1 - 15), and a zero offset of none, as 900 is whole
    code = codecs.imap_encode(F.col("l_extendedprice") / 1000.0, -900.0, 19_000.0, 4)
    line = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", code.alias("code")).where("code is not null")
    return line.withColumn("value", codecs.imap_decode(F.col("code"), -900.0, 19_000.0, 4))


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber) % 65536 AS raw,
  (l_orderkey * 7919 + l_linenumber) % 65536 * (360.0 / 65535) AS heading,
  CASE WHEN (l_orderkey * 7919 + l_linenumber) % 65536 <> 32768 THEN (CASE WHEN (l_orderkey * 7919 + l_linenumber) % 65536 >= 32768 THEN (l_orderkey * 7919 + l_linenumber) % 65536 - 65536 ELSE (l_orderkey * 7919 + l_linenumber) % 65536 END) * (40.0 / 65534) END AS pitch FROM lineitem""")
def mapped_decode(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 65536).alias("raw"))
    return line.select("*", codecs.mapped_decode(F.col("raw"), 16, 0.0, 360.0, False).alias("heading"), codecs.mapped_decode(F.col("raw"), 16, -20.0, 20.0, True).alias("pitch"))


@query(f"SELECT event_id, ts_us + event_id % 1000 - (event_id % 3 + 17) * 1000000 AS utc_us FROM {E}")
def utc_convert(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", codecs.misp_to_utc(F.col("ts_us"), F.col("event_id") % 3 + 17, F.col("event_id") % 1000).alias("utc_us"))


@query(f"SELECT event_id, (ts_us * 1000 + event_id % 1000 + 500) // 1000 AS us FROM {E}")
def nano_micro(spark, sf_dir):
    ns = F.col("ts_us") * 1000 + F.col("event_id") % 1000
    return events(spark, sf_dir).select("event_id", codecs.nano_to_micro(ns).alias("us"))


@query(f"SELECT event_id, ts_us * 9 // 100 % 8589934592 AS pts FROM {E}")
def pts_codec(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", (F.expr("ts_us * 9 div 100") % (1 << 33)).alias("t"))
    return e.select("event_id", codecs.pts_encode(F.col("t")).alias("raw")).select("event_id", codecs.pts_decode(F.col("raw")).alias("pts"))


@query("""
WITH b AS (SELECT doc_id, encode(text) AS raw FROM documents), o AS (SELECT doc_id, octet_length(raw) AS n, hex(raw) AS h FROM b),
u AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), ' ')[1:n]) AS x FROM o WHERE n > 0)
SELECT d.doc_id, coalesce(checksum, 0) AS checksum FROM documents d LEFT JOIN (
SELECT doc_id, CAST(sum((CASE WHEN i % 2 = 0 THEN 256 ELSE 1 END) * CAST('0x' || x AS BIGINT)) % 65536 AS BIGINT) AS checksum FROM u GROUP BY doc_id) c ON c.doc_id = d.doc_id
""")
def checksum16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(codecs.running_sum_16(F.col("text").cast("binary")), F.lit(0)).alias("checksum"))


def _crc_sql(polynomial, bits, start):
    table_ = ", ".join(map(str, codecs.crc_table(polynomial, bits)))
    return (
        f"list_reduce(list_prepend(CAST({start} AS BIGINT), list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(substr(t, i, 1)) AS BIGINT))), "
        f"lambda c, x: xor((c << 8) & {(1 << bits) - 1}, ([{table_}])[xor(c >> {bits - 8}, x) + 1]))"
    )


@query(f"SELECT c_custkey, CAST({_crc_sql(0x04C11DB7, 32, 0xFFFFFFFF)} AS BIGINT) AS crc, CAST({_crc_sql(0x1021, 16, 0x1D0F)} AS BIGINT) AS crc16 FROM (SELECT c_custkey, c_name AS t FROM customer)")
def crc32_mpeg2(spark, sf_dir):
    raw = F.col("c_name").cast("binary")
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.mpeg2_crc32(raw).alias("crc"), codecs.crc16_ccitt(raw).alias("crc16"))


_SPECIALS = {0xE0: "below_minimum", 0xE1: "above_maximum", 0xC8: "positive_infinity", 0xE8: "negative_infinity"}
_FAMILIES = {0xC0: "user_defined", 0xD0: "positive_quiet_nan", 0xD8: "positive_signaling_nan", 0xF0: "negative_quiet_nan", 0xF8: "negative_signaling_nan"}


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN (l_orderkey + l_linenumber) % 256 * 16777216 WHEN l_orderkey % 5 = 1 THEN 2147483648 ELSE (l_orderkey * 7919 + l_linenumber * 104729) * 2654435 % 4294967296 END AS code FROM lineitem),
k AS (SELECT *, code // 16777216 AS first, code % 16777216 = 0 AS bare FROM c),
s AS (SELECT *, CASE {' '.join(f"WHEN first = {k} AND bare THEN '{v}'" for k, v in _SPECIALS.items())} {' '.join(f"WHEN first & 248 = {k} THEN '{v}'" for k, v in _FAMILIES.items())} WHEN first >= 128 THEN 'reserved' END AS kind FROM k)
SELECT l_orderkey, l_linenumber, CASE WHEN kind IN ('below_minimum', 'above_maximum') THEN NULL ELSE kind END AS special,
  CASE kind WHEN 'below_minimum' THEN -900.0 WHEN 'above_maximum' THEN 19000.0 ELSE CASE WHEN kind IS NULL THEN code / 65536.0 - 900.0 END END AS value,
  CASE WHEN l_orderkey % 3 = 0 THEN 'E1000000' ELSE upper(printf('%08x', CAST(floor(CAST(l_quantity AS DOUBLE) * 65536 + 900 * 65536) AS BIGINT))) END AS octets FROM s
""")
def imap_specials(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    code = F.when(k % 5 == 0, (k + n) % 256 * 16_777_216).when(k % 5 == 1, F.lit(1 << 31)).otherwise((k * 7919 + n * 104_729) * 2_654_435 % (1 << 32))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.unhex(F.lpad(F.hex(code), 8, "0")).alias("raw"))
    value = codecs.imap_value(F.col("raw"), -900.0, 19000.0, 4, clamp=True)
    octets = codecs.imap_octets(F.when(k % 3 == 0, F.lit(20000.0)).otherwise(F.col("q")), -900.0, 19000.0, 4)
    return line.select("l_orderkey", "l_linenumber", value["special"].alias("special"), value["value"].alias("value"), F.hex(octets).alias("octets"))


_H = (1.1, 0.02, 3.0, -0.01, 0.95, -2.0, 0.0001, 0.00002)
_X, _Y = "l_quantity", "l_extendedprice / 1000"


@query(f"""SELECT l_orderkey, l_linenumber, round(({_H[0]}*{_X} + {_H[1]}*({_Y}) + {_H[2]}) / ({_H[6]}*{_X} + {_H[7]:.5f}*({_Y}) + 1.0), 9) AS u,
  round(({_H[3]}*{_X} + {_H[4]}*({_Y}) + {_H[5]}) / ({_H[6]}*{_X} + {_H[7]:.5f}*({_Y}) + 1.0), 9) AS v FROM lineitem""".replace("l_quantity", "CAST(l_quantity AS DOUBLE)"))
def homography(spark, sf_dir):
    u, v = geometry.homography(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, _H)
    return _line(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE), 5) AS x, round(l_extendedprice / 1000, 5) AS y FROM lineitem")
def homography_inverse(spark, sf_dir):
    u, v = geometry.homography(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, _H)
    x, y = geometry.homography_inverse(F.col("u"), F.col("v"), _H)
    out = _line(spark, sf_dir).select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v"))
    return out.select("l_orderkey", "l_linenumber", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("""SELECT l_returnflag AS flag, round(a, 3) AS a, round(b, 3) AS b FROM (SELECT l_returnflag,
  (covar_samp(z, x) * var_samp(y) - covar_samp(z, y) * covar_samp(x, y)) / (var_samp(x) * var_samp(y) - covar_samp(x, y) * covar_samp(x, y)) AS a,
  (covar_samp(z, y) * var_samp(x) - covar_samp(z, x) * covar_samp(x, y)) / (var_samp(x) * var_samp(y) - covar_samp(x, y) * covar_samp(x, y)) AS b
  FROM (SELECT l_returnflag, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z FROM lineitem) GROUP BY 1)""")
def plane_fit(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("z"))
    return geometry.fit_plane(line, "x", "y", "z", ["flag"]).select("flag", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query("""SELECT p_partkey, (p_partkey * 977 % 307200) // 640 AS row_, (p_partkey * 977 % 307200) % 640 AS col_,
  ((p_partkey * 977 % 307200) % 640) / 640.0 AS left_, (((p_partkey * 977 % 307200) // 640) + 10 + 1) / 480.0 AS bottom FROM part""")
def pixel_boxes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 977 % 307_200 + 1).alias("pixel"))
    row, column = geometry.pixel_row_column(F.col("pixel"), F.lit(640))
    p = p.select("p_partkey", row.alias("row_"), column.alias("col_"))
    box = geometry.normalised_box(F.col("row_"), F.col("col_"), F.col("row_") + 10, F.col("col_") + 10, F.lit(480), F.lit(640))
    return p.withColumn("box", box).select("p_partkey", "row_", "col_", F.col("box.left").alias("left_"), "box.bottom")


@query("""SELECT c_custkey, round((1 - c_custkey % 10 / 10.0) * (1 - c_custkey % 7 / 7.0) * 10.0 + c_custkey % 10 / 10.0 * (1 - c_custkey % 7 / 7.0) * 11.5
  + c_custkey % 10 / 10.0 * (c_custkey % 7 / 7.0) * 12.25 + (1 - c_custkey % 10 / 10.0) * (c_custkey % 7 / 7.0) * 9.75, 6) AS latitude FROM customer""")
def bilinear_ground(spark, sf_dir):
    at = geometry.bilinear(F.col("c_custkey") % 10 / 10.0, F.col("c_custkey") % 7 / 7.0, [F.lit(v) for v in (10.0, 11.5, 12.25, 9.75)])
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(at, 6).alias("latitude"))


@query("""SELECT c_custkey, CASE WHEN c_custkey * 7 % 400 - 200 BETWEEN -180 AND 180 AND c_acctbal / 60 BETWEEN -90 AND 90 THEN c_custkey * 7 % 400 - 200.0 END AS lon,
  CASE WHEN c_custkey * 7 % 400 - 200 BETWEEN -180 AND 180 AND c_acctbal / 60 BETWEEN -90 AND 90 THEN round(c_acctbal / 60, 6) END AS lat FROM customer""")
def geo_points(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("p", geometry.point(F.col("c_custkey") * 7 % 400 - 200.0, F.col("c_acctbal") / 60))
    return c.select("c_custkey", F.col("p.coordinates")[0].alias("lon"), F.round(F.col("p.coordinates")[1], 6).alias("lat"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_acctbal * 10 BETWEEN -900 AND 40000 THEN c_acctbal * 10 END AS altitude,
  CAST(CASE WHEN c_custkey % 6 <> 0 AND c_acctbal * 10 BETWEEN -900 AND 40000 THEN 3 ELSE 2 END AS INTEGER) AS parts FROM customer""")
def geo_altitudes(spark, sf_dir):
    alt = F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal") * 10)
    c = table(spark, sf_dir, "customer").select("c_custkey", geometry.point(F.lit(5.0), F.lit(6.0), alt)["coordinates"].alias("p"))
    return c.select("c_custkey", F.get("p", F.lit(2)).alias("altitude"), F.size("p").alias("parts"))


@query("""
WITH c AS (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x FROM customer), e AS (SELECT *, greatest(0.0, x + 5 - 180) AS over FROM c)
SELECT c_custkey, CASE WHEN over > 0 THEN 2 ELSE 1 END AS rings, (5.0 - over) * 4 AS east, over * 4 AS west FROM e
""")
def antimeridian_split(spark, sf_dir):
    x = (F.col("c_custkey") % 360 - 180).cast("double")
    far = F.when(x + 5 > 180, x + 5 - 360).otherwise(x + 5)
    ring = F.array(*[F.struct(a.alias("x"), F.lit(b).alias("y")) for a, b in ((x, 0.0), (far, 0.0), (far, 4.0), (x, 4.0))])
    c = table(spark, sf_dir, "customer").select("c_custkey", geometry.split_antimeridian(ring).alias("r"))
    size = lambda k: F.coalesce(F.abs(geometry.ring_area(F.get("r", F.lit(k)))) / 2, F.lit(0.0))
    return c.select("c_custkey", F.size("r").alias("rings"), size(0).alias("east"), size(1).alias("west"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 200 AS lat, (c_custkey % 100 - 50) / 1000.0 AS d FROM customer)
SELECT c_custkey, CASE WHEN abs(d) < 0.0245 THEN 4 END AS corners, CASE WHEN abs(d) < 0.0245 THEN round(lat + 3 * d, 6) END AS last_lat FROM c
""")
def frame_corners(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("lat"), ((F.col("c_custkey") % 100 - 50) / 1000.0).alias("d"))
    corners = geometry.offset_corners(F.col("lat"), F.lit(10.0), [(F.col("d") * k, F.lit(0.01)) for k in range(4)], most=0.074)
    c = c.select("c_custkey", corners.alias("r"))
    return c.select("c_custkey", F.when(F.col("r").isNotNull(), F.size("r")).alias("corners"), F.round(F.get("r", F.lit(3))["y"], 6).alias("last_lat"))


@query("SELECT c_custkey, ((c_custkey * 37.5 + 180.0) % 360.0) - 180.0 AS lon FROM customer")
def lon_wrap(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", geometry.wrap_longitude(F.col("c_custkey") * 37.5).alias("lon"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE -2.0 END AS area, CAST(5 AS BIGINT) AS points, 2.0 AS turned FROM customer""")
def rings(spark, sf_dir):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    ring = F.array(*[F.struct((F.col("c_custkey") % 3 + x).alias("x"), F.lit(y).alias("y")) for x, y in square])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring")).withColumn("closed", geometry.closed_ring(F.col("ring")))
    return c.select("c_custkey", geometry.ring_area(F.col("ring")).alias("area"), F.size("closed").cast("long").alias("points"), geometry.ring_area(F.slice("closed", 1, 4)).alias("turned"))


@query("""SELECT p_partkey, i, CASE WHEN i >= p_partkey % 4 + 2 AND i < p_partkey % 4 + 4 THEN 9.0 WHEN i >= 1 AND i < 5 THEN 5.0 ELSE 1.0 END AS value
FROM part, (SELECT unnest(range(0, 8)) AS i) x""")
def rle_expand(spark, sf_dir):
    patch = lambda v, a, n: F.struct(F.lit(v).alias("value"), a.alias("start"), F.lit(n).alias("length"))
    patches = F.array(patch(5.0, F.lit(1).cast("long"), 4), patch(9.0, F.col("p_partkey") % 4 + 2, 2))
    values = arrays.run_length_expand(F.lit(8), F.lit(1.0), patches)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(values).alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("SELECT vec_id, CAST(embedding[vec_id % 8 * 8 + vec_id % 5 + 1] AS DOUBLE) AS value FROM embeddings")
def mdap_element(spark, sf_dir):
    value = arrays.element(F.col("embedding"), F.col("vec_id") % 8, F.col("vec_id") % 5, F.lit(8))
    return table(spark, sf_dir, "embeddings").select("vec_id", value.cast("double").alias("value"))


_PAIRS = [(i, j) for k, i in enumerate(("l_quantity", "l_discount", "l_tax")) for j in ("l_quantity", "l_discount", "l_tax")[k:]]


@query(" UNION ALL ".join(f"SELECT '{i}' AS i, '{j}' AS j, round(covar_samp({i}, {j}), 6) AS covariance, round(corr({i}, {j}), 6) AS correlation FROM lineitem" for i, j in _PAIRS))
def sdcc_pairs(spark, sf_dir):
    out = arrays.covariance_pairs(_line(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"])
    return out.select("i", "j", F.round("covariance", 6).alias("covariance"), F.round("correlation", 6).alias("correlation"))


def _packets(spark, sf_dir):
    e = events(spark, sf_dir)
    pcr = F.when(F.col("event_id") % 5 == 0, F.col("ts_us") * 27 % ((1 << 33) * 300))
    raw = transport.build_packet(F.col("user_id") % 8000 + 32, F.col("event_id") % 16, F.col("event_id") % 4 == 0, F.col("event_type").cast("binary"), pcr, F.col("event_type") == "signup")
    return e.select("event_id", "ts_us", raw.alias("raw"))


@query(f"""SELECT event_id, user_id % 8000 + 32 AS pid, event_id % 16 AS cc, event_id % 4 = 0 AS pusi, event_type = 'signup' AS discontinuity,
  CASE WHEN event_id % 5 = 0 THEN ts_us * 27 % 2576980377600 END AS pcr, event_type AS payload, CAST(188 AS BIGINT) AS size FROM {E}""")
def ts_packets(spark, sf_dir):
    out = transport.parse_packets(_packets(spark, sf_dir))
    return out.select("event_id", F.col("pid").cast("long"), F.col("cc").cast("long"), "pusi", "discontinuity", "pcr", F.col("payload").cast("string").alias("payload"), F.octet_length("raw").cast("long").alias("size"))


@query(f"""
WITH s AS (SELECT *, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 8000 + 32 ORDER BY event_id) AS pes FROM {E})
SELECT user_id % 8000 + 32 AS pid, min(event_id) AS first_offset, count(*) AS packets, string_agg(event_type, '' ORDER BY event_id) AS data FROM s WHERE pes > 0 GROUP BY 1, pes
""")
def pes_assembly(spark, sf_dir):
    out = transport.assemble_pes(transport.parse_packets(_packets(spark, sf_dir)), ["pid"], "event_id")
    return out.select(F.col("pid").cast("long"), "first_offset", "packets", F.col("data").cast("string").alias("data"))


@query(f"""SELECT event_id AS packet, CASE WHEN event_id % 40 <> 1 THEN ts_us END AS precision_time, CASE WHEN event_id % 40 = 1 THEN 9223372036854775808::DECIMAL(20, 0) + event_id ELSE ts_us END AS exact_time,
  event_type AS kind, CASE WHEN event_id % 6 <> 0 THEN user_id END AS target, CASE WHEN event_id % 8 = 0 THEN 'target' ELSE '' END AS repeated FROM {E}""")
def klv_items(spark, sf_dir):
    e = events(spark, sf_dir)

    def item(tag, value):
        return F.concat(F.lpad(F.hex(F.lit(tag)), 2, "0"), F.hex(codecs.ber_length(F.octet_length(value).cast("long"))), F.hex(value))

    number = lambda c, n: F.unhex(F.lpad(F.hex(c), 2 * n, "0"))
    i = F.col("event_id")
    time = F.when(i % 40 == 1, F.unhex(F.concat(F.lit("80"), F.lpad(F.hex(i), 14, "0")))).otherwise(number(F.col("ts_us"), 8))
    target = F.when(i % 6 != 0, number(F.col("user_id"), 4)).otherwise(F.lit("").cast("binary"))
    again = F.when(i % 8 == 0, item(65, number(i * 0, 1))).otherwise("")
    again = F.when(i % 6 == 0, F.when(i % 8 == 0, item(65, F.lit("").cast("binary"))).otherwise("")).otherwise(again)
    raw = F.unhex(F.concat(item(2, time), item(10, F.col("event_type").cast("binary")), item(65, target), again))
    items = klv.local_set_items(e.select(i.alias("packet"), raw.alias("raw")))
    out = klv.wide(items, ["packet"], {"precision_time": (2, "long"), "exact_time": (2, "unsigned"), "kind": (10, "string"), "target": (65, "long")})
    return out.withColumn("repeated", F.array_join("repeated", ","))


@query("""SELECT c_custkey AS "TimeStamp", c_acctbal AS "PlatformHeading", CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 100 END AS "SensorLatitude", CAST(NULL AS VARCHAR) AS issue FROM customer""")
def csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "sidecar")
    c = table(spark, sf_dir, "customer")
    files.write_sidecar(c.select(F.col("c_custkey").alias("TimeStamp"), F.col("c_acctbal").alias("PlatformHeading"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 100).alias("SensorLatitude")), path)
    return files.read_sidecar(spark, path).select("TimeStamp", "PlatformHeading", "SensorLatitude", "issue")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN 1 ELSE 0 END AS features, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 180 AS DOUBLE) END AS lon FROM customer""")
def geojson_seq(spark, sf_dir):
    path = scratch(spark, "features")
    c = table(spark, sf_dir, "customer")
    place = F.when(F.col("c_custkey") % 4 != 0, geometry.point(F.col("c_custkey") % 180, F.lit(10.0)))
    features = F.array(files.feature(place, F.struct(F.col("c_custkey").alias("id"))))
    files.write_sequence(c, features, path)
    kind = "type string, features array<struct<type string, geometry struct<type string, coordinates array<double>>, properties struct<id bigint>>>"
    read = spark.read.schema(kind).json(path)
    found = read.select(F.explode_outer("features").alias("f")).select(F.col("f.properties.id").alias("c_custkey"), F.col("f.geometry.coordinates")[0].alias("lon"))
    return c.select("c_custkey").join(found.where("c_custkey is not null"), "c_custkey", "left").select("c_custkey", F.when(F.col("lon").isNull(), 0).otherwise(1).alias("features"), "lon")


@query(f"""
WITH l AS (SELECT event_id, user_id, ts_us, event_type, lag(value) OVER w AS v, lag(ts_us) OVER w AS t FROM {E} WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts_us, event_id))
SELECT user_id, event_id, ts_us, event_type, CASE WHEN ts_us - t <= {3 * DAY} THEN v END AS before, false AS late FROM l
""")
def streaming_roc(spark, sf_dir):
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.select("user_id", "event_id", micros("ts").alias("ts_us"), "event_type", "value")
    return state.run_once(state.streaming_carry(stream, "user_id", "event_id", "ts_us", "event_type", "value", 3 * DAY), scratch(spark, "stream"), scratch(spark, "state"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_dedup(spark, sf_dir):
    """The first of each pair within a span longer than the whole table's."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    timed = stream.select("user_id", "event_type", F.timestamp_micros(micros("ts")).alias("at"))
    return state.run_once(state.distinct_within(timed, "at", "3650 days", ["user_id", "event_type"]), scratch(spark, "stream"), scratch(spark, "state")).select("user_id", "event_type")


@query(f"""
WITH e AS (SELECT user_id, event_id, ts_us, event_type IN ('view', 'click') AND user_id % 4 <> 0 AS media, CASE WHEN event_id % 3 <> 0 THEN (ts_us * 9 // 100 + 8589934592 - 1000000) % 8589934592 END AS pts FROM {E}),
s AS (SELECT user_id, arg_min(pts, CAST(ts_us AS HUGEINT) * 1000000 + event_id) FILTER (media AND pts IS NOT NULL) AS start, min(ts_us) FILTER (NOT media) AS first FROM e GROUP BY user_id),
p AS (SELECT e.user_id, event_id, (pts - start + 4294967296 + 8589934592) % 8589934592 - 4294967296 AS d, ts_us - first AS since, start FROM e JOIN s USING (user_id) WHERE NOT media)
SELECT user_id, event_id AS ref, greatest(0.0, coalesce(d / 90000.0, since / 1000000.0)) AS seconds, d IS NOT NULL AS by_clock FROM p
""")
def streaming_live(spark, sf_dir):
    """Metadata of every user, shown by the clock of the media; every fourth user has none, and a timer ends the wait."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    at = micros("ts")
    media = F.col("event_type").isin("view", "click") & (F.col("user_id") % 4 != 0)
    stream = stream.select("user_id", F.col("event_id").alias("ref"), media.alias("media"), F.expr("CASE WHEN event_id % 3 <> 0 THEN 1 END").alias("told"), at.alias("at"))
    stream = stream.select("user_id", "ref", "media", F.when(F.col("told") == 1, F.expr("(at * 9 div 100 + 8589934592 - 1000000) % 8589934592")).alias("pts"), "at")
    last = table(spark, sf_dir, "events").agg(F.max(micros("ts"))).first()[0]
    # a row of no user that is of use, so much later that the watermark passes all others
    end = spark.createDataFrame([(-1, -1, True, None, last + 100 * DAY)], "user_id long, ref long, media boolean, pts long, at long")
    return state.run_to_the_end(stream, end, lambda s: state.live_samples(s, "user_id", 30 * DAY, "1 hour"), scratch(spark, "live"))

