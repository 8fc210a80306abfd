"""Queries of structured packs, keyed tables and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, packs, targets
from ..operators import tables
from ..session import dealt, table
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


def _part(table_, column="p_partkey"):
    return table_, F.col(column)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 31 END AS numerator, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 500 + 1 END AS denominator FROM part""")
def frame_rates(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    raw = F.concat(codecs.ber_oid(k * 31), F.when(k % 7 == 0, F.lit(b"\x00")).when(k % 3 == 0, F.lit(b"")).otherwise(codecs.ber_oid(k % 500 + 1)))
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", packs.frame_rate(F.col("raw")).alias("r")).select("p_partkey", "r.*")


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 101 AS x, p_partkey * 7919 % 2147483647 AS u FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 1 THEN x END AS x0, CASE WHEN p_partkey % 4 <> 1 THEN 100 END AS x1, CASE WHEN p_partkey % 4 = 2 THEN u * (90.0 / 2147483647) END AS latitude0 FROM b
""")
def horizons(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    raw = F.concat(_octets(k % 101, 1), F.lit(b"\x00"), _octets(F.lit(100), 1), _octets(k % 101, 1), F.when(k % 4 == 1, F.lit(b"\x01")).when(k % 4 == 2, _octets(k * 7919 % 2147483647, 4)).otherwise(F.lit(b"")))
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", packs.horizon(F.col("raw")).alias("h")).select("p_partkey", "h.x0", "h.x1", "h.latitude0")


@query("SELECT p_partkey, array_to_string(list_filter(range(0, 16), lambda b: (CASE WHEN b < 8 THEN p_partkey % 256 ELSE p_partkey // 256 % 256 END) >> CAST(b % 8 AS BIGINT) & 1 = 1), ',') AS bits FROM part")
def active_bits(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    raw = F.concat(_octets(k % 256, 1), _octets(F.expr("p_partkey div 256 % 256"), 1))
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", F.array_join(packs.bitset(F.col("raw")), ",").alias("bits"))


@query("""
WITH d AS (SELECT c_custkey, upper(sha1(upper(hex(c_name)) || upper(hex(c_mktsegment)))) AS h FROM customer)
SELECT c_custkey, substr(h, 1, 12) || '5' || substr(h, 14, 3) || substr('89AB', CAST(CAST('0x' || substr(h, 17, 1) AS BIGINT) % 4 + 1 AS BIGINT), 1) || substr(h, 18, 15) AS id FROM d
""")
def miis_combined(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", packs.miis_combine([F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")]).alias("id"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 4 > 0 THEN upper(repeat('ab', 16)) END END AS sensor, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 > 0 THEN upper(repeat('cd', 16)) END END AS window_ FROM part
""")
def miis_cores(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    usage = (k % 4) * 32 + (k % 2) * 4
    raw = F.concat(F.when(k % 5 == 0, F.lit(b"\x02")).otherwise(F.lit(b"\x01")), _octets(usage, 1), F.unhex(F.when(k % 4 > 0, F.repeat(F.lit("AB"), 16)).otherwise("")), F.unhex(F.when(k % 2 > 0, F.repeat(F.lit("CD"), 16)).otherwise("")))
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", packs.miis_core(F.col("raw")).alias("m")).select("p_partkey", "m.sensor", F.col("m.window").alias("window_"))


@query("""
SELECT p_partkey, n, p_partkey % 40 + 10 + n AS id, CASE WHEN p_partkey % 40 + 10 + n < 21 THEN 'reserved_id' END AS issue, 'w' || CAST(n AS VARCHAR) AS name, 380.0 + n AS low_nm FROM part, (VALUES (0), (1), (2)) v(n) WHERE n <= p_partkey % 3
""")
def wavelengths(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))

    def record(n):
        body = F.concat(codecs.ber_oid(k % 40 + 10 + n), codecs.imap_octets(F.lit(380.0 + n), 0.0, 1e9, 4), codecs.imap_octets(F.lit(750.0), 0.0, 1e9, 4), F.lit(f"w{n}").cast("binary"))
        return F.when(k % 3 >= n, F.concat(codecs.ber_length(F.octet_length(body).cast("long")), body)).otherwise(F.lit(b""))

    out = packs.wavelength_records(p.select("p_partkey", F.concat(*map(record, range(3))).alias("raw")), "raw")
    return out.select("p_partkey", "n", "id", "issue", "name", F.round("low_nm", 0).alias("low_nm"))


@query("SELECT p_partkey, CAST(p_partkey % 3 + 1 AS BIGINT) AS id, p_partkey % 65536 - 32768 AS order_ FROM part")
def waypoint_packs(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    raw = F.concat(F.lit(b"\x03"), codecs.ber_oid(k % 3 + 1), _octets(F.pmod(k % 65_536 - 32_768, F.lit(65_536)), 2))
    return packs.waypoint_records(p.select("p_partkey", raw.alias("raw")), "raw").select("p_partkey", "id", F.col("order").alias("order_"))


@query("""
WITH i AS (SELECT p_partkey, unnest(range(0, 6)) AS i FROM part)
SELECT p_partkey, i, CASE p_partkey % 4 WHEN 0 THEN CAST(i * 10 + p_partkey % 50 AS DOUBLE) WHEN 1 THEN CAST(64 >> CAST(i AS INTEGER) & 64 = 64 AS DOUBLE) WHEN 2 THEN CAST(5 + i AS DOUBLE) ELSE CASE WHEN i IN (4, 5) THEN 9.0 ELSE 1.0 END END AS value FROM i
""".replace("CAST(64 >> CAST(i AS INTEGER) & 64 = 64 AS DOUBLE)", "CASE WHEN i = 1 THEN 1.0 ELSE 0.0 END"))
def mdap_decode(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    head = F.unhex(F.lit("020203"))
    plain = F.concat(head, F.unhex(F.lit("0201")), *[_octets(k % 50 + i * 10, 2) for i in range(6)])
    bits = F.concat(head, F.unhex(F.lit("010340")))
    biased = F.concat(head, F.unhex(F.lit("010405" + "".join(f"{i:02X}" for i in range(6)))))
    runs = F.concat(head, F.unhex(F.lit("010501" + "09" + "0101" + "0102")))
    body = F.when(k % 4 == 0, plain).when(k % 4 == 1, bits).when(k % 4 == 2, biased).otherwise(runs)
    out = packs.decode_arrays(p.select("p_partkey", F.concat(codecs.ber_length(F.octet_length(body).cast("long")), body).alias("raw")), "raw")
    return out.select("p_partkey", F.posexplode("elements").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("""
WITH b AS (SELECT p_partkey, CAST(p_partkey % 16 + 1 AS DOUBLE) AS s FROM part)
SELECT p_partkey, s * s AS v00, CASE WHEN p_partkey % 2 = 0 THEN s * 2 * 0.5 ELSE 0.0 END AS v01, s * 4 * -0.25 AS v12 FROM b
""")
def sdcc_decode(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    # 32-bit floats of 1 to 16, and of 2 and 4
    whole = F.get(F.array(*[F.lit(h) for h in ["3F800000", "40000000", "40400000", "40800000", "40A00000", "40C00000", "40E00000", "41000000", "41100000", "41200000", "41300000", "41400000", "41500000", "41600000", "41700000", "41800000"]]), (k % 16).cast("int"))
    deviations = F.concat(whole, F.lit("40000000"), F.lit("40800000"))
    # correlations (0,1), (0,2), (1,2): all, or the last two
    full, sparse = F.concat(F.lit("038404"), F.concat(whole, F.lit("40000000"), whole), F.lit("3F0000003F800000BE800000")), F.concat(F.lit("03A404" + "60"), F.concat(whole, F.lit("40000000"), whole), F.lit("3F800000BE800000"))
    out = packs.decode_covariances(p.select("p_partkey", F.unhex(F.when(k % 2 == 0, full).otherwise(sparse)).alias("raw")), "raw")
    v = lambda r, c: packs.covariance(F.col("deviations"), F.col("correlations"), F.lit(r), F.lit(c))
    out = out.select("p_partkey", v(0, 0).alias("v00"), v(1, 0).alias("v01"), v(1, 2).alias("v12"), (k % 16 + 1).alias("s"))
    return out.select("p_partkey", "v00", "v01", (F.col("v12") * 4 / 2).alias("v12"))


_REF = f"(SELECT event_id, user_id, ts_us, event_id % 30 AS id FROM {E} WHERE event_type = 'view')"
_REC = f"(SELECT DISTINCT user_id, ts_us, event_id % 30 AS id FROM {E} WHERE event_type = 'click' AND event_id % 30 >= 21)"


@query(f"""
WITH c AS (SELECT user_id, ts_us AS clear_at FROM {E} WHERE event_type = 'error'),
j AS (SELECT r.*, CASE WHEN r.ts_us - k.ts_us <= {3 * DAY} THEN k.ts_us END AS rec FROM {_REF} r ASOF LEFT JOIN {_REC} k ON r.user_id = k.user_id AND r.id = k.id AND r.ts_us >= k.ts_us),
f AS (SELECT j.*, c.clear_at FROM j ASOF LEFT JOIN c ON j.user_id = c.user_id AND j.ts_us >= c.clear_at)
SELECT event_id, id, CASE WHEN id BETWEEN 7 AND 20 THEN 'reserved' ELSE 'undefined' END AS issue FROM f WHERE id BETWEEN 7 AND 20 OR (id >= 21 AND NOT coalesce(rec IS NOT NULL AND (clear_at IS NULL OR rec >= clear_at), false))
""")
def table_references(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("id", F.col("event_id") % 30)
    refs = e.where("event_type = 'view'").select("event_id", "user_id", "ts_us", "id")
    out = tables.active_issues(refs, e.where("event_type = 'click' and id >= 21"), e.where("event_type = 'error'"), ["user_id"], "id", "ts_us", 3 * DAY, (7, 20), 21)
    return out.select("event_id", "id", "issue")


@query(f"""
WITH t AS (SELECT event_id, user_id, ts_us, CASE WHEN event_id % 3 <> 0 THEN event_id // 50 % 4 END AS n, event_type = 'error' AS wipe, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS k FROM {E}),
w AS (SELECT user_id, k, CASE WHEN NOT wipe THEN n END AS n, ts_us FROM t WHERE wipe OR n IS NOT NULL),
j AS (SELECT t.*, w.n AS held, w.ts_us AS at_, lag(t.ts_us) OVER (PARTITION BY t.user_id ORDER BY t.k) AS before FROM t ASOF LEFT JOIN w ON w.user_id = t.user_id AND w.k < t.k)
SELECT event_id, CASE WHEN wipe THEN 'cleared' WHEN held IS NOT NULL AND ts_us - at_ > {DAY} AND before - at_ <= {DAY} THEN 'expired' WHEN ts_us - at_ <= {DAY} AND n <> held THEN 'count' END AS restart FROM j
""")
def payload_restarts(spark, sf_dir):
    """Every third packet tells no count, errors clear the table."""
    e = events(spark, sf_dir).withColumn("n", F.when(F.col("event_id") % 3 != 0, F.expr("event_id div 50 % 4")))
    return tables.count_restarts(e, ["user_id"], ["ts_us", "event_id"], "ts_us", "n", DAY, F.col("event_type") == "error").select("event_id", "restart")


@query("""
WITH g AS (SELECT l_orderkey, 4 AS total, list_distinct(list(CAST(l_linenumber - 1 AS BIGINT))) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, total, array_to_string(list_filter(range(0, 4), lambda i: NOT list_contains(ids, i)), ',') AS missing, len(list_filter(range(0, 4), lambda i: NOT list_contains(ids, i))) = 0 AS complete FROM g
""")
def payload_missing(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(4).alias("total"), (F.col("l_linenumber") - 1).cast("long").alias("id"))
    return tables.missing_records(line.withColumnRenamed("total", "declared"), ["l_orderkey"], "declared", "id").withColumn("missing", F.array_join("missing", ","))


_WP = f"""(
  SELECT user_id, event_id, ts_us, event_id % 7 AS id, CASE WHEN event_id % 11 = 0 THEN 32767 ELSE event_id % 13 - 6 END AS order_ FROM {E} WHERE event_type <> 'error'
  UNION ALL SELECT user_id, event_id, ts_us, 7 + event_id % 3, event_id % 5 - 4 FROM {E} WHERE event_type IN ('view', 'click')
)"""


@query(f"""
WITH r AS (SELECT *, lag(order_) OVER w AS p_order, lag(ts_us) OVER w AS p_ts, lag(event_id) OVER w AS p_seq FROM {_WP} WINDOW w AS (PARTITION BY user_id, id ORDER BY event_id)),
i AS (SELECT DISTINCT user_id, id FROM r), c AS (SELECT user_id, event_id FROM {E} WHERE event_type = 'error'),
q AS (SELECT e.user_id, e.event_id, e.ts_us, i.id, c.event_id AS wiped FROM {E} e JOIN i USING (user_id) ASOF LEFT JOIN c ON c.user_id = e.user_id AND c.event_id <= e.event_id),
s AS (
  SELECT q.user_id, q.event_id, q.id, r.order_, r.event_id = q.event_id AS told,
    CASE WHEN r.event_id <> q.event_id THEN r.order_ WHEN q.ts_us - p_ts <= {3 * DAY} AND (wiped IS NULL OR p_seq > wiped) THEN p_order END AS before
  FROM q ASOF JOIN r ON r.user_id = q.user_id AND r.id = q.id AND r.event_id <= q.event_id WHERE q.ts_us - r.ts_us <= {3 * DAY} AND (wiped IS NULL OR r.event_id > wiped)
), b AS (SELECT *, told AND order_ < 0 AND coalesce(before >= 0, true) AS became, count(*) OVER (PARTITION BY user_id, event_id, order_) AS n FROM s),
l AS (SELECT *, min(CASE WHEN order_ < 0 AND NOT became THEN order_ END) OVER (PARTITION BY user_id, event_id) AS low FROM b)
SELECT user_id, event_id, id, CAST(order_ AS BIGINT) AS order_, 'duplicate_order' AS code FROM l WHERE n > 1 AND order_ <> 32767
UNION ALL SELECT user_id, event_id, id, CAST(order_ AS BIGINT), 'historical_not_decreasing' FROM l WHERE became AND order_ >= low
""")
def waypoint_orders(spark, sf_dir):
    """A packet for each event, with one waypoint or two; errors clear the list, waypoints stay for three days."""
    i = F.col("event_id")
    e = events(spark, sf_dir).select("user_id", "event_id", "ts_us", "event_type")
    first = F.struct((i % 7).alias("id"), F.when(i % 11 == 0, 32767).otherwise(i % 13 - 6).cast("long").alias("order_"))
    second = F.struct((7 + i % 3).alias("id"), (i % 5 - 4).cast("long").alias("order_"))
    records = e.where("event_type <> 'error'").withColumn("r", F.explode(F.when(F.col("event_type").isin("view", "click"), F.array(first, second)).otherwise(F.array(first))))
    clears = e.where("event_type = 'error'")
    return tables.order_issues(e, records.select("user_id", "event_id", "ts_us", "r.*"), clears, ["user_id"], "event_id", "ts_us", "id", "order_", 3 * DAY)


@query(f"""
WITH s AS (SELECT user_id, ts_us // {DAY} AS day, list_sort(list_distinct(list(event_type))) AS tags FROM {E} GROUP BY ALL), b AS (SELECT *, coalesce(lag(tags) OVER (PARTITION BY user_id ORDER BY day), []) AS before FROM s)
SELECT user_id, day, array_to_string(list_sort(list_filter(tags, lambda t: NOT list_contains(before, t))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda t: NOT list_contains(tags, t))), ',') AS removed FROM b
""")
def tag_changes(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id", F.expr(f"ts_us div {DAY}").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("tags"))
    return tables.set_changes(s, ["user_id"], ["day"], "tags").select("user_id", "day", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


_START = 1_705_276_800_000_000


@query(f"SELECT event_id, user_id FROM {E} e WHERE ts_us >= coalesce((SELECT max(ts_us) FROM {E} x WHERE x.user_id = e.user_id AND x.ts_us <= {_START}), {_START})")
def seek_start(spark, sf_dir):
    return tables.start_at(events(spark, sf_dir), ["user_id"], "ts_us", _START).select("event_id", "user_id")


@query(f"""
WITH a AS (SELECT user_id, ts_us // 3600000000 AS due, CASE WHEN event_type = 'view' THEN 'media' ELSE 'metadata' END AS kind, event_id AS ref FROM {E})
SELECT user_id, kind, ref, row_number() OVER (PARTITION BY user_id ORDER BY due, kind = 'media', ref) - 1 AS slot FROM a
""")
def interleaved(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", F.expr("ts_us div 3600000000").alias("due"), F.col("event_id").alias("ref"))
    return tables.interleave(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), ["user_id"], "due").select("user_id", "kind", "ref", "slot")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, CASE l_linenumber WHEN 1 THEN 15 WHEN 2 THEN 75 WHEN 3 THEN 6 WHEN 4 THEN 90 WHEN 5 THEN 104 ELSE 13 END AS tag FROM lineitem),
c AS (SELECT *, CASE WHEN tag IN (104, 75, 15) THEN 1 WHEN tag IN (90, 6) THEN 2 END AS chain, CASE tag WHEN 104 THEN 0 WHEN 75 THEN 1 WHEN 15 THEN 2 WHEN 90 THEN 0 WHEN 6 THEN 1 END AS place FROM i)
SELECT l_orderkey, tag FROM c WHERE chain IS NULL OR place = (SELECT min(place) FROM c d WHERE d.l_orderkey = c.l_orderkey AND d.chain = c.chain)
""")
def effective_tags(spark, sf_dir):
    n = F.col("l_linenumber")
    tag = F.when(n == 1, 15).when(n == 2, 75).when(n == 3, 6).when(n == 4, 90).when(n == 5, 104).otherwise(13)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", tag.alias("tag")).distinct()
    return tables.effective_fields(line, ["l_orderkey"], "tag", [(104, 75, 15), (90, 6)])


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN abs(CAST(l_quantity AS DOUBLE) - 25) > 10 THEN 'l_quantity' END, CASE WHEN abs(l_discount - 0.05) > 0.021 THEN 'l_discount' END) AS wrong FROM lineitem")
def expected_fields(spark, sf_dir):
    wrong = tables.expectation_issues(None, [("l_quantity", F.lit(25.0), 10.0), ("l_discount", F.lit(0.05), 0.021)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(wrong, ",").alias("wrong"))


@query("""
WITH c AS (SELECT user_id, event_id AS o, event_id * 1000 + event_id % 7 * 10 AS t FROM events WHERE event_type = 'view')
SELECT e.event_id, CAST(floor(p.t + (e.event_id - p.o) * (n.t - p.t) / (n.o - p.o)) AS BIGINT) AS at_ticks FROM events e ASOF LEFT JOIN c p ON p.user_id = e.user_id AND e.event_id >= p.o ASOF LEFT JOIN c n ON n.user_id = e.user_id AND e.event_id < n.o
""")
def byte_clock(spark, sf_dir):
    """A recording for each user; the views read its clock."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    clock = e.where("event_type = 'view'").select("user_id", "event_id", (F.col("event_id") * 1000 + F.col("event_id") % 7 * 10).alias("t"))
    return tables.byte_times(e, clock, ["user_id"], "event_id", "t").select("event_id", "at_ticks")


@query("""
SELECT 'order' AS relation, CAST(l_orderkey AS VARCHAR) AS ref, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) GROUP BY ALL
UNION ALL SELECT 'customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 <> 0) GROUP BY ALL
""")
def integrity_relations(spark, sf_dir):
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    return tables.integrity([("order", line, "l_orderkey", orders.where("o_orderkey % 9 <> 0"), "o_orderkey"), ("customer", orders, "o_custkey", customer.where("c_custkey % 8 <> 0"), "c_custkey")])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.5 WHEN abs(c_acctbal / 400) <= 19.2 THEN 10 + c_acctbal / 400 END AS latitude, CASE WHEN c_custkey % 3 = 0 THEN 2.5 WHEN abs(c_acctbal / 400) <= 19.2 THEN -175.0 END AS longitude FROM customer
""")
def target_places(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    own = F.when(F.col("c_custkey") % 3 == 0, 1.5)
    place = targets.target_location((own, own + 1, F.lit(None)), (F.lit(10.0), F.lit(170.0)), (F.col("c_acctbal") / 400, F.lit(15.0)), F.lit(7.0))
    return c.select("c_custkey", place.alias("p")).select("c_custkey", "p.latitude", "p.longitude")


@query("""
WITH b AS (SELECT p_partkey, p_partkey % 600 AS l, p_partkey % 400 AS t, p_partkey % 600 + p_partkey % 40 AS r, p_partkey % 400 + 30 AS b FROM part)
SELECT p_partkey, CASE WHEN r > l THEN t * 640 + l + 1 END AS top_left, CASE WHEN r > l THEN (b - 1) * 640 + r END AS bottom_right, CASE WHEN r > l THEN ((t + b - 1) // 2) * 640 + (l + r - 1) // 2 + 1 END AS centroid FROM b
""")
def box_numbers(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    box = targets.box_pixels(k % 600, k % 400, k % 600 + k % 40, k % 400 + 30, F.lit(640))
    return p.select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query("""
WITH b AS (SELECT p_partkey, p_partkey * 331 % 310000 + 1 AS a, p_partkey * 577 % 310000 + 1 AS z FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN a > 307200 OR z > 307200 THEN 'beyond_frame' END, CASE WHEN (a - 1) // 640 > (z - 1) // 640 OR (a - 1) % 640 > (z - 1) % 640 THEN 'order' END) AS issues FROM b
""")
def pixel_rules(spark, sf_dir):
    p, k = _part(dealt(spark, sf_dir, "part", "p_partkey"))
    return p.select("p_partkey", F.array_join(targets.pixel_issues(k * 331 % 310_000 + 1, k * 577 % 310_000 + 1, F.lit(640), F.lit(480)), ",").alias("issues"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - (0.5 * l_linenumber + 0.25 * CAST(l_quantity AS DOUBLE) + 3.0), 6) AS residual, round(l_extendedprice, 6) AS restored, CASE WHEN l_linenumber % 2 = 0 THEN 'hae' ELSE 'msl' END AS datum FROM lineitem")
def range_planes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    plane = (F.col("l_linenumber"), F.col("l_quantity").cast("double"), F.lit(0.5), F.lit(0.25), F.lit(3.0))
    residual = targets.plane_residual(F.col("l_extendedprice"), *plane)
    datum = targets.target_elevation(F.when(F.col("l_linenumber") % 2 == 0, 1.0), F.lit(2.0))["datum"]
    return line.select("l_orderkey", "l_linenumber", F.round(residual, 6).alias("residual"), F.round(targets.plane_restored(residual, *plane), 6).alias("restored"), datum.alias("datum"))
