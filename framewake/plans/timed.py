"""Queries over timed streams: state, correlation, clocks, queues, life cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, carry, clocks, lifecycle, queues
from ..session import micros, table

DAY = 86_400_000_000
TAGS = ("signup", "purchase", "error", "view", "click")
#: ts_us and the columns of events, for SQL
E = "(SELECT *, epoch_us(ts) AS ts_us FROM events)"

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts_us", micros("ts"))


_PIVOT = ",\n".join(
    f"""CASE WHEN ts_us - last_value(CASE WHEN event_type = '{t}' THEN ts_us END IGNORE NULLS) OVER w <= {3 * DAY}
  THEN last_value(CASE WHEN event_type = '{t}' THEN value END IGNORE NULLS) OVER w END AS "{t}" """
    for t in TAGS
)


@query(f"SELECT event_id, user_id, ts_us, {_PIVOT} FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)")
def roc_state(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "ts_us", "event_type", "value")
    out = carry.snapshot(e, ["user_id"], ["ts_us", "event_id"], "ts_us", {t: F.col("event_type") == t for t in TAGS}, F.col("value"), 3 * DAY)
    return out.select("event_id", "user_id", "ts_us", *TAGS)


@query(f"""
WITH t AS (
  SELECT event_id, user_id, ts_us, event_type, last_value(CASE WHEN event_type IN ('purchase', 'error') THEN ts_us END IGNORE NULLS) OVER w AS sec,
    last_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER w AS kind,
    last_value(CASE WHEN event_type IN ('purchase', 'error') THEN value END IGNORE NULLS) OVER w AS v
  FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, coalesce(kind = 'purchase' AND ts_us - sec <= {DAY}, false) AS live, coalesce(kind = 'purchase' AND ts_us - sec > {DAY}, false) AS old FROM t)
SELECT event_id, CASE WHEN live THEN v END AS state_value, CASE WHEN live THEN sec END AS state_at,
  old AND NOT coalesce(lag(old) OVER w, false) AS expired, event_type = 'error' AND coalesce(lag(live) OVER w, false) AS cleared
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)
""")
def roc_clear_expire(spark, sf_dir):
    e = events(spark, sf_dir)
    out = carry.carry_forward(e, ["user_id"], ["ts_us", "event_id"], "ts_us", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("value"), DAY)
    return out.select("event_id", "state_value", "state_at", "expired", "cleared")


def _sides(spark, sf_dir, cut=1):
    e = events(spark, sf_dir).select("user_id", "event_id", (F.floor(F.col("ts_us") / cut)).cast("long").alias("ts_us"), "event_type")
    return e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


_P, _V = f"(SELECT user_id, event_id, ts_us FROM {E} WHERE event_type = 'purchase')", f"(SELECT user_id, event_id, ts_us FROM {E} WHERE event_type = 'view')"


@query(f"""SELECT p.event_id, p.ts_us, CASE WHEN p.ts_us - v.ts_us <= {DAY} THEN v.event_id END AS view_event_id
FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts_us >= v.ts_us""")
def asof_latest(spark, sf_dir):
    p, v = _sides(spark, sf_dir)
    out = asof.asof_join(p, v, ["user_id"], "ts_us", "ts_us", tolerance=DAY, right_order=["event_id"], prefix="view_")
    return out.select("event_id", "ts_us", "view_event_id")


@query(f"""
WITH b AS (SELECT p.*, v.ts_us AS bt, v.event_id AS bi FROM {_P} p ASOF LEFT JOIN {_V} v ON p.user_id = v.user_id AND p.ts_us >= v.ts_us),
f AS (SELECT b.*, v.ts_us AS ft, v.event_id AS fi FROM b ASOF LEFT JOIN {_V} v ON b.user_id = v.user_id AND b.ts_us <= v.ts_us),
c AS (SELECT *, bt IS NULL OR ft - ts_us < ts_us - bt AS ahead FROM f)
SELECT event_id, CASE WHEN coalesce(ahead, false) THEN CASE WHEN ft - ts_us <= {DAY // 2} THEN fi END ELSE CASE WHEN ts_us - bt <= {DAY // 2} THEN bi END END AS view_event_id FROM c
""")
def asof_nearest(spark, sf_dir):
    p, v = _sides(spark, sf_dir)
    out = asof.asof_join(p, v, ["user_id"], "ts_us", "ts_us", tolerance=DAY // 2, mode="nearest", right_order=["event_id"], prefix="view_")
    return out.select("event_id", "view_event_id")


@query(f"""
WITH v AS (SELECT user_id, ts_us // 3600000000 AS h, max(event_id) AS view_event_id FROM {_V} GROUP BY ALL)
SELECT p.event_id, p.ts_us // 3600000000 AS hour, v.view_event_id FROM {_P} p LEFT JOIN v ON v.user_id = p.user_id AND v.h = p.ts_us // 3600000000
""")
def asof_exact(spark, sf_dir):
    p, v = _sides(spark, sf_dir, 3_600_000_000)
    v = v.groupBy("user_id", "ts_us").agg(F.max("event_id").alias("event_id"))
    out = asof.asof_join(p, v, ["user_id"], "ts_us", "ts_us", mode="exact", prefix="view_")
    return out.select("event_id", F.col("ts_us").alias("hour"), "view_event_id")


_HOUR = 3_600_000_000


@query(f"""
WITH p AS (SELECT user_id, event_id, ts_us // {_HOUR} AS h FROM {_P}), v AS (SELECT user_id, event_id, ts_us // {_HOUR} AS h FROM {_V}),
g AS (SELECT user_id, h, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM v GROUP BY ALL)
SELECT p.event_id, CASE WHEN p.h - g.h <= 24 THEN g.h END AS hour, CASE WHEN p.h - g.h <= 24 THEN g.ids ELSE '' END AS view_ids FROM p ASOF LEFT JOIN g ON p.user_id = g.user_id AND p.h >= g.h
""")
def asof_packets(spark, sf_dir):
    p, v = _sides(spark, sf_dir, _HOUR)
    out = asof.asof_all(p, v, ["user_id"], "ts_us", "ts_us", ["event_id"], tolerance=24)
    return out.select("event_id", F.col("matched_ts_us").alias("hour"), F.array_join(F.transform("matches", lambda m: m["event_id"].cast("string")), ",").alias("view_ids"))


@query(f"""
WITH f AS (SELECT user_id, event_id, ts_us * 9 // 100 AS pts, CASE WHEN event_id % 4 = 0 THEN ts_us + 5 END AS own, ts_us * 9 // 100 + 4500 AS eff FROM {E} WHERE event_type = 'purchase'),
m AS (SELECT user_id, CASE WHEN event_id % 10 <> 0 THEN ts_us // 10000000 * 900000 END AS pts, event_id, ts_us FROM {E} WHERE event_type IN ('view', 'click')),
g AS (SELECT user_id, pts, count(*) AS n, arg_max(ts_us, event_id) AS last FROM m WHERE pts IS NOT NULL GROUP BY ALL),
j AS (SELECT f.*, CASE WHEN eff - g.pts <= 90000000 THEN g.pts END AS mpts, g.n, g.last FROM f ASOF LEFT JOIN g ON f.user_id = g.user_id AND f.eff >= g.pts)
SELECT event_id, eff AS effective_pts, CASE WHEN mpts IS NULL THEN 0 ELSE n END AS packets, coalesce(own, CASE WHEN mpts IS NOT NULL THEN last + ((eff - mpts) * 100 + 4) // 9 END) AS derived_ts FROM j
""")
def correlate_frames(spark, sf_dir):
    e = events(spark, sf_dir)
    i = F.col("event_id")
    f = e.where("event_type = 'purchase'").select("user_id", "event_id", F.expr("ts_us * 9 div 100").alias("pts"), F.when(i % 4 == 0, F.col("ts_us") + 5).alias("ts"))
    m = e.where("event_type in ('view', 'click')").select("user_id", F.when(i % 10 != 0, F.expr("ts_us div 10000000 * 900000")).alias("pts"), i.alias("seq"), F.col("ts_us").alias("ts"))
    out = asof.correlate(f, m, ["user_id"], "pts", "ts", ["seq"], offset=4500, tolerance=90_000_000)
    return out.select("event_id", "effective_pts", F.size("metadata").cast("long").alias("packets"), "derived_ts")


@query(f"""
WITH c AS (SELECT user_id, ts_us, event_id, event_type FROM {E})
SELECT p.event_id, b.ts_us AS before, f.ts_us AS after,
  CASE WHEN b.ts_us IS NULL OR f.ts_us IS NULL THEN 'unverifiable' WHEN p.ts_us - b.ts_us <= {DAY // 4} THEN 'compliant'
    WHEN f.ts_us - b.ts_us > {DAY} THEN 'excessive' ELSE 'indeterminate' END AS verdict
FROM {_P} p ASOF LEFT JOIN {_V} b ON p.user_id = b.user_id AND p.ts_us >= b.ts_us ASOF LEFT JOIN {_V} f ON p.user_id = f.user_id AND p.ts_us < f.ts_us
""")
def bracket_delay(spark, sf_dir):
    p, v = _sides(spark, sf_dir)
    out = asof.bracket(p, v, ["user_id"], "ts_us", "ts_us")
    verdict = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "unverifiable").when(F.col("ts_us") - F.col("before") <= DAY // 4, "compliant")
        .when(F.col("after") - F.col("before") > DAY, "excessive").otherwise("indeterminate")
    )
    return out.select("event_id", "before", "after", verdict.alias("verdict"))


@query(f"""
WITH t AS (SELECT event_id, user_id, ts_us * 9 // 100 AS truth FROM {E}),
f AS (SELECT *, first_value(truth) OVER (PARTITION BY user_id ORDER BY truth, event_id) AS first, lag(truth) OVER (PARTITION BY user_id ORDER BY truth, event_id) AS before FROM t),
d AS (SELECT *, (((truth - before) % 8589934592) + 4294967296) % 8589934592 - 4294967296 AS step FROM f)
SELECT event_id, truth % 8589934592 AS pts, CAST(first % 8589934592 + sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY truth, event_id) AS BIGINT) AS unwrapped,
  coalesce(step = -4294967296, false) AS ambiguous FROM d
""")
def clock_unwrap(spark, sf_dir):
    truth = F.expr("ts_us * 9 div 100")
    e = events(spark, sf_dir).select("event_id", "user_id", truth.alias("truth")).withColumn("pts", F.col("truth") % (1 << 33))
    return clocks.unwrap(e, ["user_id"], ["truth", "event_id"], "pts", 1 << 33).select("event_id", "pts", "unwrapped", "ambiguous")


@query(f"""
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS segment FROM {E}),
d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id, segment ORDER BY ts_us, event_id) AS elapsed FROM s)
SELECT event_id, CAST(segment AS BIGINT) AS segment, elapsed, CASE WHEN elapsed > {DAY // 2} THEN 'interval' ELSE 'regression' END AS code FROM d WHERE elapsed > {DAY // 2} OR elapsed < 0
""")
def cadence_gaps(spark, sf_dir):
    out = clocks.cadence(events(spark, sf_dir), ["user_id"], ["ts_us", "event_id"], "ts_us", DAY // 2, F.col("event_type") == "signup")
    return out.select("event_id", "segment", "elapsed", "code")


@query(f"""
WITH d AS (SELECT DISTINCT user_id, ts_us // {DAY} AS day FROM {E}), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, b)) AS day FROM s)
SELECT user_id, day FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = g.user_id AND d.day = g.day)
""")
def psi_missing(spark, sf_dir):
    return clocks.missing_slots(events(spark, sf_dir).select("user_id", F.expr(f"ts_us div {DAY}").alias("day")), ["user_id"], "day")


@query(f"""
WITH r AS (SELECT event_id, user_id, ts_us, 0 AS copy, event_type || value AS raw, event_type FROM {E}
  UNION ALL SELECT event_id, user_id, ts_us, 1, event_type || value || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'x' END, event_type FROM {E} WHERE event_id % 17 = 0),
n AS (SELECT *, event_id // 3 % 16 AS cc, sum(CASE WHEN event_type = 'signup' AND copy = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id, copy) AS segment FROM r),
c AS (SELECT *, lag(cc) OVER w AS before, lag(raw) OVER w AS same FROM n WHERE event_id % 9 <> 0 WINDOW w AS (PARTITION BY user_id, segment ORDER BY ts_us, event_id, copy))
SELECT event_id, copy, cc, (before + 1) % 16 AS expected, CASE WHEN before IS NULL THEN 'first' WHEN cc = before AND raw = same THEN 'duplicate' WHEN cc = (before + 1) % 16 THEN 'ok' ELSE 'error' END AS continuity FROM c
""")
def continuity(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("raw", F.concat("event_type", F.col("value").cast("string")))
    sent = e.withColumn("copy", F.lit(0)).union(e.where("event_id % 17 = 0").withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.col("raw")).otherwise(F.concat("raw", F.lit("x")))).withColumn("copy", F.lit(1)))
    sent = sent.withColumn("cc", F.expr("event_id div 3 % 16"))
    out = clocks.continuity(
        sent, ["user_id"], ["ts_us", "event_id", "copy"], "cc", "raw", counted=F.col("event_id") % 9 != 0, reset=(F.col("event_type") == "signup") & (F.col("copy") == 0)
    )
    return out.select("event_id", "copy", "cc", "expected", "continuity")


@query("""
WITH a AS (SELECT event_id AS seq, event_id + CASE WHEN event_id % 31 = 0 THEN 5 ELSE 0 END AS place, 0 AS again FROM events WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, event_id + 3, 1 FROM events WHERE event_id % 17 = 0 AND event_id % 13 <> 0),
h AS (SELECT *, seq % 8 AS lane FROM a), m AS (SELECT *, max(seq // 8) OVER (PARTITION BY lane ORDER BY place, again, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM h)
SELECT seq, again, CASE WHEN high IS NULL OR seq // 8 = high + 1 THEN 'ok' WHEN seq // 8 <= high THEN 'late' ELSE 'loss' END AS verdict,
  CAST(CASE WHEN seq // 8 > high + 1 THEN seq // 8 - high - 1 ELSE 0 END AS BIGINT) AS lost FROM m
""")
def reorder_loss(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 13 <> 0").select(F.col("event_id").alias("seq"))
    sent = e.select("seq", (F.col("seq") + F.when(F.col("seq") % 31 == 0, 5).otherwise(0)).alias("place"), F.lit(0).alias("again"))
    sent = sent.union(e.where("seq % 17 = 0").select("seq", F.col("seq") + 3, F.lit(1)))
    sent = sent.withColumn("lane", F.col("seq") % 8).withColumn("number", F.expr("seq div 8"))
    return clocks.sequence_audit(sent, ["lane"], ["place", "again", "seq"], "number").select("seq", "again", "verdict", "lost")


@query("""
WITH n AS (SELECT event_id, user_id % 5 AS ssrc, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) + 65000 AS seq FROM events),
a AS (SELECT ssrc, seq, seq + CASE WHEN seq % 31 = 0 THEN 5 ELSE 0 END AS place, 0 AS again FROM n WHERE seq % 13 <> 0
  UNION ALL SELECT ssrc, seq, seq + 3, 1 FROM n WHERE seq % 17 = 0 AND seq % 13 <> 0),
m AS (SELECT *, max(seq) OVER (PARTITION BY ssrc ORDER BY place, again, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, row_number() OVER (PARTITION BY ssrc, seq ORDER BY place, again) AS n FROM a)
SELECT ssrc, seq, again, CASE WHEN n > 1 THEN 'duplicate' WHEN high IS NULL OR seq = high + 1 THEN 'ok' WHEN seq < high THEN 'late' ELSE 'loss' END AS verdict,
  CAST(CASE WHEN n = 1 AND seq > high + 1 THEN seq - high - 1 ELSE 0 END AS BIGINT) AS lost FROM m
""")
def rtp_gaps(spark, sf_dir):
    """Five senders whose numbers begin at 65,001, so that they wrap."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("ssrc"))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("ssrc").orderBy("event_id")).cast("long") + 65_000).where("seq % 13 <> 0")
    sent = e.select("ssrc", "seq", (F.col("seq") + F.when(F.col("seq") % 31 == 0, 5).otherwise(0)).alias("place"), F.lit(0).alias("again"))
    sent = sent.union(e.where("seq % 17 = 0").select("ssrc", "seq", F.col("seq") + 3, F.lit(1))).withColumn("wrapped", F.col("seq") % 65_536)
    return clocks.rtp_audit(sent, ["ssrc"], ["place", "again", "seq"], "wrapped").select("ssrc", "seq", "again", "verdict", "lost")


@query(f"""
WITH t AS (SELECT user_id, event_id, ts_us + CASE WHEN event_id % 37 = 0 THEN -{DAY} WHEN event_id % 41 = 0 THEN {DAY} ELSE 0 END AS t, event_type = 'signup' AS declared, ts_us FROM {E}),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS step FROM t)
SELECT event_id, CASE WHEN step < 0 THEN 'regression' ELSE 'undeclared_repeat' END AS code FROM d WHERE NOT declared AND step <= 0
""")
def time_regressions(spark, sf_dir):
    i = F.col("event_id")
    e = events(spark, sf_dir).withColumn("t", F.col("ts_us") + F.when(i % 37 == 0, -DAY).when(i % 41 == 0, DAY).otherwise(0))
    return clocks.regressions(e, ["user_id"], ["ts_us", "event_id"], "t", F.col("event_type") == "signup").select("event_id", "code")


@query(f"""
WITH t AS (SELECT event_id, user_id, ts_us, CASE WHEN event_id % 23 <> 0 THEN ts_us - 3600000000 END AS low, ts_us + event_id % 5 * 3600000000 AS high, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS g FROM {E}),
d AS (SELECT *, low - lag(high) OVER w AS shortest, high - lag(low) OVER w AS longest, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY user_id, g ORDER BY ts_us, event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'first' WHEN shortest IS NULL OR longest IS NULL THEN 'unverifiable' WHEN longest < {DAY // 3} THEN 'compliant' WHEN shortest >= {DAY // 3} THEN 'excessive' ELSE 'indeterminate' END AS verdict FROM d
""")
def bracketed_cadence(spark, sf_dir):
    i = F.col("event_id")
    e = events(spark, sf_dir).withColumn("low", F.when(i % 23 != 0, F.col("ts_us") - 3_600_000_000)).withColumn("high", F.col("ts_us") + i % 5 * 3_600_000_000)
    return clocks.bounded_cadence(e, ["user_id"], ["ts_us", "event_id"], "low", "high", DAY // 3, F.col("event_type") == "error").select("event_id", "verdict")


@query("""
WITH c AS (SELECT user_id, event_id AS o, event_id * 3 % 4096 AS ticks, event_id // 500 % 2 AS pid, event_id % 97 = 0 AS jump FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT *, (ticks - lag(ticks) OVER w + 2048 + 4096) % 4096 - 2048 AS step, coalesce(lag(pid) OVER w <> pid, true) AS other FROM c WINDOW w AS (PARTITION BY user_id ORDER BY o)),
n AS (SELECT *, jump OR other OR step < 0 AS fresh, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n FROM s),
k AS (SELECT *, sum(CAST(fresh AS INT)) OVER w AS seg, sum(CASE WHEN fresh THEN 0 ELSE step END) OVER w AS t FROM n WINDOW w AS (PARTITION BY user_id ORDER BY o)),
b AS (SELECT user_id, event_id AS o, CASE event_type WHEN 'signup' THEN 'PAT' ELSE 'PMT' END AS tab FROM events WHERE event_type IN ('signup', 'purchase')),
h AS (SELECT b.user_id, b.o, tab, lo.t AS lt, hi.t AS ht, hi.n AS m, hi.seg AS seg FROM b ASOF JOIN k lo ON lo.user_id = b.user_id AND lo.o < b.o ASOF JOIN k hi ON hi.user_id = b.user_id AND hi.o > b.o WHERE lo.seg = hi.seg),
l AS (SELECT user_id, tab, m, max(o) AS told_at, arg_max(lt, o) AS lt, arg_max(ht, o) AS ht, any_value(seg) AS seg FROM h GROUP BY ALL),
q AS (SELECT k.user_id, k.n, k.o, k.t, k.seg, x.tab FROM k JOIN (SELECT DISTINCT user_id, tab FROM l) x USING (user_id)),
a AS (SELECT q.*, l.m, l.told_at, q.t - l.ht AS shortest, q.t - l.lt AS longest FROM q ASOF JOIN l ON l.user_id = q.user_id AND l.tab = q.tab AND l.m <= q.n WHERE l.seg = q.seg AND l.m < q.n AND q.t - l.ht >= 1200)
SELECT user_id, tab AS "table", told_at, min(o) AS clock_at, CAST(min(shortest) AS BIGINT) AS shortest, CAST(min(longest) AS BIGINT) AS longest FROM a GROUP BY user_id, tab, told_at, m
""")
def tables_overdue(spark, sf_dir):
    """Views and clicks read each user's clock, whose pid changes and which jumps; signups and purchases are the tables."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    read = e.where("event_type in ('view', 'click')").select("user_id", "event_id", (i * 3 % 4096).alias("ticks"), F.expr("event_id div 500 % 2").alias("pid"), (i % 97 == 0).alias("jump"))
    told = e.where("event_type in ('signup', 'purchase')").select("user_id", "event_id", F.when(F.col("event_type") == "signup", "PAT").otherwise("PMT").alias("table"))
    return clocks.overdue_tables(read, told, ["user_id"], "event_id", "ticks", "pid", "table", 1200, 4096, F.col("jump"))


_ALLOWED = [("view", "click"), ("click", "view"), ("click", "purchase"), ("view", "purchase"), ("purchase", "view"), ("purchase", "click"), ("signup", "view"), ("signup", "click")]
_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in _ALLOWED)


@query(f"""
WITH t AS (SELECT event_id, user_id, ts_us, CASE WHEN event_id % 19 <> 0 THEN CASE WHEN event_type = 'error' AND event_id % 7 <> 0 THEN 'view' ELSE event_type END END AS status FROM {E}),
p AS (SELECT *, lag(status) OVER w AS previous, row_number() OVER w AS n,
  coalesce(max(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone
  FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id))
SELECT event_id, previous, status, CAST(n AS BIGINT) AS observations, gone OR coalesce(status = 'error', false) AS retired,
  concat_ws(',', CASE WHEN status IS NULL THEN 'missing_status' END, CASE WHEN n = 1 AND status NOT IN ('signup', 'view') THEN 'invalid_initial' END,
    CASE WHEN gone THEN 'retired_reused' WHEN previous <> status AND (previous || '>' || status) NOT IN ({_PAIRS}) THEN 'invalid_transition' END) AS issues FROM p
""")
def lifecycle_issues(spark, sf_dir):
    e = events(spark, sf_dir)
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 != 0), "view").otherwise(F.col("event_type"))
    out = lifecycle.lifecycle(e.withColumn("status", F.when(F.col("event_id") % 19 != 0, kind)), ["user_id"], ["ts_us", "event_id"], "status", _ALLOWED, ["signup", "view"], ["error"])
    return out.select("event_id", "previous", "status", F.col("observations").cast("long").alias("observations"), "retired", F.array_join("issues", ",").alias("issues"))


@query(f"SELECT user_id, arg_max(event_type, ts_us) AS status, count(*) AS observations, coalesce(bool_or(event_type = 'error' AND event_id % 11 = 0), false) AS retired FROM (SELECT * REPLACE (CASE WHEN event_type = 'error' AND event_id % 11 <> 0 THEN 'view' ELSE event_type END AS event_type) FROM {E}) GROUP BY user_id")
def lifecycle_state(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("event_type", F.when((F.col("event_type") == "error") & (F.col("event_id") % 11 != 0), "view").otherwise(F.col("event_type")))
    return lifecycle.lifecycle_state(e, ["user_id"], ["ts_us", "event_id"], "event_type", ["error"])


_CMD = "(SELECT user_id, ts_us, event_id AS seq, event_id % 4 AS pos, (event_id // 40 + event_id % 3) AS id, CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'go' END AS text, CASE WHEN event_id % 17 = 0 THEN ts_us + 1 END AS issued FROM " + E + " WHERE event_type IN ('view', 'click'))"
_CMD2 = f"(SELECT * FROM {_CMD} UNION ALL SELECT user_id, ts_us, seq, pos + 4, id, text, issued FROM {_CMD} WHERE seq % 23 = 0)"
_ACK = f"(SELECT user_id, event_id AS seq, event_id // 40 + event_id % 5 AS id FROM {E} WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, event_id // 40 + event_id % 5 FROM {E} WHERE event_type = 'purchase' AND event_id % 29 = 0)"


@query(f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, seq, id ORDER BY pos) > 1 AS again, row_number() OVER i AS n, first_value(text) OVER i AS text0, first_value(coalesce(issued, ts_us)) OVER i AS at0,
    max(id) OVER (PARTITION BY user_id ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {_CMD2} WINDOW i AS (PARTITION BY user_id, id ORDER BY seq, pos)),
a AS (SELECT x.*, f.first FROM (SELECT user_id, seq, id, count(*) AS times FROM {_ACK} GROUP BY ALL) x LEFT JOIN (SELECT user_id, id, min(seq) AS first FROM c GROUP BY ALL) f USING (user_id, id)),
d AS (SELECT c.*, coalesce((SELECT min(a.seq) FROM a WHERE a.user_id = c.user_id AND a.id = c.id AND a.first <= a.seq) < c.seq, false) AS shut FROM c)
SELECT user_id, seq, id, 'duplicate_command_in_packet' AS code FROM d WHERE again
UNION ALL SELECT user_id, seq, id, 'command_after_acknowledgement' FROM d WHERE NOT again AND n > 1 AND shut
UNION ALL SELECT user_id, seq, id, 'command_changed' FROM d WHERE NOT again AND n > 1 AND NOT shut AND text <> text0
UNION ALL SELECT user_id, seq, id, 'command_time_changed' FROM d WHERE NOT again AND n > 1 AND NOT shut AND issued <> at0
UNION ALL SELECT user_id, seq, id, 'non_increasing_command_id' FROM d WHERE n = 1 AND id <= high
UNION ALL SELECT user_id, seq, id, 'duplicate_acknowledgement' FROM a WHERE times > 1
UNION ALL SELECT user_id, seq, id, 'unknown_acknowledgement' FROM a WHERE first IS NULL OR first > seq
""")
def command_issues(spark, sf_dir):
    e = events(spark, sf_dir)
    i = F.col("event_id")
    c = e.where("event_type in ('view', 'click')").select(
        "user_id", "ts_us", i.alias("seq"), (i % 4).alias("pos"), F.expr("event_id div 40 + event_id % 3").alias("id"),
        F.when(i % 13 == 0, "other").otherwise("go").alias("text"), F.when(i % 17 == 0, F.col("ts_us") + 1).alias("issued"),
    )
    c = c.union(c.where("seq % 23 = 0").withColumn("pos", F.col("pos") + 4))
    a = e.where("event_type = 'purchase'").select("user_id", i.alias("seq"), F.expr("event_id div 40 + event_id % 5").alias("id"))
    return lifecycle.command_issues(c, a.union(a.where("seq % 29 = 0")), ["user_id"], "seq", "ts_us", "id", "text", "issued")


@query(f"""
WITH b AS (SELECT user_id, ts_us AS sec, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS ack FROM {E} WHERE event_type IN ('click', 'purchase')),
t AS (SELECT *, sum(1 - ack) OVER (PARTITION BY user_id ORDER BY sec, ack) AS turn FROM b),
g AS (SELECT user_id, turn, min(CASE WHEN ack = 0 THEN sec END) AS sec, min(CASE WHEN ack = 1 THEN sec END) AS ack_at FROM t GROUP BY ALL)
SELECT user_id, CASE WHEN ack_at IS NULL THEN 'outstanding' ELSE 'acknowledged' END AS kind, sec, ack_at FROM g WHERE sec IS NOT NULL
UNION ALL SELECT user_id, 'unknown_ack', sec, sec FROM t WHERE turn = 0 AND ack = 1
""")
def command_lifecycle(spark, sf_dir):
    e = events(spark, sf_dir)
    return lifecycle.acknowledgements(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ts_us").withColumnRenamed("at", "sec")


_Q = "(SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec FROM events)"


@query(f"""
WITH i AS (SELECT *, row_number() OVER w - 1 AS i FROM {_Q} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
d AS (SELECT *, max(sec - 30000 * i) OVER (PARTITION BY user_id ORDER BY sec, event_id) + 30000 * (i + 1) AS departure FROM i)
SELECT event_id, departure, CAST(ceil((departure - sec) / 30000) AS BIGINT) AS fullness, ceil((departure - sec) / 30000) > 3 AS overflow,
  coalesce(sec >= lag(departure) OVER (PARTITION BY user_id ORDER BY sec, event_id), true) AS busy_start FROM d
""")
def leaky_bucket(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.expr("ts_us div 1000000").alias("at"))
    return queues.leaky_bucket(e, ["user_id"], ["at", "event_id"], "at", 30_000, 3).select("event_id", "departure", "fullness", "overflow", "busy_start")


_START = 1_704_067_200


@query(f"""
WITH i AS (SELECT *, row_number() OVER w - 1 AS i, CAST(ceil((sec - {_START}) / 3600) AS BIGINT) AS due FROM {_Q} WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
s AS (SELECT *, max(due - i) OVER (PARTITION BY user_id ORDER BY sec, event_id) + i AS slot FROM i)
SELECT event_id, slot, slot - coalesce(lag(slot) OVER (PARTITION BY user_id ORDER BY sec, event_id), -1) - 1 AS idle_before FROM s
""")
def rate_slots(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.expr("ts_us div 1000000").alias("at"))
    return queues.rate_slots(e, ["user_id"], ["at", "event_id"], "at", 3600, _START).select("event_id", "slot", "idle_before")


@query(f"""
WITH d AS (SELECT *, CAST(floor((sec - {_START}) / 7200) AS BIGINT) AS due FROM {_Q}),
h AS (SELECT *, coalesce(max(due) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS high FROM d)
SELECT event_id, due, due - high - 1 AS missed, sec - {_START} - due * 7200 AS late_by FROM h WHERE due > high
""")
def scheduler_slots(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", F.expr("ts_us div 1000000").alias("at"))
    return queues.scheduled(e, ["user_id"], ["at", "event_id"], "at", _START, 7200).select("event_id", "due", "missed", "late_by")


@query(f"""
WITH s AS (SELECT user_id, sec, 1 AS i, 0 AS o FROM {_Q} UNION ALL SELECT user_id, sec + 20000 + event_id % 7 * 5000, 0, 1 FROM {_Q}),
g AS (SELECT user_id, sec, sum(i) AS entered, sum(o) AS left_ FROM s GROUP BY ALL)
SELECT user_id, sec, CAST(sum(entered - left_) OVER (PARTITION BY user_id ORDER BY sec) AS BIGINT) AS level, sum(entered - left_) OVER (PARTITION BY user_id ORDER BY sec) < 0 AS underflow FROM g
""")
def buffer_occupancy(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.expr("ts_us div 1000000").alias("at"), "event_id")
    e = e.select("user_id", F.col("at").alias("enter"), (F.col("at") + 20_000 + F.col("event_id") % 7 * 5000).alias("leave"))
    return queues.occupancy(e, ["user_id"], "enter", "leave").withColumnRenamed("at", "sec").select("user_id", "sec", "level", "underflow")


