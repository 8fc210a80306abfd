"""Queries of inventories, findings, coverage, keyed tables, hierarchy and packet flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import carry, relations, reports
from ..session import table
from .timed import DAY, E, events

QUERIES, ORACLE_SQL = {}, {}
START, NOW = 1_704_067_200_000_000, 1_706_659_200_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH b AS (SELECT least(63, CAST(floor((ts_us - {START}) / {float(30 * DAY)} * 64) AS BIGINT)) AS bin, CASE WHEN event_id % 11 <> 0 THEN event_type END AS label FROM {E}),
c AS (SELECT bin, label, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT *, CASE WHEN label IS NOT NULL THEN row_number() OVER (PARTITION BY bin ORDER BY label IS NULL, n DESC, label) END AS rank FROM c)
SELECT bin, CAST(sum(n) AS BIGINT) AS total, coalesce(string_agg(label || '=' || n, ',' ORDER BY rank) FILTER (WHERE rank <= 2), '') AS labels,
  CAST(sum(CASE WHEN rank <= 2 THEN 0 ELSE n END) AS BIGINT) AS other_count FROM r GROUP BY bin
""")
def density_timeline(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("label", F.when(F.col("event_id") % 11 != 0, F.col("event_type")))
    return reports.density_timeline(e, "ts_us", "label", 64, 2, START, 30 * DAY)


@query(f"""SELECT event_type AS tag, count(DISTINCT user_id * 100000 + ts_us // {DAY}) AS packets, count(*) AS occurrences,
  count(*) FILTER (WHERE event_id % 7 = 0) AS zero_length, count(*) FILTER (WHERE value < 5) AS issues FROM {E} GROUP BY 1""")
def tag_inventory(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("packet", F.col("user_id") * 100_000 + F.expr(f"ts_us div {DAY}"))
    return reports.tag_inventory(e, "packet", "event_type", F.col("event_id") % 7 == 0, F.col("value") < 5)


@query(f"""
WITH d AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM {E})
SELECT user_id, count(*) AS packets, arg_min(ts_us, event_id) AS first_ts, arg_max(ts_us, event_id) AS last_ts, min(ts_us) AS min_ts, max(ts_us) AS max_ts,
  count(*) FILTER (WHERE d < 0) AS regressions, count(*) FILTER (WHERE d = 0) AS duplicates, coalesce(max(d) FILTER (WHERE d > 0), 0) AS max_gap FROM d GROUP BY user_id
""")
def stream_stats(spark, sf_dir):
    return reports.stream_stats(events(spark, sf_dir), ["user_id"], ["event_id"], "ts_us")


_FINDINGS = """(
  SELECT l_orderkey, l_suppkey % 5 AS program, 'discount' AS code, 'warning' AS status FROM lineitem WHERE l_discount > 0.08
  UNION ALL SELECT l_orderkey, l_suppkey % 5, 'late', 'error' FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey, l_suppkey % 5, 'flag', 'pass' FROM lineitem WHERE l_returnflag = 'R')"""


def _findings(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("program"), "l_discount", "l_quantity", "l_returnflag")
    rules = F.array(
        F.when(F.col("l_discount") > 0.08, F.struct(F.lit("discount").alias("code"), F.lit("warning").alias("status"))),
        F.when(F.col("l_quantity") > 45, F.struct(F.lit("late").alias("code"), F.lit("error").alias("status"))),
        F.when(F.col("l_returnflag") == "R", F.struct(F.lit("flag").alias("code"), F.lit("pass").alias("status"))),
    )
    return line.select("l_orderkey", "program", F.explode(F.array_compact(rules)).alias("r")).select("l_orderkey", "program", "r.*")


@query(f"SELECT status, code, program, count(*) AS count, min(l_orderkey) AS first_offset, max(l_orderkey) AS last_offset FROM {_FINDINGS} GROUP BY status, code, program")
def findings_coalesce(spark, sf_dir):
    return reports.coalesce_findings(_findings(spark, sf_dir), ["status", "code", "program"], "l_orderkey")


@query(f"""SELECT status, code, program, count(*) AS count, min(l_orderkey) AS first_offset, max(l_orderkey) AS last_offset FROM {_FINDINGS} GROUP BY status, code, program
ORDER BY CASE WHEN status = 'error' THEN 0 ELSE 1 END, first_offset, status, code, program LIMIT 8""")
def findings_capped(spark, sf_dir):
    return reports.coalesce_findings(_findings(spark, sf_dir), ["status", "code", "program"], "l_orderkey", 8, F.col("status") == "error")


@query(f"""SELECT program, code, CAST(CASE WHEN grouping(program) = 1 THEN 0 WHEN grouping(code) = 1 THEN 1 ELSE 2 END AS BIGINT) AS level, count(*) AS findings,
  count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'error') = 0 AS ok FROM {_FINDINGS} GROUP BY ROLLUP (program, code)""")
def report_rollup(spark, sf_dir):
    return reports.rollup_report(_findings(spark, sf_dir), ["program", "code"], F.col("status") == "error")


@query(f"""
WITH r AS (SELECT unnest(['signup', 'purchase', 'error', 'refund']) AS event_type), s AS (SELECT DISTINCT user_id FROM events),
l AS (SELECT user_id, event_type, max(ts_us) AS last_seen FROM {E} WHERE event_id % 5 <> 0 GROUP BY ALL)
SELECT s.user_id, r.event_type, last_seen, {NOW} - last_seen AS age, CASE WHEN last_seen IS NULL THEN 'MISSING' WHEN {NOW} - last_seen > {3 * DAY} THEN 'OVERDUE' ELSE 'CURRENT' END AS status
FROM s CROSS JOIN r LEFT JOIN l ON l.user_id = s.user_id AND l.event_type = r.event_type
""")
def coverage_status(spark, sf_dir):
    e = events(spark, sf_dir)
    required = spark.createDataFrame([("signup",), ("purchase",), ("error",), ("refund",)], "event_type string")
    return reports.coverage(e, required, e.where("event_id % 5 <> 0"), ["user_id"], "event_type", "ts_us", NOW, 3 * DAY)


@query("""
SELECT event_type AS stage, count(*) AS started, count(*) FILTER (WHERE user_id % 10 <> 3) AS succeeded, count(*) FILTER (WHERE user_id % 10 = 3) AS failed,
  CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total_duration, max(CAST(floor(value * 100) AS BIGINT)) AS max_duration,
  arg_max(CAST(floor(value * 100) AS BIGINT), event_id) FILTER (WHERE user_id % 10 = 3) AS last_failed_duration FROM events GROUP BY 1
""")
def inference_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.floor(F.col("value") * 100).cast("long"))
    return reports.stage_metrics(e, "event_type", "d", F.when(F.col("user_id") % 10 == 3, "failed").otherwise("ok"), ["event_id"])


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1.0 END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1.0 END) AS chosen,
  CASE WHEN o_orderkey % 3 = 0 THEN '104' WHEN o_orderkey % 2 = 0 THEN '75' WHEN o_orderkey % 5 <> 0 THEN '15' END AS chosen_tag FROM orders
""")
def preferred_field(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("t104"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("double")).alias("t75"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("double")).alias("t15"),
    )
    return relations.preferred(o, {"t104": "104", "t75": "75", "t15": "15"}, "chosen", "chosen_tag").select("o_orderkey", "chosen", "chosen_tag")


@query("""
SELECT l_orderkey, l_linenumber, 'part' AS issue FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 10 <> 0)
UNION ALL SELECT l_orderkey, l_linenumber, 'supplier' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_suppkey % 7 <> 0)
""")
def ref_integrity(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = relations.dangling(line, table(spark, sf_dir, "part").where("p_partkey % 10 <> 0"), "l_partkey", "p_partkey", "part")
    supplier = relations.dangling(line, table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0"), "l_suppkey", "s_suppkey", "supplier")
    return part.union(supplier).select("l_orderkey", "l_linenumber", "issue")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def upsert_table(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return carry.latest_records(c, ["conv_id", "role"], ["turn"])


@query(f"""
WITH c AS (SELECT event_id, user_id, ts_us, length(event_type) AS n, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS b FROM {E})
SELECT event_id, n, CAST(sum(CASE WHEN n <> b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS BIGINT) AS generation FROM c
""")
def generation_restart(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("n", F.length("event_type").cast("long"))
    return carry.generations(e, ["user_id"], ["ts_us", "event_id"], "n").select("event_id", "n", "generation")


_WAY = "(SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 32767 ELSE o_orderkey % 9 - 4 END AS ord FROM orders)"


@query(f"SELECT o_custkey, o_orderkey, ord, CASE WHEN ord = 32767 THEN 'cancelled' WHEN ord = 0 THEN 'current' WHEN ord > 0 THEN 'planned' ELSE 'historical' END AS view FROM {_WAY}")
def waypoint_views(spark, sf_dir):
    return relations.order_views(_way(spark, sf_dir), "ord")


@query(f"SELECT o_custkey, ord, count(*) AS claims FROM {_WAY} GROUP BY ALL HAVING count(*) > 1")
def waypoint_conflicts(spark, sf_dir):
    return relations.conflicts(_way(spark, sf_dir), ["o_custkey"], "ord")


def _way(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(key % 13 == 0, 32767).otherwise(key % 9 - 4).cast("long").alias("ord"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, n_name) END AS name,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS region
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def tree_overlay(spark, sf_dir):
    nothing = F.lit(None).cast("array<string>")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"), F.lit(None).cast("string").alias("name"))
    nation = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("region"), nothing.alias("deleted"))
    nation = relations.overlay(region, nation, ["n_regionkey"], ["region", "name"], "deleted")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("region"),
        F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("name"))).alias("deleted"),
    )
    return relations.overlay(nation, customer, ["c_nationkey"], ["region", "name"], "deleted").select("c_custkey", "name", "region")


@query("""
WITH k AS (SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'),
a AS (SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN value * 2 ELSE value END AS value, 1 AS place FROM k
  UNION ALL SELECT event_id, 'marker', -1.0, 0 FROM k WHERE event_type = 'signup')
SELECT event_id AS order_, event_type AS kind, value, row_number() OVER (PARTITION BY event_id ORDER BY place) - 1 AS pos FROM a
""")
def processor_flatmap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("value").cast("double").alias("value")).alias("packet"))
    p = F.col("packet")
    none = F.array().cast("array<struct<kind:string,value:double>>")
    stages = [
        F.when(p["kind"] != "error", F.array(p)).otherwise(none),
        F.array(F.when(p["kind"] == "view", F.struct(p["kind"].alias("kind"), (p["value"] * 2).alias("value"))).otherwise(p)),
        F.when(p["kind"] == "signup", F.array(F.struct(F.lit("marker").alias("kind"), F.lit(-1.0).alias("value")), p)).otherwise(F.array(p)),
    ]
    out = relations.processor_chain(e, "event_id", stages)
    return out.select(F.col("order").alias("order_"), "packet.*", F.element_at("pos", -1).cast("long").alias("pos"))


@query(f"""SELECT user_id, event_type, count(*) AS claims FROM {E} GROUP BY ALL HAVING count(*) > 1""")
def duplicate_claims(spark, sf_dir):
    return relations.conflicts(events(spark, sf_dir), ["user_id"], "event_type")


@query(f"""
WITH r AS (SELECT user_id, event_id, ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM {E})
SELECT user_id, event_id, c - 12 AS dropped FROM r WHERE n <= 12 AND c > 12 UNION ALL SELECT user_id, event_id, 0 FROM r WHERE c <= 12
""")
def bounded_history(spark, sf_dir):
    """The twelve newest of each stream, and how many older ones a client has lost."""
    e = events(spark, sf_dir).select("user_id", "event_id", "ts_us")
    counts = e.groupBy("user_id").agg(F.count("*").alias("c"))
    newest = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts_us"), F.desc("event_id")))).where("n <= 12")
    return newest.join(counts, "user_id").select("user_id", "event_id", F.greatest(F.col("c") - 12, F.lit(0)).alias("dropped"))


