"""Queries over reporting requirements that the events meet, miss, empty and break."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requirements
from .timed import DAY, E, events

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


GROUPS = {k: v for k, v in (requirements.MINIMUM_SET | requirements.SECURITY_SET).items() if k in (
    "precision_timestamp", "mission_id", "platform_heading", "platform_pitch", "sensor_altitude", "target_width", "security_classification", "security_caveats")}
#: items of the events: tag, empty, malformed
_ITEMS = f"""(
  SELECT user_id, event_id, ts_us, '2' AS tag, false AS none, false AS bad FROM {E}
  UNION ALL SELECT user_id, event_id, ts_us, CASE WHEN event_id % 2 = 0 THEN '5' ELSE '6' END, event_id % 4 = 0, event_id % 9 = 0 FROM {E} WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, ts_us, '90', event_id % 5 = 0, false FROM {E} WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, ts_us, CASE event_id % 3 WHEN 0 THEN '75' WHEN 1 THEN '104' ELSE '15' END, event_id % 7 = 0, false FROM {E} WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, event_id, ts_us, '96', false, event_id % 6 = 0 FROM {E} WHERE event_type = 'signup'
  UNION ALL SELECT user_id, event_id, ts_us, CASE WHEN event_id % 8 < 2 THEN '48' ELSE '48/1' END, event_id % 8 < 2, false FROM {E} WHERE event_type = 'error'
)"""
_VALUES = ", ".join(f"('{g}', '{t}')" for g, tags in GROUPS.items() for t in tags)


@query(f"""
WITH i AS {_ITEMS}, g AS (SELECT * FROM (VALUES {_VALUES}) g(g, tag)), names AS (SELECT DISTINCT g FROM g),
f AS (SELECT user_id, event_id, g.g, bool_or(NOT none AND NOT bad) AS full_, bool_or(none) AS none, bool_or(bad) AS bad FROM i JOIN g USING (tag) GROUP BY ALL),
p AS (SELECT e.user_id, e.event_id, e.ts_us, n.g, coalesce(full_, false) AS full_, coalesce(none, false) AS none, coalesce(bad, false) AS bad FROM {E} e CROSS JOIN names n LEFT JOIN f ON f.user_id = e.user_id AND f.event_id = e.event_id AND f.g = n.g),
w AS (SELECT *, coalesce(max(CASE WHEN full_ THEN ts_us END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first(ts_us) OVER o) AS since, lag(ts_us) OVER o AS prior FROM p WINDOW o AS (PARTITION BY user_id, g ORDER BY event_id)),
x AS (
  SELECT e.user_id, e.event_id, e.ts_us, a.none AS a_none, a.ts_us AS a_at, b.none AS b_none, b.ts_us AS b_at FROM {E} e
  ASOF JOIN (SELECT * FROM i WHERE tag = '75') a ON a.user_id = e.user_id AND a.event_id <= e.event_id ASOF JOIN (SELECT * FROM i WHERE tag = '104') b ON b.user_id = e.user_id AND b.event_id <= e.event_id
), l AS (SELECT user_id, g, max(CASE WHEN full_ THEN ts_us END) AS met, max(ts_us) AS last_ FROM p GROUP BY ALL)
SELECT user_id, event_id, 'invalid_field' AS code, g AS requirement, true AS starts FROM w WHERE bad
UNION ALL SELECT user_id, event_id, 'zero_length', g, true FROM w WHERE none AND NOT full_
UNION ALL SELECT user_id, event_id, 'zero_length', 'security', true FROM i WHERE tag = '48' AND none
UNION ALL SELECT user_id, event_id, 'overdue', g, NOT coalesce(prior - since > {2 * DAY}, false) FROM w WHERE ts_us - since > {2 * DAY}
UNION ALL SELECT user_id, event_id, 'exclusive_or', 'sensor_altitude', true FROM x WHERE NOT a_none AND NOT b_none AND ts_us - a_at <= {2 * DAY} AND ts_us - b_at <= {2 * DAY}
UNION ALL SELECT user_id, NULL, CASE WHEN met IS NULL THEN 'missing' ELSE 'overdue' END, g, true FROM l WHERE met IS NULL OR last_ - met > {2 * DAY}
""")
def minimum_set(spark, sf_dir):
    """The minimum metadata set, eight of its groups, at every packet of every user."""
    e = events(spark, sf_dir)
    i = F.col("event_id")
    item = lambda tag, none, bad: F.struct(tag.alias("tag"), F.when(none, F.lit(b"")).otherwise(F.lit(b"x")).alias("raw"), bad.alias("bad"))
    no = F.lit(False)
    own = (
        F.when(F.col("event_type") == "view", item(F.when(i % 2 == 0, "5").otherwise("6"), i % 4 == 0, i % 9 == 0)).when(F.col("event_type") == "click", item(F.lit("90"), i % 5 == 0, no))
        .when(F.col("event_type") == "purchase", item(F.when(i % 3 == 0, "75").when(i % 3 == 1, "104").otherwise("15"), i % 7 == 0, no))
        .when(F.col("event_type") == "signup", item(F.lit("96"), no, i % 6 == 0)).otherwise(item(F.when(i % 8 < 2, "48").otherwise("48/1"), i % 8 < 2, no))
    )
    items = e.select("user_id", "event_id", F.explode(F.array(item(F.lit("2"), no, no), own)).alias("x")).select("user_id", "event_id", "x.*")
    return requirements.requirement_issues(e, items, ["user_id"], "event_id", "ts_us", GROUPS, 2 * DAY)
