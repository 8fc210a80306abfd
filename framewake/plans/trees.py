"""Queries over segment and amend sets that the events fill, three levels deep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..functions.codecs import ber_length
from ..session import let, settle
from ..sources import branches, klv
from .streams import _octets
from .timed import DAY, E, events

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _item(tag: int, value):
    return let(value, lambda v: F.concat(F.lit(bytes([tag]) if tag < 128 else bytes([128 + tag // 128, tag % 128])), let(F.octet_length(v).cast("long"), ber_length), v))


def tree_packets(spark, sf_dir):
    """A local set for each event. The root has tag 10, every third time tag 5. Segment 1 or 2 in it, but for errors, has tag 5 (empty
    every fourth time) and in views also an amend 21 or 22 with tags 5 (empty every second time) and 6. Clicks have an amend
    3 with tag 10 (empty every fifth time), in which amend 31 holds amend 32 with tag 6."""
    i = F.col("event_id")
    name = lambda n: _item(143, _octets(F.lit(n) if isinstance(n, int) else n, 1))
    maybe = lambda tag, empty, value: F.when(empty, _item(tag, F.lit(b""))).otherwise(_item(tag, _octets(value % 256, 1)))
    inner = F.concat(name(21 + i % 2), maybe(5, i % 2 == 0, i), _item(6, _octets(i % 100, 1)))
    segment = F.concat(name(1 + i % 2), maybe(5, i % 4 == 0, i + 1), F.when(F.col("event_type") == "view", _item(101, inner)).otherwise(F.lit(b"")))
    deep = F.concat(name(32), _item(6, _octets(i % 50, 1)))
    amend = F.concat(name(3), maybe(10, i % 5 == 0, i + 2), _item(101, F.concat(name(31), _item(101, deep))))
    root = F.concat(
        _item(10, _octets(i % 256, 1)), F.when(i % 3 == 0, _item(5, _octets(i * 7 % 256, 1))).otherwise(F.lit(b"")),
        F.when(F.col("event_type") != "error", _item(100, segment)).otherwise(F.lit(b"")), F.when(F.col("event_type") == "click", _item(101, amend)).otherwise(F.lit(b"")),
    )
    return events(spark, sf_dir).select("user_id", "event_id", "ts_us", root.alias("raw"))


def tree_rows(spark, sf_dir):
    """The packets, and rows of all their sets."""
    packets = settle(tree_packets(spark, sf_dir), "packets")
    keys = ["user_id", "event_id", "ts_us"]
    items = settle(klv.local_set_items(packets, "raw", tuple(keys)), "items")
    nested = branches.branch_items(items, keys).where("issue is null").select(*keys, "path", "kind", "tag", "raw", "ordinal", "place")
    root = items.where("tag not in (100, 101)").select(*keys, F.array().cast("array<string>").alias("path"), F.lit("root").alias("kind"), "tag", "raw", "ordinal", F.lit(0).alias("place"))
    return packets.select(*keys), settle(nested.union(root), "rows")


#: what each packet says of each path and tag: p (path), tag, v (its value, null if empty), amend
_WORDS = f"""
WITH RECURSIVE w AS (
  SELECT user_id, event_id, ts_us, event_type, event_id % 256 AS v, '' AS p, 10 AS tag, false AS amend FROM {E}
  UNION ALL SELECT user_id, event_id, ts_us, event_type, event_id * 7 % 256, '', 5, false FROM {E} WHERE event_id % 3 = 0
  UNION ALL SELECT user_id, event_id, ts_us, event_type, CASE WHEN event_id % 4 <> 0 THEN (event_id + 1) % 256 END, CAST(1 + event_id % 2 AS VARCHAR), 5, false FROM {E} WHERE event_type <> 'error'
  UNION ALL SELECT user_id, event_id, ts_us, event_type, CASE WHEN event_id % 2 <> 0 THEN event_id % 256 END, (1 + event_id % 2) || '/' || (21 + event_id % 2), 5, true FROM {E} WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, ts_us, event_type, event_id % 100, (1 + event_id % 2) || '/' || (21 + event_id % 2), 6, true FROM {E} WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, ts_us, event_type, CASE WHEN event_id % 5 <> 0 THEN (event_id + 2) % 256 END, '3', 10, true FROM {E} WHERE event_type = 'click'
  UNION ALL SELECT user_id, event_id, ts_us, event_type, event_id % 50, '3/31/32', 6, true FROM {E} WHERE event_type = 'click'
), ids AS (
  SELECT user_id, event_id, ts_us, p FROM w WHERE p <> '' UNION SELECT user_id, event_id, ts_us, '3/31' FROM {E} WHERE event_type = 'click'
)
"""


@query(_WORDS + "SELECT user_id, event_id, p AS path, CAST(tag AS BIGINT) AS tag, v AS value, amend FROM w WHERE p <> ''")
def branch_sets(spark, sf_dir):
    _, rows = tree_rows(spark, sf_dir)
    own = rows.where("kind <> 'root' and tag <> 143")
    value = F.when(F.octet_length("raw") > 0, F.conv(F.hex("raw"), 16, 10).cast("long"))
    return own.select("user_id", "event_id", F.array_join("path", "/").alias("path"), "tag", value.alias("value"), (F.col("kind") == "amend").alias("amend"))


@query(_WORDS + f""", paths AS (SELECT DISTINCT user_id, p FROM ids),
q AS (
  SELECT e.user_id, e.event_id, e.ts_us, p.p FROM {E} e JOIN paths p USING (user_id) ASOF JOIN ids i ON i.user_id = e.user_id AND i.p = p.p AND i.event_id <= e.event_id WHERE e.ts_us - i.ts_us <= {3 * DAY}
  UNION ALL SELECT user_id, event_id, ts_us, '' FROM {E}
), a AS (
  SELECT q.*, d.d, CASE WHEN d.d = 0 THEN '' ELSE array_to_string(string_split(q.p, '/')[1:d.d], '/') END AS above FROM q, (VALUES (0), (1), (2), (3)) d(d) WHERE d.d <= CASE WHEN q.p = '' THEN 0 ELSE len(string_split(q.p, '/')) END
), t AS (SELECT DISTINCT user_id, p AS above, tag FROM w),
f AS (
  SELECT a.user_id, a.event_id, a.p, a.d, t.tag, w.v, w.amend FROM a JOIN t USING (user_id, above) ASOF JOIN w ON w.user_id = a.user_id AND w.p = a.above AND w.tag = t.tag AND w.event_id <= a.event_id
  WHERE a.ts_us - w.ts_us <= {3 * DAY} AND (w.v IS NOT NULL OR w.amend)
)
SELECT user_id, event_id, p AS path, CAST(tag AS BIGINT) AS tag, CAST(arg_max(d, d) AS INTEGER) AS depth, arg_max(coalesce(v, -1), d) AS value FROM f GROUP BY ALL HAVING arg_max(coalesce(v, -1), d) >= 0
""")
def metadata_tree(spark, sf_dir):
    """Effective fields at every packet and branch: carried forward for three days, laid over one another along the path."""
    packets, rows = tree_rows(spark, sf_dir)
    found = tree.effective_tree(packets, rows, ["user_id"], "event_id", "ts_us", ["ordinal", "place"], 3 * DAY)
    value = F.conv(F.hex(F.element_at("values", 1)), 16, 10).cast("long")
    return found.where("tag <> 143").select("user_id", "event_id", F.array_join("path", "/").alias("path"), "tag", "depth", value.alias("value"))
