"""Queries over contours, identifiers in text, and packets put back into order."""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boundary, identifiers
from ..operators import reorder
from ..session import dealt, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: contours around a place, and how many areas they bound: square, bow tie, five-pointed star, two squares that touch, a line there and back,
#: a square with a branch that is retraced, two corners, two corners of one latitude, one that crosses itself along a side
_STAR = [(round(2 * cos(pi / 2 + k * 4 * pi / 5), 6), round(2 * sin(pi / 2 + k * 4 * pi / 5), 6)) for k in range(5)]
SHAPES = [
    ([(0, 0), (1, 0), (1, 1), (0, 1)], 1), ([(0, 0), (1, 1), (1, 0), (0, 1)], 2), (_STAR, 6), ([(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1), (0, 1)], 2), ([(0, 0), (1, 0), (3, 0)], 0),
    ([(0, 0), (1, 0), (1, 1), (2, 2), (1, 1), (0, 1)], 1), ([(0, 0), (2, 1)], 1), ([(0, 0), (2, 0)], 0), ([(0, 0), (3, 0), (3, 1), (1, 1), (1, 0), (2, 0), (2, 2), (0, 2)], 3),
]


@query(f"""
SELECT c_custkey, CAST(CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE list_extract({[n for _, n in SHAPES]}, CAST(1 + c_custkey % {len(SHAPES)} AS BIGINT)) END AS BIGINT) AS areas,
  CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % {len(SHAPES)} = 7 THEN 'corners' WHEN list_extract({[n for _, n in SHAPES]}, CAST(1 + c_custkey % {len(SHAPES)} AS BIGINT)) <> 1 THEN 'areas' END AS issue FROM customer
""")
def boundary_contours(spark, sf_dir):
    """A contour for each customer, many across the antimeridian; every fiftieth has a vertex without a longitude."""
    k = F.col("c_custkey")
    wrapped = lambda x: F.pmod(x + 180, F.lit(360.0)) - 180
    at = lambda x, y: F.struct(F.round(wrapped(178.5 + k % 3 + x * (1 + k % 4) / 2), 6).alias("lon"), F.round(F.lit(float(y)) * (1 + k % 4) / 2 - 40, 6).alias("lat"))
    shapes = F.array(*[F.array(*[at(float(x), y) for x, y in s]) for s, _ in SHAPES])
    own = F.get(shapes, (k % len(SHAPES)).cast("int"))
    broken = F.concat(F.slice(own, 1, 1), F.array(F.struct(F.lit(None).cast("double").alias("lon"), F.lit(1.0).alias("lat"))))
    return boundary.boundary_areas(dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.when(k % 50 == 7, broken).otherwise(own).alias("points")), ["c_custkey"], "points")


_DIGITS = "(SELECT p_partkey, '01' || CASE WHEN p_partkey % 2 = 0 THEN '70' ELSE '60' END || upper(md5(p_name)) || CASE WHEN p_partkey % 2 = 0 THEN upper(md5(p_brand)) ELSE '' END AS d FROM part)"
_FOLD = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(d) + 1), lambda k: CAST(list_extract({t}, CAST(k % 15 * 16 + CAST('0x' || substr(d, k, 1) AS BIGINT) + 1 AS BIGINT)) AS BIGINT))), lambda a, b: xor(a, b))"


@query(f"""
WITH c AS (SELECT p_partkey, d, upper(printf('%x', {_FOLD.format(t=identifiers.powers(identifiers.FIRST))})) || upper(printf('%x', {_FOLD.format(t=identifiers.powers(identifiers.SECOND))})) AS v FROM {_DIGITS}),
t AS (SELECT p_partkey, d, v, substr(d, 1, 4) || ':' || trim(regexp_replace(regexp_replace(substr(d, 5), '([0-9A-F]{{4}})', '\\1-', 'g'), '((?:[0-9A-F]{{4}}-){{7}}[0-9A-F]{{4}})-', '\\1/', 'g'), '/') || ':' || v AS text FROM c)
SELECT p_partkey, text, CASE p_partkey % 7 WHEN 0 THEN 'check' WHEN 1 THEN 'format' WHEN 2 THEN 'xml' END AS issue, CASE WHEN p_partkey % 7 > 2 THEN d END AS back FROM t
""")
def identifier_texts(spark, sf_dir):
    """Identifiers to text and, by XML or plainly, back; some with another digit, without a dash, or in another element."""
    k = F.col("p_partkey")
    raw = F.unhex(F.concat(F.lit("01"), F.when(k % 2 == 0, "70").otherwise("60"), F.md5("p_name"), F.when(k % 2 == 0, F.md5("p_brand")).otherwise("")))
    t = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", identifiers.core_text(raw).alias("text"), identifiers.core_xml(raw).alias("xml"))
    last = F.substring("text", -1, 1)
    broken = F.concat(F.col("text").substr(F.lit(1), F.length("text") - 1), F.when(last == "0", "1").otherwise("0"))
    plain = identifiers.parse_core_text(F.when(k % 7 == 0, broken).when(k % 7 == 1, F.regexp_replace("text", "^(.{9})-", "$1")).otherwise(F.lower("text")))
    document = identifiers.parse_core_xml(F.when(k % 7 == 2, F.regexp_replace("xml", "MiisCoreId", "Other")).otherwise(F.col("xml")))
    t = t.select("p_partkey", "text", F.when((k % 7 == 2) | (k % 7 > 4), document).otherwise(plain).alias("p"))
    return t.select("p_partkey", "text", "p.issue", F.hex("p.raw").alias("back"))


@query()
def rtp_reorder(spark, sf_dir):
    """Five senders whose numbers wrap, with drops, repeats and packets that come up to forty places late."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("ssrc"))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("ssrc").orderBy("event_id")).cast("long") + 65_000).where("seq % 13 <> 0")
    late = F.when(F.col("seq") % 31 == 0, 5).when(F.col("seq") % 211 == 0, 40).otherwise(0)
    sent = e.select("ssrc", "seq", (F.col("seq") + late).alias("at"), F.lit(0).alias("again"))
    sent = sent.union(e.where("seq % 17 = 0").select("ssrc", "seq", F.col("seq") + 3, F.lit(1))).withColumn("ref", F.col("seq") * 2 + F.col("again")).withColumn("wrapped", F.col("seq") % 65_536)
    return reorder.reordered(sent, ["ssrc"], ["at", "again", "seq"], "wrapped", "ref")
