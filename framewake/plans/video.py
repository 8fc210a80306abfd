"""Queries over video streams of three codecs whose sequence sets the parts fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import dealt, let, settle
from ..sources import video

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _u(v, n: int):
    return F.lpad(F.bin((F.lit(v) if isinstance(v, int) else v).cast("long")), n, "0")


def _ue(v):
    return let(F.bin((F.lit(v) if isinstance(v, int) else v).cast("long") + 1), lambda b: F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b))


def _octets(bits, protect: bool):
    """Bits and a stop bit, filled up to whole octets, as hexadecimal text; kept from looking like a start code."""
    stopped = F.concat(bits, F.lit("1"))
    full = let(stopped, lambda s: F.rpad(s, (F.ceil(F.length(s) / 8) * 8).cast("int"), "0"))
    text = let(full, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), (F.length(s) / 8).cast("int") - 1), lambda k: F.lpad(F.conv(F.substring(s, k * 8 + 1, F.lit(8)), 2, 16), 2, "0")), " "))
    return F.translate(F.regexp_replace(text, "00 00 (?=0[0-3])", "00 00 03 ") if protect else text, " ", "")


_AVC_LEVELS, _HEVC_LEVELS = (9, 10, 11, 13, 21, 30, 31, 40, 51), (30, 60, 63, 90, 93, 120, 150, 99)


def video_chunks(spark, sf_dir):
    """A stream for each part, of MPEG-2, AVC or HEVC by its number: two sequence sets among other units, cut to seven octets."""
    k = F.col("p_partkey")
    columns, rows = 20 + k % 60, 15 + k % 41
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    one, none = F.lit("1"), F.lit("0")
    bits = 1 + k * 61 % 200000
    header = F.concat(_u(columns * 16 % 4096, 12), _u(rows * 16 % 4096, 12), _u(1 + k % 4, 4), _u(1 + k % 8, 4), _u(bits % (1 << 18), 18), one, _u(k % 113, 10), F.when(k % 7 == 0, one).otherwise(none), F.lit("00"))
    extension = F.concat(
        _u(1, 4), none, _u(F.when(k % 5 == 0, 5).otherwise(4), 3), _u(F.when(k % 2 == 0, 8).otherwise(4), 4), F.when(k % 11 == 0, none).otherwise(one), _u(1 + k % 2, 2),
        _u(0, 4), _u(0, 12), one, _u(0, 8), none, _u(F.when(k % 13 == 0, 1).otherwise(0), 2), _u(0, 5),
    )
    high = k % 2 == 0
    frames = k % 5 != 0
    avc = F.concat(
        _u(F.when(high, 100).otherwise(77), 8), _u(F.when(k % 9 == 0, 0x10).otherwise(0), 8), _u(pick(_AVC_LEVELS), 8), _ue(k % 3), F.when(high, F.concat(_ue(1), _ue(0), _ue(0), F.lit("00"))).otherwise(F.lit("")),
        _ue(0), _ue(2), _ue(1), none, _ue(columns - 1), _ue(rows - 1), F.when(frames, one).otherwise(F.lit("00")), one,
        F.when(k % 4 == 0, F.concat(one, _ue(0), _ue(3), _ue(0), _ue(2))).otherwise(none), one, F.when(k % 3 == 1, F.concat(one, _u(1 + k % 16, 8))).otherwise(none), F.lit("000"),
        F.when(k % 6 != 1, F.concat(one, _u(1001, 32), _u(60000, 32), one)).otherwise(none), F.lit("00000"),
    )
    hevc = F.concat(
        F.lit("00000001"), _u(0, 3), _u(F.when(k % 7 == 0, 1).otherwise(2), 5), _u(0, 32), F.lit("10"), _u(0, 46), _u(pick(_HEVC_LEVELS), 8), _ue(0), _ue(1), _ue(columns * 16), _ue(rows * 16),
        F.when(k % 4 == 0, F.concat(one, _ue(0), _ue(5), _ue(1), _ue(0))).otherwise(none), _ue(2), _ue(2), _ue(4), one, *[_ue(1)] * 9, none, F.lit("000"), _ue(1), _ue(1), _ue(0), _ue(0), one,
        none, F.lit("00"), one, F.lit("0000000"), none, one, _u(1 + k % 3, 32), _u(50, 32), none, F.lit("000"),
    )
    code, other = F.lit("000001"), F.lit("0000000109AABBCC00000300")
    two = lambda unit: F.concat(other, unit, other, unit)
    mpeg2 = two(F.concat(code, F.lit("B3"), _octets(header, False), code, F.lit("B5"), _octets(extension, False)))
    text = F.when(k % 3 == 0, mpeg2).when(k % 3 == 1, two(F.concat(code, F.lit("67"), _octets(avc, True)))).otherwise(two(F.concat(code, F.lit("4201"), _octets(hevc, True))))
    p = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", pick_type(k).alias("stream_type"), F.unhex(text).alias("raw"))
    p = settle(p, "streams")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / 7).cast("int") - 1), lambda n: F.col("raw").substr(n * 7 + 1, F.lit(7)))
    return p.select("p_partkey", "stream_type", F.posexplode(cut).alias("n", "payload"))


def pick_type(k):
    return F.when(k % 3 == 0, video.MPEG2).when(k % 3 == 1, video.AVC).otherwise(video.HEVC)


_SETS = f"""
WITH b AS (SELECT p_partkey AS k, 20 + p_partkey % 60 AS c, 15 + p_partkey % 41 AS r, p_partkey % 3 AS t FROM part),
v AS (
  SELECT k, 2 AS stream_type, CASE WHEN k % 5 = 0 THEN 'Simple' ELSE 'Main' END AS profile, CASE WHEN k % 2 = 0 THEN 'Main' ELSE 'High' END AS level, CASE WHEN k % 2 = 0 THEN 8 ELSE 4 END AS code,
    16 * c AS width, 16 * r AS height, 16 * c AS cw, 16 * r AS ch, list_extract([24000, 24, 25, 30000, 30, 50, 60000, 60], 1 + k % 8) * CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END AS num,
    list_extract([1001, 1, 1, 1001, 1, 1, 1001, 1], 1 + k % 8) AS den, k % 11 <> 0 AS progressive, 1 + k % 2 AS chroma, (1 + k * 61 % 200000) * 400 AS bits, k % 113 * 16384 AS buf
  FROM b WHERE t = 0
  UNION ALL SELECT k, 27, CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Main' END, CASE WHEN lv = 9 AND k % 2 = 0 OR lv = 11 AND k % 2 = 1 AND k % 9 = 0 THEN '1b' ELSE lv // 10 || '.' || lv % 10 END, lv,
    16 * c - CASE WHEN k % 4 = 0 THEN 6 ELSE 0 END, 16 * r * f - CASE WHEN k % 4 = 0 THEN 4 * f ELSE 0 END, 16 * c, 16 * r * f, CASE WHEN k % 6 <> 1 THEN 30000 END, CASE WHEN k % 6 <> 1 THEN 1001 END, f = 1, 1, NULL, NULL
  FROM (SELECT *, list_extract({list(_AVC_LEVELS)}, CAST(1 + k % {len(_AVC_LEVELS)} AS BIGINT)) AS lv, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS f FROM b) WHERE t = 1
  UNION ALL SELECT k, 36, CASE WHEN k % 7 = 0 THEN 'Main' ELSE 'Main 10' END, CASE lv % 30 WHEN 0 THEN CAST(lv // 30 AS VARCHAR) WHEN 3 THEN lv // 30 || '.1' WHEN 6 THEN lv // 30 || '.2' ELSE 'Level IDC ' || lv END, lv,
    16 * c - CASE WHEN k % 4 = 0 THEN 10 ELSE 0 END, 16 * r - CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END, 16 * c, 16 * r, 50, 1 + k % 3, true, 1, NULL, NULL
  FROM (SELECT *, list_extract({list(_HEVC_LEVELS)}, CAST(1 + k % {len(_HEVC_LEVELS)} AS BIGINT)) AS lv FROM b) WHERE t = 2
)
"""
_LIMITS = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x == "-" else x for x in (line.split() + ["-"] * 5)[:9]) + ")" for line in video.LEVELS.split("\n") if line) + ") l(lt, lc, ls, lr, lw, lh, lf, lb, lv)"


@query(_SETS + """
SELECT k AS p_partkey, stream_type, profile, level, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, CAST(cw AS INTEGER) AS coded_width, CAST(ch AS INTEGER) AS coded_height,
  round(CAST(num AS DOUBLE) / den, 6) AS rate, progressive, CAST(chroma AS INTEGER) AS chroma, CAST(bits AS BIGINT) AS bit_rate, CAST(buf AS BIGINT) AS buffer_bits FROM v, (VALUES (0), (1)) twice(n)
""")
def video_sets(spark, sf_dir):
    units = video.sequence_units(video_chunks(spark, sf_dir), ["p_partkey"], "n")
    sets = video.sequence_sets(units, ["p_partkey"], "n")
    rate = F.round(F.col("rate_num") / F.col("rate_den"), 6)
    return sets.where("issue is null").select("p_partkey", "stream_type", "profile", "level", "width", "height", "coded_width", "coded_height", rate.alias("rate"), "progressive", "chroma", "bit_rate", "buffer_bits")


@query(_SETS + f""", j AS (SELECT *, (cw + 15) // 16 AS a, (ch + 15) // 16 AS d FROM v LEFT JOIN {_LIMITS} ON lt = stream_type AND lc = CASE WHEN level = '1b' THEN 9 ELSE code END)
SELECT k AS p_partkey,
  CASE stream_type WHEN 2 THEN profile = 'Main' WHEN 27 THEN code <> 51 ELSE profile = 'Main 10' AND lc IS NOT NULL END AS profile_ok,
  CASE WHEN lc IS NULL THEN NULL WHEN stream_type = 2 THEN CASE WHEN profile = 'Main' THEN cw <= lw AND ch <= lh END WHEN stream_type = 27 THEN a * d <= ls AND a * a <= 8 * ls AND d * d <= 8 * ls ELSE cw * ch <= ls AND cw * cw <= 8 * ls AND ch * ch <= 8 * ls END AS size_ok,
  CASE WHEN lc IS NULL OR num IS NULL THEN NULL WHEN stream_type = 2 THEN CASE WHEN profile = 'Main' THEN num <= lf * den AND 16 * a * CASE WHEN progressive THEN 16 * d ELSE 32 * ((ch + 31) // 32) END * num <= lr * den END WHEN stream_type = 27 THEN a * d * num <= lr * den ELSE cw * ch * num <= lr * den END AS rate_ok,
  CASE WHEN stream_type = 2 THEN k % 13 <> 0 END AS extension_ok, CASE WHEN stream_type = 2 AND profile = 'Main' THEN bits <= lb END AS bits_ok, CASE WHEN stream_type = 2 AND profile = 'Main' THEN buf <= lv END AS buffer_ok,
  CASE WHEN stream_type = 2 AND profile = 'Main' THEN chroma = 1 END AS chroma_ok, CASE WHEN stream_type = 2 THEN k % 7 <> 0 END AS constrained_ok
FROM j, (VALUES (0), (1)) twice(n)
""")
def video_conformity(spark, sf_dir):
    sets = video.sequence_sets(video.sequence_units(video_chunks(spark, sf_dir), ["p_partkey"], "n"), ["p_partkey"], "n")
    return video.conformity(sets).select("p_partkey", "profile_ok", "size_ok", "rate_ok", "extension_ok", "bits_ok", "buffer_ok", "chroma_ok", "constrained_ok")
