"""Network payloads as tables: RTP headers, sender reports, session descriptions, datagram boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_join


def _number(raw: Column, at: int | Column, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(raw.substr(at, F.lit(n))), 16, 10).cast("long")


def parse_rtp(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add version, padding, extension, marker, payload_type, seq_no, rtp_ts, ssrc and payload; issue says why a header is none.

    Contributing sources and a header extension are skipped, padding is cut off.
    """
    r = F.col(raw)
    df = df.withColumns({"__a": _number(r, 1, 1), "__b": _number(r, 2, 1)})
    sources = F.col("__a") % 16
    extended = F.shiftright("__a", 4) % 2 == 1
    start = sources * 4 + 13
    skip = F.when(extended, _number(r, (start + 2).cast("int"), 2) * 4 + 4).otherwise(0)
    end = F.octet_length(r) - F.when(F.shiftright("__a", 5) % 2 == 1, _number(r, F.octet_length(r), 1)).otherwise(0)
    first = (start + skip).cast("int")
    issue = F.when(F.octet_length(r) < 12, "short").when(F.shiftright("__a", 6) != 2, "version").when(first > end + 1, "length")
    return df.withColumns({
        "version": F.shiftright("__a", 6), "padding": F.shiftright("__a", 5) % 2 == 1, "extension": extended, "marker": F.col("__b") >= 128, "payload_type": F.col("__b") % 128,
        "seq_no": _number(r, 3, 2), "rtp_ts": _number(r, 5, 4), "ssrc": _number(r, 9, 4), "issue": issue,
        "payload": F.when(issue.isNull(), r.substr(first, (end - first + 1).cast("int"))),
    }).drop("__a", "__b")


def parse_sender_report(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ssrc, ntp_us (microseconds since 1970) and rtp_ts of an RTCP sender report; null if it isn't one."""
    r = F.col(raw)
    is_report = (F.octet_length(r) >= 28) & (F.shiftright(_number(r, 1, 1), 6) == 2) & (_number(r, 2, 1) == 200)
    ntp = (_number(r, 9, 4) - 2_208_988_800) * 1_000_000 + F.shiftright(_number(r, 13, 4) * 1_000_000, 32)
    return df.withColumns({"ssrc": F.when(is_report, _number(r, 5, 4)), "ntp_us": F.when(is_report, ntp), "rtp_ts": F.when(is_report, _number(r, 17, 4))})


def wall_clock(packets: DataFrame, reports: DataFrame, key: str, at: str, ticks: str, rate: int) -> DataFrame:
    """Packets with utc_us by the latest sender report at or before them; RTP times may have wrapped once since."""
    told = reports.select(key, F.col(at).alias("report_at"), F.col("ntp_us"), F.col("rtp_ts").alias("base"))
    out = asof_join(packets, told, [key], at, "report_at", prefix="sr_")
    step = F.pmod(F.col(ticks) - F.col("sr_base") + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return out.withColumn("utc_us", F.col("sr_ntp_us") + F.floor(step.cast("decimal(20,0)") * 1_000_000 / F.lit(rate)).cast("long"))


def parse_sdp(df: DataFrame, text: str = "sdp") -> DataFrame:
    """Add session (its name), and a row for each media description: media, port, format, encoding, clock_rate."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\nm=")
    df = df.withColumn("__p", parts).withColumn("session", F.nullif(F.regexp_extract(F.col("__p")[0], r"(?m)^s=(.*)$", 1), F.lit("")))
    df = df.select("*", F.posexplode("__p").alias("media_no", "__m")).where("media_no > 0")
    head = F.split(F.split("__m", "\n")[0], " ")
    kind = F.try_element_at(head, F.lit(4))
    mapping = F.regexp_extract("__m", r"(?m)^a=rtpmap:(\d+) ([^/\s]+)/(\d+)", 0)
    return df.select(
        *[c for c in df.columns if c not in ("__p", "__m", "media_no")], "media_no", head[0].alias("media"), head[1].try_cast("int").alias("port"), kind.try_cast("int").alias("format"),
        F.nullif(F.regexp_extract(mapping, r" ([^/]+)/", 1), F.lit("")).alias("encoding"), F.regexp_extract(mapping, r"/(\d+)", 1).try_cast("long").alias("clock_rate"),
    )


def datagram_issue(length: Column, packet: int = 188, most: int = 7) -> Column:
    """Why a datagram isn't 1 to ``most`` whole packets; null if it is."""
    return F.when(length <= 0, "empty").when(length % packet != 0, "partial").when(length > packet * most, "too_many")
