"""Reporting requirements over time: groups of alternative items, told at least once in an interval, and items that exclude one another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the standard: the minimum metadata set, each with the tags that can meet it; those of the security set,
# item 48, are named with it; and the tags that exclude one another
MINIMUM_SET = {
    "checksum": ("1",), "precision_timestamp": ("2",), "mission_id": ("3",), "platform_heading": ("5",), "platform_pitch": ("6", "90"), "platform_roll": ("7", "91"),
    "platform_designation": ("10",), "image_source_sensor": ("11",), "image_coordinate_system": ("12",), "sensor_latitude": ("13",), "sensor_longitude": ("14",),
    "sensor_altitude": ("15", "75", "104"), "sensor_horizontal_fov": ("16",), "sensor_vertical_fov": ("17",), "sensor_relative_azimuth": ("18",),
    "sensor_relative_elevation": ("19",), "sensor_relative_roll": ("20",), "slant_range": ("21",), "target_width": ("22", "96"), "frame_center_latitude": ("23",),
    "frame_center_longitude": ("24",), "frame_center_elevation": ("25", "78"), "uas_local_set_version": ("65",),
}
SECURITY_SET = {
    "security_classification": ("48/1",), "security_country_coding_method": ("48/2",), "security_classifying_country": ("48/3",),
    "security_object_country_coding_method": ("48/12",), "security_object_country_codes": ("48/13",), "security_metadata_version": ("48/22",),
}
#: wanted only where the marking applies
SECURITY_MARKINGS = {"security_sci_shi_information": ("48/4",), "security_caveats": ("48/5",), "security_releasing_instructions": ("48/6",)}
IDENTIFIER = {"miis_core_identifier": ("94",)}
EXCLUSIVE = ("sensor_altitude", "75", "104")


def _items_of(packets: DataFrame, items: DataFrame, keys: Sequence[str], seq: str, ts: str) -> DataFrame:
    """Every packet with what it has: the sets of tags that are populated, empty and malformed."""
    empty = F.coalesce(F.octet_length("raw"), F.lit(0)) == 0
    bad = F.coalesce(F.col("bad"), F.lit(False))
    found = items.groupBy(*keys, seq).agg(
        F.collect_set(F.when(~empty & ~bad, F.col("tag"))).alias("__full"), F.collect_set(F.when(empty, F.col("tag"))).alias("__empty"), F.collect_set(F.when(bad, F.col("tag"))).alias("__bad"),
    )
    none = F.array().cast("array<string>")
    out = packets.select(*keys, seq, ts).join(found, [*keys, seq], "left")
    return out.select(*keys, seq, ts, *[F.coalesce(c, none).alias(c) for c in ("__full", "__empty", "__bad")])


def _any(tags: Sequence[str], column: str) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, tags)))


def requirement_issues(
    packets: DataFrame, items: DataFrame, keys: Sequence[str], seq: str, ts: str, groups: Mapping[str, Sequence[str]], limit: int,
    exclusive: tuple[str, str, str] | None = EXCLUSIVE, end: int | None = None,
) -> DataFrame:
    """What breaks the reporting of ``groups``: keys, ``seq`` (null at a stream's end), code, requirement, starts.

    packets: keys, seq (their order), ts. items: keys, seq, tag (text; of a nested set with its parent's), raw, bad (malformed).
    At a packet: invalid_field, a malformed item of the group; zero_length, an empty item and none that is populated, of item 48 also on its own;
    overdue, ``limit`` is exceeded since the group was last met before this packet, or since the stream's beginning, with starts true
    at the first such packet; exclusive_or, both tags of ``exclusive`` are current, told within ``limit`` and not emptied since. At the end
    (``end``, or the last packet): missing, what never came, and overdue.

    One scan of the packets in their order carries the last time of every group; rows aren't multiplied by groups.
    """
    p = _items_of(packets, items, keys, seq, ts)
    w = Window.partitionBy(*keys).orderBy(seq)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    met = {g: F.last(F.when(_any(tags, "__full"), F.col(ts)), ignorenulls=True) for g, tags in groups.items()}
    p = p.withColumns({"__start": F.first(ts).over(upto), "__prior": F.lag(ts).over(w), **{f"__met_{g}": last.over(before) for g, last in met.items()}})
    issue = lambda code, name, starts=None: F.struct(F.lit(code).alias("code"), F.lit(name).alias("requirement"), (F.lit(True) if starts is None else starts).alias("starts"))
    found = []
    if any(t.startswith("48") for tags in groups.values() for t in tags):
        found.append(F.when(_any(["48"], "__empty"), issue("zero_length", "security")))
    for g, tags in groups.items():
        parents = sorted({t.partition("/")[0] for t in tags})
        since = F.coalesce(F.col(f"__met_{g}"), F.col("__start"))
        late = F.col(ts) - since > limit
        found += [
            F.when(_any([*tags, *parents], "__bad"), issue("invalid_field", g)), F.when(~_any(tags, "__full") & _any(tags, "__empty"), issue("zero_length", g)),
            F.when(late, issue("overdue", g, ~(F.coalesce(F.col("__prior") - since > limit, F.lit(False))))),
        ]
    if exclusive:
        words = [F.last(F.when(_any([t], "__full"), F.struct(F.col(ts).alias("at"), F.lit(True).alias("on"))).when(_any([t], "__empty"), F.struct(F.col(ts).alias("at"), F.lit(False).alias("on"))), ignorenulls=True) for t in exclusive[1:]]
        p = p.withColumns({f"__x{k}": x.over(upto) for k, x in enumerate(words)})
        current = [F.coalesce(F.col(f"__x{k}.on") & (F.col(ts) - F.col(f"__x{k}.at") <= limit), F.lit(False)) for k in (0, 1)]
        found.append(F.when(current[0] & current[1], issue("exclusive_or", exclusive[0])))
    told = p.select(*keys, seq, F.explode(F.array_compact(F.array(*found))).alias("i")).select(*keys, seq, "i.*")

    last = p.groupBy(*keys).agg(F.max(ts).alias("__end"), *[F.max(F.when(_any(tags, "__full"), F.col(ts))).alias(f"__met_{g}") for g, tags in groups.items()])
    at = F.col("__end") if end is None else F.greatest(F.lit(end), F.col("__end"))
    ends = [F.when(F.col(f"__met_{g}").isNull(), issue("missing", g)).when(at - F.col(f"__met_{g}") > limit, issue("overdue", g)) for g in groups]
    closing = last.select(*keys, F.lit(None).cast(packets.schema[seq].dataType).alias(seq), F.explode(F.array_compact(F.array(*ends))).alias("i")).select(*keys, seq, "i.*")
    return told.union(closing)
