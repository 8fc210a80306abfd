"""Target geometry: locations, pixels, range planes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import wrap_longitude


def target_location(own: Sequence[Column], centre: Sequence[Column], offsets: Sequence[Column], height: Column, most: float = 19.2) -> Column:
    """latitude, longitude and height of a target: its own location (latitude, longitude, height) if it has one, else the frame
    centre and its offsets, with ``height``; null if neither is whole and in range."""
    lat, lon = centre[0] + offsets[0], wrap_longitude(centre[1] + offsets[1])
    good = offsets[0].between(-most, most) & offsets[1].between(-most, most) & lat.between(-90, 90)
    named = lambda a, b, c: F.struct(a.cast("double").alias("latitude"), b.cast("double").alias("longitude"), c.cast("double").alias("height"))
    return F.when(own[0].between(-90, 90) & own[1].between(-180, 180), named(*own)).when(good, named(lat, lon, height))


def box_pixels(left: Column, top: Column, right: Column, bottom: Column, width: Column) -> Column:
    """Pixel numbers, from 1, of a half-open box's corners and centroid: top_left, bottom_right, centroid; null for an empty box."""
    number = lambda row, column: (row - 1) * width + column
    middle = lambda low, high: F.floor((low + high - 1) / 2).cast("long") + 1
    fields = [number(top + 1, left + 1).alias("top_left"), number(bottom, right).alias("bottom_right"), number(middle(top, bottom), middle(left, right)).alias("centroid")]
    return F.when((right > left) & (bottom > top), F.struct(*fields))


def pixel_issues(top_left: Column, bottom_right: Column, width: Column, height: Column) -> Column:
    """What is wrong with a box of pixel numbers: beyond_frame, order (the first corner below or right of the second)."""
    total = width * height
    row, column = (lambda p: F.floor((p - 1) / width)), (lambda p: F.pmod(p - 1, width))
    out = (top_left < 1) | (bottom_right < 1) | (top_left > total) | (bottom_right > total)
    turned = (row(top_left) > row(bottom_right)) | (column(top_left) > column(bottom_right))
    return F.array_compact(F.array(F.when(out, "beyond_frame"), F.when(turned, "order")))


def plane_residual(value: Column, row: Column, column: Column, a: Column, b: Column, c: Column) -> Column:
    """A range less the plane a i + b j + c."""
    return value - (a * row + b * column + c)


def plane_restored(residual: Column, row: Column, column: Column, a: Column, b: Column, c: Column) -> Column:
    return residual + (a * row + b * column + c)


def target_elevation(ellipsoid: Column, sea_level: Column) -> Column:
    """value and datum: height above the ellipsoid if there, else above sea level, else unknown."""
    datum = F.when(ellipsoid.isNotNull(), "hae").when(sea_level.isNotNull(), "msl").otherwise("unknown")
    return F.struct(F.coalesce(ellipsoid, sea_level).alias("value"), datum.alias("datum"))


def context_issues(
    declared: Column, reported: Column, detected: Column, at: Column, frame_at: Column, parent_at: Column, standalone: Column, other_source: Column,
    sourced: Column, size: tuple[Column, Column], frame: tuple[Column, Column], period: Column, offsets: Column,
) -> Column:
    """What of a moving-target set contradicts the frame it was made from; what the context doesn't tell (null) isn't checked.

    total_mismatch: ``declared`` targets aren't the ``detected`` ones; total_required: it isn't declared though not all are
    ``reported``; time_mismatch: ``at`` isn't the frame's time; time_required: an embedded set without time whose parent has
    another time than the frame; source: the images are of another source and fields of view or identifier (``sourced``)
    are absent; width, height; offsets: targets with offsets from the parent, over two frame periods apart.
    """
    apart = F.abs(F.coalesce(frame_at, at) - parent_at)
    return F.array_compact(F.array(
        F.when(declared != detected, "total_mismatch"), F.when(declared.isNull() & (detected != reported), "total_required"),
        F.when(at != frame_at, "time_mismatch"), F.when(at.isNull() & ~standalone & (parent_at != frame_at), "time_required"),
        F.when(other_source & ~sourced, "source"), F.when(size[0] != frame[0], "width"), F.when(size[1] != frame[1], "height"),
        F.when((apart > 2 * period) & offsets, "offsets"),
    ))


def tracker_issues(first: Column, latest: Column, boundary: Column, confidence: Column, history: Column, moving: Column) -> Column:
    """What is wrong with a track: order (of its times), boundary (one place), confidence (over 100), history (a velocity or
    acceleration, ``moving``, without a place). ``boundary`` and ``history`` count places, null where not told."""
    return F.array_compact(F.array(
        F.when(latest < first, "order"), F.when(boundary == 1, "boundary"), F.when(~confidence.between(0, 100), "confidence"), F.when(moving & (F.coalesce(history, F.lit(0)) < 1), "history"),
    ))
