"""Field semantics as column expressions: flags, nibble packs, security marks, tables with reserved ids, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_names(value: Column, names: Sequence[str]) -> Column:
    """Names of the set bits from the lowest, joined by plus signs, with the value in hexadecimal; nothing set: none."""
    chosen = F.array_compact(F.array(*[F.when(F.shiftright(value, k) % 2 == 1, n) for k, n in enumerate(names)]))
    return F.concat(F.when(F.size(chosen) > 0, F.array_join(chosen, " + ")).otherwise("none"), F.lit(" (0x"), F.lpad(F.hex(value.cast("long")), 2, "0"), F.lit(")"))


def time_status(flags: Column) -> Column:
    """Lock, discontinuity and reverse bits of a time stamp's status octet (0x80: not locked, 0x40: discontinuity, 0x20: reverse)."""
    return F.struct((F.shiftright(flags, 7) % 2 == 0).alias("locked"), (F.shiftright(flags, 6) % 2 == 1).alias("discontinuity"), (F.shiftright(flags, 5) % 2 == 1).alias("reverse"))


def weapon_load(value: Column) -> Column:
    """Station, substation, type and variant: four nibbles of 16 bits."""
    return F.struct(*[(F.shiftright(value, s) % 16).alias(n) for n, s in (("station", 12), ("substation", 8), ("type", 4), ("variant", 0))])


def laser_code_valid(code: Column) -> Column:
    """Three or four digits from 1 to 8."""
    return F.coalesce(code.cast("string").rlike("^[1-8]{3,4}$"), F.lit(False))


def country_code_issue(code: Column, method: Column) -> Column:
    """Why a country code doesn't fit its coding method: two letters, three letters, or three digits."""
    bare = F.regexp_replace(code, "^//", "")
    fits = F.when(method == "two", bare.rlike("^[A-Z]{2}$")).when(method == "three", bare.rlike("^[A-Z]{3}$")).when(method == "numeric", bare.rlike("^[0-9]{3}$"))
    return F.when(code.isNull(), "missing").when(fits.isNull(), "method").when(~fits, "format")


def record_id_issue(id_: Column, reserved: tuple[int, int] = (7, 20)) -> Column:
    """Ids below the reserved range are predefined, those above custom."""
    return F.when(id_.between(*reserved), "reserved").when(id_ < 0, "negative")


def normalised_end(start: Column, extent: Column) -> Column:
    """Where a view that starts at an angle and extends over a range ends, in [0, 360)."""
    return F.pmod(start + extent, F.lit(360.0))


def percent(confidence: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.round(confidence.cast("decimal(20,10)") * 100, 0).cast("int")


def polynomial(row: Column, column: Column, coefficients: Sequence[Sequence[float]]) -> Column:
    """Sum of c[i][j] row^i column^j."""
    total = F.lit(0.0)
    for line in reversed(coefficients):
        inner = F.lit(0.0)
        for c in reversed(line):
            inner = inner * column + F.lit(float(c))
        total = total * row + inner
    return total


def transform_chain(x: Column, y: Column, steps: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Projective transforms of eight coefficients one after another."""
    from .geometry import homography

    for h in steps:
        x, y = homography(x, y, h)
    return x, y


def crosses_antimeridian(lon: Column) -> Column:
    """Whether an open ring of longitudes has an edge that is shorter across 180 degrees."""
    n = F.size(lon)
    edges = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    return F.exists(edges, lambda i: F.abs(F.get(lon, i) - F.get(lon, (i + 1) % n)) > 180.0)
