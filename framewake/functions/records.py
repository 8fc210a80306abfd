"""Packs that list commands, countries, bases, payloads and stores; universal labels, places with their accuracy, masks.

Packs of repeated records go to small parsers behind Arrow, a row for each record; a malformed pack gives one row with an
issue. Packs of fixed layout and all rules are expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let
from .codecs import imap_value

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _cut(data: bytes) -> list[bytes]:
    """The values of a series with their lengths before them."""
    from ..sources.klv import _ber

    found, at = [], 0
    while at < len(data):
        size, start = _ber(data, at)
        at = start + size
        if at > len(data):
            raise ValueError("truncated")
        found.append(data[start:at])
    return found


def _oids(data: bytes, most: int | None = None) -> tuple[list[int], int]:
    """Up to ``most`` identifiers from the start of ``data``, and where they end."""
    from ..sources.klv import _oid

    found, at = [], 0
    while at < len(data) and (most is None or len(found) < most):
        value, at = _oid(data, at)
        if value >> 63:
            raise ValueError("identifier")
        found.append(value)
    return found, at


def _text(data: bytes) -> str:
    """UTF-8 without white space at its ends, and without control characters."""
    text = data.decode()
    if text != text.strip("\t\n\r ") or _CONTROL.search(text):
        raise ValueError("text")
    return text


def _named(data: bytes, numbers: int) -> tuple[list[int], str]:
    """A record of so many identifiers and a text that isn't empty, with its length before it."""
    ids, at = _oids(data, numbers)
    (name,) = _cut(data[at:])
    if len(ids) < numbers or not name:
        raise ValueError("record")
    return ids, _text(name)


def _records(df: DataFrame, raw: str, parse, names: list[str], kinds: list[pa.DataType], ddl: str) -> DataFrame:
    from ..sources.metadata import _spread

    def rows(data: bytes) -> list[tuple]:
        try:
            return [(*row, None) for row in parse(data)]
        except (IndexError, ValueError):
            return [(*[None] * len(names), "malformed")]

    return _spread(df, raw, rows, [*names, "issue"], [*kinds, pa.string()], f"{ddl}, issue string")


def commands(df: DataFrame, raw: str) -> DataFrame:
    """Control commands: the row's other columns, id, command, at_us (null if to be done at once), issue.

    Malformed: a text over 127 characters, or anything but eight octets of time after it.
    """

    def parse(data):
        from ..sources.klv import _ber

        (id_,), at = _oids(data, 1)
        size, start = _ber(data, at)
        text, rest = _text(data[start : start + size]), data[start + size :]
        if start + size > len(data) or len(text) > 127 or len(rest) not in (0, 8) or rest[:1] > b"\x7f":
            raise ValueError("command")
        return [(id_, text, int.from_bytes(rest, "big") if rest else None)]

    return _records(df, raw, parse, ["id", "command", "at_us"], [pa.int64(), pa.string(), pa.int64()], "id long, command string, at_us long")


def id_lists(df: DataFrame, raw: str, zero_alone: bool = False) -> DataFrame:
    """Lists of identifiers: the row's other columns, ids, issue. Malformed: an empty list, an open identifier, and with
    ``zero_alone`` a zero among others."""

    def parse(data):
        ids, _ = _oids(data)
        if not ids or (zero_alone and 0 in ids and len(ids) > 1):
            raise ValueError("list")
        return [(ids,)]

    return _records(df, raw, parse, ["ids"], [pa.list_(pa.int64())], "ids array<long>")


def countries(df: DataFrame, raw: str) -> DataFrame:
    """Country codes: the row's other columns, method, overflight, operator, manufacture, issue.

    A country that isn't told is null, one that is told to be unknown is empty. Malformed: other than 2 to 4 values, or a
    method other than 1 to 15 and 64.
    """

    def parse(data):
        method, overflight, *more = _cut(data)
        if len(method) != 1 or method[0] not in (*range(1, 16), 64) or len(more) > 2:
            raise ValueError("countries")
        return [(method[0], *map(_text, (overflight, *more)), *[None] * (2 - len(more)))]

    names = ["overflight", "operator", "manufacture"]
    return _records(df, raw, parse, ["method", *names], [pa.int32(), *[pa.string()] * 3], "method int, overflight string, operator string, manufacture string")


def payloads(df: DataFrame, raw: str) -> DataFrame:
    """Payload lists: the row's other columns, total, id, kind, name, issue, a row for each payload.

    Malformed: an id that repeats or isn't below the total, a kind above 4, a whole list out of order, no payload though
    the total is positive. A list whose total is 0 has no rows.
    """

    def parse(data):
        (total,), at = _oids(data, 1)
        found = [_named(value, 2) for value in _cut(data[at:])]
        ids = [numbers[0] for numbers, _ in found]
        if any(i >= total for i in ids) or len(set(ids)) < len(ids) or any(n[1] > 4 for n, _ in found):
            raise ValueError("payloads")
        if (total and not ids) or (len(ids) == total and ids != sorted(ids)):
            raise ValueError("payloads")
        return [(total, *numbers, name) for numbers, name in found]

    return _records(df, raw, parse, ["total", "id", "kind", "name"], [*[pa.int64()] * 3, pa.string()], "total long, id long, kind long, name string")


def stores(df: DataFrame, raw: str) -> DataFrame:
    """Weapon stores: the row's other columns, station, hardpoint, carriage, store, status, name, issue, a row for each store.

    Malformed: no store, an address that repeats, a status with reserved bits. ``engagement`` names the bits of a status.
    """

    def parse(data):
        found = [_named(value, 5) for value in _cut(data)]
        places = {tuple(numbers[:4]) for numbers, _ in found}
        if not found or len(places) < len(found) or any(n[4] > 0xFFF or n[4] & 0x80 for n, _ in found):
            raise ValueError("stores")
        return [(*numbers, name) for numbers, name in found]

    names = ["station", "hardpoint", "carriage", "store", "status"]
    return _records(df, raw, parse, [*names, "name"], [*[pa.int64()] * 5, pa.string()], ", ".join(f"{n} long" for n in names) + ", name string")


def engagement(status: Column) -> Column:
    """general and the four flags of a store's status."""
    flag = lambda bit, name: (status.bitwiseAND(bit) != 0).alias(name)
    return F.struct(status.bitwiseAND(0xFF).alias("general"), flag(0x100, "fuze"), flag(0x200, "laser"), flag(0x400, "target"), flag(0x800, "armed"))


def _base(raw: Column) -> Column:
    """latitude, longitude and height of a base; null unless its octets are 8 or 11 and none of its numbers is special."""
    parts = [imap_value(raw.substr(1, 4), -90, 90, 4), imap_value(raw.substr(5, 4), -180, 180, 4), imap_value(raw.substr(9, 3), -900, 9000, 3)]
    size, (lat, lon, height) = F.octet_length(raw), [p["value"] for p in parts]
    good = lat.isNotNull() & lon.isNotNull() & ((size == 8) | ((size == 11) & height.isNotNull()))
    return F.when(good, F.struct(lat.alias("latitude"), lon.alias("longitude"), height.alias("height")))


def bases(raw: Column) -> Column:
    """takeoff and recovery of a pack of one or two bases, each null if unknown; a recovery that isn't told is the takeoff.

    Null if malformed: over 24 octets, no base known, other lengths, a recovery told though it equals the takeoff.
    """
    size = lambda x: F.conv(F.hex(x.substr(1, 1)), 16, 10).cast("int")

    def rest(second: Column, first: Column) -> Column:
        fits = (F.octet_length(second) == 0) | (F.octet_length(second) == size(second) + 1)
        told = second.substr(2, 11)

        def of(p: Column) -> Column:
            a, b = p["a"], p["b"]
            good = (a.isNotNull() | (F.octet_length(first) == 0)) & (b.isNotNull() | (F.octet_length(told) == 0)) & (a.isNotNull() | b.isNotNull()) & ~F.coalesce(a == b, F.lit(False))
            return F.when(good & fits, F.struct(a.alias("takeoff"), F.when(F.octet_length(second) == 0, a).otherwise(b).alias("recovery")))

        return let(F.struct(_base(first).alias("a"), _base(told).alias("b")), of)

    whole = (F.octet_length(raw) <= 24) & (size(raw) < F.octet_length(raw))
    return F.when(whole, rest(raw.substr(size(raw) + 2, F.lit(24)), raw.substr(F.lit(2), size(raw))))


#: an item designator in hexadecimal digits: identifiers without leading zeros, then zeros
_DESIGNATOR = "((?:0[1-9A-F]|[1-7].|(?:8[1-9A-F]|[9A-F].)(?:[89A-F].)*[0-7].)+?)(?:00)*"


def universal_label(raw: Column) -> Column:
    """category, registry, structure, version, designator (hexadecimal) and key of a universal label; null if it is none.

    ``key`` tells whether it may be the key of a packet: labels of category 4 may not.
    """
    text = F.hex(raw)
    shape = "^060E2B34((?:0[1-9A-F]|[1-7].){4})" + _DESIGNATOR + "$"
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("int")
    fields = [part(9 + 2 * k).alias(n) for k, n in enumerate(("category", "registry", "structure", "version"))]
    return F.when((F.octet_length(raw) == 16) & text.rlike(shape), F.struct(*fields, F.regexp_extract(text, shape, 2).alias("designator"), (part(9) != 4).alias("key")))


def _groups(raw: Column, base: list[tuple[str, float, float, int]], axes: str) -> Column:
    """Numbers of a pack with, after its ``base``, three deviations and then three correlations, each group or none; null at other lengths."""
    more = [(f"sigma_{a}", 0.0, 650.0, 2) for a in axes] + [(f"rho_{a}{b}", -1.0, 1.0, 2) for a, b in ((axes[0], axes[1]), (axes[0], axes[2]), (axes[1], axes[2]))]
    fields, at = [], 1
    for name, low, high, size in base + more:
        fields.append(imap_value(raw.substr(at, size), low, high, size)["value"].alias(name))
        at += size
    least = sum(size for *_, size in base)
    return F.when(F.octet_length(raw).isin(least, least + 6, least + 12), F.struct(*fields))


def location(raw: Column) -> Column:
    """latitude, longitude, height and what is told of their accuracy: sigma_e, sigma_n, sigma_u, rho_en, rho_eu, rho_nu."""
    return _groups(raw, [("latitude", -90.0, 90.0, 4), ("longitude", -180.0, 180.0, 4), ("height", -900.0, 19_000.0, 2)], "enu")


def motion(raw: Column) -> Column:
    """east, north and up of a velocity or acceleration, and what is told of their accuracy."""
    return _groups(raw, [(n, -900.0, 900.0, 2) for n in ("east", "north", "up")], "enu")


def contour_turn(contour: Column, width: Column) -> Column:
    """Twice the area in a contour of pixel numbers, positive if it goes clockwise in an image whose rows grow downwards."""
    row, column = (lambda p: F.floor((p - 1) / width)), (lambda p: F.pmod(p - 1, width))
    after = F.concat(F.slice(contour, 2, F.greatest(F.size(contour), F.lit(1))), F.slice(contour, 1, 1))
    cross = F.zip_with(contour, after, lambda p, q: column(p) * row(q) - column(q) * row(p))
    return F.aggregate(cross, F.lit(0).cast("long"), lambda total, x: total + x)


def mask_issues(contour: Column, runs: Column, width: Column, height: Column) -> Column:
    """What is wrong with a mask of a contour (pixel numbers) and runs (start, length): empty, contour_short,
    contour_bounds, contour_order (not clockwise), run_bounds. Null parts count as empty ones."""
    contour, runs = F.coalesce(contour, F.array().cast("array<bigint>")), F.coalesce(runs, F.array().cast("array<struct<start:bigint,length:bigint>>"))
    total, points = width * height, F.size(contour)
    outside = F.exists(contour, lambda p: (p < 1) | (p > total))
    return F.array_compact(F.array(
        F.when((points == 0) & (F.size(runs) == 0), "empty"), F.when(points.between(1, 2), "contour_short"), F.when(outside, "contour_bounds"),
        F.when((points > 2) & (contour_turn(contour, width) <= 0), "contour_order"),
        F.when(F.exists(runs, lambda r: (r["start"] < 1) | (r["length"] < 1) | (r["start"] + r["length"] - 1 > total)), "run_bounds"),
    ))
