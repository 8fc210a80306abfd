"""Structured packs of metadata fields: expressions where the layout allows, small parsers behind Arrow where it repeats."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let
from .codecs import ber_oid_decode


def _number(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("long")


def oid_length(raw: Column, start: int | Column = 1) -> Column:
    """How many octets the identifier that begins at ``start`` has."""
    start = F.lit(start) if isinstance(start, int) else start
    ends = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: F.coalesce(_number(raw.substr((start + k).cast("int"), F.lit(1))) < 128, F.lit(False)))
    return F.element_at(ends, 1) + 1


def frame_rate(raw: Column) -> Column:
    """Numerator and denominator of a frame rate: two identifiers, the second 1 if absent; null if malformed or divided by 0."""
    def cut(n: Column) -> Column:
        return F.struct(raw.substr(F.lit(1), n.cast("int")).alias("a"), raw.substr((n + 1).cast("int"), F.lit(20)).alias("b"))

    def read(parts: Column) -> Column:
        den = F.when(F.octet_length(parts["b"]) == 0, F.lit(1).cast("long")).otherwise(ber_oid_decode(parts["b"]))
        return F.struct(ber_oid_decode(parts["a"]).alias("numerator"), den.alias("denominator"))

    rate = let(let(F.when(F.octet_length(raw).between(1, 16), oid_length(raw)), cut), read)
    return let(rate, lambda r: F.when(r["numerator"].isNotNull() & (r["denominator"] > 0), r))


def horizon(raw: Column) -> Column:
    """Two border points of a horizon in percent and up to four coordinates (degrees); null unless the octets are 4, 8, 12, 16 or 20."""
    n = F.octet_length(raw)
    corner = [_number(raw.substr(k, 1)) for k in (1, 2, 3, 4)]
    border = (corner[0].isin(0, 100) | corner[1].isin(0, 100)) & (corner[2].isin(0, 100) | corner[3].isin(0, 100))

    def angle(k: int, full: float) -> Column:
        u = F.when(n >= 8 + 4 * k, _number(raw.substr(5 + 4 * k, 4)))
        s = F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u)
        return F.when(s != -(1 << 31), s * (full / ((1 << 31) - 1)))

    names = ("latitude0", "longitude0", "latitude1", "longitude1")
    fields = [c.alias(x) for c, x in zip(corner, ("x0", "y0", "x1", "y1"))] + [angle(k, 180.0 if k % 2 else 90.0).alias(x) for k, x in enumerate(names)]
    return F.when(n.isin(4, 8, 12, 16, 20) & border & (F.greatest(*corner) <= 100), F.struct(*fields))


def bitset(raw: Column) -> Column:
    """Numbers of the set bits, the lowest of the first octet being 0."""
    bits = F.sequence(F.lit(0), F.octet_length(raw) * 8 - 1)
    chosen = F.filter(bits, lambda b: F.call_function("shiftright", _number(raw.substr(F.floor(b / 8).cast("int") + 1, F.lit(1))), (b % 8).cast("int")) % 2 == 1)
    return F.when(F.octet_length(raw) > 0, chosen).otherwise(F.array().cast("array<int>"))


def miis_combine(parts: list[Column]) -> Column:
    """An identifier of 16 octets for identifiers together: SHA-1 over their capital hexadecimal digits, marked as version 5."""
    digest = F.sha1(F.concat(*[F.hex(p) for p in parts]).cast("binary"))
    octet = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    return F.concat(F.upper(F.substring(digest, 1, 12)), two(octet(6) % 16 + 0x50), F.upper(F.substring(digest, 15, 2)), two(octet(8) % 64 + 0x80), F.upper(F.substring(digest, 19, 14)))


def miis_core(raw: Column) -> Column:
    """Version, qualities (0 none, 1 managed, 2 virtual, 3 physical) and components of a core identifier; null if its octets don't fit its usage."""
    usage = _number(raw.substr(2, 1))
    has = {"sensor": F.shiftright(usage, 5) % 4, "platform": F.shiftright(usage, 3) % 4, "window": F.shiftright(usage, 2) % 2, "minor": F.shiftright(usage, 1) % 2}
    at, fields = F.lit(3), []
    for name, value in has.items():
        fields += [F.when(value > 0, F.hex(raw.substr(at.cast("int"), F.lit(16)))).alias(name), *([value.alias(f"{name}_quality")] if name in ("sensor", "platform") else [])]
        at = at + F.when(value > 0, 16).otherwise(0)
    good = (_number(raw.substr(1, 1)) == 1) & (usage < 128) & (usage % 2 == 0) & (F.octet_length(raw) == at - 1)
    return F.when(good, F.struct(*fields))


def spread_values(df: DataFrame, raw: str) -> DataFrame:
    """A series of values with their lengths before them to a row each: the row's other columns, n, value; issue truncated ends it."""
    from ..sources.metadata import _spread

    def cut(data: bytes) -> list[tuple]:
        from ..sources.klv import _ber

        found, at = [], 0
        while at < len(data):
            try:
                size, start = _ber(data, at)
                if start + size > len(data):
                    raise ValueError
            except (ValueError, IndexError):
                return [*found, (len(found), None, "truncated")]
            found.append((len(found), data[start : start + size], None))
            at = start + size
        return found

    return _spread(df, raw, cut, ["n", "value", "value_issue"], [pa.int32(), pa.binary(), pa.string()], "n int, value binary, value_issue string")


def after_oid(raw: Column) -> tuple[Column, Column]:
    """The identifier that octets begin with, and what follows it."""
    return ber_oid_decode(let(oid_length(raw), lambda n: raw.substr(F.lit(1), n.cast("int")))), let(oid_length(raw), lambda n: raw.substr((n + 1).cast("int"), F.lit(1 << 20)))


def wavelength_records(df: DataFrame, raw: str) -> DataFrame:
    """Records of a wavelength list: the row's other columns, n, id, low_nm, high_nm, name, issue (truncated, short, reserved_id)."""
    from .codecs import imap_value

    v = spread_values(df, raw)
    id_, rest = after_oid(F.col("value"))
    ends = [imap_value(rest.substr(k, 4), 0.0, 1e9, 4)["value"] for k in (1, 5)]
    issue = F.when(F.col("value_issue").isNotNull(), F.col("value_issue")).when(F.octet_length(rest) < 8, "short").when(id_ < 21, "reserved_id")
    return v.select(*[c for c in v.columns if c not in ("value", "value_issue")], id_.alias("id"), ends[0].alias("low_nm"), ends[1].alias("high_nm"), rest.substr(9, 1 << 20).cast("string").alias("name"), issue.alias("issue"))


def waypoint_records(df: DataFrame, raw: str) -> DataFrame:
    """Records of a waypoint list: the row's other columns, n, id, order (signed), issue (truncated, short)."""
    v = spread_values(df, raw)
    id_, rest = after_oid(F.col("value"))
    u = _number(rest.substr(1, 2))
    issue = F.when(F.col("value_issue").isNotNull(), F.col("value_issue")).when(F.octet_length(rest) < 2, "short")
    return v.select(*[c for c in v.columns if c not in ("value", "value_issue")], id_.alias("id"), F.when(u >= 32768, u - 65536).otherwise(u).alias("order"), issue.alias("issue"))


def _imap_number(raw: bytes, low: float, high: float) -> float:
    """A mapped number; special codes are no part of an array or a covariance and make it malformed."""
    from .codecs import imap_shape

    scale, zero = imap_shape(low, high, len(raw))
    code = int.from_bytes(raw, "big")
    if code > 1 << 8 * len(raw) - 1:
        raise ValueError
    return (code - zero) / scale + low


def _parts(body: bytes, width: int) -> list[bytes]:
    return [body[k : k + width] for k in range(0, len(body), width)]


def _overlaid(body: bytes, width: int, dims: list[int], total: int) -> list[float]:
    """A default value and patches (value, start, shape), of which the last one wins."""
    from ..sources.klv import _oid

    whole = lambda raw: float(int.from_bytes(raw, "big", signed=True))
    grid, at = np.full(dims, whole(body[:width])), width
    while at < len(body):
        value, at = whole(body[at : at + width]), at + width
        corner = []
        for _ in range(2 * len(dims)):
            x, at = _oid(body, at)
            corner.append(x)
        start, shape = corner[: len(dims)], corner[len(dims) :]
        if any(a + n > size or not n for a, n, size in zip(start, shape, dims)):
            raise ValueError
        grid[tuple(slice(a, a + n) for a, n in zip(start, shape))] = value
    return grid.ravel().tolist()


def _array(data: bytes, limit: int) -> tuple[list[int], list[float]]:
    """Dimensions and elements, row by row, of a multi-dimensional array pack; ValueError or IndexError if it is malformed."""
    import struct

    from ..sources.klv import _ber, _oid

    size, at = _ber(data, 0)
    if at + size != len(data):
        raise ValueError
    ndim, at = _oid(data, at)
    dims = []
    for _ in range(ndim):
        n, at = _oid(data, at)
        dims.append(n)
    width, at = _oid(data, at)
    algorithm, at = _oid(data, at)
    total, body = int(np.prod(dims, dtype=object)), data[at:]
    if not dims or not 0 < total <= limit or not width:
        raise ValueError
    if algorithm == 1:
        values = [float(int.from_bytes(x, "big", signed=True)) for x in _parts(body, width)]
    elif algorithm == 2:
        each = (len(body) - total * width) // 2
        low, high = struct.unpack({4: ">2f", 8: ">2d"}.get(each, ""), body[: 2 * each])
        values = [_imap_number(x, low, high) for x in _parts(body[2 * each :], width)]
    elif algorithm == 3:
        bits = np.unpackbits(np.frombuffer(body, np.uint8))
        if len(body) != (total + 7) // 8 or bits[total:].any():
            raise ValueError
        values = bits[:total].astype(float).tolist()
    elif algorithm == 4:
        bias, at = _oid(body, 0)
        values = [float(bias + int.from_bytes(x, "big")) for x in _parts(body[at:], width)]
    elif algorithm == 5:
        values = _overlaid(body, width, dims, total)
    else:
        raise ValueError
    if len(values) != total or algorithm in (1, 4) and (len(body) - (at if algorithm == 4 else 0)) != total * width:
        raise ValueError
    return dims, values


def _rows(df: DataFrame, raw: str, parse: Callable, names: list[str], kinds: list[pa.DataType], ddl: str) -> DataFrame:
    import struct

    from ..sources.metadata import _spread

    def cut(data: bytes) -> list[tuple]:
        try:
            return [(*parse(data), None)]
        except (IndexError, ValueError, KeyError, OverflowError, struct.error, StopIteration):
            return [(None, None, "malformed")]

    return _spread(df, raw, cut, [*names, "array_issue"], [*kinds, pa.string()], f"{ddl}, array_issue string")


def decode_arrays(df: DataFrame, raw: str, limit: int = 1 << 20) -> DataFrame:
    """Multi-dimensional array packs: the row's other columns, dims array<long>, elements array<double>, array_issue (malformed).

    Algorithms: 1 signed integers, 2 mapped numbers between bounds told first, 3 bits, 4 unsigned integers above a bias, 5 a
    default and patches of which the last wins. A pack of over ``limit`` elements, or without elements, is malformed.
    """
    return _rows(df, raw, lambda data: _array(data, limit), ["dims", "elements"], [pa.list_(pa.int64()), pa.list_(pa.float64())], "dims array<long>, elements array<double>")


def _covariances(data: bytes) -> tuple[list[float], list[float | None]]:
    """Deviations and correlations of a covariance pack; ValueError or IndexError if it is malformed."""
    import struct

    from ..sources.klv import _oid

    n, at = _oid(data, 0)
    first = data[at]
    if first & 0x80:
        second, at = data[at + 1], at + 2
        sparse, deviation, correlation = first & 0x20, second & 15, first & 15
        mapped = bool(first & 0x10)
        if first & 0x40 or second & 0xF0:  # reserved bits, or deviations mapped between bounds that only the parent knows
            raise ValueError
    else:
        at += 1
        sparse, deviation, correlation, mapped = first & 0x08, first >> 4 & 7, first & 7, True
    many = n * (n - 1) // 2
    here = np.ones(many, bool)
    if sparse:
        size = (many + 7) // 8
        bits = np.unpackbits(np.frombuffer(data[at : at + size], np.uint8))
        if len(bits) < many or bits[many:].any() or bits[:many].all():
            raise ValueError
        here, at = bits[:many].astype(bool), at + size
    ieee = {2: ">e", 4: ">f", 8: ">d"}
    cut = at + n * deviation
    deviations = [struct.unpack(ieee[deviation], x)[0] for x in _parts(data[at:cut], deviation)] if n else []
    told = _parts(data[cut:], correlation) if correlation else []
    if len(deviations) != n or correlation and len(told) != here.sum():
        raise ValueError
    values = iter([_imap_number(x, -1.0, 1.0) if mapped else struct.unpack(ieee[correlation], x)[0] for x in told])
    return deviations, [next(values) if x and correlation else None for x in here]


def decode_covariances(df: DataFrame, raw: str) -> DataFrame:
    """Covariance packs: the row's other columns, deviations array<double>, correlations array<double> (upper triangle, row by row, null where left out), array_issue."""
    return _rows(df, raw, _covariances, ["deviations", "correlations"], [pa.list_(pa.float64()), pa.list_(pa.float64())], "deviations array<double>, correlations array<double>")


def covariance(deviations: Column, correlations: Column, row: Column, column: Column) -> Column:
    """An element of the covariance matrix of a pack, from 0; correlations that were left out count as 0."""
    n = F.size(deviations)
    r, c = F.least(row, column), F.greatest(row, column)
    at = (r * (2 * n - r - 1) / 2 + c - r - 1).cast("int")
    rho = F.when(r == c, F.lit(1.0)).otherwise(F.coalesce(F.get(correlations, at), F.lit(0.0)))
    return F.when((r >= 0) & (c < n), F.get(deviations, r.cast("int")) * F.get(deviations, c.cast("int")) * rho)
