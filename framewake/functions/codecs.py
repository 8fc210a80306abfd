"""Binary codecs as column expressions: BER lengths and identifiers, mapped numbers, clocks, checksums."""

from __future__ import annotations

import binascii
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import let


def _number(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("long")


def _octets(value: Column, n: int) -> Column:
    """A non-negative number as ``n`` big-endian octets."""
    return F.unhex(F.lpad(F.hex(value), 2 * n, "0"))


def ber_length(value: Column) -> Column:
    """The shortest BER form of a length: one octet below 128, else a count of octets and the octets; negative: null."""
    n = F.ceil(F.length(F.hex(value)) / 2).cast("int")
    digits = F.hex(value)
    return F.when(value.between(0, 127), _octets(value, 1)).when(value > 127, F.unhex(F.concat(F.hex(n + 128), F.lpad(digits, n * 2, "0"))))


def ber_length_decode(raw: Column) -> Column:
    """The length at the start of ``raw``; null for the indefinite form, over eight octets, or too few octets."""
    head = _number(F.substring(raw, 1, 1))
    n = head - 128
    return F.when(head < 128, head).when((n >= 1) & (n <= 8) & (F.octet_length(raw) > n), _number(raw.substr(F.lit(2), n.cast("int"))))


def ber_oid(value: Column, most: int = 9) -> Column:
    """Base 128, big-endian, with the high bit set on all octets but the last; non-negative values."""
    groups = F.transform(F.sequence(F.lit(most - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", value, F.lit(7) * k).bitwiseAND(127))
    used = F.greatest(F.lit(1), *[F.when(value >= (1 << (7 * k)), k + 1).otherwise(1) for k in range(1, most)])
    kept = F.slice(groups, F.lit(most + 1) - used, used)
    return F.unhex(F.array_join(F.transform(kept, lambda g, i: F.lpad(F.hex(F.when(i < used - 1, g + 128).otherwise(g)), 2, "0")), ""))


def ber_oid_decode(raw: Column) -> Column:
    """The identifier at the start of ``raw``, which has no octets besides; null if it begins with 0x80, has over nine octets, or doesn't end."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: _number(raw.substr(i, F.lit(1))))

    def value(x: Column) -> Column:
        ends = (F.element_at(x, -1) < 128) & (F.size(F.filter(x, lambda o: o < 128)) == 1)
        return F.when((F.element_at(x, 1) != 128) & ends, F.aggregate(x, F.lit(0).cast("long"), lambda a, o: a * 128 + o % 128))

    return F.when(F.octet_length(raw).between(1, 9), let(octets, value))


def imap_shape(low: float, high: float, length: int) -> tuple[float, float]:
    """Scale and zero offset of an integer mapping of [low, high] onto ``length`` octets."""
    exponent = math.frexp(high - low)
    bits = exponent[1] - (exponent[0] == 0.5)  # the least power of two that is at least the range
    scale = 2.0 ** (8 * length - 1 - bits)
    return scale, (scale * low - math.floor(scale * low)) if low < 0 < high else 0.0


def imap_encode(value: Column, low: float, high: float, length: int) -> Column:
    """The mapped integer; out of range or not a number: null."""
    scale, zero = imap_shape(low, high, length)
    return F.when(~F.isnan(value) & value.between(low, high), F.floor((value - low) * scale + zero).cast("long"))


def imap_decode(code: Column, low: float, high: float, length: int) -> Column:
    """The number of a mapped integer; codes with the top bit set, but for the exact upper end, are special: null."""
    scale, zero = imap_shape(low, high, length)
    top = 1 << (8 * length - 1)
    return F.when((code < top) | ((code == top) & F.lit(math.log2(high - low).is_integer())), (code - zero) / scale + low)


def imap_special(raw: Column) -> Column:
    """What a mapped value's octets signal other than a number; null for a number. An exact upper end isn't told apart here."""
    first, rest = _number(F.substring(raw, 1, 1)), F.ltrim(F.hex(raw.substr(F.lit(2), F.octet_length(raw))), F.lit("0")) == ""
    exact = {0xE0: "below_minimum", 0xE1: "above_maximum", 0xC8: "positive_infinity", 0xE8: "negative_infinity"}
    family = {0xC0: "user_defined", 0xD0: "positive_quiet_nan", 0xD8: "positive_signaling_nan", 0xF0: "negative_quiet_nan", 0xF8: "negative_signaling_nan"}
    kind = F.lit("reserved")
    for code, name in family.items():
        kind = F.when(first.bitwiseAND(0xF8) == code, name).otherwise(kind)
    for code, name in exact.items():
        kind = F.when((first == code) & rest, name).otherwise(kind)
    return F.when(first >= 0x80, kind)


def imap_value(raw: Column, low: float, high: float, length: int, clamp: bool = False) -> Column:
    """value and special of ``length`` mapped octets; with ``clamp``, signals of too low and too high become the ends.

    Other lengths are of neither kind: both null. Up to seven octets.
    """
    code, kind = _number(raw), imap_special(raw)
    top = 1 << (8 * length - 1)
    kind = F.when((code == top) & F.lit(math.log2(high - low).is_integer()), None).otherwise(kind)
    value = F.when(kind.isNull(), imap_decode(code, low, high, length))
    if clamp:
        value = F.when(kind == "below_minimum", float(low)).when(kind == "above_maximum", float(high)).otherwise(value)
        kind = F.when(~kind.isin("below_minimum", "above_maximum"), kind)
    fits = F.octet_length(raw) == length
    return F.struct(F.when(fits, value).alias("value"), F.when(fits, kind).alias("special"))


def imap_octets(value: Column, low: float, high: float, length: int) -> Column:
    """``length`` octets of a number: its code, or the signal of a value too low, too high, infinite or not a number."""
    mark = lambda octet: F.lit(f"{octet:02X}" + "00" * (length - 1))
    infinite = F.abs(value) == float("inf")
    text = (
        F.when(F.isnan(value), mark(0xD0)).when(infinite & (value > 0), mark(0xC8)).when(infinite, mark(0xE8))
        .when(value < low, mark(0xE0)).when(value > high, mark(0xE1)).otherwise(F.lpad(F.hex(imap_encode(value, low, high, length)), 2 * length, "0"))
    )
    return F.unhex(text)


def imapa_length(low: float, high: float, precision: float) -> int:
    """Octets that the mapping of [low, high] needs for a precision."""
    if not low < high or not 0 < precision < high - low:
        raise ValueError("low < high and 0 < precision < high - low")
    mantissa, exponent = math.frexp(high - low)
    bits = exponent - (mantissa == 0.5) - (math.frexp(precision)[1] - 1) + 1
    return (bits + 7) // 8


def mapped_decode(raw: Column, bits: int, low: float, high: float, signed: bool) -> Column:
    """A linear mapping of an integer of ``bits`` bits onto [low, high]; the least signed value is a special: null."""
    if signed:
        half = (1 << (bits - 1)) - 1
        value = F.when(raw >= 1 << (bits - 1), raw - (1 << bits)).otherwise(raw)
        return F.when(value != -(half + 1), value * ((high - low) / (2 * half)) + (high + low) / 2)
    return raw * ((high - low) / ((1 << bits) - 1)) + low


def misp_to_utc(misp: Column, leap: Column, correction: Column) -> Column:
    """UTC microseconds of a monotonic precision time."""
    return misp + correction - leap * 1_000_000


def nano_to_micro(ns: Column) -> Column:
    """Microseconds, halves up, in integers."""
    return F.floor((ns + 500).cast("decimal(20,0)") / F.lit(1000)).cast("long")


def pts_encode(ticks: Column) -> Column:
    """The five octets of a 33-bit presentation time, with the marks 0010 and 1."""
    b = [
        F.lit(0x21) + F.shiftright(ticks, 30).bitwiseAND(7) * 2, F.shiftright(ticks, 22).bitwiseAND(255),
        F.shiftright(ticks, 15).bitwiseAND(127) * 2 + 1, F.shiftright(ticks, 7).bitwiseAND(255), ticks.bitwiseAND(127) * 2 + 1,
    ]
    return F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in b]))


def pts_decode(raw: Column) -> Column:
    """The 33-bit time of five octets; null where a mark bit is missing."""
    b = [_number(raw.substr(k, 1)) for k in range(1, 6)]
    value = F.shiftright(b[0], 1).bitwiseAND(7) * (1 << 30) + b[1] * (1 << 22) + F.shiftright(b[2], 1) * (1 << 15) + b[3] * (1 << 7) + F.shiftright(b[4], 1)
    marked = (b[0] % 2 == 1) & (b[2] % 2 == 1) & (b[4] % 2 == 1)
    return F.when(marked, value)


#: every octet with its bits turned round
_TURNED = bytes(int(f"{n:08b}"[::-1], 2) for n in range(256))


#: octets whose sums are worked out at once, longer rows alone, so that memory doesn't grow with the rows of a batch
SUMMED = 1 << 20


def _sums_16(rows: list[bytes]) -> np.ndarray:
    """Of each row, the sum of its 16-bit words modulo 2^16; a row is padded to whole words."""
    words = np.frombuffer(b"".join(x + b"\0" if len(x) % 2 else x for x in rows), ">u2")
    size = np.array([(len(x) + 1) // 2 for x in rows], np.int64)
    total = np.zeros(len(rows), np.int64)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(words, (np.cumsum(size) - size)[some], dtype=np.int64) % 65536
    return total


@F.pandas_udf(LongType())
def _sum_16(raw: pd.Series) -> pd.Series:
    found, part, held = [], [], 0
    for x in raw:
        part.append(x or b"")
        held += len(part[-1])
        if held >= SUMMED:
            found.append(_sums_16(part))
            part, held = [], 0
    return pd.Series(np.concatenate([*found, _sums_16(part)]), index=raw.index).where(raw.notna())


@F.pandas_udf(LongType())
def _crc_32(raw: pd.Series) -> pd.Series:
    # zlib's is the same polynomial with all bits turned round, and inverted at the end
    return raw.map(lambda x: int(f"{zlib.crc32(bytes(x).translate(_TURNED)) ^ 0xFFFFFFFF:032b}"[::-1], 2), na_action="ignore")


@F.pandas_udf(LongType())
def _crc_16(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: binascii.crc_hqx(bytes(x), 0x1D0F), na_action="ignore")


def crc_table(polynomial: int, bits: int) -> list[int]:
    """What each octet adds to a CRC that isn't reflected."""
    table, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for n in range(256):
        c = n << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        table.append(c)
    return table


def running_sum_16(raw: Column) -> Column:
    """The sum of big-endian 16-bit words modulo 2^16; an odd last octet is the high one. Whole batches are summed at once."""
    return _sum_16(raw)


def mpeg2_crc32(raw: Column) -> Column:
    """CRC-32/MPEG-2 (not reflected, no final inversion), which Spark's crc32 is not."""
    return _crc_32(raw)


def crc16_ccitt(raw: Column) -> Column:
    """CRC-16 of polynomial 0x1021 from 0x1D0F."""
    return _crc_16(raw)
