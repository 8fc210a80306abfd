"""Video parameter sets: units found across packets, sequence sets of three codecs, and how they keep to their levels.

Units are cut by Spark: every chunk of an elementary stream is searched with the three octets before it, only units that
hold a sequence set are put together, and one row is made of each. What a set says is then read from its few octets; levels
are a table, and conformity is a column for each rule.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the standards: stream types, frame rates, shapes, names of profiles and levels
MPEG2, AVC, HEVC = 0x02, 0x1B, 0x24
RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}
DISPLAYS = {2: (4, 3), 3: (16, 9), 4: (221, 100)}
SAMPLES = {
    1: (1, 1), 2: (12, 11), 3: (10, 11), 4: (16, 11), 5: (40, 33), 6: (24, 11), 7: (20, 11), 8: (32, 11), 9: (80, 33), 10: (18, 11), 11: (15, 11), 12: (64, 33),
    13: (160, 99), 14: (4, 3), 15: (3, 2), 16: (2, 1),
}
MPEG2_PROFILES = {1: "High", 2: "Spatially Scalable", 3: "SNR Scalable", 4: "Main", 5: "Simple"}
MPEG2_LEVELS = {4: "High", 6: "High 1440", 8: "Main", 10: "Low"}
AVC_WITH_CHROMA = frozenset({44, 83, 86, 100, 110, 118, 122, 128, 134, 135, 138, 139, 244})
#: samples of chroma for one of luma, by chroma format: across and down
CHROMA = {0: (1, 1), 1: (2, 2), 2: (2, 1), 3: (1, 1)}

# Fixed values of the standards: by stream type and level the largest picture and rate of samples (macroblocks for AVC); for
# MPEG-2 Main profile also width, height, frames a second, bits a second and bits of the buffer
LEVELS = """
2 4 - 62668800 1920 1088 60 80000000 9781248
2 8 - 10368000 720 576 30 15000000 1835008
27 9 99 1485
27 10 99 1485
27 11 396 3000
27 12 396 6000
27 13 396 11880
27 20 396 11880
27 21 792 19800
27 22 1620 20250
27 30 1620 40500
27 31 3600 108000
27 32 5120 216000
27 40 8192 245760
36 30 36864 552960
36 60 122880 3686400
36 63 245760 7372800
36 90 552960 16588800
36 93 983040 33177600
36 120 2228224 66846720
36 123 2228224 133693440
36 150 8912896 267386880
36 153 8912896 534773760
"""
FIELDS = {
    "profile_code": "int", "level_code": "int", "profile": "string", "level": "string", "width": "int", "height": "int", "coded_width": "int", "coded_height": "int",
    "rate_num": "long", "rate_den": "long", "aspect_num": "long", "aspect_den": "long", "progressive": "boolean", "chroma": "int", "depth_luma": "int", "depth_chroma": "int",
    "fixed_rate": "boolean", "bit_rate": "long", "buffer_bits": "long", "rate_extended": "boolean", "constrained": "boolean",
}
_CODE = re.compile(rb"\x00\x00\x01")


class Short(ValueError):
    """The octets end within a field."""


class Bits:
    """Reads a number of bits, or an Exp-Golomb code, at a time."""

    def __init__(self, data: bytes):
        self.number, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, width: int) -> int:
        if width > self.left:
            raise Short("short")
        self.left -= width
        return self.number >> self.left & (1 << width) - 1

    def flag(self) -> bool:
        return self.u(1) == 1

    def ue(self) -> int:
        rest = self.number & (1 << self.left) - 1
        zeros = self.left - rest.bit_length()
        if not rest or 2 * zeros + 1 > self.left:
            raise Short("short")
        if zeros > 31:
            raise ValueError("golomb")
        self.left -= zeros
        return self.u(zeros + 1) - 1

    def se(self) -> int:
        code = self.ue()
        return (code + 1) // 2 if code % 2 else -(code // 2)

    def skip_ue(self, n: int) -> None:
        for _ in range(n):
            self.ue()


def without_prevention(data: bytes) -> bytes:
    """Octets without the 3 that keeps two zeros from looking like a start code."""
    return re.sub(rb"\x00\x00\x03(?=[\x00-\x03])", b"\x00\x00", data)


def _ratio(a: int, b: int) -> tuple[int, int]:
    return a // gcd(a, b), b // gcd(a, b)


def mpeg2_sequence(header: bytes, extension: bytes) -> dict:
    """What a sequence header and its extension say, both without their start codes."""
    h, e = Bits(header), Bits(extension)
    width, height, shape, rate, bits = h.u(12), h.u(12), h.u(4), h.u(4), h.u(18)
    marker, buffer, constrained = h.flag(), h.u(10), h.flag()
    if not width or not height:
        raise ValueError("size")
    if not 1 <= shape <= 4:
        raise ValueError("aspect")
    if rate not in RATES:
        raise ValueError("rate")
    if not marker:
        raise ValueError("marker")
    e.u(4)
    escaped, profile, level, progressive, chroma = e.flag(), e.u(3), e.u(4), e.flag(), e.u(2)
    width, height, bits, marker = e.u(2) << 12 | width, e.u(2) << 12 | height, e.u(12) << 18 | bits, e.flag()
    buffer, _, n, d = e.u(8) << 10 | buffer, e.u(1), e.u(2), e.u(5)
    if escaped:
        raise ValueError("escape")
    if not chroma:
        raise ValueError("chroma")
    if not marker:
        raise ValueError("marker")
    if not bits:
        raise ValueError("bit_rate")
    num, den = _ratio(RATES[rate][0] * (n + 1), RATES[rate][1] * (d + 1))
    across, down = DISPLAYS.get(shape) or _ratio(width, height)
    return {
        "profile_code": profile, "level_code": level, "profile": MPEG2_PROFILES.get(profile, f"Reserved ({profile})"), "level": MPEG2_LEVELS.get(level, f"Reserved ({level})"),
        "width": width, "height": height, "coded_width": width, "coded_height": height, "rate_num": num, "rate_den": den, "aspect_num": across, "aspect_den": down,
        "progressive": progressive, "chroma": chroma, "depth_luma": 8, "depth_chroma": 8, "bit_rate": bits * 400, "buffer_bits": buffer * 16384,
        "rate_extended": n > 0 or d > 0, "constrained": constrained,
    }


def _usability(b: Bits, width: int, height: int) -> tuple[int, int] | None:
    """The shape of the picture at the beginning of the usability information; what follows it up to the chroma places is passed over."""
    shape = None
    if b.flag():
        code = b.u(8)
        sample = (b.u(16), b.u(16)) if code == 255 else SAMPLES.get(code)
        if sample and all(sample):
            shape = _ratio(width * sample[0], height * sample[1])
    if b.flag():
        b.u(1)
    if b.flag():
        b.u(4)
        if b.flag():
            b.u(24)
    if b.flag():
        b.skip_ue(2)
    return shape


def _window(b: Bits, width: int, height: int, across: int, down: int) -> tuple[int, int]:
    """The size that is shown of a coded size."""
    if b.flag():
        left, right, top, bottom = (b.ue() for _ in range(4))
        width, height = width - across * (left + right), height - down * (top + bottom)
    if width <= 0 or height <= 0:
        raise ValueError("window")
    return width, height


def avc_sequence(data: bytes) -> dict:
    """What a sequence parameter set of AVC says, its first octet, the unit's type, left out."""
    b = Bits(without_prevention(data))
    profile, flags, level = b.u(8), b.u(8), b.u(8)
    if flags & 3:
        raise ValueError("reserved")
    b.ue()
    chroma, planes, luma, other = 1, False, 8, 8
    if profile in AVC_WITH_CHROMA:
        chroma = b.ue()
        if chroma > 3:
            raise ValueError("chroma")
        planes = chroma == 3 and b.flag()
        luma, other = b.ue() + 8, b.ue() + 8
        b.u(1)
        if b.flag():
            for k in range(12 if chroma == 3 else 8):
                last = step = 8
                for _ in range((16 if k < 6 else 64) if b.flag() else 0):
                    if step:
                        step = (last + b.se()) % 256
                        last = step or last
    b.ue()
    order = b.ue()
    if order > 2:
        raise ValueError("order_count")
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1)
        b.skip_ue(2)
        b.skip_ue(b.ue())
    b.ue()
    b.u(1)
    columns, rows, frames = b.ue() + 1, b.ue() + 1, b.flag()
    if not frames:
        b.u(1)
    b.u(1)
    fields = 1 if frames else 2
    coded = 16 * columns, 16 * rows * fields
    across, down = CHROMA[0 if planes else chroma]
    width, height = _window(b, *coded, across, down * fields)
    shape = rate = fixed = None
    if b.flag():
        shape = _usability(b, width, height)
        if b.flag():
            tick, scale, fixed = b.u(32), b.u(32), b.flag()
            rate = _ratio(scale, 2 * tick) if tick else None
    name = {66: "Constrained Baseline" if flags & 0x40 else "Baseline", 77: "Main", 100: "High"}.get(profile, f"Profile {profile}")
    low = level == 9 and profile == 100 or level == 11 and profile in (66, 77) and flags & 0x10
    return _set(profile, level, name, "1b" if low else f"{level // 10}.{level % 10}", (width, height), coded, rate, shape, frames, chroma, luma, other) | {"fixed_rate": fixed}


def _set(profile, level, name, level_name, size, coded, rate, shape, progressive, chroma, luma, other) -> dict:
    return {
        "profile_code": profile, "level_code": level, "profile": name, "level": level_name, "width": size[0], "height": size[1], "coded_width": coded[0], "coded_height": coded[1],
        "rate_num": rate and rate[0], "rate_den": rate and rate[1], "aspect_num": shape and shape[0], "aspect_den": shape and shape[1], "progressive": progressive, "chroma": chroma,
        "depth_luma": luma, "depth_chroma": other,
    }


def hevc_sequence(data: bytes) -> dict:
    """What a sequence parameter set of HEVC says, its unit's two octets of header left out."""
    b = Bits(without_prevention(data))
    b.u(4)
    layers = b.u(3)
    b.u(4)
    profile = b.u(5)
    b.u(32)
    whole, halves = b.flag(), b.flag()
    b.u(46)
    level = b.u(8)
    told = [(b.flag(), b.flag()) for _ in range(layers)]
    if layers and b.u(2 * (8 - layers)):
        raise ValueError("reserved")
    for own, own_level in told:
        b.u(88 * own + 8 * own_level)
    b.ue()
    chroma = b.ue()
    if chroma > 3:
        raise ValueError("chroma")
    planes = chroma == 3 and b.flag()
    coded = b.ue(), b.ue()
    size = _window(b, *coded, *CHROMA[0 if planes else chroma])
    luma, other, order = b.ue() + 8, b.ue() + 8, b.ue()
    if order > 12:
        raise ValueError("order_count")
    b.skip_ue(3 * (layers + 1 if b.flag() else 1))
    b.skip_ue(6)
    if b.flag() and b.flag():
        _scaling(b)
    b.u(2)
    if b.flag():
        b.u(8)
        b.skip_ue(2)
        b.u(1)
    _reference_sets(b, b.ue())
    if b.flag():
        far = b.ue()
        if far > 32:
            raise ValueError("long_term")
        b.u(far * (order + 5))
    b.u(2)
    shape = rate = None
    if b.flag():
        shape = _usability(b, *size)
        b.u(3)
        if b.flag():
            b.skip_ue(4)
        if b.flag():
            tick, scale = b.u(32), b.u(32)
            if not tick or not scale:
                raise ValueError("timing")
            rate = _ratio(scale, tick * (b.ue() + 1 if b.flag() else 1))
    name = {1: "Main", 2: "Main 10", 3: "Main Still Picture"}.get(profile, f"Profile {profile}")
    major, minor = divmod(level, 30)
    level_name = {0: f"{major}", 3: f"{major}.1", 6: f"{major}.2"}.get(minor, f"Level IDC {level}")
    return _set(profile, level, name, level_name, size, coded, rate, shape, None if whole == halves else whole, chroma, luma, other) | {"fixed_rate": None}


def _scaling(b: Bits) -> None:
    for size, n, step in ((0, 16, 1), (1, 64, 1), (2, 64, 1), (3, 64, 3)):
        for _ in range(0, 6, step):
            b.skip_ue(n + (size > 1) if b.flag() else 1)


def _reference_sets(b: Bits, n: int) -> None:
    if n > 64:
        raise ValueError("reference_sets")
    size = 0
    for k in range(n):
        if k and b.flag():
            b.u(1)
            b.ue()
            # a picture that isn't used may still count for its distance
            size = sum(b.flag() or b.flag() for _ in range(size + 1))
        else:
            size = b.ue() + b.ue()
            if size > 64:
                raise ValueError("reference_sets")
            for _ in range(size):
                b.ue()
                b.u(1)


def _wanted(kind: int, first: int) -> bool:
    if kind == MPEG2:
        return first in (0xB3, 0xB5)
    return first & 31 == 7 if kind == AVC else first & 0x80 == 0 and first >> 1 == 33


def _starts(view: bytes, from_: int) -> list[int]:
    """Places of the octets after start codes, from ``from_`` on."""
    return [m.end() for m in _CODE.finditer(view) if from_ <= m.end() < len(view)]


def sequence_units(chunks: DataFrame, keys: Sequence[str], order: str, data: str = "payload", kind: str = "stream_type") -> DataFrame:
    """Units that hold sequence sets: keys, ``kind``, ``order`` (of the chunk with the octet after the start code), piece, unit.

    chunks: keys, kind, order and octets of an elementary stream, cut anywhere. A chunk is searched together with the three octets before it;
    of other units no octet is handed on. A last unit that nothing ends counts as whole.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    end = lambda n: F.lag(F.when(F.octet_length(data) <= 3, F.col(data)).otherwise(F.substring(data, -3, 3)), n, b"").over(w)
    before = F.concat(end(3), end(2), end(1))
    tail = F.when(F.octet_length(before) <= 3, before).otherwise(F.substring(before, -3, 3))
    own = chunks.where(F.col(kind).isin(MPEG2, AVC, HEVC) & (F.octet_length(data) > 0)).select(*keys, kind, order, data).withColumn("tail", tail)
    n = len(keys)
    types = dict(chunks.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in (*keys, kind, order))

    def look(batches):
        for batch in batches:
            found = []
            for k, body, tail in zip(*(batch.column(c).to_pylist() for c in (n, n + 2, n + 3))):
                view = (tail or b"") + body
                at = _starts(view, len(tail or b""))
                found.append(int(_wanted(k, view[at[-1]])) if at else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "opens"])

    seen = own.mapInArrow(look, f"{head}, `{data}` binary, tail binary, opens int")
    seen = seen.withColumn("open", F.last("opens", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))

    def cut(batches):
        for batch in batches:
            out = []
            for i, (k, body, tail, open_) in enumerate(zip(*(batch.column(c).to_pylist() for c in (n, n + 2, n + 3, n + 5)))):
                tail = tail or b""
                view = tail + body
                at = _starts(view, len(tail))
                if open_ == 1:
                    out.append((i, 0, False, view[len(tail) : at[0] if at else len(view)], bool(at)))
                for p, a in enumerate(at):
                    if _wanted(k, view[a]):
                        stop = at[p + 1] if p + 1 < len(at) else len(view)
                        out.append((i, p + 1, True, view[a:stop], p + 1 < len(at)))
            if out:
                at, piece, starts, parts, ended = zip(*out)
                kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(n + 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(starts), pa.array(parts, pa.binary()), pa.array(ended)], [*keys, kind, order, "piece", "starts", "part", "ended"])

    pieces = seen.select(*keys, kind, order, data, "tail", "opens", "open").mapInArrow(cut, f"{head}, piece int, starts boolean, part binary, ended boolean")
    by = Window.partitionBy(*keys).orderBy(order, "piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("__u", F.sum(F.col("starts").cast("int")).over(by))
    parts = F.sort_array(F.collect_list(F.struct(order, "piece", "part")))
    units = pieces.groupBy(*keys, kind, "__u").agg(F.min(F.struct(order, "piece")).alias("first"), parts.alias("p"), F.max("ended").alias("ended"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["part"]))
    unit = F.when(F.col("ended"), whole.substr(F.lit(1), F.octet_length(whole) - 3)).otherwise(whole)
    return units.select(*keys, kind, f"first.{order}", "first.piece", unit.alias("unit"))


def sequence_sets(units: DataFrame, keys: Sequence[str], order: str, kind: str = "stream_type") -> DataFrame:
    """Units to what they say: keys, ``kind``, ``order``, the columns of FIELDS, and issue.

    A sequence extension of MPEG-2 is read with the last sequence header before it, and is left out if there is none. issue: short, a field
    with a value that isn't allowed (size, aspect, rate, marker, escape, chroma, bit_rate, reserved, order_count, window, golomb,
    long_term, reference_sets, timing, layer), the other columns null.
    """
    first = F.hex(F.substring("unit", 1, 1))
    w = Window.partitionBy(*keys).orderBy(order, "piece").rowsBetween(Window.unboundedPreceding, -1)
    u = units.withColumn("header", F.last(F.when((F.col(kind) == MPEG2) & (first == "B3"), F.col("unit")), ignorenulls=True).over(w))
    extension = (first == "B5") & F.hex(F.substring("unit", 2, 1)).startswith("1") & F.col("header").isNotNull()
    u = u.where((F.col(kind) != MPEG2) | extension).select(*keys, kind, order, "unit", "header")
    n = len(keys)

    def run(batches):
        for batch in batches:
            out = []
            for k, unit, header in zip(*(batch.column(c).to_pylist() for c in (n, n + 2, n + 3))):
                try:
                    if k == HEVC and (len(unit) < 2 or not unit[1] & 7):
                        raise ValueError("layer")
                    found = mpeg2_sequence(header[1:], unit[1:]) if k == MPEG2 else avc_sequence(unit[1:]) if k == AVC else hevc_sequence(unit[2:])
                    out.append([found.get(f) for f in FIELDS] + [None])
                except ValueError as e:
                    out.append([None] * len(FIELDS) + [str(e)])
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            columns = [pa.array(c, kinds[t]) for c, t in zip(zip(*out), [*FIELDS.values(), "string"])] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 2], *columns], [*keys, kind, order, *FIELDS, "issue"])

    types = dict(u.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in (*keys, kind, order))
    return u.mapInArrow(run, f"{head}, " + ", ".join(f"{f} {t}" for f, t in FIELDS.items()) + ", issue string")


def level_limits(spark: SparkSession) -> DataFrame:
    """LEVELS as a table: stream_type, level_code, and the limits l_size, l_rate, l_width, l_height, l_frames, l_bits, l_buffer."""
    rows = [tuple(None if x == "-" else int(x) for x in line.split()) for line in LEVELS.split("\n") if line]
    names = ["stream_type", "level_code", "l_size", "l_rate", "l_width", "l_height", "l_frames", "l_bits", "l_buffer"]
    return spark.createDataFrame([r + (None,) * (9 - len(r)) for r in rows], ", ".join(f"{x} long" for x in names))


def conformity(sets: DataFrame, kind: str = "stream_type") -> DataFrame:
    """Add, null where a rule doesn't apply: profile_ok, size_ok and rate_ok of the level; and of MPEG-2 extension_ok, bits_ok,
    buffer_ok, chroma_ok and constrained_ok. The limits are a fixed table of a few rows."""
    limits = level_limits(sets.sparkSession).withColumnsRenamed({"stream_type": "l_type", "level_code": "l_code"})
    code = F.when((F.col(kind) == AVC) & (F.col("level") == "1b"), 9).otherwise(F.col("level_code"))
    known = F.col("l_code").isNotNull()
    s = sets.join(F.broadcast(limits), (F.col("l_type") == F.col(kind)) & (F.col("l_code") == code), "left")
    mpeg2, avc, hevc = (F.col(kind) == k for k in (MPEG2, AVC, HEVC))
    main = mpeg2 & (F.col("profile") == "Main")
    width, height = F.col("coded_width").cast("long"), F.col("coded_height").cast("long")
    up = lambda x, n: F.floor((x + n - 1) / n)
    across, down = up(width, 16), up(height, 16)
    within: Column = lambda a, b: (a * b <= F.col("l_size")) & (a * a <= F.col("l_size") * 8) & (b * b <= F.col("l_size") * 8)
    # at most so many samples a second: size * num <= limit * den, in whole numbers
    slow = lambda size: size * F.col("rate_num") <= F.col("l_rate") * F.col("rate_den")
    padded = 16 * across * F.when(F.col("progressive"), 16 * down).otherwise(32 * up(height, 32))
    profile_ok = (
        F.when(mpeg2, (F.col("profile") == "Main") & F.col("level").isin("Main", "High"))
        .when(avc, F.col("profile").isin("Constrained Baseline", "Main", "High") & F.col("level_code").isin(*[int(x.split()[1]) for x in LEVELS.split("\n") if x.startswith("27 ")]))
        .when(hevc, (F.col("profile_code") == 2) & known)
    )
    size_ok = F.when(known & main, (width <= F.col("l_width")) & (height <= F.col("l_height"))).when(known & avc, within(across, down)).when(known & hevc, within(width, height))
    timed = known & F.col("rate_num").isNotNull()
    rate_ok = F.when(timed & main, (F.col("rate_num") <= F.col("l_frames") * F.col("rate_den")) & slow(padded)).when(timed & avc, slow(across * down)).when(timed & hevc, slow(width * height))
    s = s.withColumns({
        "profile_ok": profile_ok, "size_ok": size_ok, "rate_ok": rate_ok, "extension_ok": F.when(mpeg2, ~F.col("rate_extended")),
        "bits_ok": F.when(known & main, F.col("bit_rate") <= F.col("l_bits")), "buffer_ok": F.when(known & main, F.col("buffer_bits") <= F.col("l_buffer")),
        "chroma_ok": F.when(main, F.col("chroma") == 1), "constrained_ok": F.when(mpeg2, ~F.col("constrained")),
    })
    return s.drop("l_type", "l_code", "l_size", "l_rate", "l_width", "l_height", "l_frames", "l_bits", "l_buffer")
