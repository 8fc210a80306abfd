"""Geometry as column expressions: longitudes, frames, pixels, projective and planar models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import let


def wrap_longitude(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def point(lon: Column, lat: Column, alt: Column | None = None) -> Column:
    """A GeoJSON point; null if its place is missing or out of range. An altitude is added only if it is from -900 to 40,000."""
    flat = F.array(lon.cast("double"), lat.cast("double"))
    if alt is not None:
        flat = F.when(alt.between(-900, 40_000), F.concat(flat, F.array(alt.cast("double")))).otherwise(flat)
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), F.struct(F.lit("Point").alias("type"), flat.alias("coordinates")))


def offset_corners(lat: Column, lon: Column, offsets: Sequence[tuple[Column, Column]], most: float = 0.075) -> Column:
    """Corners (x, y) from a centre and (latitude, longitude) offsets; null if one is missing or out of range. Longitudes aren't wrapped."""
    good = lat.between(-90, 90) & lon.between(-180, 180)
    for dlat, dlon in offsets:
        good = good & dlat.between(-most, most) & dlon.between(-most, most) & (lat + dlat).between(-90, 90)
    return F.when(good, F.array(*[F.struct((lon + dlon).alias("x"), (lat + dlat).alias("y")) for dlat, dlon in offsets]))


def full_corners(corners: Sequence[tuple[Column, Column]]) -> Column:
    """Corners (x, y) from (latitude, longitude) pairs; null if one is missing or out of range."""
    good = F.lit(True)
    for lat, lon in corners:
        good = good & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, F.array(*[F.struct(lon.alias("x"), lat.alias("y")) for lat, lon in corners]))


def clip_longitude(points: Column, edge: float, above: bool) -> Column:
    """The part of an open ring of (x, y) on one side of a meridian, by walking its edges; an empty array if there is none."""

    def inside(p: Column) -> Column:
        return p["x"] >= edge if above else p["x"] <= edge

    def of(ring: Column) -> Column:
        n = F.size(ring)

        def walk(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            share = (F.lit(edge) - a["x"]) / (b["x"] - a["x"])
            crossing = F.struct(F.lit(edge).alias("x"), (a["y"] + share * (b["y"] - a["y"])).alias("y"))
            return F.array_compact(F.array(F.when(inside(a), a), F.when(inside(a) != inside(b), crossing)))

        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), walk))).otherwise(ring)

    return let(points, of)


def split_antimeridian(points: Column) -> Column:
    """Rings of longitudes in [-180, 180] of an open ring that may cross the antimeridian, each edge taken the short way."""
    # longitudes continued from the first point, so that no edge is longer than half a turn
    start = F.struct(F.element_at(points, 1)["x"].alias("x"), F.array().cast("array<struct<x:double,y:double>>").alias("ring"))

    def on(state: Column, p: Column) -> Column:
        x = state["x"] + F.pmod(p["x"] - state["x"] + 180.0, F.lit(360.0)) - 180.0
        return F.struct(x.alias("x"), F.concat(state["ring"], F.array(F.struct(x.alias("x"), p["y"].alias("y")))).alias("ring"))

    def shifted(ring: Column, by: float) -> Column:
        return F.transform(ring, lambda p: F.struct((p["x"] + by).alias("x"), p["y"].alias("y")))

    def parts(ring: Column) -> Column:
        middle = clip_longitude(clip_longitude(ring, -180.0, True), 180.0, False)
        cut = F.array(middle, shifted(clip_longitude(ring, 180.0, True), -360.0), shifted(clip_longitude(ring, -180.0, False), 360.0))
        return F.filter(cut, lambda r: (F.size(r) > 2) & (ring_area(r) != 0))

    return F.when(F.size(points) > 2, let(F.aggregate(points, start, on)["ring"], parts))


def ring_area(points: Column) -> Column:
    """Twice the signed area of an open ring of (x, y); positive is counter-clockwise."""
    n = F.size(points)
    return F.aggregate(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>")), F.lit(0.0),
        lambda a, i: a + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"],
    )


def closed_ring(points: Column) -> Column:
    """The ring counter-clockwise, with its first point again at the end."""
    turned = F.when(ring_area(points) < 0, F.reverse(points)).otherwise(points)
    return F.concat(turned, F.slice(turned, 1, 1))


def homography(x: Column, y: Column, h: Sequence[float]) -> tuple[Column, Column]:
    """Projective image of (x, y) under eight coefficients; null where the denominator is 0."""
    w = h[6] * x + h[7] * y + 1.0
    ok = w != 0
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def homography_inverse(u: Column, v: Column, h: Sequence[float]) -> tuple[Column, Column]:
    """The point whose image is (u, v)."""
    a, b, c, d, e, f, g, i = h
    ia, ib, ic = e - f * i, c * i - b, b * f - c * e
    id_, ie, if_ = f * g - d, a - c * g, c * d - a * f
    ig, ih, ii = d * i - e * g, b * g - a * i, a * e - b * d
    w = ig * u + ih * v + ii
    ok = w != 0
    return F.when(ok, (ia * u + ib * v + ic) / w), F.when(ok, (id_ * u + ie * v + if_) / w)


def pixel_row_column(pixel: Column, width: Column) -> tuple[Column, Column]:
    """Row and column, from 0, of a pixel number, from 1."""
    row = F.floor((pixel - 1) / width).cast("long")
    return row, pixel - 1 - row * width


def normalised_box(top: Column, left: Column, bottom: Column, right: Column, height: Column, width: Column) -> Column:
    """Left, top, right, bottom of an inclusive pixel box as fractions of the frame."""
    return F.struct((left / width).alias("left"), (top / height).alias("top"), ((right + 1) / width).alias("right"), ((bottom + 1) / height).alias("bottom"))


def bilinear(x: Column, y: Column, corners: Sequence[Column]) -> Column:
    """A value inside a frame from those at its upper left, upper right, lower right and lower left corners."""
    ul, ur, lr, ll = corners
    return (1 - x) * (1 - y) * ul + x * (1 - y) * ur + x * y * lr + (1 - x) * y * ll


def fit_plane(df: DataFrame, x: str, y: str, z: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares z = a x + b y + c for each key; rows with a missing part don't count; a singular fit is null.

    Sums combine before the shuffle; the three equations are solved in closed form.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull() & ~F.isnan(z))
    s = {k: F.sum(e).alias(k) for k, e in {
        "n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "z": F.col(z), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y),
        "yy": F.col(y) * F.col(y), "xz": F.col(x) * F.col(z), "yz": F.col(y) * F.col(z)}.items()}
    m = df.groupBy(*keys).agg(*[e.alias(f"__{k}") for k, e in s.items()])
    c = {k: F.col(f"__{k}") for k in s}
    det = c["xx"] * (c["yy"] * c["n"] - c["y"] * c["y"]) - c["xy"] * (c["xy"] * c["n"] - c["y"] * c["x"]) + c["x"] * (c["xy"] * c["y"] - c["yy"] * c["x"])
    a = c["xz"] * (c["yy"] * c["n"] - c["y"] * c["y"]) - c["xy"] * (c["yz"] * c["n"] - c["y"] * c["z"]) + c["x"] * (c["yz"] * c["y"] - c["yy"] * c["z"])
    b = c["xx"] * (c["yz"] * c["n"] - c["z"] * c["y"]) - c["xz"] * (c["xy"] * c["n"] - c["y"] * c["x"]) + c["x"] * (c["xy"] * c["z"] - c["yz"] * c["x"])
    k = c["xx"] * (c["yy"] * c["z"] - c["yz"] * c["y"]) - c["xy"] * (c["xy"] * c["z"] - c["yz"] * c["x"]) + c["xz"] * (c["xy"] * c["y"] - c["yy"] * c["x"])
    ok = F.abs(det) > 1e-12
    return m.select(*keys, *[F.when(ok, v / det).alias(name) for name, v in (("a", a), ("b", b), ("c", k))])
