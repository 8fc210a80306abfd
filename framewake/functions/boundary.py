"""Bounded areas of a contour, in exact arithmetic.

Segments are swept by their left ends, so only those that overlap across are compared; crossings and touches cut them into
edges, and areas are edges - corners + connected parts.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame

Point = tuple[Fraction | int, Fraction | int]


def straightened(points: list[tuple[float | None, float | None]]) -> list[Point] | None:
    """(longitude, latitude) as exact decimals, each longitude on the side nearest to the one before; None if a coordinate is missing."""
    out: list[Point] = []
    for lon, lat in points:
        if lon is None or lat is None or lon != lon or lat != lat:
            return None
        x = Fraction(repr(float(lon)))
        if out:
            turns = (x - out[-1][0] + 180) // 360
            x -= 360 * turns
            if x - out[-1][0] == -180 and turns:
                x += 360
        out.append((x, Fraction(repr(float(lat)))))
    return out


def _cuts(p: Point, q: Point, r: Point, s: Point) -> list[Point]:
    """Points that two segments have in common, of an overlap its ends."""
    (ax, ay), (bx, by), (ox, oy) = (q[0] - p[0], q[1] - p[1]), (s[0] - r[0], s[1] - r[1]), (r[0] - p[0], r[1] - p[1])
    turn = ax * by - ay * bx
    if turn:
        t, u = ox * by - oy * bx, ox * ay - oy * ax
        if turn < 0:
            turn, t, u = -turn, -t, -u
        if not (0 <= t <= turn and 0 <= u <= turn):
            return []
        return [p if t == 0 else q if t == turn else (p[0] + Fraction(t * ax, turn), p[1] + Fraction(t * ay, turn))]
    if ox * ay - oy * ax:
        return []
    between = lambda x, a, b: min(a[0], b[0]) <= x[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= x[1] <= max(a[1], b[1])
    return [x for x in (r, s) if between(x, p, q)] + [x for x in (p, q) if between(x, r, s)]


def bounded_areas(points: list[Point]) -> int:
    """How many areas a closed contour bounds; what is retraced bounds none."""
    # in whole numbers, as the count doesn't depend on the unit; only crossings inside segments may be fractions
    unit = lcm(*(Fraction(c).denominator for p in points for c in p))
    points = [(int(x * unit), int(y * unit)) for x, y in points]
    segments = sorted((min(a, b), max(a, b)) for a, b in zip(points, points[1:] + points[:1]) if a != b)
    marks: list[set[Point]] = [{a, b} for a, b in segments]
    active: list[int] = []
    for k, (a, b) in enumerate(segments):
        active = [j for j in active if segments[j][1][0] >= a[0]]
        low, high = min(a[1], b[1]), max(a[1], b[1])
        for j in active:
            c, d = segments[j]
            if max(c[1], d[1]) >= low and min(c[1], d[1]) <= high:
                for x in _cuts(a, b, c, d):
                    marks[k].add(x)
                    marks[j].add(x)
        active.append(k)
    edges = {pair for m in marks for pair in zip(sorted(m), sorted(m)[1:])}
    root: dict[Point, Point] = {}

    def top(x: Point) -> Point:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    return len(edges) - len(root) + sum(top(x) == x for x in list(root))


def boundary_areas(df: DataFrame, keys: list[str], points: str) -> DataFrame:
    """Contours (an array of lon, lat) to areas and issue: keys, areas, issue.

    vertices: fewer than two. Two vertices are opposite corners: corners, if they share a latitude or longitude. More: areas, if the contour doesn't bound
    exactly one. A contour with a missing coordinate can't be judged: both null. A row is a contour, and is worked out in its task.
    """

    def judged(told: list) -> tuple[int | None, str | None]:
        own = straightened([(p["lon"], p["lat"]) for p in told])
        if len(told) < 2:
            return None, "vertices"
        if own is None:
            return None, None
        if len(own) == 2:
            wrong = own[0][0] == own[1][0] or own[0][1] == own[1][1]
            return (0, "corners") if wrong else (1, None)
        n = bounded_areas(own)
        return n, None if n == 1 else "areas"

    def run(batches):
        for batch in batches:
            found = [judged(told or []) for told in batch.column(len(keys)).to_pylist()]
            n, issue = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n, pa.int64()), pa.array(issue, pa.string())], [*keys, "areas", "issue"])

    types = dict(df.dtypes)
    return df.select(*keys, points).mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", areas long, issue string")
