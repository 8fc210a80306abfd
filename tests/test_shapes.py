"""Contours, check values, requirements and reordering against plain versions and known values."""

import random
from fractions import Fraction
from itertools import combinations

from pyspark.sql import functions as F

from framewake.functions import boundary, identifiers
from framewake.operators import reorder, requirements

KNOWN = "0170F592F02373364AF8AA9162C00F2EB2DA16B74341000841A0BE365B5AB96A3645"
TEXT = "0170:F592-F023-7336-4AF8-AA91-62C0-0F2E-B2DA/16B7-4341-0008-41A0-BE36-5B5A-B96A-3645:D3"


def test_known_identifiers(spark):
    r = spark.range(1).select(
        identifiers.check_value(F.lit("031FA3")).alias("v"), identifiers.core_text(F.unhex(F.lit(KNOWN))).alias("t"), identifiers.parse_core_text(F.lit(TEXT.lower())).alias("p"),
        identifiers.parse_core_text(F.lit(TEXT[:-1] + "2")).alias("c"), identifiers.parse_core_text(F.lit("0170:<bad>:00")).alias("f"), identifiers.parse_core_text(F.lit("")).alias("e"),
        identifiers.parse_core_xml(identifiers.core_xml(F.unhex(F.lit(KNOWN)))).alias("x"), identifiers.check_value(F.lit("0G")).alias("n"),
    ).first()
    assert (r["v"], r["t"], r["n"]) == ("79", TEXT, None) and (r["c"]["issue"], r["f"]["issue"], r["e"]["issue"]) == ("check", "format", "format")
    assert bytes(r["p"]["raw"]).hex().upper() == bytes(r["x"]["raw"]).hex().upper() == KNOWN and r["p"]["issue"] is r["x"]["issue"] is None


def all_pairs_areas(points):
    segments = [(a, b) for a, b in zip(points, points[1:] + points[:1]) if a != b]
    marks = [{a, b} for a, b in segments]
    for i, j in combinations(range(len(segments)), 2):
        for x in boundary._cuts(*segments[i], *segments[j]):
            marks[i].add(x)
            marks[j].add(x)
    edges = {pair for m in marks for pair in zip(sorted(m), sorted(m)[1:])}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, parts = set(), 0
    for x in near:
        if x not in seen:
            parts, stack = parts + 1, [x]
            while stack:
                y = stack.pop()
                if y not in seen:
                    seen.add(y)
                    stack += near[y]
    return len(edges) - len(near) + parts


def test_sweep_against_all_pairs():
    rng = random.Random(10)
    for _ in range(400):
        points = [(Fraction(rng.randint(0, 6)), Fraction(rng.randint(0, 6))) for _ in range(rng.randint(3, 12))]
        assert boundary.bounded_areas(points) == all_pairs_areas(points)
    assert boundary.bounded_areas([(Fraction(0), Fraction(0))] * 3) == 0
    assert [float(x) for x, _ in boundary.straightened([(179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1)])] == [179.5, 180.5, 180.5, 179.5]
    assert boundary.straightened([(0.1, 0), (180.1, 0), (0.1, 1)])[1][0] == Fraction("180.1")


def plain_reorder(rows, bound, modulus):
    out, expected, held = [], None, {}

    def drain():
        nonlocal expected
        while expected in held:
            out.append(("packet", held.pop(expected), None))
            expected = (expected + 1) % modulus

    def nearest():
        nonlocal expected
        n = min(held, key=lambda x: (x - expected) % modulus)
        if n != expected:
            out.append(("loss", held[n], (n - expected) % modulus))
            expected = n
        drain()

    for ref, s in rows:
        if expected is None:
            out.append(("packet", ref, None))
            expected = (s + 1) % modulus
            continue
        d = (s - expected) % modulus
        if d >= modulus // 2 or s in held:
            out.append(("late_or_duplicate", ref, 0))
            continue
        held[s] = ref
        if d == 0:
            drain()
        elif d > bound:
            nearest()
    while held:
        nearest()
    return out


def test_reorder_against_a_plain_buffer(spark):
    rng = random.Random(12)
    rows = []
    for k in range(4):
        numbers = []
        for s in range(65_400, 65_400 + 1500):
            if rng.random() > 0.05:
                numbers += [s] * (2 if rng.random() < 0.05 else 1)
        for a in range(0, len(numbers), 90):
            if rng.random() < 0.4:
                numbers[a : a + 12] = numbers[a : a + 12][::-1]
        numbers.insert(700, numbers[700] + 50)
        rows += [(k, o, k * 10_000 + o, s % 65_536) for o, s in enumerate(numbers)]
    df = spark.createDataFrame(rows, "k int, o int, ref long, s int").repartition(5)
    got = reorder.reordered(df, ["k"], ["o"], "s", "ref", bound=8).collect()
    for k in range(4):
        want = plain_reorder([(r[2], r[3]) for r in rows if r[0] == k], 8, 65_536)
        own = [r for r in got if r["k"] == k]
        packets = sorted((r["place"], r["ref"]) for r in own if r["kind"] == "packet")
        assert [r for _, r in packets] == [r for kind, r, _ in want if kind == "packet"] and [p for p, _ in packets] == list(range(len(packets)))
        assert sorted((r["kind"], r["ref"], r["lost"]) for r in own if r["kind"] != "packet") == sorted(x for x in want if x[0] != "packet")


def test_requirements_at_the_right_packets(spark):
    limit = 30
    groups = {"a": ("5",), "b": ("6", "90"), "never": ("7",), "sensor_altitude": ("15", "75", "104")}
    told = {0: {"5": b"x", "75": b"x"}, 10: {"90": b"x", "6": b""}, 30: {"104": b"x", "5": b""}, 31: {"75": b""}, 41: {}, 62: {"6": b"x"}, 70: {}}
    packets = spark.createDataFrame([(1, n, t) for n, t in enumerate(told)], "k int, n int, t long")
    items = spark.createDataFrame([(1, n, tag, bytearray(raw), False) for n, own in enumerate(told.values()) for tag, raw in own.items()], "k int, n int, tag string, raw binary, bad boolean")
    got = {(r["n"], r["code"], r["requirement"], r["starts"]) for r in requirements.requirement_issues(packets, items, ["k"], "n", "t", groups, limit).collect()}
    assert got == {
        (2, "zero_length", "a", True), (2, "exclusive_or", "sensor_altitude", True), (3, "zero_length", "sensor_altitude", True), (3, "overdue", "a", True), (4, "overdue", "a", False), (5, "overdue", "a", False),
        (6, "overdue", "a", False), (3, "overdue", "never", True), (4, "overdue", "never", False), (5, "overdue", "never", False), (6, "overdue", "never", False), (4, "overdue", "b", True), (5, "overdue", "b", False),
        (5, "overdue", "sensor_altitude", True), (6, "overdue", "sensor_altitude", False), (None, "missing", "never", True), (None, "overdue", "a", True), (None, "overdue", "sensor_altitude", True),
    }


def test_rows_of_one_row_group_are_dealt_to_tasks(spark):
    from framewake import session
    from framewake.plans import packs, records, shapes, video

    assert session.dealt(spark, "/root/testdata/sf0.001", "part", "p_partkey").rdd.getNumPartitions() >= 4
    for module, name in ((shapes, "boundary_contours"), (records, "payload_lists"), (packs, "wavelengths")):
        assert module.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
    assert video.video_chunks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4
