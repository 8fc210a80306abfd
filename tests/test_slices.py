"""Order within a file is kept from slice to slice, and no task holds a file."""

import random
import re

from pyspark.sql import functions as F

from framewake.operators import slices
from framewake.sources import metadata, transport

FAR = slices.WIDTH // 3


def windows(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [m for line in plan.splitlines() if re.match(r"[\s:+|-]*Window \[", line) for m in re.findall(r"windowspecdefinition\(([^)]*)", line)]


def test_numbers_and_carries_cross_slices(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randint(0, 2), rng.randint(0, 400)) for _ in range(300)})
    df = spark.createDataFrame(rows, "k int, t long")
    got = slices.numbered(df.withColumn("s", slices.slice_of("t", 7)), ["k"], "s", ["t"], "n").collect()
    assert sorted((r["k"], r["t"], r["n"]) for r in got) == [(k, t, sum(x[0] == k and x < (k, t) for x in rows)) for k, t in rows]
    many = spark.createDataFrame([(1, 5, i) for i in range(500)] + [(2, i, 0) for i in range(50)], "k int, v int, i int")
    told = slices.numbered(slices.ranged(many, ["k", "v", "i"], "s"), ["k"], "s", ["v", "i"], "n").collect()
    assert all(r["n"] == (r["i"] if r["k"] == 1 else r["v"]) for r in told) and len(told) == 550


def test_pes_packets_cross_slices(spark):
    rows = [("f", 7, n * FAR, n % 5 == 2, bytearray(f"p{n}.".encode())) for n in range(30)]
    out = transport.assemble_pes(spark.createDataFrame(rows, "file string, pid int, offset long, pusi boolean, payload binary"))
    want = [b"".join(f"p{n}.".encode() for n in range(a, min(a + 5, 30))) for a in range(2, 30, 5)]
    assert [bytes(r["data"]) for r in out.orderBy("first_offset").collect()] == want
    assert any("__slice" in w for w in windows(out))


def unit(sequence, fragment, data):
    return bytes([0, sequence, fragment << 6 | 31]) + len(data).to_bytes(2, "big") + data


def test_units_cross_slices(spark):
    # a whole unit, one of three parts over several slices, a lost number, a last part without its first
    cells = [(0, 3, b"a"), (1, 2, b"b"), (2, 0, b"c"), (3, 1, b"d"), (5, 3, b"e"), (6, 1, b"f"), (7, 3, b"g")]
    rows = [("f", 1, 9, n * FAR, bytearray(unit(*c)), "synchronous", [0], None, 0xFC, 5, None, True) for n, c in enumerate(cells)]
    rows += [("f", 1, 10, n * FAR, bytearray(b"xyz"[n : n + 1]), "asynchronous", None, None, 0xBD, None, None, n != 1) for n in range(3)]
    schema = "file string, program long, pid long, first_offset long, payload binary, carriage string, services array<int>, issue string, stream_id int, pts long, dts long, aligned boolean"
    pes = spark.createDataFrame(rows, schema).withColumn("packet_length", F.lit(9))
    got = [(r["offset"] // FAR, r["data"] and bytes(r["data"]), r["issue"]) for r in metadata.synchronous_units(pes).orderBy("offset").collect()]
    assert got == [(0, b"a", None), (1, b"bcd", None), (4, b"e", "lost"), (5, None, "fragment"), (6, b"g", None)]
    assert [bytes(r["data"]) for r in metadata.asynchronous_units(pes).orderBy("offset").collect()] == [b"xy", b"z"]
    for units in (metadata.synchronous_units(pes), metadata.asynchronous_units(pes)):
        assert any("__slice" in w for w in windows(units))


def test_orders_meet_within_a_stream(spark):
    from framewake.operators import tables

    packets = spark.createDataFrame([(1, n, n) for n in range(4)], "u int, n long, t long")
    records = spark.createDataFrame([(1, 0, 0, 7, -1), (1, 1, 1, 8, -1), (1, 2, 2, 8, -3)], "u int, n long, t long, id int, o int")
    clears = spark.createDataFrame([(1, 3)], "u int, n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = tables.order_issues(packets, records, clears, ["u"], "n", "t", "id", "o", 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r["n"], r["id"], r["code"]) for r in out.collect()) == [(1, 7, "duplicate_order"), (1, 8, "duplicate_order"), (1, 8, "historical_not_decreasing")]
    # packets with their ids, many for each, are never shuffled
    assert "Generate explode" in plan and "Exchange" not in plan.partition("Generate explode(__all")[0]
