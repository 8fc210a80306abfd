"""Edge cases of the operators on small hand-made tables, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from framewake.functions import arrays, codecs, geometry
from framewake.operators import asof, carry, clocks, lifecycle, queues, relations, reports
from framewake.sources import files, klv, transport


def test_time_to_live_is_inclusive(spark):
    df = spark.createDataFrame([(1, 0, "a", 5.0), (1, 30, "b", 1.0), (1, 31, "b", 2.0)], "k int, t long, tag string, v double")
    out = carry.snapshot(df, ["k"], ["t"], "t", {"a": F.col("tag") == "a"}, F.col("v"), 30).orderBy("t").collect()
    assert [r["a"] for r in out] == [5.0, 5.0, None]


def test_clear_and_expiry(spark):
    df = spark.createDataFrame([(0, "u", 1.0), (5, "c", None), (6, "c", None), (7, "u", 2.0), (20, "x", None), (21, "x", None)], "t long, e string, v double").withColumn("k", F.lit(1))
    out = carry.carry_forward(df, ["k"], ["t"], "t", F.col("e") == "u", F.col("e") == "c", F.col("v"), 10).orderBy("t").collect()
    assert [r["state_value"] for r in out] == [1.0, None, None, 2.0, None, None]
    assert [r["cleared"] for r in out] == [False, True, False, False, False, False]
    assert [r["expired"] for r in out] == [False, False, False, False, True, False]


@pytest.mark.parametrize("mode", ["latest", "nearest", "exact"])
def test_asof_against_loops(spark, mode):
    rng = random.Random(3)
    left = [(rng.randint(0, 3), rng.randint(0, 40), i) for i in range(60)]
    right = [(k, t, i) for i, (k, t) in enumerate({(rng.randint(0, 3), rng.randint(0, 40)) for _ in range(40)})]
    got = asof.asof_join(spark.createDataFrame(left, "k int, t long, i int"), spark.createDataFrame(right + [(0, None, 99)], "k int, u long, j int"), ["k"], "t", "u", tolerance=4, mode=mode)
    for r in got.collect():
        own = [(u, j) for k, u, j in right if k == r["k"]]
        if mode == "exact":
            own = [x for x in own if x[0] == r["t"]]
        elif mode == "latest":
            own = [x for x in own if 0 <= r["t"] - x[0] <= 4]
        own = [x for x in own if abs(r["t"] - x[0]) <= 4]
        best = min(own, key=lambda x: (abs(r["t"] - x[0]), x[0]), default=(None, None))
        assert (r["right_u"], r["right_j"]) == best


def test_unwrap_and_half(spark):
    df = spark.createDataFrame([(0, 250), (1, 5), (2, 250), (3, 122)], "n long, x long").withColumn("k", F.lit(1))
    out = clocks.unwrap(df, ["k"], ["n"], "x", 256).orderBy("n").collect()
    assert [r["unwrapped"] for r in out] == [250, 261, 250, 122] and [r["ambiguous"] for r in out] == [False, False, False, True]


def test_leaky_bucket_against_a_loop(spark):
    rng = random.Random(5)
    times = sorted(rng.randint(0, 400) for _ in range(60))
    df = spark.createDataFrame(list(enumerate(times)), "n long, t long").withColumn("k", F.lit(1))
    done, want = 0, []
    for i, t in enumerate(times):
        busy = not i or t >= done
        done = max(t, done) + 7
        want.append((done, -(-(done - t) // 7), busy))
    got = queues.leaky_bucket(df, ["k"], ["n"], "t", 7, 3).orderBy("n").collect()
    assert [(r["departure"], r["fullness"], r["busy_start"]) for r in got] == want


def test_retirement_lasts(spark):
    df = spark.createDataFrame([(1, "A"), (2, "D"), (3, "X"), (4, None), (5, "A")], "n int, s string").withColumn("k", F.lit(1))
    out = lifecycle.lifecycle(df, ["k"], ["n"], "s", [("A", "D")], ["A"], ["D"]).orderBy("n").collect()
    assert [r["issues"] for r in out] == [[], [], ["retired_reused"], ["missing_status", "retired_reused"], ["retired_reused"]]
    assert [r["retired"] for r in out] == [False, True, True, True, True] and [r["observations"] for r in out] == [1, 2, 3, 4, 5]


def test_density_parts_add_up(spark):
    rows = [(i % 10, ["a", "b", "c", None][i % 4]) for i in range(100)] + [(10, "a")]
    out = reports.density_timeline(spark.createDataFrame(rows, "t long, l string"), "t", "l", 5, 1, 0, 10).collect()
    assert sum(r["total"] for r in out) == 101 and all(r["bin"] < 5 for r in out)
    for r in out:
        assert r["total"] == r["other_count"] + sum(int(x.split("=")[1]) for x in r["labels"].split(",") if x)


def test_codecs(spark):
    values = [0, 1, 127, 128, 255, 256, 16383, 16384, 2**31, 2**40]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    got = df.select("n", codecs.ber_length_decode(codecs.ber_length(F.col("n"))).alias("a"), codecs.ber_oid_decode(codecs.ber_oid(F.col("n"))).alias("b"), F.hex(codecs.ber_length(F.col("n"))).alias("h")).collect()
    assert all(r["a"] == r["n"] == r["b"] for r in got) and {r["n"]: r["h"] for r in got}[128] == "8180"
    one = spark.createDataFrame([(bytearray(b"123456789"), bytearray(b"\x01\x02\x03"))], "a binary, b binary")
    r = one.select(codecs.mpeg2_crc32("a").alias("crc"), codecs.running_sum_16(F.col("b")).alias("sum"), codecs.ber_length_decode(F.lit(b"\x80")).alias("bad")).first()
    assert r["crc"] == 0x0376E6E7 and r["sum"] == 0x0102 + 0x0300 and r["bad"] is None


def test_imap_special_values(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (900.0,), (901.0,), (float("nan"),)], "x double")
    got = [r["y"] for r in df.select(codecs.imap_decode(codecs.imap_encode(F.col("x"), 0.0, 900.0, 2), 0.0, 900.0, 2).alias("y")).collect()]
    assert got[0] is None and got[3] is None and got[4] is None and got[1] == 0.0 and abs(got[2] - 900) < 0.05


def test_geometry(spark):
    df = spark.createDataFrame([(190.0, 10.0), (-180.0, 91.0), (179.0, 0.0)], "lon double, lat double")
    got = df.select(geometry.wrap_longitude(F.col("lon")).alias("w"), geometry.point(F.col("lon"), F.col("lat")).alias("p")).collect()
    assert [r["w"] for r in got] == [-170.0, -180.0, 179.0] and [r["p"] is None for r in got] == [True, True, False]
    assert spark.range(1).select(arrays.element(F.array(*map(F.lit, [1, 2, 3, 4])), F.lit(1), F.lit(2), F.lit(2)).alias("x")).first()["x"] is None


def test_local_sets(spark):
    good = bytes([2, 2, 1, 0, 0x81, 0x01, 1, 7, 65, 0])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"\x02\x05\x01")), (3, bytearray()), (4, None)], "packet int, raw binary")
    items = klv.local_set_items(df)
    got = [(r["packet"], r["tag"], r["issue"]) for r in items.orderBy("packet", "ordinal").collect()]
    assert got == [(1, 2, None), (1, 129, None), (1, 65, None), (2, 2, "truncated")]


def test_packets_from_files(spark, tmp_path):
    df = spark.range(6).select(transport.build_packet(F.lit(256), F.col("id") % 16, F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id").cast("string")).cast("binary")).alias("raw"), "id")
    data = b"".join(bytes(r["raw"]) for r in df.orderBy("id").collect())
    (tmp_path / "a.ts").write_bytes(data + b"G12")
    packets = transport.parse_packets(transport.read_packets(spark, str(tmp_path / "a.ts")))
    assert packets.count() == 6 and packets.where("sync_lost or pid <> 256").count() == 0
    assert [bytes(r["data"]) for r in transport.assemble_pes(packets).orderBy("first_offset").collect()] == [b"p0p1p2", b"p3p4p5"]


def test_sidecar_issues(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿TimeStamp,SensorLatitude,Other\n5, 1.5,x\n,2,y\n7,abc,z\n8,,w\n")
    got = files.read_sidecar(spark, str(tmp_path / "a.csv")).select("TimeStamp", "SensorLatitude", "issue").collect()
    assert [tuple(r) for r in got] == [(5, 1.5, None), (None, 2.0, "no TimeStamp"), (7, None, "not a number: SensorLatitude"), (8, None, None)]


def test_processor_chain_order(spark):
    df = spark.createDataFrame([(1, ("a",)), (2, ("b",))], "o int, packet struct<n:string>")
    p = F.col("packet")
    twice = [F.array(p, F.struct(F.upper(p["n"]).alias("n"))), F.when(p["n"] == "b", F.array(p).cast("array<struct<n:string>>")).otherwise(F.array(p, p))]
    out = relations.processor_chain(df, "o", twice).orderBy("order", "pos").collect()
    assert [(r["order"], r["packet"]["n"]) for r in out] == [(1, "a"), (1, "a"), (1, "A"), (1, "A"), (2, "b"), (2, "B"), (2, "B")]


def test_entry(spark):
    import __spark_entry__

    assert "roc_state" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reader_finds_its_step_again(spark, tmp_path):
    packet = lambda k: bytes([0x47, 1, 0, 16 + k % 16]) + bytes([k]) * 184
    data = b"junk\x47!" + b"".join(packet(k) for k in range(30)) + b"\x00" * 77 + b"".join(packet(k) for k in range(30, 60)) + b"\x47\x00"
    (tmp_path / "b.ts").write_bytes(data)
    (tmp_path / "empty.ts").write_bytes(b"")
    for size in (7, 1 << 18):
        got = transport.read_packets(spark, str(tmp_path), size).orderBy("offset").collect()
        assert [bytes(r["raw"])[4] for r in got] == list(range(60)) and got[0]["offset"] == 6 and got[30]["offset"] == 6 + 30 * 188 + 77


def test_codes_out_of_range_are_null(spark):
    one = spark.range(1)
    r = one.select(
        codecs.ber_length(F.lit(-1)).alias("a"), codecs.ber_oid_decode(F.lit(b"\xff" * 9 + b"\x01")).alias("b"), codecs.ber_oid_decode(F.lit(b"\x81\x81")).alias("c"),
        arrays.run_length_expand(F.lit(0), F.lit(1.0), F.array().cast("array<struct<value:double,start:bigint,length:bigint>>")).alias("d"),
        geometry.ring_area(F.array().cast("array<struct<x:double,y:double>>")).alias("e"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (None, None, None, [], 0.0)


def test_latest_of_equal_times_is_by_number(spark):
    left = spark.createDataFrame([(1, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 5, 9), (1, 5, 10)], "k int, u long, j int")
    assert asof.asof_join(left, right, ["k"], "t", "u", right_order=["j"]).first()["right_j"] == 10
    assert [m["j"] for m in asof.asof_all(left, right, ["k"], "t", "u", ["j"]).first()["matches"]] == [9, 10]
