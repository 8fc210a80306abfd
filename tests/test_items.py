"""Items read in step against items read one by one."""

import random

from framewake.sources import klv


def oid(n):
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def test_items_in_step(spark):
    rng = random.Random(14)
    sets = []
    for _ in range(600):
        data = b""
        for _ in range(rng.randint(0, 9)):
            size = rng.choice([0, 1, 3, 130, 300])
            length = bytes([size]) if size < 128 else rng.choice([b"\x81" + bytes([size])] if size < 256 else [b"\x82" + size.to_bytes(2, "big")]) if rng.random() < 0.9 else b"\x84" + size.to_bytes(4, "big")
            data += oid(rng.choice([1, 2, 65, 127, 128, 300, 1 << 20, 1 << 40])) + length + bytes(rng.randrange(256) for _ in range(size))
        if rng.random() < 0.3:
            data = data[: rng.randint(0, len(data))] + rng.choice([b"", b"\x80", b"\x05\x80", b"\xff" * 12])
        sets.append(data)
    df = spark.createDataFrame([(k, bytearray(d) if d or k % 2 else None) for k, d in enumerate(sets)], "packet int, raw binary").repartition(3)
    got = {}
    for r in klv.local_set_items(df).orderBy("packet", "ordinal").collect():
        got.setdefault(r["packet"], []).append((r["ordinal"], r["tag"], None if r["raw"] is None else bytes(r["raw"]), r["issue"]))
    for k, d in enumerate(sets):
        want = [(n, t if t is None or t < 1 << 63 else None, None if issue else d[a : a + s], issue) for n, (t, a, s, issue) in enumerate(klv._one_by_one(d))]
        assert got.get(k, []) == want


def test_sums_of_many_octets_hold_a_part_of_them():
    import tracemalloc

    import pandas as pd

    from framewake.functions import codecs

    rows = [bytes([k % 256]) * (k * 37 % 5000) for k in range(4000)] + [None, b"", b"\x01"]
    want = [sum(x << 8 * (k % 2 == 0) for k, x in enumerate(r)) % 65536 if r is not None else None for r in rows]
    tracemalloc.start()
    got = codecs._sum_16.func(pd.Series(rows, dtype=object))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [None if pd.isna(x) else int(x) for x in got] == want
    assert peak < 10 << 20 and sum(len(r or b"") for r in rows) > 9 << 20


def test_items_of_a_packet_are_gathered_without_a_sort_of_all(spark, monkeypatch):
    from pyspark.sql import functions as F

    from framewake.sources import metadata, registry

    time, version, sum_ = b"\x02\x08" + bytes(8), b"\x41\x01\x13", b"\x01\x02"
    bodies = {
        "empty": b"", "truncated": time + b"\x05\x09", "item_143": time + b"\x81\x0f\x00" + version, "amend_and_segment": time + b"\x64\x00\x65\x00" + version, "checksum_place": time + version + b"\x05\x00",
        "time_place": version + time, "time_missing": version, "version_missing": time, "repeated": time + version + version, "checksum": time + version, None: time + version + b"\x64\x00\x64\x00",
    }
    rows = []
    for n, (issue, body) in enumerate(bodies.items()):
        value = body if issue in ("empty", "truncated", "checksum_place") else body + sum_
        key = bytes.fromhex(metadata.LOCAL_SET_KEY)
        start = key + bytes([len(value) + (2 if value.endswith(sum_) else 0)]) + value
        total = sum(x << 8 * (k % 2 == 0) for k, x in enumerate(start)) + (issue == "checksum") & 65535
        end = total.to_bytes(2, "big") if value.endswith(sum_) else b""
        rows += [(n, None if n % 2 else k, bytearray(key), bytearray(value + end), bytearray(start + end), issue) for k in range(9)]
    df = spark.createDataFrame(rows, "n int, pts int, key binary, value binary, packet binary, want string").repartition(3)
    told = metadata.packet_issue(df, ["n", "want"]).select("want", "issue").collect()
    assert len(told) == 99 and all(r["want"] == r["issue"] for r in told)
    # items meet in tasks of a bounded number of packets, and aren't shuffled; a null among the keys loses no packet
    monkeypatch.setattr(metadata, "TASK_PACKETS", 11)
    values = metadata.local_set_values(df, registry.registry(spark), ["n", "pts"])
    assert values.rdd.getNumPartitions() == 10
    wide = values.groupBy("n", "pts").agg(F.max(F.when(F.col("tag") == 2, F.col("exact"))).alias("time"), F.count("*").alias("items"))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert sorted((r["n"], r["pts"], r["time"], r["items"]) for r in wide.collect()) == [(10, k, 0, 5) for k in range(9)]
