"""Rules of orders, counts, cadence and sequence numbers on the cases that tell them from simpler ones."""

import random

from pyspark.sql import functions as F

from framewake.operators import clocks, tables

TTL = 30_000_000


def orders(spark, packets, clears=()):
    """packets: (seq, ts, {id: order})."""
    p = spark.createDataFrame([(1, s, t) for s, t, _ in packets], "k int, seq long, ts long")
    r = spark.createDataFrame([(1, s, t, i, o) for s, t, own in packets for i, o in own.items()], "k int, seq long, ts long, id long, ord long")
    c = spark.createDataFrame([(1, s) for s in clears], "k int, seq long")
    return {(x["seq"], x["id"], x["code"]) for x in tables.order_issues(p, r, c, ["k"], "seq", "ts", "id", "ord", TTL).collect()}


def plain_orders(packets, clears=()):
    held, out = {}, set()
    for seq, ts, own in packets:
        before = {} if seq in clears else {i: v for i, v in held.items() if ts - v[1] <= TTL}
        held = before | {i: (o, ts) for i, o in own.items()}
        new = {i for i, o in own.items() if o < 0 and (i not in before or before[i][0] >= 0)}
        old = [o for i, (o, _) in held.items() if o < 0 and i not in new]
        out |= {(seq, i, "historical_not_decreasing") for i in new if old and own[i] >= min(old)}
        claims = [o for o, _ in held.values()]
        out |= {(seq, i, "duplicate_order") for i, (o, _) in held.items() if o != 32767 and claims.count(o) > 1}
    return out


def test_waypoint_orders(spark):
    assert orders(spark, [(0, 0, {1: -3}), (1, 1, {1: 0}), (2, 2, {2: -2}), (3, 3, {2: -1})]) == set()
    assert orders(spark, [(0, 0, {1: -3}), (1, 1, {2: -2})]) == {(1, 2, "historical_not_decreasing")}
    assert orders(spark, [(0, 0, {1: -3}), (1, TTL + 1, {2: -2})]) == set() == orders(spark, [(0, 0, {1: -3}), (1, 1, {}), (2, 2, {2: -2})], [1])
    rng = random.Random(8)
    packets, ts = [], 0
    for seq in range(200):
        ts += rng.choice([1, 10_000_000, TTL, TTL + 1])
        packets.append((seq, ts, {i: rng.choice([-4, -3, -2, -1, 0, 1, 2, 32767]) for i in rng.sample(range(6), rng.randint(0, 3))}))
    clears = {s for s, _, own in packets if not own and rng.random() < 0.5}
    assert orders(spark, packets, clears) == plain_orders(packets, clears)


def test_payload_restarts(spark):
    rows = [(0, 0, 4, False), (1, 1, None, False), (2, 2, 5, False), (3, TTL + 2, None, False), (4, TTL + 3, None, False), (5, TTL + 4, 6, False), (6, TTL + 5, None, True), (7, TTL + 6, 7, False), (8, TTL + 7, 7, False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, o int, ts long, n int, wipe boolean")
    got = tables.count_restarts(df, ["k"], ["o"], "ts", "n", TTL, F.col("wipe")).orderBy("o").collect()
    assert [r["restart"] for r in got] == [None, None, "count", None, "expired", None, "cleared", None, None]


def test_an_interval_of_exactly_the_limit(spark):
    df = spark.createDataFrame([(1, k, t, t) for k, t in enumerate([0, 250, 499, 500])], "k int, o int, low long, high long")
    got = clocks.bounded_cadence(df, ["k"], ["o"], "low", "high", 250).orderBy("o").collect()
    assert [r["verdict"] for r in got] == ["first", "excessive", "compliant", "compliant"]


def test_overdue_once_until_the_next(spark):
    clock = spark.createDataFrame([(1, o, t, 7, j) for o, t, j in [(0, 0, False), (10, 100, False), (20, 200, False), (30, 300, False), (40, 400, False), (50, 500, False), (60, 600, True), (70, 700, False)]], "k int, o int, ticks long, pid int, jump boolean")
    told = spark.createDataFrame([(1, 5, "PAT"), (35, 35, "PAT")][:1] + [(1, 33, "PAT"), (1, 55, "PMT")], "k int, o int, table string")
    got = clocks.overdue_tables(clock, told, ["k"], "o", "ticks", "pid", "table", 100, 1 << 33, F.col("jump")).collect()
    assert {(r["told_at"], r["clock_at"], r["shortest"], r["longest"]) for r in got} == {(5, 20, 100, 200), (33, 50, 100, 200)}


def test_numbers_against_the_highest(spark):
    rng = random.Random(9)
    rows = []
    for k in range(3):
        at = 65_000 + k
        for o in range(600):
            at += rng.choice([1, 1, 1, 2, 400])
            rows.append((k, o, (at - rng.choice([0, 0, 0, 30_000, 45_000])) % 65_536))
    want = []
    for k in range(3):
        high = None
        for _, o, s in (r for r in rows if r[0] == k):
            u = s if high is None else high + (s - high + 32_768) % 65_536 - 32_768
            want.append((k, o, u, high))
            high = u if high is None else max(high, u)
    df = spark.createDataFrame(rows, "k int, o int, s int").repartition(5)
    got = clocks.unwrap_highest(df, ["k"], ["o"], "s", 65_536).orderBy("k", "o").collect()
    assert [(r["k"], r["o"], r["unwrapped"], r["high"]) for r in got] == want
