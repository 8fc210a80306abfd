"""Streaming state with timers: what can't be seen any more leaves it, keys that never return too."""

from framewake.streaming import state


def feed(spark, tmp_path, schema, batches, shape, at):
    """Rows of each batch in turn, and the rows in state after each."""
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(where)
    stream = shape(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(where))
    going = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
    held = []
    try:
        for rows in batches:
            rows = [(*r[:at], r[at] + T0, *r[at + 1 :]) for r in rows]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
            going.processAllAvailable()
            held.append(sum(s["numRowsTotal"] for s in going.lastProgress["stateOperators"]))
    finally:
        going.stop()
    return spark.read.schema(stream.schema).parquet(out).collect(), held


SECOND = 1_000_000
T0 = 1_000 * SECOND  # the watermark begins at 0


def test_carry_forgets_by_timers(spark, tmp_path):
    schema = "k long, n long, t long, tag string, v double"
    far = 100_000 * SECOND
    batches = [
        [(1, 1, 0, "a", 1.0), (1, 2, 10 * SECOND, "a", 2.0), (1, 3, 10 * SECOND + 30 * SECOND, "a", 3.0), (2, 4, SECOND, "b", None)],
        [(1, 5, 70 * SECOND + 1, "a", 4.0), (2, 6, 5 * SECOND, "b", 5.0), (1, 7, 39 * SECOND, "a", 9.0)],
        [(9, 8, far, "z", 0.0)], [(9, 9, 2 * far, "z", 0.0)],
    ]
    got, held = feed(spark, tmp_path, schema, batches, lambda s: state.streaming_carry(s, "k", "n", "t", "tag", "v", 30 * SECOND, "1 hour"), 2)
    told = {r["n"]: (r["before"], r["late"]) for r in got}
    assert told[1] == (None, False) and told[2] == (1.0, False) and told[3] == (2.0, False) and told[5] == (None, False)
    assert told[6] == (None, False) and told[7] == (None, True)
    assert held[0] > 0 and held[-1] <= 5  # only the last key's rows and timers are left


class Told:
    """A state handle that counts what it is asked."""

    def __init__(self):
        self.calls, self.held = 0, None

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value

    def registerTimer(self, _):
        self.calls += 1


def test_carry_asks_the_state_thrice_for_a_key(spark):
    from pyspark.sql import Row

    handle, carry = Told(), state.Carry(("k", "n", "t", "tag", "v"), {}, 30)
    carry.init(handle)
    rows = [Row(k=1, n=n, t=n // 2, tag="abcde"[n % 5], v=float(n)) for n in range(40)]
    got = [r for part in (rows[:25], rows[25:]) for r in carry.handleInputRows((1,), iter(part), None)]
    assert [r["before"] for r in got] == [None if n < 5 else n - 5.0 for n in range(40)]
    assert handle.calls == 6 and handle.held[0] == 19 and len(handle.held[1]) == 5  # two batches
    again = list(carry.handleInputRows((1,), iter([Row(k=1, n=40, t=19, tag="a", v=1.0), Row(k=1, n=41, t=18, tag="a", v=2.0)]), None))
    assert [(r["n"], r["before"], r["late"]) for r in again] == [(41, None, True), (40, 35.0, False)]
    assert ("a", 1.0, 19) in handle.held[1]  # a touch at the newest time counts


def test_metadata_waits_for_the_media_clock(spark, tmp_path):
    schema = "k long, ref long, media boolean, pts long, at long"
    wrap = (1 << 33) - 90_000
    batches = [
        [(1, 1, False, wrap + 45_000, 0), (1, 2, False, None, 3 * SECOND), (2, 3, False, 77, 0), (2, 4, False, None, 2 * SECOND)],
        [(1, 5, True, None, 4 * SECOND), (1, 6, True, wrap, 5 * SECOND), (1, 7, False, 90_000, 6 * SECOND), (1, 8, False, wrap - 9, 7 * SECOND)],
        [(9, 9, True, 0, 10_000 * SECOND)], [(9, 10, True, 0, 90_000 * SECOND)],
    ]
    got, held = feed(spark, tmp_path, schema, batches, lambda s: state.live_samples(s, "k", 60 * SECOND, "1 minute"), 4)
    assert {r["ref"]: (r["seconds"], r["by_clock"]) for r in got} == {
        1: (0.5, True), 2: (3.0, False), 7: (2.0, True), 8: (0.0, True), 3: (0.0, False), 4: (2.0, False)}
    assert held[0] > held[-1] and held[-1] <= 4
