"""Packs of records, labels, masks, presentation times and streams: malformed input, nulls and ends of visibility."""

from pyspark.sql import functions as F

from framewake.functions import codecs, records
from framewake.operators import presentation
from framewake.sources import targets
from framewake.streaming import state


def packs(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "k int, raw binary")


def parsed(df):
    return [tuple(r)[1:] for r in df.orderBy("k").collect()]


def test_commands_and_lists(spark):
    long = ("é" * 128).encode()
    got = parsed(records.commands(packs(spark, b"\x05\x02go", b"\x81\x00\x00", b"\x05\x03go", b"\x05\x02\x20g", b"\x05\x82\x01\x00" + long, b"", None, b"\x05\x02g\x01"), "raw"))
    assert got == [(5, "go", None, None), (128, "", None, None)] + [(None, None, None, "malformed")] * 6
    lists = packs(spark, b"\x00", b"\x00\x01", b"\x81", b"", None, b"\xff" * 9 + b"\x7f")
    assert parsed(records.id_lists(lists, "raw")) == [([0], None), ([0, 1], None), *[(None, "malformed")] * 4]
    assert parsed(records.id_lists(lists, "raw", zero_alone=True))[1] == (None, "malformed")


def test_record_lists(spark):
    got = parsed(records.payloads(packs(spark, b"\x00", b"\x02\x04\x01\x00\x01b\x04\x00\x00\x01a", b"\x03\x04\x02\x04\x01b", b"\x01", b"\x02\x04\x01\x00\x01b\x04\x01\x00\x01a", None), "raw"))
    # nothing of an empty list; the second is whole but out of order; the third tells a part
    assert got == [(None, None, None, None, "malformed"), (3, 2, 4, "b", None), *[(None, None, None, None, "malformed")] * 3]
    assert [r[-1] for r in parsed(records.stores(packs(spark, b"", b"\x07\x01\x01\x01\x01\x01\x01m", b"\x07\x01\x01\x01\x01\x01\x01", b"\x08\x01\x01\x01\x01\x81\x00\x01m"), "raw"))] == ["malformed", None, "malformed", "malformed"]
    assert parsed(records.countries(packs(spark, b"\x01\x40\x00", b"\x01\x10\x00", b"\x01\x01", b"\x01\x01\x01a\x00\x00\x00"), "raw")) == [(64, "", None, None, None), *[(None, None, None, None, "malformed")] * 3]


def test_fixed_layouts(spark):
    df = packs(spark, b"", None, b"\x08" + b"\xe0" + b"\x00" * 7, b"\x00\x00", b"\x09" + b"\x00" * 8).select("k", records.bases(F.col("raw")).alias("b"), records.location(F.col("raw")).alias("l"), records.universal_label(F.col("raw")).alias("u"))
    assert parsed(df) == [(None, None, None)] * 5
    special = packs(spark, b"\x80" + b"\x01" * 9).select("k", records.location(F.col("raw")).alias("l")).first()["l"]
    assert special["latitude"] is None and special["longitude"] is not None and special["sigma_e"] is None


def test_masks(spark):
    none = F.lit(None)
    row = spark.range(1).select(
        records.mask_issues(none.cast("array<bigint>"), none.cast("array<struct<start:bigint,length:bigint>>"), F.lit(4), F.lit(4)).alias("a"),
        records.mask_issues(F.array(*[F.lit(x).cast("long") for x in (1, 2, 6, 5)]), none.cast("array<struct<start:bigint,length:bigint>>"), F.lit(4), F.lit(4)).alias("b"),
        records.mask_issues(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)]), none.cast("array<struct<start:bigint,length:bigint>>"), F.lit(4), F.lit(4)).alias("c"),
    ).first()
    assert tuple(row) == (["empty"], [], ["contour_order"])


def test_visible_counts(spark):
    rows = [("s", 1, 0, "a"), ("s", 2, 5, "b"), ("s", 3, 10, "a"), ("s", 4, 15, None), ("s", 5, 16, None), ("s", 6, 16, "clear"), ("s", 7, 17, "a"), ("t", 1, 0, None)]
    df = spark.createDataFrame(rows, "s string, o int, t long, r string")
    got = {(r["s"], r["o"]): r["visible"] for r in presentation.visible_counts(df, ["s"], ["o"], "t", "r", F.col("r") == "clear", 10).collect()}
    # b is seen at 15, ten after it was told, and not at 16
    assert got == {("s", 1): 1, ("s", 2): 2, ("s", 3): 2, ("s", 4): 2, ("s", 5): 1, ("s", 6): 0, ("s", 7): 1, ("t", 1): 0}
    assert presentation.visible_counts(df.limit(0), ["s"], ["o"], "t", "r", F.col("r") == "clear", 10).count() == 0


def test_audio_times(spark):
    rows = [(1, None, 1024, 48000, False), (2, 900, 1024, 48000, False), (3, None, 1024, 48000, False), (4, None, 1152, 44100, True), (5, 0, 1152, 44100, False)]
    df = spark.createDataFrame(rows, "o int, anchor long, samples long, rate long, cut boolean").withColumn("s", F.lit("s"))
    got = [r["presented"] for r in presentation.audio_times(df, ["s"], ["o"], "anchor", "samples", "rate", F.col("cut")).orderBy("o").collect()]
    assert got == [None, 900.0, 900.0 + 1024 * 90_000 / 48_000, None, 0.0]


def test_distinct_within(spark, tmp_path):
    rows = [(i, i % 3) for i in range(30)]
    spark.createDataFrame(rows, "i long, k long").withColumn("at", F.timestamp_seconds("i")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, k long, at timestamp").parquet(str(tmp_path / "in"))
    out = state.run_once(state.distinct_within(stream, "at", "1 hour", ["k"]), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["k"] for r in out.collect()) == [0, 1, 2]


def test_lengths_of_values(spark):
    long = "x" * 200
    raw = spark.range(1).select(F.concat(F.lit(b"\x01\x01"), codecs.ber_length(F.lit(200).cast("long")), F.lit(long).cast("binary")).alias("raw"), F.lit(0).alias("k"))
    assert records.countries(raw, "raw").first()["overflight"] == long


def test_target_series(spark):
    one, two = b"\x04\x01\x05\x01\x09", b"\x07\x02\x05\x01\x09\x05\x01\x08"
    got = parsed(targets.target_items(packs(spark, one + two, one + one, b"\x01\x01" + one, one + b"\x09\x02", b"", None), "raw"))
    nine = lambda target, issue=None: (target, 5, b"\x09", issue)
    assert [(t, tag, raw and bytes(raw), issue) for t, tag, raw, issue in got] == [
        nine(1), nine(2), (2, 5, b"\x08", "repeated_item"), nine(1), (1, None, None, "repeated_target"), (1, None, None, "no_items"), nine(1),
        nine(1), (None, None, None, "malformed"), *[(None, None, None, "no_targets")] * 2,
    ]
