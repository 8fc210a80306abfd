"""Transport files as a data source: pushed filters, files that grow, writers that clash, runs found at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewake.sources import stream_files, transport


def packet(pid, cc, fill):
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | cc]) + bytes([fill]) * 184


def read(spark, path, **options):
    stream_files.register(spark)
    return spark.read.format("transport").option("path", str(path)).options(**options).load()


def test_filters_reach_the_reader(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.ts").write_bytes(b"".join(packet(256 + k % 3, k % 16, k) for k in range(90)))
    (tmp_path / ".hidden.ts").write_bytes(packet(1, 0, 0))
    df = read(spark, tmp_path, rangePackets="7")
    assert df.count() == 180 and read(spark, f"{tmp_path}/a*").count() == 90
    own = df.where(F.col("pid").isin(256, 258) & F.col("file").endswith("a.ts"))
    assert own.count() == 60 and own.agg(F.sum("offset")).first()[0] == sum(188 * k for k in range(90) if k % 3 != 1)
    reader = stream_files.TransportReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    names = [f"file://{tmp_path}/a.ts"]
    left = list(reader.pushFilters([In(("pid",), (256, 257)), EqualTo(("pid",), 257), GreaterThan(("offset",), 5), In(("file",), tuple(names))]))
    assert [type(f) for f in left] == [GreaterThan] and reader.pids == {257} and [p.name for p in reader.partitions()] == names


def test_a_file_that_grows(spark, tmp_path):
    stream_files.register(spark)
    data = b"xx" + b"".join(packet(300, k % 16, k) for k in range(50))
    where, out = tmp_path / "in", str(tmp_path / "out")
    where.mkdir()
    (where / "a.ts").write_bytes(data[: 188 * 20 + 100])
    stream = spark.readStream.format("transport").option("path", str(where)).option("chunkOctets", "1001").load()

    def run():
        going = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        going.processAllAvailable()
        going.stop()

    run()
    assert spark.read.parquet(out).count() == 20
    (where / "a.ts").write_bytes(data)
    (where / "b.ts").write_bytes(data[2:])
    run()  # from the checkpoint
    got = spark.read.parquet(out).orderBy("file", "offset").collect()
    assert [bytes(r["raw"])[4] for r in got] == [*range(50), *range(50)] and got[0]["discarded"] == 2


def test_writing_whole_files(spark, tmp_path):
    stream_files.register(spark)
    rows = spark.range(40).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), F.col("id").cast("string").cast("binary").alias("raw"), "id")
    write = lambda df, mode: df.select("file", "raw").write.format("transport").option("path", str(tmp_path / "o")).mode(mode).save()
    write(rows.repartition(4, "file").sortWithinPartitions("file", "id"), "append")
    assert (tmp_path / "o" / "f1").read_bytes() == b"".join(str(k).encode() for k in range(1, 40, 3))
    with pytest.raises(Exception, match="aren't together|several tasks"):
        write(rows.repartition(4), "append")
    assert sorted(p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")) == ["f0", "f1", "f2"]
    write(rows.where("file = 'f2'").coalesce(1), "overwrite")
    assert [p.name for p in (tmp_path / "o").iterdir() if not p.name.startswith(".")] == ["f2"]


def test_runs_are_found_as_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(30):
        parts = [packet(5, 0, 0) if rng.random() < 0.9 else bytes(rng.integers(0, 256, rng.integers(1, 300), dtype=np.uint8)) for _ in range(40)]
        octets = np.frombuffer(b"".join(parts), np.uint8)
        places, lost = transport.find_packets(octets, len(octets))
        at, passed, want = 0, 0, []
        while at + 188 <= len(octets):
            if octets[at] == 0x47 and (not passed or (octets[at : at + 4 * 188 + 1 : 188] == 0x47).all()):
                want.append((at, passed))
                at, passed = at + 188, 0
            else:
                at, passed = at + 1, passed + 1
        assert list(zip(places.tolist(), lost.tolist())) == want


def test_ranges_find_the_packets_of_the_whole_file(tmp_path):
    # an octet of the payload looks like a sync octet in every packet of a long stretch
    good = bytearray(packet(7, 0, 0))
    good[90] = 0x47
    rng = np.random.default_rng(5)
    parts = []
    for k in range(600):
        parts.append(bytes(good) if k % 200 < 150 else packet(7, 0, k % 50))
        if k % 97 == 50:
            parts.append(bytes(rng.integers(1, 60)))
    data = b"".join(parts)
    (tmp_path / "a.ts").write_bytes(data)
    octets = np.frombuffer(data, np.uint8)
    places, lost = transport.find_packets(octets, len(octets))
    assert len(places) == 600
    for size in (5, 17, 33, 61):
        found = [(o, d) for s in range(0, len(data), size * 188) for b in stream_files.read_range(f"file://{tmp_path}/a.ts", s, min(s + size * 188, len(data)), None) for o, d in zip(b["offset"].to_pylist(), b["discarded"].to_pylist())]
        assert found == list(zip(places.tolist(), lost.tolist()))


def test_gaps_cost_no_more_than_they_are_long():
    octets = np.frombuffer((packet(5, 0, 0) * 8 + bytes(3)) * 4000, np.uint8)

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, key):
            got = super().__getitem__(key)
            Counted.seen += got.size if isinstance(got, np.ndarray) else 1
            return got

    places, lost = transport.find_packets(octets.view(Counted), len(octets))
    assert len(places) == 32_000 and lost.sum() == 3 * 3999 and Counted.seen < 2 * len(octets)


def test_a_search_over_octets_that_are_no_packet_goes_on_block_by_block():
    octets = np.frombuffer(bytes(5_000_000) + packet(5, 0, 0) * 9, np.uint8)
    places, lost = transport.find_packets(octets, len(octets))
    assert places.tolist() == [5_000_000 + 188 * k for k in range(9)] and lost[0] == 5_000_000
    assert transport._settled(octets[4_000_000:], 900_000) is None and transport._settled(octets[4_000_000:], 1_000_100) == 1_000_000


def test_a_range_is_held_block_by_block(tmp_path, monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    gap = lambda: bytes(rng.integers(0, 256, rng.choice([1, 40, 300, 3000]), dtype=np.uint8)) if rng.random() < 0.15 else b""
    data = b"".join(packet(5, k % 16, k % 90) + gap() for k in range(700)) + bytes(90)
    octets = np.frombuffer(data, np.uint8)
    (tmp_path / "a.ts").write_bytes(data)
    places, lost = transport.find_packets(octets, len(octets))
    assert lost.max() > 2000
    for size in (150, 188, 701, 5000):
        monkeypatch.setattr(transport, "BLOCK", size)
        for start, end in ((0, len(data)), (10_007, 90_000), (90_000, len(data))):
            found = [(o, d) for b in stream_files.read_range(f"file://{tmp_path}/a.ts", start, end, None) for o, d in zip(b["offset"].to_pylist(), b["discarded"].to_pylist())]
            assert found == [(p, x) for p, x in zip(places.tolist(), lost.tolist()) if start <= p < end]
    monkeypatch.undo()
    (tmp_path / "b.ts").write_bytes(packet(5, 0, 0) * 100_000)
    tracemalloc.start()
    held = sum(len(b) for b in stream_files.read_range(f"file://{tmp_path}/b.ts", 0, 18_800_000, frozenset([5])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == 100_000 and peak < 12 << 20
