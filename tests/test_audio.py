"""Audio frames over packets cut anywhere, against what was written."""

import random

from framewake.sources import audio


def adts(rng):
    size, sample = rng.randint(9, 700), rng.randrange(13)
    return bytes([0xFF, 0xF9, 0x40 | sample << 2, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5, 0xFC]) + bytes(rng.randrange(0, 200) for _ in range(size - 7))


def layer(rng, kind):
    rate, sample, padding = rng.randint(1, 14), rng.randrange(3), rng.randrange(2)
    size = 144000 * audio.BIT_RATES[kind][rate] // audio.SAMPLE_RATES[kind][sample] + padding
    return bytes([0xFF, 0xFD if kind == audio.MPEG1 else 0xF5, rate << 4 | sample << 2 | padding << 1, 0x40]) + bytes(rng.randrange(0, 200) for _ in range(size - 4))


def test_frames_over_packets_cut_anywhere(spark):
    rng = random.Random(15)
    rows, want = [], {}
    for k in range(12):
        kind = (audio.ADTS, audio.MPEG1, audio.MPEG2)[k % 3]
        data, told, passed = b"", [], 0
        for n in range(30):
            if n and n % 7 == 0:
                passed = rng.randint(1, 50)
                data += bytes(passed)
            f = adts(rng) if kind == audio.ADTS else layer(rng, kind)
            told.append((len(data), len(f), passed, None))
            data, passed = data + f, 0
        rest = rng.choice([b"", data[told[0][0] : told[0][0] + told[0][1] - 1]])
        if rest:
            told.append((len(data), len(rest), 0, "truncated"))
        data, at, n, want[k] = data + rest, 0, 0, told
        while at < len(data):
            size = rng.choice([1, 5, 60, 900, 5000])
            rows.append((k, kind, n, bytearray(data[at : at + size]), n * 10))
            at, n = at + size, n + 1
    df = spark.createDataFrame(rows, "k int, stream_type int, n int, payload binary, pts long").repartition(5)
    got = audio.audio_frames(df, ["k"], "n").collect()
    for k, told in want.items():
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["offset"])
        assert [(r["offset"], r["length"], r["passed"], r["issue"]) for r in own] == told
        stamped = [r["n"] for r in own if r["pts"] is not None]
        assert len(stamped) == len(set(stamped)) and all(r["pts"] in (None, r["n"] * 10) for r in own)


def test_a_frame_between_gaps_at_the_end_of_a_batch():
    rng = random.Random(4)
    for kind, make in ((audio.ADTS, adts), (audio.MPEG1, lambda r: layer(r, audio.MPEG1))):
        frames = [make(rng) for _ in range(6)]
        # the third stands between two gaps, the fifth after one
        data = b"".join([*frames[:2], bytes(30), frames[2], bytes(20), *frames[3:5], bytes(9), frames[5]])
        whole = audio._Stream(kind)
        want = whole.feed([data], [0], [None], False) + whole.feed([], [], [], True)
        assert [f[3] for f in want if f[-1] is None] == [len(f) for k, f in enumerate(frames) if k != 2]
        for cut in range(1, len(data)):
            stream = audio._Stream(kind)
            got = stream.feed([data[:cut]], [0], [None], False) + stream.feed([data[cut:]], [1], [None], False) + stream.feed([], [], [], True)
            assert [(f[0], f[3], f[8], f[9]) for f in got] == [(f[0], f[3], f[8], f[9]) for f in want]


def test_streams_of_nothing(spark):
    df = spark.createDataFrame([(1, audio.ADTS, 0, bytearray(b"abc"), None), (2, audio.MPEG1, 0, None, None), (3, 27, 0, bytearray(b"x"), None)], "k int, stream_type int, n int, payload binary, pts long")
    assert [(r["k"], r["length"], r["issue"]) for r in audio.audio_frames(df, ["k"], "n").collect()] == [(1, 3, "truncated")]
