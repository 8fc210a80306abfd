"""Audio frames of elementary streams: MPEG layer II and ADTS, found across packets and again after damage.

All places of a buffer are tried as headers at once; what a header says leads from each place to the next. Frames are what is
reached that way from a stream's beginning; where the chain breaks, it is taken up at the next place from which two headers follow
one another, and the octets passed over are told.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the standards: stream types, bits a second in thousands by index (0: free), and samples a second
MPEG1, MPEG2, ADTS = 3, 4, 15
BIT_RATES = {MPEG1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), MPEG2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLE_RATES = {MPEG1: (44100, 48000, 32000), MPEG2: (22050, 24000, 16000), ADTS: (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)}
HEADER = {MPEG1: 4, MPEG2: 4, ADTS: 9}
#: samples of a frame, or of one of its blocks
SAMPLES = {MPEG1: 1152, MPEG2: 1152, ADTS: 1024}


def _layer_two(o: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
    """Of each place: the frame's length (0 where no header is), samples a second, samples, bits a second, and channels."""
    n = len(o) - 3
    a, b, c, d = (o[k : k + n].astype(np.int64) for k in range(4))
    rate, sample, padding = c >> 4, c >> 2 & 3, c >> 1 & 1
    good = (a == 0xFF) & (b & 0xFE == (0xFC if kind == MPEG1 else 0xF4)) & (rate > 0) & (rate < 15) & (sample < 3)
    bits = 1000 * np.array((*BIT_RATES[kind], 0))[rate]
    per = np.array((*SAMPLE_RATES[kind], 1))[sample]
    length = np.where(good, 144 * bits // per + padding, 0)
    return length, per, np.full(n, SAMPLES[kind]), bits, np.where(d >> 6 == 3, 1, 2)


def _adts(o: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(o) - 6
    a, b, c, d, e, f, g = (o[k : k + n].astype(np.int64) for k in range(7))
    length, sample = (d & 3) << 11 | e << 3 | f >> 5, c >> 2 & 15
    # MPEG-2, layer 0, low complexity
    good = (a == 0xFF) & (b & 0xFE == 0xF8) & (c >> 6 == 1) & (sample < 13) & (length >= np.where(b & 1, 7, 9))
    per = np.array((*SAMPLE_RATES[ADTS], 1, 1, 1))[sample]
    channels = np.array([0, 1, 2, 3, 4, 5, 6, 8])[(c & 1) << 2 | d >> 6]
    return np.where(good, length, 0), per, SAMPLES[ADTS] * ((g & 3) + 1), np.zeros(n, np.int64), channels


class _Stream:
    """One stream's octets that aren't told yet, and where its packets begin."""

    def __init__(self, kind: int):
        self.kind, self.data, self.base, self.starts, self.passed = kind, b"", 0, [], 0

    def feed(self, parts: list[bytes], orders: list, stamps: list, last: bool) -> list[tuple]:
        end = self.base + len(self.data)
        for part, order, pts in zip(parts, orders, stamps):
            self.starts.append((end, order, pts))
            end += len(part)
        self.data = b"".join([self.data, *parts])
        need = HEADER[self.kind] - (2 if self.kind == ADTS else 0)
        o = np.frombuffer(self.data, np.uint8)
        if len(o) < need:
            length = per = samples = bits = channels = np.empty(0, np.int64)
        else:
            length, per, samples, bits, channels = _adts(o) if self.kind == ADTS else _layer_two(o, self.kind)
        candidates = np.flatnonzero(length)
        follows = candidates + length[candidates]
        beyond = follows >= len(length)
        # places from which another header, or the end, follows; of those that lead beyond what is here, only the end tells
        sure = candidates[beyond | (length[np.minimum(follows, max(len(length) - 1, 0))] > 0)] if len(candidates) else candidates
        open_ = frozenset() if last else frozenset(candidates[beyond].tolist())
        out, at = [], 0
        while at < len(o):
            if at < len(length) and length[at] and not (self.passed and at not in self._set(sure)):
                if at + length[at] > len(o) or self.passed and at in open_:
                    break
                order, pts, first = self._packet(self.base + at)
                out.append((self.base + at, order, pts if first else None, int(length[at]), int(per[at]), int(samples[at]), int(bits[at]) or None, int(channels[at]), self.passed, None))
                self.passed, at = 0, at + int(length[at])
                continue
            if at >= len(length):
                break  # too little is left for a header
            k = int(np.searchsorted(sure, at, side="right"))
            step = int(sure[k]) if k < len(sure) else len(length)
            self.passed, at = self.passed + step - at, step
        if last and at < len(o):
            order, _, _ = self._packet(self.base + at)
            out.append((self.base + at, order, None, len(o) - at, None, None, None, None, self.passed, "truncated"))
        self.base, self.data = self.base + at, self.data[at:]
        keep = max((k for k, s in enumerate(self.starts) if s[0] <= self.base), default=0)
        self.starts = self.starts[keep:]
        self.held = None
        return out

    held = None

    def _set(self, sure: np.ndarray) -> set:
        if self.held is None:
            self.held = set(sure.tolist())
        return self.held

    def _packet(self, place: int) -> tuple:
        """Of the packet that a place is in: its order, its time, and whether this is the first frame that begins in it."""
        k = 0
        while k + 1 < len(self.starts) and self.starts[k + 1][0] <= place:
            k += 1
        self.starts = self.starts[k:]
        start, order, pts = self.starts[0]
        self.starts[0] = (start, order, None)
        return order, pts, True


def audio_frames(pes: DataFrame, keys: Sequence[str], order: str, data: str = "payload", pts: str = "pts", kind: str = "stream_type") -> DataFrame:
    """Frames of audio streams: keys, offset (in the stream), ``order`` (of the packet it begins in), pts, length, sample_rate, samples,
    bit_rate, channels, passed (octets passed over before it) and issue.

    pes: keys, kind (3 or 4 layer II, 15 ADTS), order, octets cut anywhere, and pts. A packet's time goes with the first frame that begins in it. issue: truncated, for
    what is left at a stream's end; it has no header's columns. Rows of a stream are streamed in their order, and just an
    unfinished frame is held between batches.
    """
    types = dict(pes.dtypes)
    n = len(keys)
    rows = pes.where(pes[kind].isin(MPEG1, MPEG2, ADTS)).select(*keys, kind, order, data, pts).repartition(*keys).sortWithinPartitions(*keys, order)
    names = [*keys, "offset", order, "pts", "length", "sample_rate", "samples", "bit_rate", "channels", "passed", "issue"]

    def run(batches):
        owner, stream, heads = None, None, None
        for batch in batches:
            heads = [batch.schema.field(k).type for k in (*range(n), n + 1)]
            owners = list(zip(*(batch.column(k).to_pylist() for k in range(n + 1))))
            orders, parts, stamps = ([x for x in batch.column(k).to_pylist()] for k in (n + 1, n + 2, n + 3))
            edges = [0, *[k for k in range(1, len(owners)) if owners[k] != owners[k - 1]], len(owners)]
            found = []
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if owners[i] != owner:
                    if stream is not None:
                        found += [(*owner[:n], *f) for f in stream.feed([], [], [], True)]
                    owner, stream = owners[i], _Stream(owners[i][n])
                found += [(*owner[:n], *f) for f in stream.feed([p or b"" for p in parts[i:j]], orders[i:j], stamps[i:j], False)]
            if found:
                yield told(found, heads)
        if stream is not None and (found := [(*owner[:n], *f) for f in stream.feed([], [], [], True)]):
            yield told(found, heads)

    def told(found: list, heads: list) -> pa.RecordBatch:
        kinds = [*heads[:n], pa.int64(), heads[n], pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return rows.mapInArrow(run, f"{head}, offset long, `{order}` {types[order]}, pts long, length long, sample_rate int, samples int, bit_rate int, channels int, passed long, issue string")
