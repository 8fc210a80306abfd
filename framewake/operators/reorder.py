"""Packets put back into the order of their numbers within a bound, with the losses that the bound makes certain."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Sender:
    """What one sender waits for, and what it holds: at most as many packets as the bound."""

    def __init__(self, bound: int, modulus: int):
        self.bound, self.modulus, self.expected, self.held, self.place = bound, modulus, None, {}, 0

    def take(self, numbers: np.ndarray, first_row: int) -> tuple[list, list]:
        """(row, place) of packets that go out, and (row, kind, expected, number, lost) of what is wrong, for a batch's numbers.

        While nothing is held, a run of numbers that follow one another goes out in one step.
        """
        out, wrong, k = [], [], 0
        while k < len(numbers):
            if not self.held:
                base = int(numbers[k]) if self.expected is None else self.expected
                run = numbers[k:] == (base + np.arange(len(numbers) - k)) % self.modulus
                n = len(run) if run.all() else int(np.argmin(run))
                if n:
                    out += [(first_row + k + i, self.place + i) for i in range(n)]
                    self.place, self.expected, k = self.place + n, (base + n) % self.modulus, k + n
                    continue
            number = int(numbers[k])
            ahead = (number - self.expected) % self.modulus
            if ahead >= self.modulus // 2 or number in self.held:
                wrong.append((first_row + k, "late_or_duplicate", self.expected, number, 0))
            else:
                self.held[number] = first_row + k
                if ahead == 0:
                    self._drain(out)
                elif ahead > self.bound:
                    self._nearest(out, wrong)
            k += 1
        return out, wrong

    def _drain(self, out: list) -> None:
        while self.expected in self.held:
            out.append((self.held.pop(self.expected), self.place))
            self.place, self.expected = self.place + 1, (self.expected + 1) % self.modulus

    def _nearest(self, out: list, wrong: list) -> None:
        number = min(self.held, key=lambda x: (x - self.expected) % self.modulus)
        lost = (number - self.expected) % self.modulus
        if lost:
            wrong.append((self.held[number], "loss", self.expected, number, lost))
            self.expected = number
        self._drain(out)

    def flush(self) -> tuple[list, list]:
        out, wrong = [], []
        while self.held:
            self._nearest(out, wrong)
        return out, wrong


def reordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str, ref: str, bound: int = 32, modulus: int = 65_536) -> DataFrame:
    """Arrivals to what goes out: keys, kind (packet, loss, late_or_duplicate), ``ref`` (of the arrival), place, expected, number, lost.

    A packet goes out when all before it have, or when a packet more than ``bound`` ahead of the one waited for comes: then the nearest held
    packet ends the gap, and the numbers in between are lost. At a sender's end all gaps are. place numbers what goes out, from 0. A number behind the one
    waited for, by less than half the modulus, or held already, is late_or_duplicate. ``ref`` is a whole number.

    A sender's rows are streamed in the order of arrival; at most ``bound`` and one of them are held.
    """
    types = dict(df.dtypes)
    width = len(keys)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(seq).cast("long").alias("__s"), F.col(ref).cast("long").alias("__r"))
    names = [*keys, "kind", ref, "place", "expected", "number", "lost"]

    def table(found: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*found))
        kinds = [*[schema.field(k).type for k in range(width)], pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches):
        owner, sender, refs, seen, schema = None, None, {}, 0, None

        def told(out: list, wrong: list) -> list:
            found = [(*owner, "packet", refs[r], p, None, None, None) for r, p in out]
            found += [(*owner, kind, refs[r], None, e, n, lost) for r, kind, e, n, lost in wrong]
            for r in {*(r for r, _ in out), *(x[0] for x in wrong if x[1] != "loss")}:
                refs.pop(r, None)
            return found

        for batch in batches:
            schema = batch.schema
            owners = list(zip(*(batch.column(k).to_pylist() for k in range(width))))
            numbers, ids = batch.column(width).to_numpy(), batch.column(width + 1).to_pylist()
            edges = [0, *[k for k in range(1, len(owners)) if owners[k] != owners[k - 1]], len(owners)]
            found = []
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if owners[i] != owner:
                    if sender is not None:
                        found += told(*sender.flush())
                    owner, sender, refs, seen = owners[i], _Sender(bound, modulus), {}, 0
                refs.update(zip(range(seen, seen + j - i), ids[i:j]))
                found += told(*sender.take(numbers[i:j], seen))
                seen += j - i
            if found:
                yield table(found, schema)
        if sender is not None and (found := told(*sender.flush())):
            yield table(found, schema)

    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return rows.mapInArrow(run, f"{head}, kind string, `{ref}` long, place long, expected long, number long, lost long")
