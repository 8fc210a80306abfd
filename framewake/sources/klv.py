"""Key-length-value metadata: local sets as item tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ber(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 128:
        return first, at + 1
    n = first - 128
    if not 1 <= n <= 8 or at + 1 + n > len(data):
        raise ValueError("length")
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def _oid(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value, more = value << 7 | data[at] & 127, data[at] >> 7
        at += 1
        if not more:
            return value, at


def _one_by_one(data: bytes) -> list[tuple]:
    """(tag, start, size, issue) of a set's items, in order."""
    found, at = [], 0
    while at < len(data):
        try:
            tag, at = _oid(data, at)
        except IndexError:
            return [*found, (None, 0, -1, "truncated")]
        try:
            size, at = _ber(data, at)
            if at + size > len(data):
                raise ValueError("value")
        except (ValueError, IndexError):
            return [*found, (tag, 0, -1, "truncated")]
        found.append((tag, at, size, None))
        at += size
    return found


def _in_step(octets: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Items of many sets, one of each set at a time: set, tag, start, size, and sets that aren't plain.

    Plain are tags of up to four octets and lengths of up to three; where anything else stands, or an item reaches beyond its
    set, the set is left to be taken one by one.
    """
    rows, tags, starts, sizes, odd = [], [], [], [], np.zeros(len(start), bool)
    padded = np.concatenate([octets, np.zeros(8, np.uint8)]).astype(np.int64)
    live = np.flatnonzero(start < end)
    at = start[live].copy()
    while len(live):
        tag, going = np.zeros(len(live), np.int64), np.ones(len(live), bool)
        for _ in range(4):
            b = padded[np.minimum(at, len(octets))]
            tag = np.where(going, tag << 7 | b & 127, tag)
            at = at + going
            going &= b >= 128
            if not going.any():
                break
        bad = going | (at >= end[live])
        first = padded[np.minimum(at, len(octets))]
        at = at + 1
        extra = np.where(first > 128, first - 128, 0)
        bad |= (first == 128) | (extra > 2)
        size = np.where(first < 128, first, 0)
        for k in range(2):
            more = extra > k
            if more.any():
                size = np.where(more, size << 8 | padded[np.minimum(at, len(octets))], size)
                at = at + more
        bad |= at + size > end[live]
        odd[live[bad]] = True
        good = ~bad
        live, at, tag, size = live[good], at[good], tag[good], size[good]
        rows.append(live)
        tags.append(tag)
        starts.append(at)
        sizes.append(size)
        at = at + size
        left = at < end[live]
        live, at = live[left], at[left]
    none = np.empty(0, np.int64)
    return (*(np.concatenate([none, *x]) for x in (rows, tags, starts, sizes)), odd)


def _items_of(data: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array]:
    """Items of sets that are read in step: set, ordinal, tag, raw, issue; in the order of the sets."""
    octets = np.frombuffer(b"".join(data), np.uint8)
    end = np.cumsum([len(x) for x in data])
    start = end - np.array([len(x) for x in data], np.int64)
    row, tag, at, size, odd = _in_step(octets, start, end)
    keep = ~odd[row]
    row, tag, at, size = row[keep], tag[keep], at[keep], size[keep]
    told = np.zeros(len(row), bool)
    no_tag = np.zeros(len(row), bool)
    slow = [(i, t, start[i] + a, s, issue) for i in np.flatnonzero(odd).tolist() for t, a, s, issue in _one_by_one(data[i])]
    if slow:
        i, t, a, s, issue = zip(*slow)
        # a tag beyond a long is none
        t = [x if x is not None and x < 1 << 63 else None for x in t]
        row, at, size = np.concatenate([row, i]), np.concatenate([at, a]), np.concatenate([size, s])
        tag = np.concatenate([tag, [x or 0 for x in t]]).astype(np.int64)
        no_tag = np.concatenate([no_tag, [x is None for x in t]])
        told = np.concatenate([told, [x is not None for x in issue]])
    order = np.argsort(row, kind="stable")
    row, tag, at, size, told, no_tag = (x[order] for x in (row, tag, at, size, told, no_tag))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    ordinal = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate([first, [len(row)]])))
    held = np.maximum(size, 0)
    ends = np.concatenate([[0], np.cumsum(held)])
    values = octets[np.repeat(at - ends[:-1], held) + np.arange(ends[-1])]
    column = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.array(ends.astype(np.int32)).buffers()[1], pa.py_buffer(values.tobytes())])
    if told.any():
        column = pc.if_else(pa.array(told), pa.scalar(None, pa.binary()), column)
    issues = pc.if_else(pa.array(told), pa.scalar("truncated"), pa.scalar(None, pa.string()))
    return row, pa.array(ordinal.astype(np.int32)), pa.array(tag, mask=no_tag), column, issues


def local_set_items(df: DataFrame, raw: str = "raw", keys: tuple[str, ...] = ("packet",)) -> DataFrame:
    """Items of local sets: keys, ordinal, tag, raw, and issue for what a malformed set ends with.

    A zero-length item has empty octets. One row in, its items out; nothing is shuffled. The sets of a batch are read in step,
    an item of each at a time.
    """
    n = len(keys)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                row, *columns = _items_of([x or b"" for x in part.column(n).to_pylist()])
                if len(row):
                    kept = [part.column(c).take(pa.array(row)) for c in range(n)]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], [*keys, "ordinal", "tag", "raw", "issue"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ordinal int, tag long, raw binary, issue string"
    return df.select(*keys, raw).mapInArrow(run, schema)


def local_set_lists(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Each row with ``items``, those of its local set as a list of (ordinal, tag, raw, issue), instead of ``raw``: what a set's items say together needs no shuffle."""
    keys = [c for c in df.columns if c != raw]
    n = len(keys)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.slice(k, 4096)
                row, *columns = _items_of([x or b"" for x in part.column(n).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(columns, ["ordinal", "tag", "raw", "issue"]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(n)], lists], [*keys, "items"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", items array<struct<ordinal:int,tag:bigint,raw:binary,issue:string>>"
    return df.select(*keys, raw).mapInArrow(run, schema)


def wide(items: DataFrame, keys: list[str], fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Items to a row a packet: each field of (tag, type), and repeated, the names of fields that a packet has more than once.

    Types: long, an unsigned number, null beyond a signed 64-bit one; unsigned, up to eight octets as decimal(20,0); string;
    binary. Of several the first by ordinal is taken; null if absent or empty.
    """

    def value(tag: int, kind: str):
        raw = F.min_by("raw", F.when((F.col("tag") == tag) & (F.octet_length("raw") > 0), F.col("ordinal")))
        if kind in ("binary", "string"):
            return raw.cast(kind)
        number = F.when(F.octet_length(raw) <= 8, F.conv(F.hex(raw), 16, 10))
        return number.try_cast("long" if kind == "long" else "decimal(20,0)")

    many = [F.when(F.count(F.when(F.col("tag") == tag, 1)) > 1, name) for name, (tag, _) in fields.items()]
    return items.groupBy(*keys).agg(*[value(tag, kind).alias(name) for name, (tag, kind) in fields.items()], F.array_compact(F.array(*many)).alias("repeated"))
