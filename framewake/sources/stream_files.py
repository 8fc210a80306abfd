"""Transport files as a Spark data source: batches and streams by byte ranges, and files written a row group each.

``register(spark)`` makes the format ``transport`` known. Reading takes a file, a folder or a pattern of names in one folder;
rows are (file, offset, discarded, pid, pusi, cc, raw). Filters on file and pid reach the reader: other files aren't opened,
packets of other pids never become rows. As a stream a file may grow; every trigger takes a range of each file, and ranges of
any size give the same rows. Writing takes (file, raw) in the order of the rows of each partition: a file is written under a name
of its own and gets its name only when all tasks are done.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystem
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .transport import PACKET, RANGE_PACKETS, packet_column, range_blocks

SCHEMA = "file string, offset long, discarded long, pid int, pusi boolean, cc int, raw binary"
#: octets of small files, or of small ranges, that one task reads
PACK = 8 << 20


def store_of(path: str) -> tuple[filesystem.FileSystem, str]:
    return filesystem.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_files(path: str) -> list[tuple[str, int]]:
    """(name, octets) of the files at ``path``, in the order of their names; hidden ones aren't listed."""
    folder, _, last = path.rstrip("/").rpartition("/")
    pattern = None
    if any(c in last for c in "*?["):
        path, pattern = folder, last
    store, where = store_of(path)
    info = store.get_file_info(where)
    found = [info] if info.is_file else [] if info.type == filesystem.FileType.NotFound else store.get_file_info(filesystem.FileSelector(where, recursive=True))
    root = path[: len(path) - len(where)] if path.endswith(where) and path != where else "file://"
    own = [(root + f.path, f.size) for f in found if f.is_file and not any(p.startswith((".", "_")) for p in f.path[len(where) :].split("/"))]
    return sorted((n, s) for n, s in own if pattern is None or fnmatch.fnmatch(n.rpartition("/")[2], pattern))


def read_range(name: str, start: int, end: int, pids: frozenset | None) -> Iterator[pa.RecordBatch]:
    """Packets that begin in [start, end) of a file, of ``pids`` if they are named.

    A range reads a few packets before it, to be in step, and after it, to tell a packet from an octet that looks like one. It is
    read block by block, and a block's packets are a batch, so that memory doesn't grow with the range.
    """
    store, where = store_of(name)
    with store.open_input_file(where) as f:
        for octets, begin, at, passed in range_blocks(f, start, end):
            pid = (octets[at + 1].astype(np.int32) & 31) << 8 | octets[at + 2]
            if pids is not None:
                keep = np.isin(pid, list(pids))
                at, passed, pid = at[keep], passed[keep], pid[keep]
            if not len(at):
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at + begin), pa.array(passed), pa.array(pid), pa.array(octets[at + 1] & 64 > 0), pa.array((octets[at + 3] & 15).astype(np.int32)), packet_column(octets, at)],
                ["file", "offset", "discarded", "pid", "pusi", "cc", "raw"],
            )


@dataclass
class Range(InputPartition):
    """A range of a file, and further ranges that are so small that one task reads them all."""

    name: str
    start: int
    end: int
    more: list

    def __init__(self, name: str, start: int, end: int, more: list | None = None):
        self.name, self.start, self.end, self.more = name, start, end, more or []

    def read(self, pids: frozenset | None) -> Iterator[pa.RecordBatch]:
        for name, start, end in [(self.name, self.start, self.end), *self.more]:
            if name:
                yield from read_range(name, start, end, pids)


def packed(spans: list[tuple[str, int, int]], size: int) -> list[Range]:
    """Spans, in their order, cut to ranges of ``size`` octets at most; ranges of less than PACK together go to one task."""
    out: list[Range] = []
    room = 0
    for name, start, end in spans:
        for at in range(start, end, size):
            piece = (name, at, min(at + size, end))
            if out and piece[2] - at <= room:
                out[-1].more.append(piece)
                room -= piece[2] - at
            else:
                out.append(Range(*piece))
                room = PACK - (piece[2] - at)
    return out or [Range("", 0, 0)]


def _pids(options: dict) -> frozenset | None:
    told = options.get("pids")
    return frozenset(map(int, told.split(","))) if told else None


class TransportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangePackets", RANGE_PACKETS)) * PACKET
        self.pids, self.files = _pids(options), None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("pid",), ("file",)):
                yield f
            elif f.attribute == ("pid",):
                self.pids = frozenset(values) if self.pids is None else self.pids & values
            else:
                self.files = values if self.files is None else self.files & values

    def partitions(self):
        files = [(n, s) for n, s in list_files(self.path) if self.files is None or n in self.files]
        return packed([(n, 0, s) for n, s in files], self.size)

    def read(self, partition: Range):
        yield from partition.read(self.pids)


class TransportStreamReader(DataSourceStreamReader):
    """Offsets are the places up to which each file is read. A last packet that isn't whole yet waits for its rest."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangePackets", RANGE_PACKETS)) * PACKET
        self.chunk, self.pids, self.at = int(options.get("chunkOctets", self.size)), _pids(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size in list_files(self.path):
            whole = max(0, size - PACKET + 1)
            if whole > self.at.get(name, 0):
                self.at[name] = min(self.at.get(name, 0) + self.chunk, whole)
        return dict(self.at)

    def partitions(self, start: dict, end: dict):
        # after a restart the places are those of the last batch told
        self.at = {n: max(self.at.get(n, 0), e) for n, e in {**self.at, **end}.items()}
        spans = [(n, start.get(n, 0), e) for n, e in end.items() if e > start.get(n, 0)]
        return packed(spans, self.size)

    def read(self, partition: Range):
        yield from partition.read(self.pids)

    def commit(self, end: dict) -> None:
        return None


@dataclass
class Written(WriterCommitMessage):
    names: str


class TransportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        """The octets of each run of rows of one file, under a hidden name; a file's rows are to be in one partition."""
        names, out, current = [], None, None
        try:
            for row in rows:
                if row["file"] != current:
                    if out is not None:
                        out.close()
                    current = row["file"]
                    if any(current == n for n, _ in names):
                        raise ValueError(f"the rows of {current} aren't together")
                    store, folder = store_of(self.path)
                    store.create_dir(folder, recursive=True)
                    hidden = f"{folder}/.{self.job}-{uuid.uuid4().hex}"
                    names.append((current, hidden))
                    out = store.open_output_stream(hidden)
                out.write(bytes(row["raw"] or b""))
        finally:
            if out is not None:
                out.close()
        return Written(json.dumps(names))

    def commit(self, messages) -> None:
        store, folder = store_of(self.path)
        told = [pair for m in messages if m is not None for pair in json.loads(m.names)]
        if len({n for n, _ in told}) < len(told):
            self.abort(messages)
            raise ValueError("several tasks wrote one file")
        if self.overwrite:
            for name, _ in list_files(self.path):
                store.delete_file(store_of(name)[1])
        for name, hidden in told:
            store.move(hidden, f"{folder}/{name}")

    def abort(self, messages) -> None:
        store, _ = store_of(self.path)
        for m in messages:
            for _, hidden in json.loads(m.names) if m is not None else []:
                if store.get_file_info(hidden).is_file:
                    store.delete_file(hidden)


class TransportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transport"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TransportReader(self.options)

    def streamReader(self, schema):
        return TransportStreamReader(self.options)

    def writer(self, schema, overwrite: bool):
        return TransportWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``transport`` known to the session, and let filters reach data sources of Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TransportFiles)
