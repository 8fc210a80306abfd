"""Segment and amend sets: sets nested in items 100 and 101 of a local set, opened to rows of their paths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from . import klv

# Fixed values of the standard: items that hold sets, the identifier, the checksum, and items that a set may repeat
SEGMENT, AMEND, IDENTIFIER, CHECKSUM, REPEATABLE = 100, 101, 143, 1, (100, 101, 102, 115)
#: levels of sets below the root
DEEPEST = 17

Row = tuple[list[str], str, int | None, bytes | None, str | None]


def identifier(data: bytes) -> str | None:
    """An identifier's octets as text: its number, or 0 and 32 hexadecimal digits; None if it is malformed."""
    try:
        number, at = klv._oid(data, 0)
    except IndexError:
        return None
    rest = data[at:]
    if len(data) > 17 or len(rest) != (0 if number else 16):
        return None
    return str(number) if number else f"0:{rest.hex()}"


def _items(data: bytes) -> list[tuple[int, bytes]] | None:
    found, at = [], 0
    try:
        while at < len(data):
            tag, at = klv._oid(data, at)
            size, at = klv._ber(data, at)
            if at + size > len(data):
                return None
            found.append((tag, data[at : at + size]))
            at += size
    except (ValueError, IndexError):
        return None
    return found


def opened(data: bytes, kind: str, above: list[str]) -> Iterator[Row]:
    """Rows of one set and of the sets in it: a set's own items first, then its segments, then its amends.

    A set that breaks a rule is a single row with an issue, and what is in it isn't opened.
    """
    items = _items(data)
    tags = [t for t, _ in items or []]
    own = [v for t, v in items or [] if t == IDENTIFIER]
    name = identifier(own[0]) if len(own) == 1 else None
    path = [*above, name or "?"]
    issue = (
        "depth" if len(path) > DEEPEST else "truncated" if items is None else "checksum" if CHECKSUM in tags else "identifier" if name is None
        else "children" if SEGMENT in tags and (AMEND in tags or kind == "amend")
        else "repeated" if len({t for t in tags if t not in REPEATABLE}) < sum(t not in REPEATABLE for t in tags) else None
    )
    if issue:
        yield path, kind, None, None, issue
        return
    yield path, kind, IDENTIFIER, own[0], None
    for tag, value in items:
        if tag not in (IDENTIFIER, SEGMENT, AMEND):
            yield path, kind, tag, value, None
    for child, of in ((SEGMENT, "segment"), (AMEND, "amend")):
        for tag, value in items:
            if tag == child:
                yield from opened(value, of, path)


def branch_items(items: DataFrame, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """Items 100 and 101 (keys, ``order``, tag, raw) opened: keys, path, kind, place, tag, raw, issue. Other items are left out.

    path: identifiers from the root's child down. A set that is there without items has its identifier's row. place: rows of
    one item in the order in which sets take effect, after ``order``; segments of a packet come before its amends. Nothing is
    shuffled; a set of any depth up to 17 is opened in its row.
    """
    columns = [*keys, order]

    def run(batches):
        for batch in batches:
            out = []
            for k, (tag, raw) in enumerate(zip(*(batch.column(len(columns) + i).to_pylist() for i in range(2)))):
                kind = "segment" if tag == SEGMENT else "amend"
                out += [(k, n, *row) for n, row in enumerate(opened(raw or b"", kind, []))]
            if out:
                at, place, path, kinds, tags, values, issues = zip(*out)
                kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(place, pa.int32()), pa.array(path, pa.list_(pa.string())), pa.array(kinds), pa.array(tags, pa.int64()), pa.array(values, pa.binary()), pa.array(issues, pa.string())],
                    [*columns, "place", "path", "kind", "tag", "raw", "issue"],
                )

    types = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", place int, path array<string>, kind string, tag long, raw binary, issue string"
    return items.where(f"tag in ({SEGMENT}, {AMEND})").select(*columns, "tag", "raw").mapInArrow(run, schema)
