"""Vectorised word and shingle hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_SHINGLE = U(0xD1342543DE82EF95)
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words of more bytes than this are hashed one by one
LONG_WORD = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
#: bytes of words split at white space
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes at most (one longer row stands alone): first row, end row, bytes, offsets."""
    buf, at = string_buffer(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(buf: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within each row, and where each row's words begin."""
    inside = member[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    first = at[:-1][at[:-1] < len(buf)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = at[1:][at[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A quick 64-bit hash of every word, with A-Z taken as a-z.

    Eight bytes at a time are mixed into the hash by a bijection, so words of one length that differ in a single block
    never collide; words of several blocks that do can be solved for, as the mixing has no key. So it serves to count and
    to find, never to decide that two words are equal. Long words are hashed by BLAKE2b.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    low = np.zeros(len(buf) + 8, np.uint8)
    low[: len(buf)] = LOWER[buf]
    block = np.ndarray((len(buf) + 1,), "<u8", low.data, 0, (1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64) * U(_PRIME))
    live, at, left = np.arange(len(starts)), starts, size
    if (long := size > LONG_WORD).any():
        where = np.flatnonzero(long)
        for k, a, b in zip(where.tolist(), starts[where].tolist(), ends[where].tolist()):
            out[k] = int.from_bytes(hashlib.blake2b(low[a:b].data, digest_size=8).digest(), "little")
        live = np.flatnonzero(~long)
        at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] * U(_PRIME) ^ (block[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word first is among the words, and which of these every word is, A-Z taken as a-z.

    Words are told apart by hash and then compared byte by byte; should any two collide, all are told apart by their bytes.
    """
    _, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    low = np.zeros(len(buf) + 8, np.uint8)
    low[: len(buf)] = LOWER[buf]
    block = np.ndarray((len(buf) + 1,), "<u8", low.data, 0, (1,))
    size, a, b = ends - starts, starts, starts[first][which]
    same = (size == size[first][which]).all()
    live = np.flatnonzero(same & (size > 0) & (a != b))
    long = size[live] > LONG_WORD
    for k in live[long].tolist():
        same &= low[a[k] : a[k] + size[k]].tobytes() == low[b[k] : b[k] + size[k]].tobytes()
    live = live[~long]
    a, b, left = a[live], b[live], size[live]
    while len(a) and same:
        same &= not ((block[a] ^ block[b]) & _KEEP[np.minimum(left, 8)]).any()
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    if not same:
        found: dict[bytes, int] = {}
        data = low.tobytes()
        which = np.array([found.setdefault(data[i:j], len(found)) for i, j in zip(starts.tolist(), ends.tolist())], np.int64)
        _, first = np.unique(which, return_index=True)
    return first, which


def word_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of every word, with A-Z taken as a-z. Distinct words, told apart by their bytes, are digested once."""
    if not len(starts):
        return np.empty(0, np.uint64)
    first, which = distinct_words(buf, starts, ends)
    data = LOWER[buf].tobytes()
    found = [hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return np.frombuffer(b"".join(found), "<u8")[which]


def sequence_key(text: str | None) -> bytes | None:
    """128 bits of the BLAKE2b digest of a text's words in order, with A-Z taken as a-z; None if it has no word."""
    words = (text or "").encode().lower().split()  # of bytes: just A-Z, and just ASCII white space
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row (a shorter, non-empty row is one run), and where each row's begin."""
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(number)])
    if not begin[-1]:
        return np.empty(0, np.uint64), begin
    row = np.repeat(np.arange(len(counts)), number)
    pos = np.arange(begin[-1]) - begin[row] + first[row]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    length = np.minimum(counts, size)[row]
    out = length.astype(np.uint64)
    for j in range(size):
        out = mix(out * _SHINGLE ^ np.where(length > j, padded[pos + j], U(0)))
    return out, begin


def release() -> None:
    """Give freed buffers back to the machine: workers outlive their tasks and share the executor's memory."""
    pa.default_memory_pool().release_unused()


def distinct_by_row(values: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
