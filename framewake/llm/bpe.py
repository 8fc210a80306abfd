"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import only

#: bytes, roughly, of encoded pieces that a worker remembers in each of two generations; it speeds up, and changes nothing
REMEMBERED_BYTES = 96 << 20
#: characters up to which an encoded piece is remembered
REMEMBERED_CHARS = 64
#: bytes of text that are encoded together
CHUNK_BYTES = 2 << 20
_TWO_SPACES = re.compile(r"\s\s|^\s|\s$")


class Encoder:
    """Ranks of a vocabulary file applied to each match of a pattern; no special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(k) for k in range(len(self.bytes))]
        #: every way to make a token of two, as keys of two ranks; one rank more stands for the end of a piece
        self.size = len(self.bytes) + 1
        self.single_byte = np.array([self.ranks.get(bytes([b]), len(self.bytes)) for b in range(256)], np.int64)
        made = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    made[a * self.size + b] = rank
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_ranks = np.array([made[k] for k in self.pair_keys.tolist()], np.int64)
        #: bitmaps of the ranks that wait, 256 a word; all clear between pieces
        self.waiting = [0] * ((len(self.bytes) >> 8) + 1)
        self.codes = [np.uint32(k).tobytes() for k in range(len(self.bytes))]
        #: the ids, as little-endian 32-bit integers, of matches, and of pieces that follow a space; and older ones
        self.forget()

    def forget(self) -> None:
        """Give back what has been remembered."""
        self.tokens: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.held = 0
        T.release()

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of tokens makes, -1 if none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        return [np.frombuffer(x, "<u4").tolist() for x in self._merge(pieces)]

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Merge, in each piece, the pair of the least rank, the leftmost first, until none is in the vocabulary.

        All pieces share one linked list over the positions of their parts' first bytes, in which pieces end at a
        sentinel, and one queue. Positions wait in a bucket for each rank; a bitmap word says which of 256 ranks wait, and
        ``top`` which words aren't zero, so that find-first-set on ``top`` and then on a word gives the least rank. Its
        whole bucket is merged at once. An entry whose position has another pair by now, or none, is stale and skipped.
        Of pairs that overlap, as in a run of one letter, every other one from the left is merged. Should a merge make a
        pair of no greater rank, which a trained vocabulary doesn't, the bucket's order may matter; then the piece is done
        again one position at a time.
        """
        out = [self.codes[rank] if (rank := self.ranks.get(piece)) is not None else None for piece in pieces]
        todo = [k for k, ids in enumerate(out) if ids is None and pieces[k]]
        data = b"".join([pieces[k] for k in todo])
        n, none = len(data), self.size - 1
        ids = np.append(self.single_byte[np.frombuffer(data, np.uint8)], none)
        begin = np.concatenate([[0], np.cumsum([len(pieces[k]) for k in todo])]).astype(np.int64)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[begin[1:] - 1] = n
        before[begin[:-1]] = n
        pair = np.append(self._ranks_of(ids[:-1], ids[after[:-1]]), -1)
        words, buckets, top, again = self.waiting, {}, 0, []

        def wait(positions: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            first = [0, *cut.tolist()]
            for rank, i, j in zip(ranks[first].tolist(), first, [*first[1:], len(ranks)]):
                if rank in buckets:
                    buckets[rank].append(positions[i:j])
                else:
                    buckets[rank] = [positions[i:j]]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)

        live = np.flatnonzero(pair >= 0)
        if len(live):
            wait(live, pair[live])
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            low = word & -word
            rank = at << 8 | (low.bit_length() - 1)
            words[at] = word ^ low
            if word == low:
                top ^= 1 << at
            bucket = buckets.pop(rank)
            i = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            i = i[pair[i] == rank]
            if not len(i):
                continue
            gone = after[i]
            if len(i) > 1 and (overlap := gone[:-1] == i[1:]).any():
                start = np.concatenate([[True], ~overlap])
                since = np.arange(len(i)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                i, gone = i[since % 2 == 0], gone[since % 2 == 0]
            end = after[gone]
            after[i] = end
            before[end] = i
            ids[i] = rank
            pair[gone] = -2
            left = before[i]
            left = left[left < n]
            new = np.unique(np.concatenate([i, left])) if len(left) else i
            pair[new] = found = self._ranks_of(ids[new], ids[after[new]])
            live = found >= 0
            if live.any():
                if found[live].min() <= rank:
                    again += np.unique(np.searchsorted(begin, new[live & (found <= rank)], side="right") - 1).tolist()
                wait(new[live], found[live])
        alive = pair[:n] != -2
        flat = ids[:n][alive].astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(alive)])[begin]).tolist()
        for k, a, b in zip(todo, ends, ends[1:]):
            out[k] = flat[a:b]
        for k in set(again):
            out[todo[k]] = np.array(self._merge_singly(pieces[todo[k]]), "<u4").tobytes()
        return [ids or b"" for ids in out]

    def _merge_singly(self, piece: bytes) -> list[int]:
        """The same for one piece, one position at a time, with a heap of ranks and positions."""
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.ranks.get(piece[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, stop = heappop(waiting)
            gone = after[i]
            if gone >= n or gone < 0 or after[gone] != stop:
                continue
            after[i], after[gone] = stop, -1
            before[stop] = i
            for j, end in ((i, after[stop] if stop < n else 0), (before[i], stop)):
                if j >= 0 and end and (rank := self.ranks.get(piece[j:end])) is not None:
                    heappush(waiting, (rank, j, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts."""
        return [ids.tolist() for ids in self.encode_arrays(texts)]

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts.

        Where white space is a single character between two others, a space belongs to the match that follows it, so the
        text may be cut before each space. Such pieces and matches recur: each is worked out once, and short ones are
        remembered for later calls. When there are too many, those not met since the last time are forgotten.
        """
        if self.held > REMEMBERED_BYTES:
            self.older, self.tokens, self.spaced, self.held = (self.tokens, self.spaced), {}, {}, 0
        known, spaced, find = self.tokens, self.spaced, self.pattern.findall
        heads, tails, fresh = [], [], set()
        for text in texts:
            first, *rest = [text] if _TWO_SPACES.search(text) else text.split(" ")
            heads.append(find(first))
            tails.append(rest)
            fresh.update(rest)

        def recall(wanted: set, now: dict, older: dict) -> None:
            wanted.difference_update(now.keys())
            again = wanted & older.keys()
            wanted -= again
            for x in again:
                now[x] = older[x]
                self.held += 200 + len(x) + len(now[x])

        recall(fresh, spaced, self.older[1])
        cut = {piece: find(" " + piece) for piece in fresh}
        alone = {found[0] for found in cut.values() if len(found) == 1}
        need = {token for found in (*heads, *cut.values()) for token in found}
        recall(need, known, self.older[0])
        need = list(need)
        known.update(zip(need, self._merge([token.encode() for token in need])))
        for piece, found in cut.items():
            spaced[piece] = known[found[0]] if len(found) == 1 else b"".join([known[token] for token in found])
        out = []
        for head, rest in zip(heads, tails):
            out.append(np.frombuffer(b"".join([known[token] for token in head] + [spaced[piece] for piece in rest]), "<u4"))
        for token in need:
            if len(token) > REMEMBERED_CHARS or token in alone:  # ``spaced`` has it
                del known[token]
            else:
                self.held += 200 + len(token) + len(known[token])
        for piece in fresh:
            if len(piece) > REMEMBERED_CHARS:
                del spaced[piece]
            else:
                self.held += 200 + len(piece) + len(spaced[piece])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>, n_tokens) of every whole text. A null text counts as empty; rows and their repeats are kept."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for i, j, _, _ in T.chunks(batch.column(1), CHUNK_BYTES):
                ids = own.encode_arrays([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).view(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "ids"])
        own.forget()

    out = only(docs, id=id_col, text=text_col).mapInArrow(run, "id long, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"))


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, bytes) of every row of ids. Null ids count as none."""

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    out = only(encoded, id=id_col, ids=ids_col).mapInArrow(run, "id long, bytes binary")
    return out.select(F.col("id").alias(id_col), "bytes")


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return ``id_col``, n_tokens, ids_sha256 and decoded_sha256.

    Encoding and decoding follow one another in a task, so ids need no place anywhere.

    Defined cases: a null or empty text has no tokens; very long matches take O(n log n) time; repeated rows come out
    repeated; a null id is an id like others; an empty table gives an empty table; other columns are ignored.
    """

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for i, j, _, _ in T.chunks(batch.column(1), CHUNK_BYTES):
                counts, names, decoded = [], [], []
                for ids in own.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]):
                    counts.append(len(ids))
                    names.append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        own.forget()

    out = only(docs, id=id_col, text=text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
