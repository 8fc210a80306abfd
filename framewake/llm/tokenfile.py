"""Token ids as Simple-8b blocks: encoding, files in document order, and reading them back.

A file is a table of blocks that Spark writes and commits, so that it can lie in any store and a lost task is just run
again. Columns: part and first (the range of documents, and the ids before the block in it), doc_ids, and payload. A
payload is five little-endian 32-bit counts (documents, length words, id words, ids, escaped ids), then 64-bit words: the
documents' lengths, their ids, and the escaped ids. Lengths give each document's offset in the block.

A word has a selector in its high 4 bits and, in the other 60, as many values of equal width as the selector says, the
first in the lowest bits. Selector 15 stands for one value of over 60 bits, which is kept apart.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as T
from .common import only, shared_dir

#: fixed by the coding: values in a word, and bits of each, by selector
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
#: ids after which a block is closed; a block has whole documents
BLOCK_IDS = 1 << 18
#: bytes, roughly, of encoded words that a worker remembers in each of two generations; it speeds up, and changes nothing
REMEMBERED_BYTES = 96 << 20
U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    if values.max() < 1 << 53:
        return np.frexp(values.astype(np.float64))[1].astype(np.int64)
    return np.array([int(v).bit_length() for v in values.tolist()], np.int64)


def simple8b_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and escaped values, of unsigned 64-bit values. Each word takes as many of the next values as fit."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    widest, span = _bits(values).astype(np.uint8), 1
    take, choice = np.ones(n, np.uint8), np.full(n, ESCAPE, np.uint8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if count > n:
            break
        if count > span:  # the most bits of any of the next ``count`` values, from those of the next ``span``
            widest, span = np.maximum(widest[: n - count + 1], widest[count - span :]), count
        fits = widest <= width
        np.copyto(take[: n - count + 1], np.uint8(count), where=fits)
        np.copyto(choice[: n - count + 1], np.uint8(selector), where=fits)
    # where each word starts: every 32nd by a walk, those between by doubling
    jumps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + take, np.int32(n)), np.int32(n))]
    for _ in range(5):
        jumps.append(jumps[-1][jumps[-1]])
    far, i, starts = jumps.pop().tolist(), 0, []
    while i < n:
        starts.append(i)
        i = far[i]
    starts = np.array(starts)
    while jumps:
        starts = np.column_stack([starts, jumps.pop()[starts]]).ravel()
    starts = starts[starts < n]
    kind = choice[starts]
    words = kind.astype(np.uint64) << U(60)
    for selector, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        if width and (own := kind == selector).any():
            at = starts[own]
            packed = words[own]
            for k in range(count):
                packed |= values[at + k] << U(k * width)
            words[own] = packed
    return words, values[starts[kind == ESCAPE]]


def simple8b_decode(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values of ``words``, all words of a selector at once."""
    kind = (words >> U(60)).astype(np.int64)
    counts = np.append(COUNTS, 1)[kind]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        if width and (own := kind == selector).any():
            step = np.arange(count)
            values = (words[own][:, None] >> (step * width).astype(np.uint64)) & U((1 << width) - 1)
            out[place[own][:, None] + step] = values
    out[place[kind == ESCAPE]] = escaped
    return out


def pack_block(documents: list[np.ndarray]) -> bytes:
    """The payload of a block of documents' ids."""
    lengths, _ = simple8b_encode(np.array([len(d) for d in documents], np.uint64))
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint64)
    words, escaped = simple8b_encode(ids)
    head = np.array([len(documents), len(lengths), len(words), len(ids), len(escaped)], "<u4")
    return head.tobytes() + lengths.astype("<u8").tobytes() + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def unpack_block(payload: bytes) -> list[np.ndarray]:
    """The documents of a block."""
    _, n_lengths, n_words, _, _ = np.frombuffer(payload, "<u4", 5).tolist()
    words = np.frombuffer(payload, "<u8", offset=20)
    lengths = simple8b_decode(words[:n_lengths], words[:0]).astype(np.int64)
    ids = simple8b_decode(words[n_lengths : n_lengths + n_words], words[n_lengths + n_words :])
    return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


_LOWER = bytes(b + 32 if 65 <= b <= 90 or 0xC0 <= b <= 0xDE and b != 0xD7 else b for b in range(256))
_OTHER_LATIN = re.compile(rb"['\x80-\xbf]")
#: kinds of characters of Latin-1 in lower case: white space, others, letters
_KIND = np.ones(256, np.int8)
_KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 0


def _latin(text: bytes) -> bytes | None:
    """A text of ASCII and the letters of Latin-1 without apostrophes, in Latin-1 and lower case; else nothing."""
    if not text.isascii():
        try:
            text = text.decode().encode("latin-1")
        except UnicodeEncodeError:
            return None
    return None if _OTHER_LATIN.search(text) else text.translate(_LOWER)


class WordEncoder:
    """Whole texts through the tokenizers library, word by word.

    The vocabulary's rules drop white space and never join across it, so the ids of a text are those of its words (cut at
    ASCII white space). Words recur: each is given to the library once and its ids are remembered. Where a text has only ASCII
    and the letters of Latin-1, and no apostrophe, the rules also cut between letters and other characters and ignore case;
    such runs are found and told apart, by their bytes, over all texts of a chunk at once.

    With ``added``, the file's added tokens have their own ids, as in the library by default; they are found as written, without
    regard to the rules, so a text that has one is cut at white space only. Without, they are plain text.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if added else []
        self.forget()

    def forget(self) -> None:
        """Give back what has been remembered."""
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}
        self.held = 0
        T.release()

    def _learn(self, known: dict, older: dict, fresh: set, letters: str) -> None:
        """Know the ids of all ``fresh`` words, whose bytes are in ``letters``: remembered, or else from the library."""
        again = fresh & older.keys()
        for key in again:
            known[key] = older[key]
        fresh = list(fresh - again)
        for key, got in zip(fresh, self.library.encode_batch_fast([x.decode(letters) for x in fresh], add_special_tokens=False)):
            known[key] = array("I", got.ids).tobytes()
        self.held += sum(200 + 3 * len(key) for key in (*again, *fresh))

    def _runs(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts as ``_latin`` gives them."""
        data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        kind = _KIND[buf]
        cut = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))  # the last byte is white space, so each run ends at a cut
        own = kind[cut] > 0
        starts, ends = cut[own], cut[1:][own[:-1]]
        first, which = T.distinct_words(buf, starts, ends)
        runs = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        self._learn(self.parts, self.older[1], {x for x in runs if x not in self.parts}, "latin-1")
        found = [self.parts[x] for x in runs]
        # each run's ids, one after another: the place of an id among those of all distinct runs
        ids = np.frombuffer(b"".join(found), "<u4")
        count = np.array([len(x) for x in found], np.int64) >> 2
        begin = np.cumsum(count) - count
        many = count[which]
        after = np.cumsum(many)
        flat = ids[np.arange(after[-1] if len(after) else 0) + np.repeat(begin[which] - after + many, many)]
        text_ends = np.cumsum([len(t) + 1 for t in texts])[:-1]
        return np.split(flat, np.append(0, after)[np.searchsorted(starts, text_ends)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts in UTF-8."""
        if self.held > REMEMBERED_BYTES:  # those not met since the last time are forgotten
            self.older, self.words, self.parts, self.held = (self.words, self.parts), {}, {}, 0
        latin = [None if any(t in text for t in self.added) else _latin(text) for text in texts]
        runs = iter(self._runs([x for x in latin if x is not None]))
        cut = [text.split() if plain is None else None for text, plain in zip(texts, latin)]
        self._learn(self.words, self.older[0], set().union(*[c for c in cut if c is not None]).difference(self.words), "utf-8")
        return [next(runs) if c is None else np.frombuffer(b"".join(map(self.words.__getitem__, c)), "<u4") for c in cut]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def word_encoder(path: str, added: bool = False) -> WordEncoder:
    """One encoder of each kind for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = WordEncoder(path, added)
    return _ENCODERS[path, added]


def write_token_file(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the ids in the order of ``id_col`` to ``out``.

    Texts are range-partitioned by id before they are encoded, so each is encoded once, and every task streams its range
    into blocks. An added token of the tokenizer file in a text has its own id, as in the library by default. Defined cases: a null text counts as empty, its ids are the end id; null ids come first; rows that share an id
    follow one another in the order of their texts.
    """

    def run(batches):
        own, part, first = word_encoder(path, added=True), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0
        schema = ["part", "first", "doc_ids", "payload"]

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack_block(held)], pa.binary())], schema
            )

        for batch in batches:
            for i, j, _, _ in T.chunks(batch.column(1)):
                texts = [t or b"" for t in batch.column(1).slice(i, j - i).cast(pa.binary()).to_pylist()]
                for name, found in zip(batch.column(0).slice(i, j - i).to_pylist(), own.encode(texts)):
                    ids.append(name)
                    held.append(np.append(found, np.uint32(end_id)))
                    size += len(found) + 1
                    if size >= BLOCK_IDS:
                        yield block()
                        ids, held, first, size = [], [], first + size, 0
        if ids:
            yield block()
        T.release()

    rows = only(docs, id=id_col, text=text_col)
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, "part int, first long, doc_ids array<long>, payload binary").write.parquet(out)


def read_token_file(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of a token file: ``id_col``, start (ids before it in the file), n_tokens, ids_crc32, and ids if asked for.

    ids_crc32 is of the ids as little-endian unsigned 32-bit integers. The ids before each range are a sum over ranges, a row each.
    """

    def run(batches):
        for batch in batches:
            for part, first, names, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = [d.astype("<u4") for d in unpack_block(payload)]
                n = np.array([len(d) for d in found], np.int64)
                columns = [pa.array([part] * len(n), pa.int32()), pa.array(names, pa.int64()), pa.array(first + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(d.tobytes()) for d in found], pa.int64())]
                if with_ids:
                    columns.append(pa.array([d.astype(np.int64) for d in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["part", "id", "local", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    blocks = spark.read.schema("part int, first long, doc_ids array<long>, payload binary").parquet(path)
    shape = "part int, id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = blocks.select("part", "first", "doc_ids", "payload").mapInArrow(run, shape)
    # the fourth count of a payload is of its ids
    counts = F.conv(F.concat(*[F.hex(F.substring("payload", 16 - k, 1)) for k in range(4)]), 16, 10).cast("long")
    ranges = blocks.groupBy("part").agg(F.sum(counts).alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range of the file
    out = docs.join(F.broadcast(ranges.select("part", before.alias("before"))), "part")
    return out.select(F.col("id").alias(id_col), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a token file to the shared folder and describe its documents as read back from it."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, out, path, end_id, id_col, text_col)
    return read_token_file(spark, out, id_col, with_ids=False)
