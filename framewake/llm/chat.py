"""Chat formatting at the level of tokens.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. The two marks are reserved ids beyond the vocabulary, spliced between
separately encoded segments, so no text can ever produce them. In the text form of a conversation the same strings mark
turns; a ``<``, any backslashes and a ``|`` in a role or text get one backslash more, which is undone by taking one away,
so no text can pass for a mark there either.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import only

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
#: kinds of segments: a mark, a role, a text
MARK, ROLE, TEXT = 0, 1, 2


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and in one line: a line end becomes a backslash and an n, a backslash two."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


class ChatEncoder:
    """Turns to ids and loss masks, and back. ``path``: a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.start = self.library.get_vocab_size()
        self.end = self.start + 1
        self.line = self.library.encode("\n", add_special_tokens=False).ids

    def encode(self, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and loss mask of each turn. The mask covers an assistant's text, and nothing else."""
        pieces = [x for role, text in zip(roles, texts) for x in (escape_role(role), escape(text))]
        coded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        segments, turn, gain = [], [], []
        for k, role in enumerate(roles):
            own = [[self.start], coded[2 * k], self.line, coded[2 * k + 1], [self.end], self.line]
            segments += own
            # the mask rises where an assistant's text begins and falls where it ends
            up = int(role == "assistant")
            gain += [0, 0, 0, up, -up, 0]
            turn.append(sum(map(len, own)))
        sizes = np.array([len(s) for s in segments], np.int64)
        ids = np.fromiter((x for s in segments for x in s), np.int32, int(sizes.sum()))
        step = np.zeros(len(ids) + 1, np.int32)
        np.add.at(step, np.cumsum(sizes) - sizes, np.array(gain, np.int32))
        mask = np.cumsum(step[:-1]).astype(bool)
        cut = np.cumsum(turn)[:-1]
        return (np.split(ids, cut), np.split(mask, cut)) if turn else ([], [])

    def text(self, ids: np.ndarray) -> str:
        """The text form of ids, marks as their strings."""
        marks = np.flatnonzero(ids >= self.start)
        out, at = [], 0
        for k in marks.tolist():
            out += [self.library.decode(ids[at:k].tolist(), skip_special_tokens=False), START if ids[k] == self.start else END]
            at = k + 1
        out.append(self.library.decode(ids[at:].tolist(), skip_special_tokens=False))
        return "".join(out)


_ENCODERS: dict[str, ChatEncoder] = {}


def chat_encoder(path: str) -> ChatEncoder:
    """One encoder for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = ChatEncoder(path)
    return _ENCODERS[path]


def format_turns(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, ids array<int>, mask array<boolean>) of every turn, encoded where it lies, so that a long
    conversation burdens no task. A conversation is its turns' ids in order. Null roles and texts count as empty."""

    def run(batches):
        own = chat_encoder(path)
        for batch in batches:
            for i, j, _, _ in T.chunks(batch.column(3)):
                part = batch.slice(i, j - i)
                roles, texts = ([x or "" for x in part.column(k).to_pylist()] for k in (2, 3))
                ids, mask = own.encode(roles, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.bool_()))],
                    ["conv", "turn", "role", "text", "ids", "mask"],
                )

    rows = only(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    return rows.mapInArrow(run, "conv long, turn long, role string, text string, ids array<int>, mask array<boolean>")


def read_back(formatted: DataFrame, path: str, conv_col: str = "conv_id") -> DataFrame:
    """What ids and masks say of each conversation: turns, their digest, the text under the loss mask, and the text form's length.

    The turns of a conversation stream through one task in order, a turn at a time, because a digest is of them all.
    """

    def run(batches):
        own = chat_encoder(path)
        rows: list[tuple] = []
        at, state = object(), None

        def done():
            name, turns, all_, chars, loss, formatted_chars = state
            return name, turns, all_.hexdigest(), chars, loss.hexdigest(), formatted_chars

        def flush():
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                for conv, ids, mask in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if conv != at:
                        if state:
                            rows.append(done())
                        at, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    ids, mask = np.array(ids, np.int32), np.array(mask, bool)
                    form = own.text(ids)
                    state[5] += len(form)
                    # each turn lies between its marks, its role is the first line
                    for turn in form.split(START)[1:]:
                        role, text = turn[: turn.index(END)].split("\n", 1)
                        state[1] += 1
                        state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    for a, b in zip(edge[::2], edge[1::2]):
                        learnt = unescape(own.text(ids[a:b]))
                        state[3] += len(learnt)
                        state[4].update(learnt.encode())
                if len(rows) >= 1000:
                    yield flush()
                    rows.clear()
        if state:
            rows.append(done())
        if rows:
            yield flush()

    ordered = formatted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "ids", "mask")
    out = ordered.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)


def chat_report(turns: DataFrame, path: str, **columns: str) -> DataFrame:
    """Format all conversations and read them back from the output.

    Defined cases: null roles and texts count as empty; a role may hold line ends and marks; turns with the same number follow in the order of
    role and text, so do turns without one, which come first; turns without a conversation form one; repeated rows are
    repeated turns; an empty table gives an empty table; other columns are ignored.
    """
    return read_back(format_turns(turns, path, **columns), path, columns.get("conv_col", "conv_id"))
