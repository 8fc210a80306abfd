"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Each feature has a lookup table over its quantile bins, and a few pairs of features have one over a coarse grid. The
tables are learnt by cyclic boosting of shallow trees on the logistic loss: every round visits each feature in turn and
adds a small step of a tree of at most four leaves over that feature's bins; pairs follow on what is left. A score is a
sum of table entries, so that scoring is a few vectorised additions a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import only

#: labelled rows that the model is fitted on at most, those of the least hashed ids
TRAIN_ROWS = 20_000
BINS, COARSE, PAIRS = 64, 12, 8

FEATURES = (
    "log_bytes", "upper", "symbol", "pipe", "exclaim", "digit", "stop", "space", "newline", "beyond_ascii",
    "log_words", "word_bytes", "distinct_words", "distinct_pairs", "same_neighbour", "top_byte",
)


def _byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack(
    [_byte_class(bytes(range(65, 91))), _byte_class(b"#$%&*<>{}[]\\^~=+@"), _byte_class(b"|"), _byte_class(b"!?"), _byte_class(b"0123456789"),
     _byte_class(b".,;:"), _byte_class(b" \t"), _byte_class(b"\n\r"), _byte_class(bytes(range(128, 256)))], axis=1,
)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; a null counts as an empty text."""
    out = np.zeros((len(column), len(FEATURES)))
    for i, j, buf, at in T.chunks(column):
        hist = np.stack([np.bincount(buf[a:b], minlength=256) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        size = np.diff(at)
        per = np.maximum(size, 1)[:, None]
        starts, ends, first = T.word_spans(buf, at, T.NOT_SPACE)
        words = T.word_hashes(buf, starts, ends)
        count = np.diff(first)
        per_word = np.maximum(count, 1)
        same = np.zeros(len(words) + 1)
        pairs = np.zeros(len(words), np.uint64)
        if len(words) > 1:
            inner = np.ones(len(words), bool)
            inner[first[:-1][first[:-1] < len(words)]] = False  # the first word of a text has no neighbour before it
            same[2:] = np.cumsum((words[1:] == words[:-1]) & inner[1:])
            pairs[1:] = T.mix(words[1:] * np.uint64(3) + words[:-1])
        spans = list(zip(first[:-1].tolist(), first[1:].tolist()))
        rows = out[i:j]
        rows[:, 0] = np.log1p(size)
        rows[:, 1:10] = hist @ _CLASSES / per
        rows[:, 10] = np.log1p(count)
        rows[:, 11] = (size - hist[:, [32, 9, 10, 11, 12, 13]].sum(axis=1)) / per_word
        rows[:, 12] = [len(np.unique(words[a:b])) for a, b in spans] / per_word
        rows[:, 13] = [len(np.unique(pairs[a + 1 : b])) for a, b in spans] / np.maximum(count - 1, 1)
        rows[:, 14] = (same[first[1:]] - same[np.minimum(first[:-1] + 1, len(words))]) / per_word * (count > 0)
        rows[:, 15] = hist.max(axis=1) / per[:, 0]
    return out


@dataclass
class Model:
    """cuts: bin edges of each feature; tables: an entry for each bin; pairs: (feature, feature, cuts, cuts, table)."""

    base: float
    cuts: list
    tables: list
    pairs: list

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, f], side="right")]
        for f, g, cf, cg, table in self.pairs:
            total += table[np.searchsorted(cf, x[:, f], side="right"), np.searchsorted(cg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    if not len(values):
        return np.empty(0)
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2, ridge: float = 1.0, least: float = 1.0) -> tuple[np.ndarray, float]:
    """Steps of a shallow tree over ordered bins, and its gain."""
    total_g, total_h = grad.sum(), hess.sum()
    out = np.full(len(grad), total_g / (total_h + ridge))
    if not depth or len(grad) < 2:
        return out, 0.0
    left_g, left_h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
    gain[(left_h < least) | (total_h - left_h < least)] = -1
    at = int(np.argmax(gain))
    if gain[at] <= 1e-9:
        return out, 0.0
    out[: at + 1], a = _tree(grad[: at + 1], hess[: at + 1], depth - 1, ridge, least)
    out[at + 1 :], b = _tree(grad[at + 1 :], hess[at + 1 :], depth - 1, ridge, least)
    return out, float(gain[at]) + a + b


def _grid_tree(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best of one cut along either axis followed by a cut along the other, over a grid."""
    best, best_gain = np.zeros_like(grad), 0.0
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        for cut in range(1, len(g)):
            step, gain = np.empty_like(g), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                steps, more = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 1, ridge)
                step[part] = steps
                gain += more + g[part].sum() ** 2 / (h[part].sum() + ridge)
            gain -= g.sum() ** 2 / (h.sum() + ridge)
            if gain > best_gain:
                best, best_gain = (step if axis == 0 else step.T).copy(), gain
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, pair_rounds: int = 20) -> Model:
    """Fit a GA2M to features ``x`` and labels ``y`` of 0 and 1. Without rows every score is 0.5."""
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    cuts = [_cuts(x[:, f], BINS) for f in range(x.shape[1])]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds if len(y) else 0):
        for f, table in enumerate(tables):
            grad, hess = slopes()
            step, _ = _tree(np.bincount(bins[f], grad, len(table)), np.bincount(bins[f], hess, len(table)))
            table += rate * step
            total += rate * step[bins[f]]
    coarse = [_cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def grid(f: int, g: int, weight: np.ndarray) -> np.ndarray:
        m, n = len(coarse[f]) + 1, len(coarse[g]) + 1
        return np.bincount(cells[f] * n + cells[g], weight, m * n).reshape(m, n)

    pairs = []
    if len(y):
        grad, hess = slopes()
        gains = [(_grid_tree(grid(f, g, grad), grid(f, g, hess))[1], f, g) for f in range(x.shape[1]) for g in range(f)]
        pairs = [(f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for _, f, g in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(pair_rounds):
        for f, g, _, _, table in pairs:
            grad, hess = slopes()
            step, _ = _grid_tree(grid(f, g, grad), grid(f, g, hess))
            table += rate * step
            total += rate * step[cells[f], cells[g]]
    return Model(base, cuts, tables, pairs)


def is_held_out(id_col):
    """Rows whose crc32 of the id as text is 1 modulo 3: never trained on."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, most: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows that aren't held out, ``most`` at most, those of the least hashed ids.

    Only the sample's features, a few numbers a row, come to the driver: ``most`` rows, however often ids repeat. Unlabelled
    rows and null ids take no part; an empty table gives a model that scores 0.5.
    """
    known = only(labels, id=id_col, label=label_col).where("id is not null and label is not null").where(~is_held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(most)

    def run(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "label", "x"])

    # the sample is of at most ``most`` rows, so it may be broadcast
    rows = only(docs, id=id_col, text=text_col).join(F.broadcast(known), "id").select("id", "text", F.col("label").cast("int"))
    found = rows.mapInArrow(run, "id long, label int, x array<double>").orderBy(F.xxhash64("id"), "id", "label", "x").limit(most)
    got = found.toPandas().sort_values("id", kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, held_out, score (0 to 1), predicted (1 from 0.5 up).

    Defined cases: null and empty texts are scored as texts of no bytes; repeated rows come out repeated; a null id isn't
    held out; an empty table gives an empty table; other columns, labels among them, are never read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(features(batch.column(2))))], ["id", "held_out", "score"])

    rows = only(docs, id=id_col, text=text_col).select("id", is_held_out(F.col("id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "id long, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Just the rows whose whole text scores ``least`` or more, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
