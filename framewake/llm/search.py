"""Ranked lexical search of a query set over all documents, by sort-based accumulation.

The queries' terms are a bounded block (``BLOCK_BYTES``; a larger query set is searched block by block), which tasks get
whole. One pass over the documents leaves, for each, its length and the terms of the block that it has, with their
occurrences. Statistics come from all documents. A second pass concatenates an (item, document, impact) triple for each
matched term of an item, radix sorts their packed keys, and sums the impacts of equal keys with ``numpy.add.reduceat``. A heap for
each item keeps the best documents of a task; what tasks have kept is partitioned by ranges of items and ranked.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as T
from .common import lower_ascii, materialise, only

#: bytes of the (item, term) pairs that a pass takes
BLOCK_BYTES = 8 << 20
#: triples that are sorted together
TRIPLES = 1 << 20
#: digits, letters, and all beyond ASCII
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    TERM[_a:_b] = True


class Vocabulary:
    """Finds which of a list of words each word of a buffer is."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        ends = np.cumsum(size)
        self.starts, self.size = ends - size, size
        self.buf = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        hashes = T.word_hashes(self.buf, self.starts, ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.places = {w: k for k, w in enumerate(raw)}
        self.clash = bool((self.hashes[1:] == self.hashes[:-1]).any())

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of every word in the list, -1 for words that aren't in it; A-Z taken as a-z. Bytes decide, not hashes."""
        if not len(starts) or not len(self.hashes):
            return np.full(len(starts), -1)
        hashes = T.word_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        out = np.full(len(starts), -1)
        low = T.LOWER[buf]
        if self.clash:
            data = low.tobytes()
            out[hit] = [self.places.get(data[a:b], -1) for a, b in zip(starts[hit].tolist(), ends[hit].tolist())]
            return out
        which = self.order[at[hit]]
        size = ends[hit] - starts[hit]
        same = size == self.size[which]
        hit, which, size = hit[same], which[same], size[same]
        row = np.repeat(np.arange(len(hit)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        equal = low[starts[hit][row] + step] == self.buf[self.starts[which][row] + step]
        wrong = np.zeros(len(hit), bool)
        wrong[row[~equal]] = True
        out[hit[~wrong]] = which[~wrong]
        return out


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(id, text) to (id, n, terms, tf): how many terms a document has, places of those of ``words``, and their occurrences."""

    def run(batches):
        known = Vocabulary(words)
        for batch in batches:
            for i, j, buf, at in T.chunks(batch.column(1)):
                starts, ends, first = T.word_spans(buf, at, TERM)
                place = known.find(buf, starts, ends)
                hit = np.flatnonzero(place >= 0)
                row = np.searchsorted(first, hit, side="right") - 1
                keys, tf = np.unique(row * len(words) + place[hit], return_counts=True)
                held = np.concatenate([[0], np.cumsum(np.bincount(keys // max(len(words), 1), minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(held), pa.array((keys % max(len(words), 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(held), pa.array(tf.astype(np.int64)))],
                    ["id", "n", "terms", "tf"],
                )
        T.release()

    return docs.select("id", "text").mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def radix_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """A stable order of whole numbers below ``bound``, by passes over 16 bits, which numpy sorts by counting."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while bound >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _best(found: DataFrame, item_ids: list, item_type, weights: np.ndarray, items_of: np.ndarray, begin: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, id, score) of the ``top`` best documents of every item in each task. items_of[begin[t]:begin[t + 1]] are the items of term t."""
    arrow_type = to_arrow_type(item_type)
    last = -(1 << 63)  # a null id comes after all others

    def run(batches):
        heaps: list[list] = [[] for _ in item_ids]
        least = np.ones(len(item_ids), np.int64)
        wide = np.diff(begin)
        for batch in batches:
            ids, terms, tf = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            held = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, count = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
            m = np.array([50 + 50 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), held)
            impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
            upto = np.concatenate([[0], np.cumsum(wide[term])])
            edge = np.concatenate([[0], np.cumsum(held)])
            i = 0
            while i < len(ids):
                # documents of about TRIPLES triples, one at least
                j = max(i + 1, int(np.searchsorted(upto[edge], upto[edge[i]] + TRIPLES, side="right")) - 1)
                a, b = edge[i], edge[j]
                many = wide[term[a:b]]
                step = np.arange(upto[b] - upto[a]) - np.repeat(upto[a:b] - upto[a], many)
                item = items_of[np.repeat(begin[term[a:b]], many) + step]
                # triples come by document, so a stable sort by item sorts the packed (item, document) keys
                order = radix_order(item, len(item_ids))
                item, at, value = item[order], np.repeat(doc[a:b], many)[order], np.repeat(impact[a:b], many)[order]
                if len(item):
                    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (at[1:] != at[:-1])]))
                    score, item, at = np.add.reduceat(value, first), item[first], at[first]
                    good = score >= least[item]
                    score, item, at = score[good], item[good], at[good]
                    runs = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else []
                    for x, y in zip(runs[:-1], runs[1:]):
                        own, where = score[x:y], at[x:y]
                        if y - x > top:
                            few = own >= np.partition(own, y - x - top)[y - x - top]
                            own, where = own[few], where[few]
                        heap = heaps[item[x]]
                        for s, d in zip(own.tolist(), where.tolist()):
                            entry = (s, last if ids[d] is None else -ids[d])
                            heapq.heappush(heap, entry) if len(heap) < top else heapq.heappushpop(heap, entry)
                        if len(heap) == top:
                            least[item[x]] = heap[0][0]
                i = j
        rows = [(item_ids[k], None if d == last else -d, s) for k, heap in enumerate(heaps) for s, d in heap]
        for k in range(0, len(rows), 10_000):
            item, doc, score = zip(*rows[k : k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, arrow_type), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "id", "score"])
        T.release()

    return found.where("size(terms) > 0").mapInArrow(run, f"item {item_type.simpleString()}, id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, doc_id_col: str = "doc_id", item_id_col: str = "item_id", text_col: str = "text", item_text_col: str = "text", *,
    top: int = 50, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` documents of the highest scores for every item: ``item_id_col``, rank, ``doc_id_col``, score.

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. With N documents that have a term,
    L terms in all, and df documents that have a term, its weight is floor(1000 ln((2N + 2) / (2df + 1))); a document of n
    terms in which it occurs tf times adds weight * (10^9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L.

    Defined cases: null and empty texts have no terms: such an item has no rows and such a document isn't counted; rows that
    share an item_id, or have none, are one item with the terms of all; every document row is a document of its own, also one
    whose id is repeated or null; equal scores rank by ascending id, a null id last; empty tables give an empty table;
    texts are read whole, however long; other columns are ignored.
    """
    rows = only(docs, id=doc_id_col, text=text_col)
    asked = only(items, item=item_id_col, text=item_text_col)
    asked = materialise(asked.select("item", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(PATTERN), F.lit(0))).alias("term")).distinct(), "asked")
    weight = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = -(-weight // block_bytes)
    item_type = asked.schema["item"].dataType
    best = [_search(rows, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), item_type, top) for b in range(blocks)]
    if best:
        found = reduce(DataFrame.union, best)
    else:
        found = asked.select("item", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.repartitionByRange("item").select("item", F.row_number().over(order).alias("rank"), "id", "score").where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_id_col), "rank", F.col("id").alias(doc_id_col), "score")


def _search(rows: DataFrame, asked: DataFrame, item_type, top: int) -> DataFrame:
    """One block of (item, term), whose size is bounded: it is taken to the driver and given to every task."""
    pairs = asked.collect()
    words = sorted({r["term"] for r in pairs})
    place = {w: k for k, w in enumerate(words)}
    item_ids = list(dict.fromkeys(r["item"] for r in pairs))
    number = {v: k for k, v in enumerate(item_ids)}
    edges = np.array(sorted((place[r["term"]], number[r["item"]]) for r in pairs), np.int64).reshape(-1, 2)
    begin = np.searchsorted(edges[:, 0], np.arange(len(words) + 1))

    found = materialise(postings(rows, words), "postings")
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    # a row for each term of the block at most
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)
    return _best(found, item_ids, item_type, weights, edges[:, 1], begin, n_docs, max(n_terms, 1), top)
