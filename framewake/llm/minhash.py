"""Near-duplicate groups: Fast Similarity Sketching, banding, and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i each shingle goes to one hashed bin with a hashed value; a bin
keeps the least value of the first round that reaches it. After ``bins`` rounds, round ``bins + j`` sends every shingle to
bin j, so that each coordinate of a non-empty set fills. Equal coordinates of two sketches estimate the Jaccard
similarity with the concentration of independent samples.

Banding: ``rows`` coordinates make a band, ``bands`` bands make a sketch. A pair at the threshold 0.85 is missed by all
28 bands of 5 coordinates with probability 7e-8.

Verification: texts of the same words in the same order, by a cryptographic digest of them, are one class. Within a bucket classes are first compared with pivots only, not all
with all: with the class that has the most bucket mates, then with four classes of its largest components. That draws in
most of what belongs together, at about m comparisons for m near copies. Classes of buckets that still hold several
components then meet in a prefix-filtered join, which is exact: shingles are ordered by how many candidates have them,
the rarest first, and two sets of the similarity asked for must share one among the first few of both. How few depends
on both sizes, so sizes are binned and each (shingle, bin) is a group of its own; positions bound the overlap, and within
a group the classes of its largest component aren't joined with one another. So pairs come from real overlap, not from
the size of a bucket. A shingle that no other candidate has is in no intersection and is never joined.

Comparisons use whole shingle sets, streamed by pivot; a pivot with many partners is dealt to several tasks. A pair that
its hashes link is confirmed by its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import discard, materialise, only
from .classes import spread_components
from .components import components

U = np.uint64
#: partners of a pivot that one task compares
PER_TASK = 2000
#: pivots of a bucket in each round before the prefix-filtered join
PIVOTS = (1, 4, 4)
#: sizes of one bin of that join differ by this factor at most
BIN = 1.03


def fast_similarity_sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` coordinates for each set of 64-bit hashes; an empty set has a row of the largest value."""
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), bins), free)
    live = np.flatnonzero([len(s) > 0 for s in sets])
    for k in range(2 * bins):
        if not len(live):
            break
        sizes = np.array([len(sets[i]) for i in live])
        values = np.concatenate([sets[i] for i in live])
        hashed = T.mix(values + U((k + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        got = np.full(len(live) * bins, free)
        if k < bins:
            bin_ = ((hashed >> U(32)) * U(bins)) >> U(32)
            at = np.repeat(np.arange(len(live)) * bins, sizes) + bin_.astype(np.int64)
            # the round leads the value: what an earlier round has put into a bin is always less
            np.minimum.at(got, at, (hashed & U(0xFFFFFFFF)) | U(k << 32))
            got = got.reshape(len(live), bins)
        else:
            got = got.reshape(len(live), bins)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            got[:, k - bins] = np.minimum.reduceat(hashed & U(0xFFFFFFFF), first) | U(k << 32)
        out[live] = np.minimum(out[live], got)
        live = live[(out[live] == free).any(axis=1)]
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for i, j, buf, at in T.chunks(column):
        starts, ends, first = T.word_spans(buf, at, T.NOT_SPACE)
        values, begin = T.shingle_hashes(T.word_digests(buf, starts, ends), first, size)
        yield i, j, T.distinct_by_row(values, begin)


def sketch_documents(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(id, text) to (id, h, n, same, band): a hash of the text, the set's size, a 128-bit digest of its words in order, and its band keys."""

    def run(batches):
        for batch in batches:
            for i, j, sets in _sets(batch.column(2), size):
                sketch = fast_similarity_sketches(sets, bands * rows)
                keys = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    keys = T.mix(keys * U(3) + sketch[:, r::rows])
                keys = T.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                same = [T.sequence_key(t) for t in batch.column(2).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(same, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))],
                    ["id", "h", "n", "same", "band"],
                )
        T.release()

    return docs.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "id long, h long, n long, same binary, band array<long>")


def _shingles(text: str, size: int) -> set:
    words = text.encode().lower().split()  # of bytes: just A-Z, and just ASCII white space
    return set(zip(*[words[k:] for k in range(size)])) if len(words) >= size else {tuple(words)}


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Compare the classes (a, pivot b) of ``pairs`` by their whole sets: a, b, linked. texts: c, text."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_TASK).alias("tasks"))
    dealt = materialise(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("tasks")).alias("salt")), "dealt")
    want = dealt.select("b", "salt", F.lit(1).alias("part"), F.col("a").alias("c")).union(
        dealt.select("b", "salt").distinct().select("b", "salt", F.lit(0), F.col("b"))
    )
    rows = texts.join(want.hint("merge"), "c").select("b", "salt", "part", "c", "text")
    rows = rows.repartition(F.col("b"), F.col("salt")).sortWithinPartitions("b", "salt", "part")

    def run(batches):
        at, held, words = None, None, None
        for batch in batches:
            b, salt, part, c = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, j, sets in _sets(batch.column(4), size):
                for k, own in zip(range(i, j), sets):
                    if part[k] == 0:
                        at, held, words = (b[k], salt[k]), (own, batch.column(4)[k].as_py()), None
                        continue
                    other = held[0] if (b[k], salt[k]) == at else own[:0]
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    linked = False
                    if len(small):
                        where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        common = int(np.count_nonzero(large[where] == small))
                        linked = 100 * common >= percent * (len(small) + len(large) - common)
                    if linked:
                        words = words or _shingles(held[1], size)
                        mine = _shingles(batch.column(4)[k].as_py(), size)
                        linked = 100 * len(mine & words) >= percent * len(mine | words)
                    found.append((c[k], b[k], linked))
            if found:
                a, p, ok = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "linked"])
        T.release()

    # a row that the table repeats is compared again
    compared = rows.mapInArrow(run, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))
    found = materialise(compared.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "linked"), "compared")
    discard(dealt)
    return found


def ranked_shingles(texts: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """(c, n, own, prefix) of classes that may have a link. texts: c, text. sizes: c, n.

    own: shingles that no other class of ``texts`` has. prefix: (at, shingle) of the others, the rarest first, as far as a
    partner of the similarity asked for must have one of them; ``at`` counts a set's shingles from the rarest.
    """

    def run(batches):
        for batch in batches:
            c = batch.column(0)
            for i, j, sets in _sets(batch.column(1), size):
                rows = np.repeat(np.arange(i, j), [len(s) for s in sets])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)), pa.array(np.concatenate(sets).view(np.int64))], ["c", "shingle"])
        T.release()

    spread = texts.select("c", "text").mapInArrow(run, "c long, shingle long")
    often = spread.groupBy("shingle").agg(F.count("*").alias("seen"), F.min("c").alias("x"), F.max("c").alias("y")).where("x != y")
    shared = spread.join(often.select("shingle", "seen").hint("merge"), "shingle")
    ordered = shared.groupBy("c").agg(F.sort_array(F.collect_set(F.struct("seen", "shingle"))).alias("e"))
    ordered = ordered.join(sizes.hint("merge"), "c").withColumn("own", F.col("n") - F.size("e"))
    # a partner has at least percent of these shingles, so at most ``spare`` go before the first one in common
    spare = F.expr(f"n - ({percent} * n + 99) div 100")
    ordered = ordered.withColumn("spare", spare).where("own <= spare")
    prefix = F.transform(F.slice("e", F.lit(1), (F.col("spare") - F.col("own") + 1).cast("int")), lambda x, k: F.struct((F.col("own") + k).alias("at"), x["shingle"].alias("shingle")))
    return ordered.select("c", "n", "own", prefix.alias("prefix"))


def _bin(n):
    """Sizes within about three percent of each other share a bin."""
    return F.floor(F.log(n.cast("double")) / math.log(BIN)).cast("int")


def prefix_pairs(members: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose prefixes and sizes allow the similarity asked for. members: c, comp."""
    rows = ranked.join(members.hint("merge"), "c").select("c", "n", "comp", "prefix")
    whole = 100 + percent
    # J >= percent / 100 of sizes n and m: an overlap of percent * (n + m) / (100 + percent) at least
    need = lambda n, m: f"({percent} * ({n} + {m}) + {whole - 1}) div {whole}"
    small = rows.select("c", "n", "comp", _bin(F.col("n")).alias("bin"), F.expr(f"n - {need('n', 'n')}").alias("last"), "prefix")
    least = F.expr(f"({percent} * n + 99) div 100")
    large = rows.withColumn("least", least).select("*", F.explode(F.sequence(_bin(F.col("least")), _bin(F.col("n")))).alias("bin"))
    # the least size of a bin, one less for rounding
    large = large.withColumn("from", F.greatest("least", F.pow(F.lit(BIN), F.col("bin")).cast("long") - 1))
    large = large.select("c", "n", "comp", "bin", F.expr(f"n - {need('n', '`from`')}").alias("last"), "prefix")

    def spread(side: DataFrame, large: bool) -> DataFrame:
        cut = side.select("c", "n", "comp", "bin", F.explode(F.filter("prefix", lambda e: e["at"] <= F.col("last"))).alias("e"))
        return cut.select("e.shingle", "bin", "c", "n", "comp", "e.at", F.lit(large).alias("large"))

    entries = materialise(spread(small, False).union(spread(large, True)), "entries")
    held = entries.groupBy("shingle", "bin", "comp").agg(F.count("*").alias("held"), F.max("large").alias("l"), F.min("large").alias("s"))
    groups = held.groupBy("shingle", "bin").agg(F.max_by("comp", "held").alias("top"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("l").alias("l"), F.min("s").alias("s"))
    groups = groups.where("x != y and l and not s").select("shingle", "bin", "top")
    entries = entries.join(groups.hint("merge"), ["shingle", "bin"]).withColumn("rest", F.col("comp") != F.col("top"))
    # classes of the largest component meet the others only
    a = entries.where("not large").select("shingle", "bin", F.when(F.col("rest"), 0).otherwise(1).alias("turn"), F.col("c").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("at").alias("ia"))
    b = entries.where("large").select("shingle", "bin", F.explode(F.when(F.col("rest"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("at").alias("ib"))
    close = f"ca != cb and (na < nb or na = nb and a < b) and 100 * na >= {percent} * nb and least(na - ia, nb - ib) >= {need('na', 'nb')}"
    pairs = a.join(b.hint("merge"), ["shingle", "bin", "turn"]).where(close)
    return pairs.select("a", "b").distinct(), entries


def _links(members: DataFrame, ranked: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Labels (id, label) of all classes that have links. members: key, c, n, own, mates, of buckets with two classes or more."""
    members = members.withColumn("comp", F.col("c"))
    compared, labels = None, None

    def weigh(pairs: DataFrame) -> bool:
        """Compare new pairs; whether any is linked."""
        nonlocal compared, labels
        if compared is not None:
            pairs = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "a", "b").join(compared.select("lo", "hi"), ["lo", "hi"], "left_anti")
        pairs = materialise(pairs.select("a", "b"), "pairs")
        found = verify(pairs, texts, size, percent)
        discard(pairs)
        new = not found.where("linked").isEmpty()
        compared = found if compared is None else compared.union(found)
        if new:
            labels = components(compared.where("linked").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        return new

    for slots in PIVOTS:
        rank = F.struct("mates", "c")
        ranks = members
        if slots > 1:
            held = members.groupBy("key", "comp").agg(F.count("*").alias("held"))
            ranks, rank = members.join(held, ["key", "comp"]), F.struct("held", "mates", "c")
        pivots = ranks.groupBy("key", F.pmod(F.xxhash64("c"), F.lit(slots)).alias("slot")).agg(F.max_by(F.struct("c", "n", "own", "comp"), rank).alias("p"))
        pivots = materialise(pivots.select("key", "p.*").toDF("key", "b", "nb", "ownb", "cb"), "pivots")
        most = "least(n - own, nb - ownb)"
        pairs = (
            members.join(pivots, "key").where("comp != cb").where(f"100 * {most} >= {percent} * (n + nb - {most})")
            .select(F.least("c", "b").alias("lo"), F.greatest("c", "b").alias("hi"), F.col("c").alias("a"), "b")
            .groupBy("lo", "hi").agg(F.max_by(F.struct("a", "b"), F.struct("b", "a")).alias("p")).select("p.*")
        )
        new = weigh(pairs)
        if labels is not None:
            members = members.drop("comp").join(labels.select(F.col("id").alias("c"), F.col("label").alias("comp")), "c", "left")
            members = members.withColumn("comp", F.coalesce("comp", "c"))
        mixed = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
        members = materialise(members.join(mixed, "key", "left_semi").select("key", "c", "n", "own", "mates", "comp"), "members")
        discard(pivots)
        if members.isEmpty():
            return labels
        if not new:
            break
    pairs, entries = prefix_pairs(members.select("c", "comp").distinct(), ranked, percent)
    weigh(pairs)
    discard(entries, members)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    size: int = 5, percent: int = 85, bands: int = 28, rows: int = 5,
) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. A text of fewer words is one
    shingle. Returns ``id_col``, n_shingles, component_id, kept for each row.

    Defined cases: a text that is null, empty or all white space has no shingles and links with nothing; a null id links with
    nothing, its component_id is null and it is kept; rows that share an id are one node, linked by any of their texts; repeated
    rows come out repeated; an empty table gives an empty table; other columns are ignored.
    """
    rows_in = only(docs, id=id_col, text=text_col)
    sketches = materialise(sketch_documents(rows_in, size, bands, rows), "sketches")
    named = sketches.where("id is not null and same is not null")
    classes = named.groupBy("same").agg(F.min(F.struct("id", "h")).alias("head"), F.count("*").alias("copies"))
    classes = materialise(classes.select("same", "head.*", "copies"), "classes")
    # the row of a class that stands for it
    heads = materialise(named.join(classes.select("same", "id", "h").hint("merge"), ["same", "id", "h"], "left_semi"), "heads")
    spread = heads.select("same", "id", "h", "n", F.explode("band").alias("key"))
    mark = F.xxhash64("same")
    sized = spread.groupBy("key").agg(
        F.count("*").alias("size"), F.min(mark).alias("lo"), F.max(mark).alias("hi"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("s"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("t"),
    ).where("lo != hi")
    # buckets of other bands with just the same classes say nothing new
    own = sized.groupBy("size", "lo", "hi", "s", "t").agg(F.min("key").alias("key"), (F.col("size") * F.count("*")).alias("weight"))
    bucketed = materialise(spread.join(own.select("key", "weight").hint("merge"), "key").distinct(), "bucketed")
    nodes = bucketed.groupBy("same", "id", "h", "n").agg(F.sum("weight").alias("mates"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("c"), "*"), "nodes")
    texts = rows_in.withColumn("h", F.xxhash64("text")).join(nodes.select("c", "id", "h").hint("merge"), ["id", "h"])
    texts = materialise(texts.select("c", "text"), "texts")
    ranked = materialise(ranked_shingles(texts, nodes.select("c", "n"), size, percent), "ranked")
    members = bucketed.select("key", "same").join(nodes.select("same", "c", "mates").hint("merge"), "same").join(ranked.select("c", "n", "own").hint("merge"), "c")
    members = materialise(members.select("key", "c", "n", "own", "mates"), "members")
    labels = None if members.isEmpty() else _links(members, ranked, texts, size, percent)
    discard(heads, bucketed, members, texts, ranked)

    found = None
    if labels is not None:
        found = labels.join(nodes.select(F.col("c").alias("id"), "same"), "id").select("same", "label")
    out = spread_components(sketches, classes, found)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
