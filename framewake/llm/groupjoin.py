"""N-gram Jaccard join over a token-group matrix: exact at every similarity, opening only the groups that can hold a partner.

Texts of the same words in the same order are one class, by a cryptographic digest of them; classes are compared, not rows.

1. Filter. In the order of their hashes, the first ``spare + grace`` shingles of two linked sets have ``grace`` in common at
   least, where ``spare`` is how many shingles of a set a partner may lack. So a class that shares fewer of them with all
   others together has no link. Only these prefixes are shuffled, a fifth of all shingles.
2. Rank. What is left has its shingles counted, and a class keeps a prefix of its rarest shingles (``ranked_shingles``).
3. Partition. Classes are sorted by minima of hashes of their sets, which similar sets share, and cut into runs of at
   most ``MEMBERS``: a group. One class of each hot run of groups, that with the fewest shingles of its own, joins
   all of them. Within groups all classes are compared, twice, by different minima: this draws together what is nearly
   the same at a cost in proportion to the rows.
4. Matrix. Groups are cut anew, by component, then by minima. The matrix has a row for each shingle and group in whose
   members' prefixes it is; a query class meets, by the shingles of its prefix, groups of other components only, and of the
   component with the most classes under a shingle none are set against one another. Of every such group the union of all
   its members' shingles is held against the query: the overlap bounds that with each member, and just a group whose bound
   reaches what the least size in it asks for is opened and compared member by member.

Links are confirmed by words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .classes import spread_components
from .common import discard, materialise, only
from .components import components
from .minhash import PER_TASK, _sets, _shingles, ranked_shingles

U = np.uint64
#: classes of a group, and shingles of its members, unless one member has more
MEMBERS, SHINGLES = 32, 200_000
#: minima by which classes are sorted
MINIMA = 4


def grace(n):
    """How many common shingles the filter asks of a set of ``n``; grows with ``n``, never beyond what a link has."""
    return 1 + n // 16


def class_prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, text) to (id, h, n, same, sig, first): a hash of the text, its set's size, a digest of its words, minima, and the filter's prefix."""

    def run(batches):
        for batch in batches:
            for i, j, sets in _sets(batch.column(2), size):
                n = np.array([len(s) for s in sets], np.int64)
                spare = n - (percent * n + 99) // 100
                first = [s[: a + grace(k)].view(np.int64) for s, a, k in zip(sets, spare.tolist(), n.tolist())]
                sig = np.zeros((j - i, MINIMA), np.uint64)
                for k in range(MINIMA):
                    for row in np.flatnonzero(n):
                        sig[row, k] = T.mix(sets[row] + U((k + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)).min()
                same = [T.sequence_key(t) for t in batch.column(2).slice(i, j - i).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(same, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * MINIMA, MINIMA, dtype=np.int32)), pa.array(sig.view(np.int64).ravel())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.empty(0, np.int64)))],
                    ["id", "h", "n", "same", "sig", "first"],
                )
        T.release()

    rows = docs.select("id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "id long, h long, n long, same binary, sig array<long>, first array<long>")


def cut_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (lead, c, n and others) with ``g``: the first class of the run that a row is in, in the order of ``by``.

    A run has one ``lead``, ``MEMBERS`` classes and ``SHINGLES`` shingles at most. A range partition is cut on its own, and
    ``c`` ends the order, so rows that share all else are still dealt to many tasks.
    """
    names = rows.columns
    at_lead, at_c, at_n = (names.index(x) for x in ("lead", "c", "n"))

    def run(batches):
        g, lead, held, weight = None, None, 0, 0
        for batch in batches:
            out = []
            for own, c, n in zip(*(batch.column(k).to_pylist() for k in (at_lead, at_c, at_n))):
                if g is None or own != lead or held >= MEMBERS or weight + n > SHINGLES:
                    g, lead, held, weight = c, own, 0, 0
                held, weight = held + 1, weight + n
                out.append(g)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*names, "g"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", g long"
    return rows.repartitionByRange(*by, "c").sortWithinPartitions(*by, "c").mapInArrow(run, schema)


class _Member:
    """A class in a task: its shingles, sorted, and its text, whose words are split only for a link."""

    def __init__(self, c: int, own: np.ndarray, text: str):
        self.c, self.own, self.text, self._words = c, own, text, None

    def words(self, size: int) -> set:
        if self._words is None:
            self._words = _shingles(self.text, size)
        return self._words


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small):
        return 0
    return int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))


def _linked(x: _Member, y: _Member, size: int, percent: int) -> bool:
    n, m = len(x.own), len(y.own)
    if 100 * min(n, m) < percent * max(n, m) or 100 * (k := _common(x.own, y.own)) < percent * (n + m - k):
        return False
    a, b = x.words(size), y.words(size)
    return 100 * len(a & b) >= percent * len(a | b)


def _inside(members: list[_Member], size: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the components within a group; what is joined already isn't compared again."""
    root = list(range(len(members)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    found = []
    for j in range(1, len(members)):
        for i in range(j):
            if top(i) != top(j) and _linked(members[i], members[j], size, percent):
                root[top(j)] = top(i)
                found.append((members[i].c, members[j].c))
    return found


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def join_inside(groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) within groups. groups: g, c, lead (bool; the class that joins many groups). texts: c, text."""
    rows = texts.join(groups.select("g", "c", "lead").hint("merge"), "c").select("g", "lead", "c", "text")
    rows = rows.repartition("g").sortWithinPartitions("g", F.desc("lead"), "c")

    def run(batches):
        g, members = None, []
        for batch in batches:
            found = []
            keys, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, sets in _sets(batch.column(3), size):
                for k, own in zip(range(i, j), sets):
                    if keys[k] != g:
                        found += _inside(members, size, percent)
                        g, members = keys[k], []
                    if not members or all(m.c != ids[k] for m in members):  # a row that the table repeats
                        members.append(_Member(ids[k], own, batch.column(3)[k].as_py()))
            if found:
                yield _pairs(found)
        if found := _inside(members, size, percent):
            yield _pairs(found)
        T.release()

    return rows.mapInArrow(run, "a long, b long")


def matrix_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(c, g): classes and the groups of other components that share a shingle of their prefixes and fit by size and position.

    rows: c, n, own, k (the component, or the group of classes that have none), g, prefix (at, shingle). The class is the
    larger set of a pair, so a member is in the matrix with the few of its rarest shingles that a set no smaller must share.
    """
    whole = 100 + percent
    # J >= percent / 100 of sizes n and m: an overlap of percent * (n + m) / (100 + percent) at least
    need = lambda n, m: f"({percent} * ({n} + {m}) + {whole - 1}) div {whole}"
    entries = materialise(rows.select("c", "n", "own", "k", "g", F.explode("prefix").alias("e")).select("c", "n", "own", "k", "g", "e.*"), "entries")
    matrix = entries.where(f"at <= n - {need('n', 'n')}").groupBy("shingle", "k", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.expr("n - own")).alias("most"), F.count("*").alias("held"),
    )
    by_part = matrix.groupBy("shingle", "k").agg(F.sum("held").alias("held"))
    asked_by = entries.groupBy("shingle").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x != y")
    tops = by_part.groupBy("shingle").agg(F.max_by("k", "held").alias("top")).join(asked_by.select("shingle").hint("merge"), "shingle")
    tops = materialise(tops, "tops")
    # what belongs to the largest component under a shingle meets the others only
    turns = F.explode(F.when(F.col("k") != F.col("top"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    turn = F.when(F.col("k") != F.col("top"), 0).otherwise(1)
    asked = entries.join(tops.hint("merge"), "shingle").select("shingle", "c", "n", F.expr("n - own").alias("mine"), "at", F.col("k").alias("kc"), turn.alias("turn"))
    held = matrix.join(tops.hint("merge"), "shingle").select("shingle", "g", "k", "lo", "hi", "most", turns.alias("turn"))
    close = f"kc != k and n >= lo and 100 * hi >= {percent} * n and at <= n - {need('n', 'lo')} and least(mine, most) >= {need('n', 'lo')}"
    found = materialise(asked.join(held.hint("merge"), ["shingle", "turn"]).where(close).select("c", "g").distinct(), "candidates")
    discard(entries, tops)
    return found


def open_groups(candidates: DataFrame, groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes and groups, and within groups of classes that have no component yet.

    candidates: c, g. groups: g, c, lone. A group with many queries is dealt to several tasks, each with all its members.
    """
    many = candidates.groupBy("g").agg(F.ceil(F.count("*") / PER_TASK).alias("tasks"))
    dealt = candidates.join(many.hint("merge"), "g").select("g", F.pmod(F.xxhash64("c"), F.col("tasks")).alias("salt"), F.lit(1).alias("part"), F.lit(False).alias("lone"), "c")
    several = groups.where("lone").groupBy("g").agg(F.count("*").alias("held")).where("held > 1").select("g", F.lit(1).cast("bigint").alias("tasks"))
    opened = many.union(several).groupBy("g").agg(F.max("tasks").alias("tasks"))
    members = groups.join(opened.hint("merge"), "g").select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks") - 1)).alias("salt"), F.lit(0).alias("part"), "lone", "c")
    rows = texts.join(members.union(dealt).hint("merge"), "c").select("g", "salt", "part", "lone", "c", "text")
    rows = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", "part", "c")

    def run(batches):
        at, members, union, least = None, [], None, 0
        for batch in batches:
            found = []
            g, salt, part, lone, c = (batch.column(k).to_pylist() for k in range(5))
            for i, j, sets in _sets(batch.column(5), size):
                for k, own in zip(range(i, j), sets):
                    if (g[k], salt[k]) != at:
                        at, members, union = (g[k], salt[k]), [], None
                    new = _Member(c[k], own, batch.column(5)[k].as_py())
                    if part[k] == 0:
                        if all(m.c != c[k] for m in members):
                            if lone[k] and salt[k] == 0:
                                found += [(m.c, c[k]) for m in members if _linked(m, new, size, percent)]
                            members.append(new)
                        continue
                    if union is None:
                        union = np.unique(np.concatenate([m.own for m in members])) if members else own[:0]
                        least = min((len(m.own) for m in members), default=0)
                    n = len(own)
                    # J >= percent / 100 of sizes n and m: an overlap of percent * (n + m) / (100 + percent) at least
                    need = -(-percent * (n + max(least, -(-percent * n // 100))) // (100 + percent))
                    if _common(own, union) >= need:
                        found += [(m.c, c[k]) for m in members if m.c != c[k] and _linked(m, new, size, percent)]
            if found:
                yield _pairs(found)
        T.release()

    return rows.mapInArrow(run, "a long, b long")


def _survivors(heads: DataFrame, percent: int) -> DataFrame:
    """``c`` of the classes that share as many prefix shingles with others as a link asks for. heads: c, n, first."""
    spread = heads.select("c", F.explode("first").alias("shingle"))
    # a class has a shingle once
    often = spread.groupBy("shingle").count().where("count > 1").select("shingle")
    shared = spread.join(often.hint("merge"), "shingle").groupBy("c").agg(F.count("*").alias("shared"))
    # the least partner of a set of n has percent * n / 100 shingles
    least = F.expr(f"({percent} * n + 99) div 100")
    return heads.select("c", least.alias("least")).join(shared.hint("merge"), "c").where("shared >= 1 + least div 16").select("c")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased. A text of fewer words is one
    shingle. Returns ``id_col``, n_shingles, component_id for each row. No link is missed.

    Defined cases: a text that is null, empty or all white space has no shingles and links with nothing; a null id links with
    nothing and its component_id is null; rows that share an id are one node, linked by any of their texts; repeated rows come
    out repeated; an empty table gives an empty table; texts are read whole; other columns are ignored.
    """
    rows_in = only(docs, id=id_col, text=text_col)
    rows = materialise(class_prefixes(rows_in, size, percent), "prefixes")
    named = rows.where("id is not null and same is not null")
    classes = named.groupBy("same").agg(F.min(F.struct("id", "h")).alias("head"), F.count("*").alias("copies"))
    classes = materialise(classes.select("same", "head.*", "copies"), "classes")
    heads = named.join(classes.select("same", "id", "h").hint("merge"), ["same", "id", "h"]).dropDuplicates(["same"])
    heads = materialise(heads.select(F.monotonically_increasing_id().alias("c"), "*"), "heads")
    full, rows = rows, materialise(rows.select("id", "n", "same"), "rows")
    discard(full)
    nodes = materialise(heads.join(_survivors(heads, percent).hint("merge"), "c", "left_semi").drop("first"), "nodes")
    discard(heads)
    texts = rows_in.withColumn("h", F.xxhash64("text")).join(nodes.select("c", "id", "h").hint("merge"), ["id", "h"])
    texts = materialise(texts.select("c", "text"), "texts")
    ranked = materialise(ranked_shingles(texts, nodes.select("c", "n"), size, percent), "ranked")
    live = nodes.join(ranked.select("c", "own").hint("merge"), "c").select("c", "n", "own", "sig")
    live = materialise(live.select("c", "n", "own", *[F.get("sig", F.lit(k)).alias(f"m{k}") for k in range(MINIMA)]), "live")

    links = []
    for k in range(2):
        by = [f"m{(k + i) % MINIMA}" for i in range(3)]
        groups = cut_groups(live.select(F.lit(0).alias("lead"), *by, "c", "n", "own"), by)
        groups = materialise(groups.select("g", "c", F.col(by[0]).alias("m"), "n", "own"), "groups")
        leads = groups.groupBy("m").agg(F.min_by("c", F.struct(F.expr("1000 * own div n"), -F.col("n"), "c")).alias("c"), F.min("g").alias("x"), F.max("g").alias("y")).where("x != y")
        joined = groups.select("g", "m").distinct().join(leads.select("m", "c").hint("merge"), "m").select("g", "c", F.lit(True).alias("lead"))
        both = groups.select("g", "c", F.lit(False).alias("lead")).union(joined).groupBy("g", "c").agg(F.max("lead").alias("lead"))
        links.append(materialise(join_inside(both, texts, size, percent), "links"))
        discard(groups)

    def labelled() -> DataFrame:
        found = links[0]
        for more in links[1:]:
            found = found.union(more)
        return components(found)

    labels = labelled()
    parts = live.select("c", "n", "m0", "m1").join(labels.select(F.col("id").alias("c"), F.col("label").alias("lead")).hint("merge"), "c", "left")
    groups = cut_groups(parts.select("lead", "m0", "m1", "c", "n"), ["lead", "m0", "m1"])
    # classes without a component share their group's negative number in place of one
    groups = materialise(groups.select("g", "c", "n", F.coalesce("lead", -1 - F.col("g")).alias("k"), F.col("lead").isNull().alias("lone")), "groups")
    candidates = matrix_candidates(groups.join(ranked.select("c", "own", "prefix").hint("merge"), "c").select("c", "n", "own", "k", "g", "prefix"), percent)
    links.append(materialise(open_groups(candidates, groups.select("g", "c", "lone"), texts, size, percent), "links"))
    if not links[-1].isEmpty():
        labels = labelled()
    found = labels.select(F.col("id").alias("c"), "label").join(nodes.select("c", "same").hint("merge"), "c").select("same", "label")
    discard(texts, ranked, live, groups, candidates, *links)
    out = spread_components(rows, classes, found)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
