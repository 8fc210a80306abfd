"""Prefix trie of conversations, by the Cartesian tree over the LCP array of the sorted conversations.

1. Sort. A turn is a 128-bit digest of its role and text. ``WIDTH`` turns make a block; distinct blocks are sorted by ranges
   and named in that order, names of ``WIDTH`` blocks make a block of the next level, until every conversation is a single
   block. So rows stay small however long a conversation is, and equal conversations are one row with their number of
   copies. The rank of that row is its place in the order.
2. LCP. Neighbours' blocks are compared from the top level down: just the first that differ are looked into.
3. Nearest smaller values. Every range partition is a block of the LCP array. A stack finds the nearest smaller value on
   both sides within a block; what has none there goes by the minima of blocks (a number for each partition) to the
   block that has it, once for each value and block.
4. Tree. Elements of equal LCP between the same smaller values are one node of the tree, an interval of ranks whose
   conversations share that many turns and no more. A conversation that goes on alone is a leaf interval. Each interval stands
   for the depths from below its parent's to its own, which are expanded.
5. Aggregates of intervals are differences of prefix sums over ranks. Of the bytes below a node at depth d, members
   have copies * (bytes of all turns - bytes before d), and distinct nodes have, for each rank, the bytes beyond its LCP.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, only

#: turns of a block, and blocks of a block of the next level
WIDTH = 256
#: depths that one row is expanded to at a time
STEP = 4096


def ordered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, bytes) of every turn and (c, own) of every conversation. turns: c, turn, role, text.

    Turns are sorted by ranges, so a conversation of very many turns is dealt to many tasks; conversations that go on in
    another range, one for each range at most, have their positions carried on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    flat = turns.where("c is not null").select("c", "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["c", F.asc_nulls_first("turn"), "role", "key"]

    def run(batches):
        last, held = None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            at = np.arange(len(c))
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            begin = np.repeat(first, np.diff(np.concatenate([first, [len(c)]])))
            pos = at - begin + 1
            if c[0] == last:
                pos[begin == 0] += held
            last, held = c[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), batch.column(1), batch.column(2)], ["c", "pos", "key", "bytes"])

    sorted_ = flat.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "key", "bytes")
    placed = sorted_.mapInArrow(run, "c long, pos long, key string, bytes long").withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "turns")
    runs = placed.groupBy("c", "part").agg(F.count("*").alias("held"))
    by_part = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select("c", "part", "held", F.sum("held").over(by_part).alias("before")), "runs")
    # a row for each range at most
    carried = F.broadcast(runs.where("before > 0").select("c", "part", "before"))
    out = placed.join(carried, ["c", "part"], "left").select("c", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes")
    return out, runs.groupBy("c").agg(F.sum("held").alias("own"))


def rebuilt_turns(turns: DataFrame, family: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """(c, p, key, bytes) of rebuilt conversations and (c, len) of all, turnless ones too.

    The first h turns of conversation c - c % ``family``, then c's own after its first h; h = crc32(c) % ``spread``.
    """
    rows, convs = ordered_turns(turns)
    h = F.crc32(F.col("c").cast("string").cast("binary")) % spread
    convs = convs.select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    lent = convs.select(F.col("c").alias("base"), F.col("own").alias("lent"))
    shared = F.least("h", F.coalesce("lent", F.lit(0)))
    convs = convs.join(lent.hint("merge"), "base", "left").select("c", "h", "base", shared.alias("shared"), (shared + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    convs = materialise(convs, "convs")
    first = rows.where(F.col("pos") < spread).withColumnRenamed("c", "base")
    borrowed = first.join(convs.select("base", "c", "shared").hint("merge"), "base").where("pos <= shared").select("c", F.col("pos").alias("p"), "key", "bytes")
    own = rows.withColumn("h", h).where("pos > h").join(convs.select("c", "shared").hint("merge"), "c")
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("shared")).alias("p"), "key", "bytes")
    return materialise(borrowed.union(own), "rebuilt"), convs.select("c", "len")


def sorted_keys(keys: DataFrame, label: str) -> DataFrame:
    """Distinct rows of ``keys`` in the order of ``key``, with ``part``, the range, and ``local``, the place in it."""
    placed = keys.repartitionByRange("key").sortWithinPartitions("key")
    return materialise(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("local")), label)


def _joined(rows: DataFrame, by: str, unit: str) -> DataFrame:
    """(c, j, key): the units of each ``WIDTH`` places of a conversation, put together in their order."""
    block = rows.groupBy("c", F.expr(f"{by} div {WIDTH}").alias("j")).agg(F.sort_array(F.collect_list(F.struct(by, unit))).alias("e"))
    return block.select("c", "j", F.unhex(F.array_join(F.col(f"e.{unit}"), "")).alias("key"))


def named_conversations(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(c, key) with keys that sort as the conversations do, and the tables (name, key) of the blocks of each level."""
    empty = convs.where("len = 0").select("c", F.lit(0).cast("long").alias("j"), F.lit(b"").alias("key"))
    blocks = _joined(rows.select("c", (F.col("p") - 1).alias("at"), "key"), "at", "key").union(empty)
    levels: list[DataFrame] = []
    while True:
        blocks = materialise(blocks, "blocks")
        if not (blocks.agg(F.max("j")).first()[0] or 0):
            return blocks.select("c", "key"), levels
        names = sorted_keys(blocks.select("key").distinct(), "names")
        name = F.lpad(F.hex(F.shiftleft(F.col("part").cast("long"), 33) + F.col("local")), 16, "0")
        levels.append(names.select(F.unhex(name).alias("name"), "key"))
        named = blocks.join(names.select("key", name.alias("name")).hint("merge"), "key")
        blocks = _joined(named.select("c", F.col("j").alias("at"), "name"), "at", "name")


def _equal_units(a: bytes, b: bytes, width: int) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // width


def common_lengths(ranks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(r, lcp): how many turns ranks r and r - 1 have in common, for r from 1. ranks: r, key."""
    pairs = ranks.select("r", F.col("key").alias("y")).join(ranks.select((F.col("r") + 1).alias("r"), F.col("key").alias("x")).hint("merge"), "r")
    pairs = pairs.select("r", F.lit(0).cast("long").alias("lcp"), "x", "y")
    for level in range(len(levels), -1, -1):
        width, turns = (8, WIDTH**level) if level else (16, 1)

        def run(batches, width=width, turns=turns):
            for batch in batches:
                found, nx, ny = [], [], []
                for done, x, y in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    k = 0 if x is None else _equal_units(x, y, width)
                    found.append(done + k * turns)
                    more = turns > 1 and x is not None and k * width < min(len(x), len(y))
                    nx.append(x[k * width : (k + 1) * width] if more else None)
                    ny.append(y[k * width : (k + 1) * width] if more else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array(nx, pa.binary()), pa.array(ny, pa.binary())], ["r", "lcp", "x", "y"])

        pairs = pairs.mapInArrow(run, "r long, lcp long, x binary, y binary")
        if level:
            pairs = materialise(pairs, "lcp")
            names = levels[level - 1]
            ended = pairs.where("x is null")
            for side in "xy":
                pairs = pairs.withColumnRenamed(side, "name").join(names.hint("merge"), "name").withColumnRenamed("key", side).drop("name")
            pairs = pairs.select("r", "lcp", "x", "y").union(ended)
    return pairs.select("r", "lcp")


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """The nearest place before each one whose value is smaller, -1 if none is."""
    out, stack = np.full(len(values), -1), []
    for k, v in enumerate(values.tolist()):
        while stack and stack[-1][0] >= v:
            stack.pop()
        if stack:
            out[k] = stack[-1][1]
        stack.append((v, k))
    return out


class RangeMinima:
    """Least value between two places, both included; nothing between gives the largest number."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values, np.int64)]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), self.NONE)
        size = b - a + 1
        for k, row in enumerate(self.rows):
            at = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        return out


def elements(ranked: DataFrame, summary: list, total: int) -> DataFrame:
    """(r, lcp, l, rr, low) for r from 1: nearest smaller places, and the least conversation between them if all is in one block.

    ranked: block, r, lcp (-1 at 0), c. summary: (block, least lcp, least c) in order.
    """
    numbers = [s[0] for s in summary]
    place = {b: k for k, b in enumerate(numbers)}
    minima = np.array([s[1] for s in summary], np.int64)
    before = nearest_smaller(minima)
    after = len(minima) - 1 - nearest_smaller(minima[::-1])[::-1]

    def look(k: int, v: int, way: np.ndarray, step: int) -> int | None:
        k += step
        while 0 <= k < len(minima) and minima[k] >= v:
            k = way[k]
        return numbers[k] if 0 <= k < len(minima) else None

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        v, r, block = rows["lcp"].to_numpy(), rows["r"].to_numpy(), rows["block"].iloc[0]
        n = len(v)
        left = nearest_smaller(v)
        right = n - 1 - nearest_smaller(v[::-1])[::-1]
        whole = (left >= 0) & (right < n)
        low = RangeMinima(rows["c"].to_numpy()).least(np.where(whole, left, 0), np.where(whole, right - 1, -1))
        out = pd.DataFrame({"r": r, "lcp": v})
        out["l"] = pd.array(np.where(v == 0, 0, np.where(left >= 0, r[left], -1)), "Int64")
        out["rr"] = pd.array(np.where(v == 0, total, np.where(right < n, r[np.minimum(right, n - 1)], -1)), "Int64")
        cache: dict = {}

        def ask(side: str, value: int):
            if (side, value) not in cache:
                cache[side, value] = look(place[block], value, before if side == "l" else after, -1 if side == "l" else 1)
            return cache[side, value]

        out["tl"] = pd.array([ask("l", x) if k == -1 else None for x, k in zip(v.tolist(), out["l"].tolist())], "Int64")
        out["tr"] = pd.array([ask("r", x) if k == -1 else None for x, k in zip(v.tolist(), out["rr"].tolist())], "Int64")
        out["low"] = pd.array(np.where(whole & (v > 0), low, 0), "Int64")
        out.loc[~(whole & (v > 0)), "low"] = pd.NA
        out.loc[out["l"] == -1, "l"] = pd.NA
        # nothing smaller follows: the interval goes on to the end
        out.loc[(out["rr"] == -1) & out["tr"].isna(), "rr"] = total
        out.loc[out["rr"] == -1, "rr"] = pd.NA
        return out[out["r"] > 0]

    schema = "r long, lcp long, l long, rr long, tl long, tr long, low long"
    found = materialise(ranked.select("block", "r", "lcp", "c").groupBy("block").applyInPandas(inside, schema), "elements")
    asked = found.where("l is null").select(F.col("tl").alias("block"), F.lit("l").alias("side"), "lcp")
    asked = asked.union(found.where("rr is null").select("tr", F.lit("r"), "lcp")).distinct()

    def answer(questions: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(questions):
            return pd.DataFrame({"block": [], "side": [], "lcp": [], "place": []})
        rows = rows.sort_values("r")
        v, r = rows["lcp"].to_numpy(), rows["r"].to_numpy()
        out = questions[["block", "side", "lcp"]].copy()
        # minima from the end and from the beginning are in order
        tail, head = np.minimum.accumulate(v[::-1]), np.minimum.accumulate(v)
        want = out["lcp"].to_numpy()
        at = np.searchsorted(-tail, -want, side="right"), np.searchsorted(-head, -want, side="right")
        out["place"] = np.where(out["side"] == "l", r[np.maximum(len(v) - 1 - at[0], 0)], r[np.minimum(at[1], len(v) - 1)])
        return out

    # a row for each block at most
    blocks = F.broadcast(asked.select("block").distinct())
    answers = asked.groupBy("block").cogroup(ranked.join(blocks, "block", "left_semi").select("block", "r", "lcp").groupBy("block"))
    answers = materialise(answers.applyInPandas(answer, "block long, side string, lcp long, place long"), "answers")
    for side, own, to in (("l", "l", "tl"), ("r", "rr", "tr")):
        told = answers.where(F.col("side") == side).select(F.col("block").alias(to), "lcp", F.col("place").alias(f"far_{side}"))
        found = found.join(told.hint("merge"), [to, "lcp"], "left").withColumn(own, F.coalesce(own, f"far_{side}")).drop(f"far_{side}")
    return found.select("r", "lcp", "l", "rr", "low")


def member_digests(members: DataFrame) -> DataFrame:
    """(r, ends): SHA-256 of each rank's conversations, ascending and comma-joined, streamed. members: r, c."""
    rows = members.repartition("r").sortWithinPartitions("r", "c")

    def run(batches):
        r, state = None, None
        for batch in batches:
            out = []
            for own, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == r:
                    state.update(b",%d" % c)
                    continue
                if r is not None:
                    out.append((r, state.hexdigest()))
                r, state = own, hashlib.sha256(b"%d" % c)
            if out:
                yield _digests(out)
        if r is not None:
            yield _digests([(r, state.hexdigest())])

    return rows.mapInArrow(run, "r long, ends string")


def _digests(rows: list) -> pa.RecordBatch:
    r, ends = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(ends)], ["r", "ends"])


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, family: int = 5, spread: int = 9,
) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations (``rebuilt_turns``), the empty one too.

    Returns ``conv_col`` (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes), ends_sha256.

    Defined cases: a null role or text is empty; turns are ordered by turn, null first, ties by role and then by the digest of
    role and text; repeated rows are turns of their own; rows without a conversation are in none; a conversation that is left
    without turns is a member of the root; an empty table gives an empty table; texts are digested whole, and a conversation of
    very many turns is dealt to many tasks; other columns are ignored. The digest of a node's last members is of a
    sequence: one task streams it.
    """
    rows, convs = rebuilt_turns(only(turns, c=conv_col, turn=turn_col, role=role_col, text=text_col), family, spread)
    keyed, levels = named_conversations(rows, convs)
    classes = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("c").alias("c"))
    placed = sorted_keys(classes, "sorted")
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row for each range
    total = sum(n for _, n in counts)
    begin = dict(zip((p for p, _ in counts), np.cumsum([0, *[n for _, n in counts]]).tolist()))
    starts = F.broadcast(turns.sparkSession.createDataFrame(list(begin.items()), "part int, start long"))
    ranks = placed.join(starts, "part").select((F.col("start") + F.col("local")).alias("r"), F.col("part").cast("long").alias("block"), "key", "copies", "c")
    ranks = materialise(ranks, "ranks")

    # bytes up to each turn, of the conversation that stands for its rank
    mine = rows.join(ranks.select("c").hint("merge"), "c", "left_semi").select("c", "p", "bytes", F.expr(f"(p - 1) div {WIDTH}").alias("j"))
    sums = mine.groupBy("c", "j").agg(F.sum("bytes").alias("b"))
    sums = sums.select("c", "j", F.coalesce(F.sum("b").over(Window.partitionBy("c").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = mine.select("c", "j", "p", F.sum("bytes").over(Window.partitionBy("c", "j").orderBy("p")).alias("own"), "bytes").join(sums.hint("merge"), ["c", "j"])
    upto = materialise(upto.select("c", "p", (F.col("before") + F.col("own")).alias("upto"), "bytes"), "upto")

    lcp = materialise(common_lengths(ranks.select("r", "key"), levels), "lcp")
    both = ranks.select("r", "block", "copies", "c").join(lcp.hint("merge"), "r", "left").withColumn("lcp", F.coalesce("lcp", F.lit(-1).cast("long")))
    both = both.join(lcp.select((F.col("r") - 1).alias("r"), F.col("lcp").alias("next")).hint("merge"), "r", "left").withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))
    both = both.join(convs.hint("merge"), "c")
    both = both.join(upto.select("c", F.col("p").alias("len"), F.col("upto").alias("tot")).hint("merge"), ["c", "len"], "left")
    both = both.join(upto.select("c", F.col("p").alias("lcp"), F.col("upto").alias("known")).hint("merge"), ["c", "lcp"], "left")
    both = both.withColumn("tot", F.coalesce("tot", F.lit(0).cast("long"))).withColumn("known", F.coalesce("known", F.lit(0).cast("long")))
    own = {"n": F.col("copies"), "w": F.col("copies") * F.col("tot"), "i": F.col("tot") - F.col("known"), "f": (F.col("len") > F.col("next")).cast("long")}
    within = Window.partitionBy("block").orderBy("r")
    rest = within.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = both.select(
        "r", "block", "c", "len", "lcp", "next", "tot", *[v.alias(k) for k, v in own.items()], *[F.sum(v).over(within).alias(f"in_{k}") for k, v in own.items()],
        F.min("c").over(within).alias("head"), F.min("c").over(rest).alias("tail"),
    )
    local = materialise(local, "local")
    # a row for each block
    summary = local.groupBy("block").agg(F.min("lcp").alias("lcp"), F.min("c").alias("c"), *[F.sum(k).alias(k) for k in own]).orderBy("block").collect()
    base, offsets = dict.fromkeys(own, 0), []
    for s in summary:
        offsets.append((s["block"], *base.values()))
        base = {k: base[k] + s[k] for k in own}
    offsets = F.broadcast(turns.sparkSession.createDataFrame(offsets, "block long, " + ", ".join(f"to_{k} long" for k in own)))
    ranked = local.join(offsets, "block").select(
        "r", "block", "c", "len", "lcp", "next", "tot", "head", "tail",
        *[(F.col(f"in_{k}") + F.col(f"to_{k}")).alias(f"in_{k}") for k in own], *[(F.col(f"in_{k}") + F.col(f"to_{k}") - F.col(k)).alias(f"ex_{k}") for k in own],
    )
    ranked = materialise(ranked, "ranked")
    found = materialise(elements(ranked, [(s["block"], s["lcp"], s["c"]) for s in summary], total), "nearest")

    # nodes of the tree: elements of equal LCP between the same smaller ones
    nodes = found.groupBy(F.col("l").alias("a"), F.col("lcp").alias("bottom")).agg((F.max("rr") - 1).alias("e"), F.count("*").alias("cuts"), F.min("low").alias("low"))
    order = {s["block"]: k for k, s in enumerate(summary)}
    least = RangeMinima(np.array([s["c"] for s in summary], np.int64))

    @F.pandas_udf("long")
    def between(first: pd.Series, last: pd.Series) -> pd.Series:
        a, b = first.map(order).to_numpy(np.int64) + 1, last.map(order).to_numpy(np.int64) - 1
        return pd.Series(least.least(np.where(a <= b, a, 0), np.where(a <= b, b, -1)))

    start = ranked.select(F.col("r").alias("a"), F.col("block").alias("ba"), F.col("c").alias("ca"), F.col("lcp").alias("la"), "len", "tot", "tail", *[f"ex_{k}" for k in "nwf"], F.col("in_i").alias("ia"))
    end = ranked.select(F.col("r").alias("e"), F.col("block").alias("be"), F.col("next").alias("le"), "head", *[f"in_{k}" for k in "nwif"])
    nodes = nodes.join(start.hint("merge"), "a").join(end.hint("merge"), "e")
    across = F.when(F.col("ba") == F.col("be"), F.col("tail")).otherwise(F.least("tail", "head", between("ba", "be")))
    nodes = materialise(nodes.withColumn("low", F.coalesce("low", across)), "nodes")
    leaves = ranked.where(F.col("len") > F.greatest("lcp", "next")).select(
        F.col("r").alias("a"), F.col("r").alias("e"), F.col("len").alias("bottom"), F.lit(0).cast("long").alias("cuts"), F.col("c").alias("low"), F.col("c").alias("ca"), F.col("lcp").alias("la"), "len", "tot",
        *[f"ex_{k}" for k in "nwf"], F.col("in_i").alias("ia"), F.col("next").alias("le"), *[f"in_{k}" for k in "nwif"],
    )
    parts = nodes.select(*leaves.columns).union(leaves)
    parts = parts.join(found.select(F.col("r").alias("a"), F.col("l").alias("left")).hint("merge"), "a", "left")
    parts = parts.withColumn("above", F.greatest("la", "le")).withColumn("up", F.when(F.col("le") > F.col("la"), F.col("a")).otherwise(F.col("left")))
    told = nodes.select(F.col("a").alias("up"), F.col("bottom").alias("above"), F.col("low").alias("parent"))
    parts = parts.join(told.hint("merge"), ["up", "above"], "left")

    several = ranks.where("copies > 1").select("key", "r")
    digests = member_digests(keyed.join(several.hint("merge"), "key").select("r", "c")).select(F.col("r").alias("a"), "ends")
    parts = parts.join(digests.hint("merge"), "a", "left")
    ends = F.when(F.col("bottom") != F.col("len"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("ends", F.sha2(F.col("ca").cast("string").cast("binary"), 256)))
    n = F.col("in_n") - F.col("ex_n")
    parts = parts.select(
        "ca", "low", "parent", "above", "bottom", n.alias("n"), (F.col("in_f") - F.col("ex_f")).alias("n_leaves"),
        (F.col("in_w") - F.col("ex_w") - F.col("in_i") + F.col("ia") - F.col("tot")).alias("saved"), ends.alias("ends"),
        F.when(F.col("cuts") == 0, 0).otherwise(F.col("cuts") + 1 - (F.col("len") == F.col("bottom")).cast("long")).alias("children"),
    )
    wide = parts.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("bottom"), F.lit(STEP).cast("long"))))
    deep = wide.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + STEP - 1, "bottom"))))
    before = upto.select(F.col("c").alias("ca"), F.col("p").alias("depth"), (F.col("upto") - F.col("bytes")).alias("before"))
    deep = deep.join(before.hint("merge"), ["ca", "depth"], "left")
    last = F.col("depth") == F.col("bottom")
    out = deep.select(
        F.col("low").alias(conv_col), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("above") + 1, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n") - 1) * F.coalesce("before", F.lit(0))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    discard(lcp, local)
    return out
