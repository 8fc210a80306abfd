"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, only

#: bytes of a benchmark's windows, or of the names of documents with finds, up to which they are broadcast; beyond, joins shuffle
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(lower_ascii(text))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingle(words: str, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(size)])


def _windows(items: DataFrame, window: int, size: int) -> DataFrame:
    """Each distinct window once: its words, their number, its shingles in order, and its items. Longest windows: ``window`` words."""
    words = items.select("item", _words(F.col("text")).alias("w")).where("size(w) > 0")
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("w"))
    cut = cut.groupBy("w").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    # of fewer words than a shingle: one shingle of them all
    short = [F.when(F.size("w") == n, F.array(_shingle("w", F.lit(0), n))) for n in range(1, size)]
    full = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: _shingle("w", i, size))
    shingles = F.coalesce(*short, F.when(F.size("w") >= size, full))
    return cut.select(F.least(F.size("w"), F.lit(size)).alias("size"), F.size("w").alias("len"), "w", shingles.alias("shingles"), "items")


def _bytes(*strings: str) -> Column:
    """About the bytes that rows with these arrays of strings take."""
    each = [F.octet_length(F.array_join(s, "")) + 24 * F.size(s) for s in strings]
    return F.coalesce(F.sum(sum(each) + 200), F.lit(0)).alias("bytes")


def _bounded(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge")


def _occurrences(words: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """(id, h, n, times, occ): the windows of shingles of ``size`` words that occur in each document, as start, end, w, items."""
    shingles = materialise(windows.select(F.explode("shingles").alias("s")).distinct(), "shingles")
    known = windows.agg(_bytes("w", "items")).first()["bytes"]  # a window has no more shingles than words
    at = F.transform("w", lambda w, i: F.when(i <= F.size("w") - size, _shingle("w", i, size)))
    spread = words.select("id", "h", F.size("w").alias("n"), F.posexplode_outer(at).alias("pos", "s"))
    met = spread.join(_bounded(shingles.withColumn("known", F.lit(True)), known), "s", "left")
    met = met.where("pos is null or pos = 0 or known").select("id", "h", "n", "pos", F.when(F.col("known"), F.col("s")).alias("s"))
    met = materialise(met, "met")

    # the order of rarity over the whole corpus; of equally rare shingles the least hash, so that neighbouring windows share it
    rarity = met.where("s is not null").groupBy("s").agg(F.count("*").alias("seen"))
    places = windows.select("*", F.posexplode("shingles").alias("off", "s")).join(rarity, "s")
    first = places.groupBy("shingles").agg(F.min(F.struct("seen", "s", "off")).alias("first"), F.first("len").alias("len"), F.first("w").alias("w"), F.first("items").alias("items"), F.count("*").alias("found"))
    # a shingle that no document has rules its window out
    first = first.where(F.col("found") == F.size("shingles"))
    prefix = first.groupBy(F.col("first.s").alias("s")).agg(F.collect_list(F.struct(F.col("first.off").alias("off"), F.size("shingles").alias("k"), "len", "shingles", "w", "items")).alias("windows"))
    joined = met.join(_bounded(prefix, known), "s", "left")

    # a document's matches in order: what one document has, no more
    seen = F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("pos", "s"))))
    want = F.collect_set(F.when(F.col("windows").isNotNull(), F.struct("pos", "windows")))
    times = F.count(F.when(F.col("pos").isNull() | (F.col("pos") == 0), 1))
    docs = joined.groupBy("id", "h", "n").agg(seen.alias("seen"), want.alias("want"), times.alias("times"))
    docs = docs.select("*", F.transform("seen", lambda x: x["pos"]).alias("poss"), F.transform("seen", lambda x: x["s"]).alias("ss"))

    def verified(c):
        place = F.array_position("poss", c["pos"]).cast("int")  # from 1

        def occurs(w):
            start = place - w["off"]
            return (
                # positional bound, length bound, then every shingle at its place
                (c["pos"] >= w["off"]) & (c["pos"] - w["off"] + w["len"] <= F.col("n")) & (start >= 1)
                & (F.get("poss", start - 1) == c["pos"] - w["off"]) & (F.get("poss", start + w["k"] - 2) == c["pos"] - w["off"] + w["k"] - 1)
                & (F.slice("ss", F.greatest(start, F.lit(1)), w["k"]) == w["shingles"])
            )

        return F.transform(
            F.filter(c["windows"], occurs),
            lambda w: F.struct((c["pos"] - w["off"]).alias("start"), (c["pos"] - w["off"] + w["len"]).alias("end"), w["w"].alias("w"), w["items"].alias("items")),
        )

    return docs.select("id", "h", "n", "times", F.flatten(F.transform("want", verified)).alias("occ"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, size: int = 5,
) -> DataFrame:
    """Find every occurrence of a benchmark window, ``window`` consecutive words of an item (all words of a shorter one).

    Both sides become shingles of ``size`` words. One pass over the corpus keeps the positions of benchmark shingles and
    counts them; a window, which must be contained whole, then has a prefix of one shingle: its rarest. Only documents
    with that shingle are candidates; they must pass the positional and length bounds, and are verified by all shingles
    of the window at their places, and at last by the words of their texts, which are read again. Only matched positions and
    those texts are shuffled, as long as the names of the documents found have a size for a broadcast.

    Returns, for each row: ``id_col``, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated.

    Defined cases: a null or empty text has no words; an item without words has no windows; windows of an item whose id is
    null hit words but name no item; rows that share an id are judged each by their own text; repeated rows come out
    repeated; a null id is an id like others; without items nothing is hit; other columns are ignored.
    """
    rows = only(docs, id=id_col, text=text_col)
    words = rows.select("id", F.xxhash64("text").alias("h"), _words(F.col("text")).alias("w"))
    windows = materialise(_windows(only(items, item=item_col, text=item_text_col), window, size), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [size]  # 1 to size
    parts = [_occurrences(words, windows.where(F.col("size") == s), s) for s in sizes]
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.union(part)
        found = found.groupBy("id", "h", "n").agg(F.first("times").alias("times"), F.flatten(F.collect_list("occ")).alias("occ"))
    found = materialise(found, "found")
    # hashes have led here; the words decide, in the texts of the documents found
    hits = found.where(F.size("occ") > 0).select(F.col("id").alias("of"), F.col("h").alias("of_h"), "occ")
    this = F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h"))
    texts = rows.withColumn("h", F.xxhash64("text"))
    named = hits.select("of", "of_h")
    few = texts.join(_bounded(named, 64 * named.count()), this, "left_semi")
    rightly = F.filter("occ", lambda o: F.slice("w", o["start"] + 1, o["end"] - o["start"]) == o["w"])
    checked = few.join(hits.hint("merge"), this)
    checked = checked.select("id", _words(F.col("text")).alias("w"), "occ").select("id", F.size("w").alias("n"), rightly.alias("occ"))
    clean = found.where(F.size("occ") == 0).select("id", "n", "occ", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"))
    found = clean.drop("_").union(checked)
    ordered = F.array_sort(F.transform("occ", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))))
    # words of each occurrence beyond the last one that was counted
    hit = F.aggregate(
        ordered, F.struct(F.lit(0).alias("hit"), F.lit(0).alias("last")),
        lambda a, o: F.struct((a["hit"] + F.greatest(F.lit(0), o["end"] - F.greatest(o["start"], a["last"]))).alias("hit"), F.greatest(a["last"], o["end"]).alias("last")),
        lambda a: a["hit"],
    )
    named = F.sort_array(F.array_distinct(F.flatten(F.transform("occ", lambda o: o["items"]))))
    out = found.select("id", "n", hit.alias("n_hit"), named.alias("items"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
