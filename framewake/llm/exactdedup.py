"""Exact duplicates by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only

#: bytes of the first digit; every further digit is GROWTH times what has been read so far
FIRST, GROWTH = 24, 15


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group texts that are identical once every ASCII white space character is deleted.

    The documents are split by a first digit, their length and leading bytes, and every group of two or more by its next
    bytes, again and again, until a group is a single row or its texts have ended. The bytes themselves are compared, so
    equality rests on no digest. Digits grow with the depth, so a text of n bytes takes log(n) rounds, and only rows that
    still share a group read and move their next bytes. Counts are combined before each shuffle, and rows meet their
    group's number in a merge join that Spark may split, at every size, so a group with a third of all rows burdens no single task.

    Returns, for every row: ``id_col``, keep_id, group_size, kept, text_sha256 (of the normalised text). The row with the
    most code points in its original text stays, then the smallest id.

    Defined cases: a null text counts as empty, and all texts without other characters form one group; a null id loses
    every tie; of repeated rows one stays; an empty table gives an empty table; other columns are ignored.
    """
    rows = only(docs, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    base = rows.select("id", F.char_length(text).cast("long").alias("chars"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary").alias("bytes"))
    base = base.select("id", "chars", "bytes", F.octet_length("bytes").alias("n"), F.substring("bytes", 1, FIRST).alias("digit"))
    shared = base.groupBy("n", "digit").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialise(shared.select("n", "digit", F.monotonically_increasing_id().alias("g")), "radix")
    split = base.join(shared.hint("merge"), ["n", "digit"], "left").select(
        F.monotonically_increasing_id().alias("row"), "id", "chars", "n", "g", F.sha2("bytes", 256).alias("sha"),
        F.when(F.col("g").isNotNull() & (F.col("n") > FIRST), F.col("bytes")).alias("bytes"),
    )
    split = materialise(split, "split")

    state = split.where("g is not null").select("row", "n", "g")
    ended, depth = [], FIRST
    while True:
        ended.append(state.where(F.col("n") <= depth).select("row", "g"))
        state = state.where(F.col("n") > depth)
        if state.isEmpty():
            break
        step = GROWTH * depth
        digit = split.where(F.col("g").isNotNull() & (F.col("n") > depth)).select("row", F.substring("bytes", depth + 1, step).alias("digit"))
        digits = state.join(digit.hint("merge"), "row")
        groups = digits.groupBy("g", "digit").agg(F.count("*").alias("c"), F.min("row").alias("to")).where("c > 1")
        state = materialise(digits.join(groups.hint("merge"), ["g", "digit"]).select("row", "n", F.col("to").alias("g")), "radix")
        depth += step
    # groups of different depths may have the same number
    final = None
    for level, part in enumerate(ended):
        part = part.withColumn("level", F.lit(level))
        final = part if final is None else final.union(part)

    member = split.select("row", "id", "chars").join(final, "row")
    order = F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    best = member.groupBy("level", "g").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    chosen = member.join(best, ["level", "g"]).select("row", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    out = split.select("row", "id", "sha").join(chosen, "row", "left")
    grouped = F.col("group_size").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce("kept", F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
