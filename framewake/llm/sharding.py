"""Sharding along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, only

#: bits for each dimension
BITS = 6


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of ``points``, whose columns are integers of ``bits`` bits.

    Skilling's transform (2004), over all rows at once: undo excess rotations from the high bit down, Gray-code, interleave.
    """
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    dims = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        mask = q - 1
        for d in range(dims):
            set_ = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & mask
            x[0] = np.where(set_, x[0] ^ mask, x[0] ^ swap)
            if d:
                x[d] = np.where(set_, x[d], x[d] ^ swap)
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ turn) >> b) & 1)
    return out


def _prefix_number(col, skip: int):
    """The seven bytes after ``skip`` as a number, in the order of the strings; a null is least."""
    head = F.rpad(F.hex(F.substring(F.col(col).cast("binary"), skip + 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def _common_prefix(a: str | None, b: str | None) -> int:
    """Bytes that the least and the greatest value, and so all values, begin with."""
    x, y = (a or "").encode(), (b or "").encode()
    return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def hilbert_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """Cut all rows, in the order of a Hilbert curve, into ``shards`` runs whose row counts differ by one at most.

    Each of the string columns ``dimensions`` and the text's size is quantised at its quantiles over all rows; the curve
    visits the cells so that a run covers a small box of each dimension, which lets readers skip whole shards by their
    minima and maxima. Within a cell equal texts are neighbours. The sort is a range shuffle of a few numbers per row,
    texts don't move; the place of each range comes from a sum over ranges, one number each.

    Returns ``id_col``, size (UTF-8 bytes plus 16), text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    Defined cases: a null text has no bytes, a null dimension is the least value, null ids and repeated rows are placed
    like others (their order among equals is open); an empty table gives an empty table; other columns are ignored.
    """
    named = {f"d{k}": name for k, name in enumerate(dimensions)}
    rows = only(docs, id=id_col, text=text_col, **named)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    meta = materialise(rows.select("id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), *named), "meta")

    span = meta.agg(F.lit(0).alias("_"), *[f(c).alias(f"{f.__name__}_{c}") for c in named for f in (F.min, F.max)]).first()
    values = {c: _prefix_number(c, _common_prefix(span[f"min_{c}"], span[f"max_{c}"])) for c in named}
    values["size"] = F.col("size").cast("double")
    cells = 1 << BITS
    at = [k / cells for k in range(1, cells)]
    cuts = meta.agg(*[F.percentile_approx(v, at, 10_000).alias(c) for c, v in values.items()]).first()
    cuts = [np.unique(np.array(cuts[c] or [0.0])) for c in values]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([np.searchsorted(c, v.to_numpy(), side="left") for c, v in zip(cuts, columns)], axis=1)))

    placed = meta.select("id", "size", "crc", curve(*values.values()).alias("curve"))
    placed = placed.repartitionByRange("curve", "crc", "size", "id").sortWithinPartitions("curve", "crc", "size", "id")
    placed = placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("local"))
    placed = materialise(placed, "curve")
    # a row for each range
    ranges = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("part", before.alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    out = placed.join(F.broadcast(ranges), "part").withColumn("place", F.col("before") + F.col("local"))
    out = out.withColumn("shard", F.expr(f"(place * {shards}) div total"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", **options) -> None:
    """Write the whole rows of ``docs``, whose ids are unique, as one folder a shard; a shard's files are in slot order.

    Rows are dealt by ranges of shard and slot, so a large shard is written by several tasks. The folders are named
    ``shard=``, with underscores before it as long as ``docs`` has a column of that name. A null id is an id like any other;
    an empty table writes no shard; rows of equal places on the curve are in the order of hilbert_shards.
    """
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    place = hilbert_shards(docs, shards, id_col, **options).select(F.col(id_col).alias("id"), F.col("shard").alias("at"), "slot")
    held = docs.select(F.col(f"`{id_col}`").alias("mine"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.join(place, held["mine"].eqNullSafe(place["id"])).select("row", "at", "slot")
    dealt = joined.repartitionByRange("at", "slot").sortWithinPartitions("at", "slot")
    dealt.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("at").alias(name)).write.partitionBy(name).parquet(path)
