"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only

#: a line on more than this share of a site's pages, and on so many pages at least, is boilerplate
RATIO, LEAST_PAGES = 0.02, 5
#: boilerplate lines in all up to which they are broadcast; beyond, the join shuffles
BROADCAST_LINES = 1_000_000


def _key(line: Column) -> Column:
    """128 bits of a line without the white space at its ends; null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, text) to (site, lines): the keys of each site's boilerplate lines.

    Lines become 128-bit keys, once a page, before the shuffle, and are counted on both sides of it. A site has at most
    its mean number of lines a page / ``ratio`` boilerplate lines, so one row holds them.
    """
    pages = docs.groupBy("site").agg(F.count("*").alias("pages"))
    lines = docs.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line")).where("line is not null")
    seen = lines.groupBy("site", "line").agg(F.count("*").alias("seen")).where(F.col("seen") >= least_pages)
    common = seen.join(pages.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of"))).where(F.col("seen") > ratio * F.col("pages"))
    return common.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, site_col: str = "source", text_col: str = "text", *, ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    lines_col: str | None = "n_lines", dropped_col: str | None = "n_dropped",
) -> DataFrame:
    """Drop, from every text, the lines that are on more than ``ratio`` of the pages of its site.

    Returns all columns of ``docs`` with ``text_col`` rewritten, and, unless their names are None, ``lines_col`` and
    ``dropped_col`` with the lines that a text had and lost; columns of those names are replaced, all others pass whatever
    they are called. Lines are compared without the blanks at their ends; blank lines stay. Texts aren't shuffled while
    all sites' boilerplate fits a broadcast.

    Defined cases: a null text stays null with no lines; an empty text is one blank line; rows without a site form a site;
    a repeated row is a page more; a line that a page repeats counts once for it and goes each time; a site with fewer than
    ``least_pages`` pages loses nothing; an empty table stays empty.
    """
    pages = only(docs, site=site_col, text=text_col)
    found = materialise(boilerplate(pages, ratio, least_pages), "boilerplate")
    many = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    found = found.select(F.col("site").alias("of"), F.col("lines").alias("common"))
    found = F.broadcast(found) if many <= BROADCAST_LINES else found.hint("merge")
    # the row as it is in one column: its names can't clash with those in use here
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{site_col}`").alias("site"), F.split(F.col(f"`{text_col}`"), "\n").alias("lines"))
    joined = packed.join(found, F.col("site").eqNullSafe(F.col("of")), "left")
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.coalesce(F.array_contains("common", _key(x)), F.lit(False))))
    joined = joined.select("row", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n"), kept.alias("kept"))
    added = {lines_col: F.col("n"), dropped_col: F.col("n") - F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept"))}
    same = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return joined.select(*same, *[v.alias(c) for c, v in added.items() if c is not None])
