"""Components of classes of equal texts, told to every row of the classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components


def spread_components(rows: DataFrame, classes: DataFrame, found: DataFrame | None) -> DataFrame:
    """(id, n, component_id) of every row. rows: id, n, same. classes: same, id (its smallest), copies. found: same, label, or None.

    Classes of one label are one component, named by the smallest id in it. Rows that share an id join their components;
    a null id or class is in none.
    """
    named = rows.where("id is not null and same is not null")
    known = classes.where("copies > 1").select("same", F.col("id").alias("component_id"), "copies")
    if found is not None:
        held = found.join(classes, "same")
        first = held.groupBy("label").agg(F.min("id").alias("component_id"))
        known = classes.select("same", "id", "copies").join(held.join(first, "label").select("same", "component_id"), "same", "left")
        known = known.where("copies > 1 or component_id is not null").select("same", F.coalesce("component_id", "id").alias("component_id"), "copies")
    known = materialise(known, "known")
    # a class with a thousandth of all rows has its label broadcast: that is a thousand labels at most
    total = rows.count()
    hot = F.broadcast(known.where(F.col("copies") * 1000 >= total).select("same", "component_id"))
    rare = named.join(hot.select("same"), "same", "left_anti").join(known.select("same", "component_id").hint("merge"), "same", "left")
    out = named.join(hot, "same").select("id", "n", "component_id").union(rare.select("id", "n", F.coalesce("component_id", "id")))
    several = named.groupBy("id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x != y").select("id")
    several = materialise(several, "several")
    if not several.isEmpty():
        # texts of one id join their components
        joined = components(out.join(several.hint("merge"), "id", "left_semi").select(F.col("id").alias("a"), F.col("component_id").alias("b")))
        out = out.join(joined.select(F.col("id").alias("component_id"), "label").hint("merge"), "component_id", "left")
        out = out.select("id", "n", F.coalesce("label", "component_id").alias("component_id"))
    return out.union(rows.where("id is null or same is null").select("id", "n", F.col("id").alias("component_id")))
