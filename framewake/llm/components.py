"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a, b) with the smallest node it can reach.

    Each round every node takes the least label among itself and its neighbours, then the label of that label.
    Labels are written to the shared folder after each round, so lineage stays short and no executor's loss matters.
    Minima are combined before the shuffle, so a node with very many neighbours costs no task more.
    Rows with a null end are ignored; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = materialise(both.union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = materialise(labels.select("id", F.least("id", "near").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        hooked = labels.select("id", "label").join(near, "id", "left").select("id", "label", F.least("label", "near").alias("to"))
        above = labels.select(F.col("id").alias("to"), F.col("label").alias("top"))
        jumped = materialise(
            hooked.join(above, "to", "left").select("id", F.least("to", "top").alias("label"), (F.least("to", "top") != F.col("label")).alias("moved")),
            "labels",
        )
        discard(labels)
        labels = jumped
        if jumped.where("moved").isEmpty():
            discard(both)
            return jumped.select("id", "label")
