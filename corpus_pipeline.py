"""The corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of their input, whatever else it has.

Defined cases, of every stage: an empty table stays empty; a null or empty text is judged as a text of no bytes by
``quality`` and passes the stages after it; repeated rows share their fate; rows that share a doc_id are kept or dropped
together by ``near_dedup`` and ``decontaminate``, and each on its own text by ``quality``; rows without a doc_id are never
dropped by those two. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewake.llm.bpe import encode_documents
from framewake.llm.common import materialise, table
from framewake.llm.decontaminate import contamination
from framewake.llm.linededup import drop_boilerplate
from framewake.llm.minhash import near_duplicates
from framewake.llm.quality import keep_good, train


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't in ``dropped``; null ids stay. A merge join at every size, as ``dropped`` grows with the corpus."""
    return docs.join(dropped.select("doc_id").hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled documents of this stage's input."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go, from all documents; n_chars, if there is one, follows the text."""
    out = drop_boilerplate(docs, lines_col=None, dropped_col=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, directly or by others, the one of the smallest doc_id stays.

    40 bands of 5 coordinates miss a pair at 0.8 with probability 1e-7.
    """
    return _without(docs, near_duplicates(docs, percent=80, bands=40).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document that is left."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: no SQL says what a trained classifier and byte-level BPE do
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
