"""Clashing names of written shards, bounded samples, stages without optional columns, a session without a shared folder."""

import subprocess
import sys

import corpus_pipeline
from framewake.llm import quality, sharding


def test_shards_of_clashing_names(spark, tmp_path):
    rows = [(i, f"text {i % 3}", "en", "s", i, -i, "a") for i in range(50)] + [(None, None, None, None, 1, 2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, slot int, `at` string")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted([*docs.columns, "_shard"])
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    sharding.write_shards(docs.where("false"), str(tmp_path / "none"), 3)


def test_ties_keep_their_order(spark):
    """Rows of equal keys on the curve are placed by their checksum, size and id."""
    docs = spark.createDataFrame([(i, "same", "en", "s") for i in (5, 3, 9, 1)], "doc_id long, text string, lang string, source string")
    got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.hilbert_shards(docs, 2).collect())
    assert [r[2] for r in got] == [1, 3, 5, 9]


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(2, "a b c d")] * 300 + [(k, "x y z") for k in range(3, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2, 20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, labels, most=40)
    assert seen == [40] or seen[0] < 40


def test_stage_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.line_dedup(spark, docs, "").columns == docs.columns


def test_keep_good_passes_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some words here", 3, 0.5, True), (1, None, 1, 0.1, False), (None, "", 2, None, None)], "id long, text string, label int, score double, held_out boolean")
    model = quality.train(docs.selectExpr("id as doc_id", "text").where("false"), docs.selectExpr("id as doc_id", "label as quality").where("false"))
    assert sorted(map(str, quality.keep_good(docs, model).collect())) == sorted(map(str, docs.collect()))


def test_a_session_without_a_shared_folder():
    """In a process of its own: the test session names a folder."""
    code = (
        "from pyspark.sql import SparkSession; from framewake.llm.minhash import near_duplicates\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print(near_duplicates(s.createDataFrame([(1, 'a b c d e f'), (2, 'A b c d e  f')], 'doc_id long, text string')).where('component_id = 1').count())"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=corpus_pipeline.__file__.rpartition("/")[0])
    assert done.stdout.strip().endswith("2"), done.stderr[-2000:]
