"""What the driver holds while an operator of many short jobs runs."""

import gc
import time

import numpy as np

import corpus_pipeline
from querymill.llm import ann, session
from querymill.llm.components import components


def held(spark):
    """Shuffles whose map outputs the driver knows."""
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def left_by(spark, monkeypatch, run):
    """What ``run`` gives, and the shuffles that it leaves on the driver."""
    monkeypatch.setattr(session, "RELEASE_S", 0.0, raising=False)
    gc.collect()
    spark._jvm.java.lang.System.gc()
    time.sleep(2)
    before = held(spark)
    out = run()
    time.sleep(2)  # the cleaner works beside the run
    return out, held(spark) - before


def test_dropped_tables_leave_the_driver(spark, monkeypatch):
    labels, more = left_by(spark, monkeypatch, lambda: components(spark.range(200).selectExpr("id AS a", "id + 1 AS b")))
    assert labels.select("label").distinct().count() == 1
    # A round has five shuffles or more, and a path of 200 takes several rounds.
    assert more <= 12


def test_neighbours_leave_the_driver(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(300, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, more = left_by(spark, monkeypatch, lambda: ann.nearest(vectors))
    assert out.count() == 30
    assert more <= 12


def test_join_stage_leaves_the_driver(spark, monkeypatch):
    texts = [" ".join(f"w{i + k}" for k in range(60)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out, more = left_by(spark, monkeypatch, lambda: corpus_pipeline.keep_one_of_near_copies(spark, docs, ""))
    assert out.count() == 1
    assert more <= 12


def bits(df):
    """Of the size in bytes that Spark estimates for ``df``."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimated_sizes_of_rounds_stay_small(spark):
    df = spark.range(20).selectExpr("id", "id + 1 AS n")
    for _ in range(5):
        df = session.stable(df.join(df.selectExpr("id AS n", "n AS m"), "n", "left").selectExpr("id", "coalesce(m, n) AS n"))
    assert bits(df) <= 71
    assert sorted(map(tuple, df.collect())) == [(i, min(i + 32, 20)) for i in range(20)]


def test_estimated_sizes_of_the_search_stay_small(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(300, 8)))]
    written = []
    monkeypatch.setattr(ann, "stable", lambda df: written.append(session.stable(df)) or written[-1])
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert out.count() == 30
    assert max(map(bits, written)) <= 71
