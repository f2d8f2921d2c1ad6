"""The streaming twins give the batch rule's rows in any order of arrival,
one file per micro-batch, and a replayed epoch adds nothing."""

import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import health as H
from runlens.operators import status as S
from runlens.sources import versioned as V
from runlens.streaming import twins as T


def _land(spark, rows, schema, ts):
    """One Parquet file per row, in the order of ``rows``."""
    path = tempfile.mkdtemp(prefix="landing-")
    for r in rows:
        spark.createDataFrame([r], schema).withColumn(ts, F.timestamp_seconds("t")).drop("t").coalesce(1) \
            .write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def status(spark):
    rows = [("c", "d", 3, "running", "parse", 30), ("c", "d", 1, "running", "parse", 10), ("k", "e", 4, "running", "parse", 5000),
            ("c", "d", 2, "completed", "done", 20), ("k", "e", 5, "running", "emit", 40), ("m", "d", 6, "failed", "x", 90_000)]
    return _land(spark, rows, "compile_id string, deal_id string, seq long, status string, stage string, t long", "updated_at")


def _no_progress(spark):
    return spark.createDataFrame([], "deal_id string, updated_at timestamp, seq long, current_stage string, stage_items_done long, stage_items_total long")


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_spans_rules(spark, status):
    events = spark.read.parquet(status)
    spans = S.run_spans(events)
    now = events.agg(F.max("updated_at")).scalar()
    budgets = spark.createDataFrame([("c", 5.0), ("k", 100.0), ("m", 0.0)], "compile_id string, budget_sec double")
    _same(T.stream_budget_overrun(spark, status, budgets, 1), H.budget_overrun(spans, budgets, now))


def test_first_memory_hit(spark):
    rows = [("c", "d", 2, 95, 100, 0.9, 20), ("c", "d", 1, 90, 100, 0.9, 10), ("c", "d", 0, 89, 100, 0.9, 5), ("z", "d", 9, 99, 0, 0.9, 1)]
    land = _land(spark, rows, "compile_id string, deal_id string, seq long, rss_bytes long, limit_bytes long, fraction double, t long",
                 "sampled_at")
    assert [(r.compile_id, r.seq) for r in T.stream_oom_first_hit(spark, land, _no_progress(spark), max_files=1).collect()] == [("c", 1)]


def test_state_is_a_row_per_key(spark, status):
    """However many batches, and when a batch is merged again."""
    rows = T.landing_stream(spark, status, 1).select("compile_id", F.col("seq").alias("s"))
    state = T.keep_merged(rows, "test", "compile_id", s=F.max("s"))
    want = spark.read.parquet(status).groupBy("compile_id").agg(F.max("seq").alias("s"))
    _same(state, want)
    path = tempfile.mkdtemp(prefix="state-") + "/t"
    reduce = lambda rows: rows.groupBy("compile_id").agg(F.max("s").alias("s"))
    for _ in range(4):
        V.merge_by_key(spark, path, want, "compile_id", reduce)
    assert V.vacuum(spark, path) == 2 and V.vacuum(spark, path) == 0
    _same(V.read_versioned(spark, path), want)
