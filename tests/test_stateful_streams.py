"""Streams with a watermark: answers while running, corrections for late rows,
state that ends, and the batch rule's rows in the end."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import health as H
from runlens.operators import status as S
from runlens.streaming import stateful as W
from runlens.streaming import twins as T

HOUR = 3600
STATUS = "compile_id string, deal_id string, seq long, status string, stage string, t long"


def _land(spark, rows, schema, ts):
    """One file per inner list of ``rows``, in that order."""
    path = tempfile.mkdtemp(prefix="landing-")
    for part in rows:
        spark.createDataFrame(part, schema).withColumn(ts, F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(path)
        W._set_times(spark, path)
    return path


def _stream(spark, path):
    return T.landing_stream(spark, path, 1)


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_late_end_is_corrected(spark):
    """The end of 20 s comes after the rows of 30 s and 25 s: both were passed, both are taken back."""
    land = _land(spark, [[("c", "d", 3, "running", "parse", 30), ("c", "d", 1, "running", "parse", 10)],
                         [("k", "d", 4, "running", "parse", 40), ("c", "d", 5, "running", "emit", 25)],
                         [("c", "d", 2, "completed", "done", 20), ("c", "d", 6, "running", "emit", 50)],
                         [("c", "d", 7, "failed", "x", 60), ("c", "d", 8, "running", "x", 15), ("k", "d", 9, "running", "x", 70)]], STATUS, "updated_at")
    told = W.drain(W.terminal_wins(_stream(spark, land)), "t")
    assert {r.seq for r in told.where("correction").collect()} == {3, 5}
    assert {r.seq for r in told.where("NOT correction").collect()} == {3, 1, 4, 5, 2, 7, 8, 9}   # 6 never comes out
    cols = ["compile_id", "seq", "status", "stage"]
    assert _rows(W.without_corrected(told), *cols) == _rows(H.terminal_wins(spark.read.parquet(land)), *cols)


def test_runs_are_forgotten(spark):
    """A lease after its end a compile is a new run, and the timer has cleared the old one."""
    land = _land(spark, [[("c", "d", 1, "completed", "done", 5)], [("z", "d", 2, "running", "x", 40 * HOUR)], [("z", "d", 3, "running", "x", 41 * HOUR)],
                         [("c", "d", 4, "running", "x", 42 * HOUR)]], STATUS, "updated_at")
    told = W.drain(W.terminal_wins(_stream(spark, land)), "t")
    assert {r.seq for r in told.collect()} == {1, 2, 3, 4}
    assert {r.seq for r in H.terminal_wins(spark.read.parquet(land)).collect()} == {1, 2, 3}


@pytest.mark.parametrize("seed", [2, 3])
def test_shuffled_arrival_equals_batch(spark, seed):
    """Random runs and deliveries, up to the watermark out of order, a batch per file."""
    rnd = random.Random(seed)
    rows = [(f"c{rnd.randrange(6)}", f"d{rnd.randrange(2)}", i, rnd.choice(["running"] * 20 + ["completed", "failed"]), "s", rnd.randrange(1, 9 * HOUR))
            for i in range(240)]
    rows.sort(key=lambda r: r[-1] + rnd.randrange(0, 4 * HOUR))
    land = _land(spark, [rows[k:k + 40] for k in range(0, len(rows), 40)], STATUS, "updated_at")
    told = W.drain(W.terminal_wins(_stream(spark, land), lease_sec=24 * HOUR), "t")
    assert told.where("correction").count() > 0
    cols = ["compile_id", "seq", "status", "stage"]
    table = spark.read.parquet(land)
    assert _rows(W.without_corrected(told), *cols) == _rows(H.terminal_wins(table), *cols)

    seen = table.select("compile_id", "seq", F.col("updated_at").alias("received_at"))
    said = W.drain(W.dedup_delivery(_stream(spark, land).select("compile_id", "seq", F.col("updated_at").alias("received_at")), lease_sec=300), "r")
    assert said.where("correction").count() > 0
    want = _rows(H.dedup_delivery(seen, lease_sec=300).withColumn("us", F.unix_micros("received_at")), "compile_id", "us", "seq", "kept")
    assert _rows(W.last_word(said), "compile_id", "us", "seq", "kept") == want
    assert said.where("NOT correction").count() == len(rows)

    # windows and silences whose time is over; the others are still open
    late = "4 hours"
    end = table.agg(F.max("updated_at")).first()[0].timestamp() - 4 * HOUR
    counts = W.drain(W.repeat_counts(_stream(spark, land), "updated_at", "1 hour", "15 minutes", late), "w")
    every = H.sliding_repeats(table, "updated_at")
    closed = every.where(F.unix_timestamp("window_start") + HOUR <= F.lit(end))
    assert _rows(counts, "window_start", "repeats") == _rows(closed, "window_start", "repeats") and 0 < closed.count() < every.count()
    told = W.drain(W.silences(_stream(spark, land), 20, late), "s")
    both = W.silences(table, 20, late)
    over = F.col("last_at") + F.expr("INTERVAL 20 MINUTES") < F.timestamp_seconds(F.lit(end))
    assert _rows(told.where(over), "compile_id", "since", "last_at", "ended") == _rows(both.where(over), "compile_id", "since", "last_at", "ended")
    assert 0 < told.count() < both.count()


def test_redelivery_within_one_lease(spark):
    land = _land(spark, [[("c", 2, HOUR)], [("c", 1, 5), ("b", 4, 7)], [("c", 3, 6 * HOUR), ("c", 5, 6 * HOUR)], [("c", 7, 13 * HOUR)], [("c", 8, 14 * HOUR)], [("c", 9, 15 * HOUR)]],
                 "compile_id string, seq long, t long", "received_at")
    said = W.drain(W.dedup_delivery(_stream(spark, land)), "r")
    assert {(r.seq, r.kept, r.correction) for r in said.collect()} == {(2, True, False), (1, True, False), (2, False, True), (4, True, False),
                                                                     (3, True, False), (5, False, False), (7, True, False), (8, False, False),
                                                                     (9, False, False)}
    kept = W.drain(W.drop_redelivery(_stream(spark, land)), "d")
    assert {r.seq for r in kept.collect()} == {2, 4, 9}   # the watermark has to pass before a compile is new again


def test_cancel_is_consumed_once(spark):
    status = [[("c", "d", 1, "running", "parse", 10), ("c", "d", 3, "running", "parse", 30), ("k", "e", 5, "running", "emit", 40)],
              [("c", "d", 2, "completed", "done", 20), ("k", "e", 4, "running", "parse", 5000), ("m", "d", 6, "failed", "x", 90_000)],
              [(W.CLOSING, W.CLOSING, None, None, None, 900_000)]]
    asked = [[(1, "d", " c\n", 15), (2, "d", " ", 15), (3, "e", "c", 15)], [(4, "e", None, 60), (5, "d", "c", 25), (6, None, None, 15)],
             [(None, W.CLOSING, None, 900_000)]]
    runs, req = _land(spark, status, STATUS, "updated_at"), _land(spark, asked, "request_id long, deal_id string, compile_id string, t long", "requested_at")
    pairs = W.drain(W.cancels(_stream(spark, req), _stream(spark, runs), "2 hours", "4 hours"), "c")
    got = {r.request_id: r.cancelled_run for r in W.consumed_by(pairs).collect()}
    assert got == {1: "c", 2: "c", 3: None, 4: "k", 5: None, 6: None}
    batch = H.cancel_once(spark.read.parquet(req).where("request_id IS NOT NULL"), S.run_spans(spark.read.parquet(runs).where("seq IS NOT NULL")))
    assert {r.request_id: r.cancelled_run for r in batch.collect()} == got


def _earliest(requests, spans):
    out = {}
    for i, deal, asked, at in requests:
        asked = (asked or "").strip() or None
        on = [(s, c) for d, c, s, u in spans if d == deal and deal is not None and s <= at <= u and asked in (None, c)]
        out[i] = min(on)[1] if on else None
    return out


def test_cancel_without_pairs(spark):
    """Overlapping, nested and equal runs against every run; and a deal with
    many runs and requests, whose widest step has as many rows as both."""
    rnd = random.Random(4)
    spans = [(rnd.choice(["d", "e", None]), f"c{i:03}", s := rnd.randrange(300), s + rnd.choice([0, 5, 60, 250])) for i in range(150)]
    requests = [(i, rnd.choice(["d", "e", "f", None]), rnd.choice([None, " ", f"c{rnd.randrange(150):03}"]), rnd.randrange(-5, 560)) for i in range(300)]

    def frames(requests, spans):
        ask = spark.createDataFrame(requests, "request_id long, deal_id string, compile_id string, t long").withColumn("requested_at", F.timestamp_seconds("t"))
        run = spark.createDataFrame(spans, "deal_id string, compile_id string, s long, u long").selectExpr(
            "deal_id", "compile_id", "timestamp_seconds(s) AS started_at", "timestamp_seconds(u) AS last_at", "CAST(NULL AS timestamp) AS ended_at")
        return ask, run
    got = {r.request_id: r.cancelled_run for r in H.cancel_once(*frames(requests, spans)).collect()}
    assert got == _earliest(requests, spans)
    ask = spark.range(20000).selectExpr("id AS request_id", "'d' AS deal_id", "CAST(NULL AS string) AS compile_id", "timestamp_seconds(id) AS requested_at")
    run = spark.range(20000).selectExpr("'d' AS deal_id", "concat('c', id) AS compile_id", "timestamp_seconds(id) AS started_at",
                                        "timestamp_seconds(id + 50000) AS last_at", "CAST(NULL AS timestamp) AS ended_at")
    found = H.cancel_once(ask, run)
    assert found.where("cancelled_run = 'c0'").count() == 20000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
