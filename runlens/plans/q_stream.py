"""Streaming queries, checked against the batch rules' SQL (ST1-ST9).
Inputs land once per session as Parquet files and are drained with
Trigger.AvailableNow in several micro-batches. The twins take them in no order
of time; the streams with a watermark (ST4-ST6, ST8, ST9) in the order in which
rows arrive, up to three hours late and out of order by that much."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans.oracle_ctes import ts_text, with_ctes
from runlens.plans import q_health  # noqa: F401 (its SQL is reused below)
from runlens.plans.registry import ORACLE, register
from runlens.session import materialized, task_count, written_once
from runlens.sources.derived import Derived
from runlens.streaming import stateful as W
from runlens.streaming import twins as T


FILES = 3  # landing files of a micro-batch
JITTER = 3 * 3600      # seconds that a row comes late, at most (the watermark allows four hours)
DAY = 24 * 3600        # synthetic time scale (FIXTURES.md): a run is a user's day


def _landing(spark, sf_dir, name, build) -> str:
    return written_once(spark, f"landing_{name}", sf_dir, lambda p: build().write.parquet(p))


def _arriving(spark, sf_dir, name, ts, build, closing_days=None):
    """A stream of ``build()`` in the order of arrival, one file per batch."""
    land = written_once(spark, f"arriving_{name}_{closing_days}", sf_dir,
                        lambda p: W.land_in_order(build(), ts, p, JITTER, closing_days=closing_days))
    return T.landing_stream(spark, land, 1)


def _text(us):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


@register("stream_decode", with_ctes(r"""
SELECT message_id, CASE WHEN route = 'draft' THEN 'drafts' WHEN job_ok THEN 'jobs' ELSE 'poison' END AS sink
FROM decoded_messages""", "decoded_messages"))
def q_stream_decode(spark, sf_dir):
    land = _landing(spark, sf_dir, "raw_messages",
                    lambda: Derived(spark, sf_dir).raw_messages(8))
    return T.stream_decode(spark, land).select("message_id", "sink")


@register("stream_latest", with_ctes(f"""
SELECT deal_id, compile_id, status, current_stage, stage_items_done, stage_items_total,
       {ts_text('updated_at')} AS updated_at FROM latest_progress""", "latest_progress"))
def q_stream_latest(spark, sf_dir):
    land = _landing(spark, sf_dir, "progress_events",
                    lambda: Derived(spark, sf_dir).progress_events().repartition(8))
    r = T.stream_latest(spark, land)
    return r.select("deal_id", "compile_id", "status", "current_stage", "stage_items_done",
                    "stage_items_total",
                    F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


@register("stream_terminal_wins", with_ctes(r"""
SELECT s.compile_id, s.seq, s.status, s.stage FROM status_events s
LEFT JOIN (SELECT compile_id, min((updated_at, seq)) AS e FROM status_events
           WHERE status IN ('completed', 'failed', 'interrupted', 'cancelled') GROUP BY compile_id) f
  USING (compile_id)
WHERE NOT (coalesce((s.updated_at, s.seq) > f.e, false) AND s.status = 'running')""", "status_events"))
def q_stream_terminal_wins(spark, sf_dir):
    rows = _arriving(spark, sf_dir, "status", "updated_at", lambda: Derived(spark, sf_dir).status_events(task_count(spark)).select(
        "compile_id", "deal_id", "seq", "status", "stage", "updated_at"))
    told = W.drain(W.terminal_wins(rows, lease_sec=DAY), "terminal_wins")
    return W.without_corrected(told).select("compile_id", "seq", "status", "stage")


@register("stream_oom_first_hit", ORACLE["oom_first_hit"])
def q_stream_oom_first_hit(spark, sf_dir):
    land = _landing(spark, sf_dir, "memory_samples",
                    lambda: Derived(spark, sf_dir).memory_samples().repartition(8))
    return T.stream_oom_first_hit(spark, land, Derived(spark, sf_dir).progress_events(), FILES)


@register("stream_dedup_delivery", with_ctes(f"""
SELECT compile_id, message_id AS seq, {ts_text('received_at')} AS received_at,
       (lag(received_at) OVER w IS NULL OR
        epoch_us(received_at) - epoch_us(lag(received_at) OVER w) > CAST(14400 AS BIGINT) * 1000000) AS kept
FROM jobs WINDOW w AS (PARTITION BY compile_id ORDER BY received_at, message_id)""", "jobs"))
def q_stream_dedup_delivery(spark, sf_dir):
    from runlens.plans.q_admission import jobs
    rows = _arriving(spark, sf_dir, "deliveries", "received_at", lambda: jobs(spark, sf_dir).select(
        "compile_id", F.col("message_id").alias("seq"), "received_at"))
    told = W.drain(W.dedup_delivery(rows), "dedup_delivery")
    return W.last_word(told).select("compile_id", "seq", _text("us").alias("received_at"), "kept")


@register("stream_budget_overrun", with_ctes(f"""
SELECT compile_id, budget_sec, {ts_text('fired')} AS fired_at
FROM (SELECT s.*, b.budget_sec,
             make_timestamp(epoch_us(s.started_at) + CAST(round(b.budget_sec * 1000000) AS BIGINT)) AS fired
      FROM run_spans s JOIN (SELECT compile_id, CAST(least(10800.0, greatest(1500.0,
                             45.0 * count(*) FILTER (WHERE stage = 'parse'))) AS DOUBLE) AS budget_sec
                             FROM status_events GROUP BY compile_id) b USING (compile_id))
WHERE budget_sec > 0 AND coalesce(ended_at, now) > fired""", "run_spans", "status_events"))
def q_stream_budget_overrun(spark, sf_dir):
    from runlens.operators.health import run_budgets
    d = Derived(spark, sf_dir)
    land = _landing(spark, sf_dir, "status_events",
                    lambda: d.status_events().repartition(8))
    budgets = run_budgets(d.status_events())
    fired = T.stream_budget_overrun(spark, land, budgets, FILES)
    return fired.select("compile_id", "budget_sec",
                        F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fired_at"))


@register("stream_stale_runs", with_ctes(f"""
SELECT compile_id, {ts_text('last_at')} AS last_at FROM run_spans
WHERE ended_at IS NULL
  AND last_at < make_timestamp(epoch_us(now) - CAST(24 * 60 * 60 AS BIGINT) * 1000000)""", "run_spans"))
def q_stream_stale_runs(spark, sf_dir):
    from runlens.plans.q_health import STALE_MINUTES
    # a last row as late as the watermark allows brings it to the newest write
    rows = _arriving(spark, sf_dir, "status", "updated_at", lambda: Derived(spark, sf_dir).status_events(task_count(spark)).select(
        "compile_id", "deal_id", "seq", "status", "stage", "updated_at"), closing_days=4 / 24)
    closed = W.drain(W.silences(rows, STALE_MINUTES), "silences")
    return W.stale_now(closed).select("compile_id", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"))


@register("stream_cancel_once", ORACLE["cancel_once"])
def q_stream_cancel_once(spark, sf_dir):
    d = Derived(spark, sf_dir)
    rows = _arriving(spark, sf_dir, "status", "updated_at", lambda: d.status_events(task_count(spark)).select(
        "compile_id", "deal_id", "seq", "status", "stage", "updated_at"), closing_days=10)
    asked = _arriving(spark, sf_dir, "cancel_requests", "requested_at", d.cancel_requests, closing_days=10)
    return W.consumed_by(W.drain(W.cancels(asked, rows, "24 hours", "24 hours", apart="4 days"), "cancels"))


def _pickups(spark, sf_dir):
    """The stream of deliveries, those of compiles that must not run again."""
    from runlens.operators.admission import last_stages, with_last
    from runlens.plans.q_admission import jobs
    rows = _arriving(spark, sf_dir, "pickups", "received_at",
                     lambda: jobs(spark, sf_dir).select("compile_id", "message_id", "received_at"), closing_days=1)
    # the table is written once, as every micro-batch meets it
    last = materialized(spark, "last_stages", sf_dir, lambda: last_stages(Derived(spark, sf_dir).status_events(task_count(spark))))
    known = with_last(rows, last)
    return known.where(F.col("blocked_stage").isNotNull() | (F.col("compile_id") == W.CLOSING))   # the closing row moves the time on


@register("stream_hourly_repeats", ORACLE["hourly_repeats"])
def q_stream_hourly_repeats(spark, sf_dir):
    closed = W.drain(W.repeat_counts(_pickups(spark, sf_dir)), "hourly_repeats")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "repeats")


@register("stream_hourly_repeats_sliding", ORACLE["hourly_repeats_sliding"])
def q_stream_hourly_repeats_sliding(spark, sf_dir):
    closed = W.drain(W.repeat_counts(_pickups(spark, sf_dir), slide="15 minutes"), "hourly_repeats_sliding")
    return closed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "repeats")
