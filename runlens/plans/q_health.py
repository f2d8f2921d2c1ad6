"""Status history and run health queries (S5, F1, P10-P14, P23, W2, W4, W6,
W7, A11, J3-J7, ST2-ST6, ST8, ST9 batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import health as H
from runlens.operators import status as S
from runlens.plans.oracle_ctes import ts_text, with_ctes
from runlens.plans.q_admission import jobs, ts
from runlens.plans.registry import register
from runlens.sources.derived import Derived

STALE_MINUTES = 24 * 60   # synthetic time scale (FIXTURES.md); default rule is 5


def _meta_sql(c: str) -> str:
    return f"nullif(left(regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[^\\x20-\\x7E]', '', 'g'), 128), '')"


_ISO = "strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"

_RUN_INDEX_SQL = f"""
SELECT run_date, compile_id, deal_id, status, stage, iso AS updated_at, worker_sha, parser_sha,
       elapsed_sec, entity_count, atom_count, percent_complete,
       CASE WHEN error IS NULL OR error = '' THEN NULL WHEN length(error) <= 500 THEN error
            ELSE left(error, 499) || '…' END AS error,
       {_meta_sql('status')} AS meta_status, {_meta_sql('stage')} AS meta_stage,
       {_meta_sql('deal_id')} AS meta_deal_id, {_meta_sql('compile_id')} AS meta_compile_id,
       {_meta_sql('iso')} AS meta_updated_at, {_meta_sql('elapsed_sec')} AS meta_elapsed_sec,
       {_meta_sql('worker_sha')} AS meta_worker_sha
FROM (SELECT *, {_ISO} AS iso, left({_ISO}, 10) AS run_date FROM status_events
      WHERE status IN ('completed', 'failed', 'interrupted'))
QUALIFY row_number() OVER (PARTITION BY run_date, compile_id ORDER BY updated_at DESC, seq DESC) = 1
"""


@register("run_index", with_ctes(_RUN_INDEX_SQL, "status_events"))
def q_run_index(spark, sf_dir):
    return S.run_index(Derived(spark, sf_dir).status_events())


@register("runs_per_day", with_ctes(f"""
SELECT run_date, status, stage, count(*) AS runs FROM ({_RUN_INDEX_SQL})
GROUP BY ROLLUP (run_date, status, stage)""", "status_events"))
def q_runs_per_day(spark, sf_dir):
    return S.runs_per_day(S.run_index(Derived(spark, sf_dir).status_events()))


@register("latest_progress", with_ctes(f"""
SELECT deal_id, compile_id, status, current_stage, stage_items_done, stage_items_total,
       {ts_text('updated_at')} AS updated_at FROM latest_progress""", "latest_progress"))
def q_latest_progress(spark, sf_dir):
    return S.latest_progress(Derived(spark, sf_dir).progress_events()).select(
        "deal_id", "compile_id", "status", "current_stage", "stage_items_done",
        "stage_items_total", ts("updated_at").alias("updated_at"))


@register("progress_view", with_ctes(r"""
SELECT l.deal_id, l.compile_id, l.status, l.current_stage, c.n AS stage_count_done,
       CAST(CASE WHEN l.status = 'done' THEN c.n ELSE 14 END AS BIGINT) AS stage_count_total_estimate,
       CAST((epoch_us(l.updated_at) - epoch_us(c.started_at)) // 1000 AS BIGINT) AS elapsed_ms,
       l.stage_items_done, l.stage_items_total
FROM latest_progress l JOIN (SELECT compile_id, count(DISTINCT current_stage) AS n,
                                    min(updated_at) AS started_at
                             FROM progress_events GROUP BY compile_id) c USING (compile_id)
""", "latest_progress", "progress_events"))
def q_progress_view(spark, sf_dir):
    p = Derived(spark, sf_dir).progress_events()
    per_run = p.groupBy("compile_id").agg(
        F.countDistinct("current_stage").alias("stage_count_done"),
        F.min("updated_at").alias("started_at"))
    last = S.latest_progress(p).drop("stage_count_done", "started_at").join(per_run, "compile_id")
    return last.select(
        "deal_id", "compile_id", "status", "current_stage", "stage_count_done",
        F.when(F.col("status") == "done", F.col("stage_count_done")).otherwise(14)
         .cast("bigint").alias("stage_count_total_estimate"),
        F.floor((F.unix_micros("updated_at") - F.unix_micros("started_at")) / 1000)
        .cast("bigint").alias("elapsed_ms"),
        "stage_items_done", "stage_items_total")


def _active(d):
    return S.active_runs(d.active_markers(), d.status_events())


@register("active_runs", with_ctes(f"""
SELECT compile_id, deal_id, stage, replica, boot_id, {ts_text('updated_at')} AS updated_at
FROM active_runs""", "active_runs"))
def q_active_runs(spark, sf_dir):
    return _active(Derived(spark, sf_dir)).select(
        "compile_id", "deal_id", "stage", "replica", "boot_id", ts("updated_at").alias("updated_at"))


def _killed_sql(stage: str, done: str, total: str) -> str:
    return (f"'The parser worker was killed mid-run' || CASE WHEN coalesce({stage}, '') <> '' THEN ' in ' || {stage} ELSE '' END"
            f" || CASE WHEN {total} > 0 AND {done} IS NOT NULL THEN ' at ' || format('{{:,}}', {done}) || ' of ' || format('{{:,}}', {total}) || ' items' ELSE '' END"
            f" || ', most likely for running out of memory. Nothing was saved from this run; press Re-parse to try again.'")


_DEAD_SQL = f"""
SELECT compile_id, deal_id, replica, boot_id, current_boot, stage, progress_compile_id, progress_stage,
       stage_items_done, stage_items_total, {_killed_sql('stage', 'stage_items_done', 'stage_items_total')} AS error
FROM (SELECT a.compile_id, a.deal_id, a.replica, a.boot_id, b.current_boot,
             coalesce(nullif(a.stage, ''), p.current_stage) AS stage, p.compile_id AS progress_compile_id,
             p.current_stage AS progress_stage, p.stage_items_done, p.stage_items_total
      FROM active_runs a JOIN current_boots b USING (replica)
      LEFT JOIN latest_progress p USING (deal_id)
      WHERE a.boot_id IS NOT NULL AND a.boot_id <> '' AND a.boot_id <> b.current_boot
        AND a.compile_id IS NOT NULL AND a.deal_id IS NOT NULL)
"""


def _dead(d):
    return H.dead_runs(_active(d), d.replica_boots(), d.progress_events())


@register("dead_runs", with_ctes(_DEAD_SQL, "active_runs", "current_boots", "latest_progress"))
def q_dead_runs(spark, sf_dir):
    return _dead(Derived(spark, sf_dir))


@register("guarded_fail", with_ctes(f"""
SELECT r.deal_id, r.compile_id, w AS written, CASE WHEN w THEN 'failed' END AS status,
       CASE WHEN w THEN 'killed' END AS stage,
       CASE WHEN w THEN coalesce(nullif(p.current_stage, ''), 'killed') END AS failed_stage,
       CAST(NULL AS VARCHAR) AS current_stage, CASE WHEN w THEN p.stages END AS stages,
       CASE WHEN w THEN p.started_at END AS started_at, CASE WHEN w THEN p.stage_count_done END AS stage_count_done,
       CASE WHEN w THEN p.stage_count_total_estimate END AS stage_count_total_estimate,
       CASE WHEN w THEN p.triggered_by END AS triggered_by, CASE WHEN w THEN p.trigger_kind END AS trigger_kind,
       CASE WHEN w THEN p.stage_items_done END AS stage_items_done,
       CASE WHEN w THEN p.stage_items_total END AS stage_items_total,
       CASE WHEN w THEN left(r.error, 500) END AS error
FROM ({_DEAD_SQL}) r LEFT JOIN latest_progress p USING (deal_id),
LATERAL (SELECT p.deal_id IS NULL OR p.compile_id IS NULL OR p.compile_id = r.compile_id AS w)
""", "active_runs", "current_boots", "latest_progress"))
def q_guarded_fail(spark, sf_dir):
    d = Derived(spark, sf_dir)
    req = _dead(d).select("deal_id", "compile_id", F.lit("killed").alias("stage"), "error")
    return H.guarded_fail(req, d.progress_events())


@register("killed_messages", with_ctes(f"""
SELECT deal_id, compile_id, {_killed_sql('current_stage', 'stage_items_done', 'stage_items_total')} AS message
FROM latest_progress""", "latest_progress"))
def q_killed_messages(spark, sf_dir):
    p = S.latest_progress(Derived(spark, sf_dir).progress_events())
    return p.select("deal_id", "compile_id", H.killed_run_message(
        F.col("current_stage"), F.col("stage_items_done"), F.col("stage_items_total"))
        .alias("message"))


@register("failure_class", with_ctes(r"""
SELECT error_id, compile_id, p AS permanent, CASE WHEN p THEN 'dead_deal' ELSE 'exception' END AS stage,
       CASE WHEN p THEN 2 ELSE 1 END AS exit_code, CASE WHEN p THEN 'drop' ELSE 'retry' END AS disposition,
       error_type || ': ' || error AS error, left(traceback, 4000) AS traceback
FROM (SELECT *, (contains(lower(error), 'blobnotfound') OR contains(lower(error), 'the specified blob does not exist')
                 OR (contains(lower(error_type), 'notfound') AND contains(lower(error), 'blob'))) AS p
      FROM errors)""", "errors"))
def q_failure_class(spark, sf_dir):
    return H.failure_class(Derived(spark, sf_dir).errors())


@register("cancel_match", with_ctes(r"""
SELECT r.request_id, r.deal_id, r.compile_id AS requested_compile_id,
       CASE WHEN r.asked IS NULL THEN l.compile_id ELSE n.compile_id END AS cancelled_run,
       (CASE WHEN r.asked IS NULL THEN l.compile_id ELSE n.compile_id END) IS NOT NULL AS matched
FROM (SELECT *, nullif(trim(compile_id, ' ' || chr(9) || chr(10) || chr(160)), '') AS asked FROM cancel_requests) r
LEFT JOIN (SELECT deal_id, compile_id FROM active_runs
           QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY updated_at DESC, compile_id DESC) = 1) l
  USING (deal_id)
LEFT JOIN active_runs n ON n.deal_id = r.deal_id AND n.compile_id = r.asked""", "cancel_requests", "active_runs"))
def q_cancel_match(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return H.cancel_match(d.cancel_requests(), _active(d))


def _oom_sql() -> str:
    gb = "printf('%.1f', round_even(CAST({x} AS DOUBLE) / 1073741824, 1))"
    where = ("CASE WHEN coalesce(current_stage, '') <> '' THEN ' in ' || current_stage ELSE '' END"
             " || CASE WHEN coalesce(stage_items_total, 0) <> 0 THEN ' at ' || format('{:,}', coalesce(stage_items_done, 0)) || ' of ' ||"
             " format('{:,}', stage_items_total) || ' items' ELSE '' END")
    return ("'The parse ran out of memory' || " + where + " || ': ' || " + gb.format(x="rss_bytes")
            + " || ' GB used of the worker''s ' || " + gb.format(x="limit_bytes")
            + " || ' GB. Nothing was saved from this run.'")


@register("oom_first_hit", with_ctes(f"""
SELECT compile_id, deal_id, {ts_text('sampled_at')} AS fired_at, seq, rss_bytes, 'failed' AS status,
       'out_of_memory' AS stage, {_oom_sql()} AS error
FROM (SELECT * FROM memory_samples
      WHERE limit_bytes > 0 AND fraction > 0 AND rss_bytes >= limit_bytes * fraction
      QUALIFY row_number() OVER (PARTITION BY compile_id ORDER BY sampled_at, seq) = 1)
LEFT JOIN (SELECT deal_id, current_stage, stage_items_done, stage_items_total FROM latest_progress) USING (deal_id)""",
    "memory_samples", "latest_progress"))
def q_oom_first_hit(spark, sf_dir):
    d = Derived(spark, sf_dir)
    r = H.oom_first_hit(d.memory_samples(), d.progress_events())
    return r.withColumn("fired_at", ts("fired_at"))


_BUDGETS = r"""
(SELECT compile_id, CAST(least(10800.0, greatest(1500.0, 45.0 * count(*) FILTER (WHERE stage = 'parse')))
         AS DOUBLE) AS budget_sec
 FROM status_events GROUP BY compile_id)"""


@register("budget_overrun", with_ctes(f"""
SELECT compile_id, deal_id, budget_sec, {ts_text('fired')} AS fired_at, 'failed' AS status, 'timeout' AS stage
FROM (SELECT s.*, b.budget_sec,
             make_timestamp(epoch_us(s.started_at) + CAST(round(b.budget_sec * 1000000) AS BIGINT)) AS fired
      FROM run_spans s JOIN {_BUDGETS} b USING (compile_id))
WHERE budget_sec > 0 AND coalesce(ended_at, now) > fired""", "run_spans", "status_events"))
def q_budget_overrun(spark, sf_dir):
    ev = Derived(spark, sf_dir).status_events()
    spans = S.run_spans(ev)
    spans = H.with_now(spans, ev)
    r = H.budget_overrun(spans, H.run_budgets(ev).select("compile_id", "budget_sec"), F.col("now"))
    return r.withColumn("fired_at", ts("fired_at"))


@register("stale_runs", with_ctes(f"""
SELECT compile_id, deal_id, {ts_text('last_at')} AS last_at,
       last_at < make_timestamp(epoch_us(now) - CAST({STALE_MINUTES * 60} AS BIGINT) * 1000000) AS stale
FROM run_spans WHERE ended_at IS NULL""", "run_spans"))
def q_stale_runs(spark, sf_dir):
    ev = Derived(spark, sf_dir).status_events()
    spans = H.with_now(S.run_spans(ev), ev)
    return H.stale_runs(spans, F.col("now"), STALE_MINUTES).withColumn("last_at", ts("last_at"))


@register("terminal_wins", with_ctes(r"""
SELECT s.compile_id, s.seq, s.status, s.stage FROM status_events s
LEFT JOIN (SELECT compile_id, min((updated_at, seq)) AS e FROM status_events
           WHERE status IN ('completed', 'failed', 'interrupted', 'cancelled') GROUP BY compile_id) f
  USING (compile_id)
WHERE NOT (coalesce((s.updated_at, s.seq) > f.e, false) AND s.status = 'running')""", "status_events"))
def q_terminal_wins(spark, sf_dir):
    return H.terminal_wins(Derived(spark, sf_dir).status_events()).select(
        "compile_id", "seq", "status", "stage")


@register("cancel_once", with_ctes(r"""
SELECT r.request_id, r.deal_id, r.compile_id AS requested_compile_id, m.compile_id AS cancelled_run,
       m.compile_id IS NOT NULL AS consumed
FROM cancel_requests r
LEFT JOIN (SELECT r2.request_id, u.compile_id
           FROM (SELECT *, nullif(trim(compile_id, ' ' || chr(9) || chr(10) || chr(160)), '') AS asked FROM cancel_requests) r2
           JOIN run_spans u ON u.deal_id = r2.deal_id AND u.started_at <= r2.requested_at
                AND coalesce(u.ended_at, u.last_at) >= r2.requested_at
                AND (r2.asked IS NULL OR r2.asked = u.compile_id)
           QUALIFY row_number() OVER (PARTITION BY r2.request_id ORDER BY u.started_at, u.compile_id) = 1) m
  USING (request_id)""", "cancel_requests", "run_spans"))
def q_cancel_once(spark, sf_dir):
    d = Derived(spark, sf_dir)
    return H.cancel_once(d.cancel_requests(), S.run_spans(d.status_events()))


_HOUR = "date_trunc('hour', j.received_at)"


@register("hourly_repeats", with_ctes(f"""
SELECT {ts_text(_HOUR)} AS window_start, count(*) AS repeats
FROM jobs j JOIN latest_status s USING (compile_id)
WHERE s.status = 'failed' AND s.stage IN ('timeout', 'killed', 'out_of_memory')
GROUP BY 1""", "jobs", "latest_status"))
def q_hourly_repeats(spark, sf_dir):
    from runlens.operators.admission import previous_final
    d = Derived(spark, sf_dir)
    picks = previous_final(jobs(spark, sf_dir), d.status_events()).where(
        F.col("blocked_stage").isNotNull())
    return H.hourly_repeats(picks).withColumn("window_start", ts("window_start"))


@register("dedup_delivery", with_ctes(f"""
SELECT compile_id, message_id AS seq, {ts_text('received_at')} AS received_at,
       row_number() OVER w AS seq_idx,
       (lag(received_at) OVER w IS NULL OR
        epoch_us(received_at) - epoch_us(lag(received_at) OVER w) > CAST(14400 AS BIGINT) * 1000000) AS kept
FROM jobs WINDOW w AS (PARTITION BY compile_id ORDER BY received_at, message_id)""", "jobs"))
def q_dedup_delivery(spark, sf_dir):
    deliveries = jobs(spark, sf_dir).select("compile_id", F.col("message_id").alias("seq"),
                                            "received_at")
    return H.dedup_delivery(deliveries).withColumn("received_at", ts("received_at"))


@register("attempt_overlap", with_ctes(r"""
SELECT message_key, seq, row_number() OVER w AS attempt,
       coalesce(lag(ended_at) OVER w > received_at, false) AS overlapped
FROM attempts WINDOW w AS (PARTITION BY message_key ORDER BY received_at, seq)""", "attempts"))
def q_attempt_overlap(spark, sf_dir):
    return H.attempt_overlap(Derived(spark, sf_dir).attempts())


@register("stage_rate", with_ctes(r"""
SELECT compile_id, current_stage, seq, seq_idx,
       CASE WHEN p_dt > 0 THEN (stage_items_done - p_done) / p_dt END AS rate,
       CASE WHEN b_dt > 0 THEN (stage_items_done - b_done) / b_dt END AS rate_window,
       stage_items_total - stage_items_done AS remaining
FROM (SELECT *, row_number() OVER w AS seq_idx,
             lag(stage_items_done) OVER w AS p_done,
             (epoch_us(updated_at) - epoch_us(lag(updated_at) OVER w)) / 1e6 AS p_dt,
             first_value(stage_items_done) OVER w5 AS b_done,
             (epoch_us(updated_at) - epoch_us(first_value(updated_at) OVER w5)) / 1e6 AS b_dt
      FROM progress_events
      WINDOW w AS (PARTITION BY compile_id, current_stage ORDER BY updated_at, seq),
             w5 AS (PARTITION BY compile_id, current_stage ORDER BY updated_at, seq
                    ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""", "progress_events"))
def q_stage_rate(spark, sf_dir):
    return H.stage_rate(Derived(spark, sf_dir).progress_events())


@register("path_keys", with_ctes(f"""
SELECT compile_id, deal_id, 'deals/' || deal_id || '/parser-jobs/' || compile_id || '.json' AS status_path,
       'deals/' || deal_id || '/latest/compile-progress.json' AS progress_path,
       'deals/' || deal_id || '/latest/compile-cancel.json' AS cancel_path,
       '_active-compiles/' || compile_id || '.json' AS marker_path,
       '_parser-runs/' || left(updated_at, 10) || '/' || compile_id || '.json' AS index_path
FROM ({_RUN_INDEX_SQL})""", "status_events"))
def q_path_keys(spark, sf_dir):
    from runlens.operators.admission import path_keys
    return path_keys(S.run_index(Derived(spark, sf_dir).status_events()))


@register("hourly_repeats_sliding", with_ctes(f"""
SELECT {ts_text('ws')} AS window_start, count(*) AS repeats
FROM (SELECT make_timestamp(epoch_us(j.received_at) // 900000000 * 900000000 - i * 900000000) AS ws
      FROM jobs j JOIN latest_status s USING (compile_id), range(4) t(i)
      WHERE s.status = 'failed' AND s.stage IN ('timeout', 'killed', 'out_of_memory'))
GROUP BY ws""", "jobs", "latest_status"))
def q_hourly_repeats_sliding(spark, sf_dir):
    from runlens.operators.admission import previous_final
    d = Derived(spark, sf_dir)
    picks = previous_final(jobs(spark, sf_dir), d.status_events()).where(
        F.col("blocked_stage").isNotNull())
    return H.sliding_repeats(picks).withColumn("window_start", ts("window_start"))
