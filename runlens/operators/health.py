"""Run health: dead runs, ownership, messages, cancels and the batch forms
of the streaming detectors (ST2-ST6, ST8, ST9).

Every detector is a pure ``DataFrame -> DataFrame`` function; the streaming
twins in ``runlens.streaming`` apply the same rules per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import blank_to_null
from runlens.operators.ordered import with_previous
from runlens.operators.sequence import sequence_index, with_lag
from runlens.operators.status import RUN_ENDS, latest_by, latest_progress

GIB = 1073741824
# What a guarded terminal write keeps of the current document.
KEPT_PROGRESS_FIELDS = ("stages", "started_at", "stage_count_done", "stage_count_total_estimate", "triggered_by",
                        "trigger_kind", "stage_items_done", "stage_items_total")
PROGRESS_ERROR_MAX = 500
TRACEBACK_MAX = 4000
LEASE_MAX_SEC = 4 * 3600


def plus_seconds(ts: Column, sec: Column) -> Column:
    """``ts + sec`` at microsecond precision (no interval-type limits)."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(sec * 1_000_000).cast("bigint"))


def _thousands(x: Column) -> Column:
    return F.format_number(x.cast("bigint"), 0)


def killed_run_message(stage: Column, done: Column, total: Column) -> Column:
    """P12: ' in <stage>' when known, ' at d of t items' when total > 0 and
    done is a number (a null done drops the item part)."""
    where = F.concat(
        F.when(F.coalesce(stage, F.lit("")) != "", F.concat(F.lit(" in "), stage)).otherwise(""),
        F.when((total > 0) & done.isNotNull(),
               F.concat(F.lit(" at "), _thousands(done), F.lit(" of "), _thousands(total),
                        F.lit(" items"))).otherwise(""))
    return F.concat(F.lit("The parser worker was killed mid-run"), where,
                    F.lit(", most likely for running out of memory. Nothing was saved from "
                          "this run; press Re-parse to try again."))


def oom_message(stage: Column, done: Column, total: Column, used: Column,
                limit: Column) -> Column:
    """GB used of the limit to one decimal (half-even like Python)."""
    def gb(x):
        return F.format_string("%.1f", F.bround(x.cast("double") / GIB, 1))
    where = F.concat(
        F.when(F.coalesce(stage, F.lit("")) != "", F.concat(F.lit(" in "), stage)).otherwise(""),
        F.when(F.coalesce(total, F.lit(0)) != 0,
               F.concat(F.lit(" at "), _thousands(F.coalesce(done, F.lit(0))), F.lit(" of "),
                        _thousands(total), F.lit(" items"))).otherwise(""))
    return F.concat(F.lit("The parse ran out of memory"), where, F.lit(": "), gb(used),
                    F.lit(" GB used of the worker's "), gb(limit),
                    F.lit(" GB. Nothing was saved from this run."))


def failure_class(errors: DataFrame) -> DataFrame:
    """P14 + F5: permanent (missing blob) failures are dropped with exit 2 as
    ``dead_deal``; anything else is transient, exit 1, left for retry. The row
    written tells the error with its type and the start of the traceback."""
    msg = F.lower(F.col("error"))
    permanent = (msg.contains("blobnotfound")
                 | msg.contains("the specified blob does not exist")
                 | (F.lower(F.col("error_type")).contains("notfound") & msg.contains("blob")))
    return errors.select(
        "error_id", "compile_id", permanent.alias("permanent"),
        F.when(permanent, "dead_deal").otherwise("exception").alias("stage"),
        F.when(permanent, 2).otherwise(1).alias("exit_code"),
        F.when(permanent, "drop").otherwise("retry").alias("disposition"),
        F.concat_ws(": ", "error_type", "error").alias("error"), F.left("traceback", F.lit(TRACEBACK_MAX)).alias("traceback"))


def current_boots(boots: DataFrame) -> DataFrame:
    """The current boot of each replica: its latest boot."""
    return latest_by(boots, ["replica"], ["booted_at", "boot_id"]).select(
        "replica", F.col("boot_id").alias("current_boot"))


def dead_runs(active: DataFrame, boots: DataFrame, progress_events: DataFrame) -> DataFrame:
    """J4 + J7 + P12: active markers left by an earlier boot of their own
    replica (both ids present) are dead; stage from the marker, else from the
    deal's progress; items from the progress."""
    cur = current_boots(boots)
    prog = latest_progress(progress_events).select(
        "deal_id", F.col("compile_id").alias("progress_compile_id"),
        F.col("current_stage").alias("progress_stage"), "stage_items_done",
        "stage_items_total")
    dead = (active.join(cur, "replica")
            .where(F.col("boot_id").isNotNull() & (F.col("boot_id") != "")
                   & (F.col("boot_id") != F.col("current_boot"))
                   & blank_to_null("compile_id").isNotNull() & blank_to_null("deal_id").isNotNull()))
    j = dead.join(prog, "deal_id", "left")
    stage = F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.col("progress_stage"))
    return j.select(
        "compile_id", "deal_id", "replica", "boot_id", "current_boot",
        stage.alias("stage"), "progress_compile_id", "progress_stage",
        "stage_items_done", "stage_items_total",
        killed_run_message(stage, F.col("stage_items_done"), F.col("stage_items_total"))
        .alias("error"))


def guarded_fail(requests: DataFrame, progress_events: DataFrame) -> DataFrame:
    """Put the deal's progress into a terminal state for *this* compile,
    only when there is no document, it names no compile, or it is ours. The
    document is the newest one of the deal, so a newer compile's write wins.

    ``requests``: deal_id, compile_id, stage, error. The eight kept fields come
    from the current document, its current_stage becomes null;
    failed_stage = its current_stage else the stage.
    """
    cur = latest_progress(progress_events).select(
        "deal_id", F.lit(True).alias("_has_doc"),
        F.col("compile_id").alias("doc_compile_id"),
        F.col("current_stage").alias("doc_stage"), *KEPT_PROGRESS_FIELDS)
    j = requests.join(cur, "deal_id", "left")
    has_doc = F.coalesce(F.col("_has_doc"), F.lit(False))
    ours = ~has_doc | F.col("doc_compile_id").isNull() | (F.col("doc_compile_id") == F.col("compile_id"))
    return j.select(
        "deal_id", "compile_id", ours.alias("written"),
        F.when(ours, F.lit("failed")).alias("status"),
        F.when(ours, F.col("stage")).alias("stage"),
        F.when(ours, F.coalesce(F.nullif(F.col("doc_stage"), F.lit("")), F.col("stage")))
         .alias("failed_stage"),
        F.lit(None).cast("string").alias("current_stage"),
        *[F.when(ours, F.col(c)).alias(c) for c in KEPT_PROGRESS_FIELDS],
        F.when(ours, F.left(F.col("error"), F.lit(PROGRESS_ERROR_MAX))).alias("error"))


def cancel_match(requests: DataFrame, active: DataFrame) -> DataFrame:
    """A request cancels a run of its own deal when it names no compile
    (the deal's latest active run) or names that run; others stay pending.
    The named id is stripped, a blank one names none.

    Two equi-joins instead of a theta join, so one deal with many runs and
    requests never produces request x run pairs.
    """
    asked = blank_to_null("compile_id")
    latest_active = latest_by(active.select("deal_id", "compile_id", "updated_at"),
                              ["deal_id"], ["updated_at", "compile_id"]).select(
        "deal_id", F.col("compile_id").alias("any_run"))
    named = active.select(F.col("deal_id").alias("_d"), F.col("compile_id").alias("named_run")).distinct()
    j = (requests.withColumn("_c", asked).join(latest_active, "deal_id", "left")
                 .join(named, (F.col("deal_id") == F.col("_d")) & (F.col("_c") == F.col("named_run")), "left"))
    run = F.when(F.col("_c").isNull(), F.col("any_run")).otherwise(F.col("named_run"))
    return j.select("request_id", "deal_id", F.col("compile_id").alias("requested_compile_id"),
                    run.alias("cancelled_run"), run.isNotNull().alias("matched"))


def oom_first_hit(samples: DataFrame, progress_events: DataFrame) -> DataFrame:
    """ST2 (batch): the first sample per compile with rss >= limit * fraction
    (equality fires); a zero limit or fraction disables the guard. Stage and
    items are those of the deal's progress."""
    return oom_failures(first_hits(samples), progress_events)


def hits(samples: DataFrame) -> DataFrame:
    """(compile_id, f): the samples at or over the ceiling, as ordered rows."""
    armed = (F.col("limit_bytes") > 0) & (F.col("fraction") > 0)
    over = samples.where(armed & (F.col("rss_bytes") >= F.col("limit_bytes") * F.col("fraction")))
    return over.select("compile_id", F.struct("sampled_at", "seq", "deal_id", "rss_bytes", "limit_bytes").alias("f"))


def first_hits(samples: DataFrame) -> DataFrame:
    """(compile_id, f): the first sample at or over the ceiling."""
    return hits(samples).groupBy("compile_id").agg(F.min("f").alias("f"))


def oom_failures(first: DataFrame, progress_events: DataFrame) -> DataFrame:
    """The terminal write that a first hit causes (P13 with the stage and items
    of the deal's latest progress, if it has one)."""
    at = latest_progress(progress_events).select(F.col("deal_id").alias("_deal"), "current_stage", "stage_items_done", "stage_items_total")
    return first.join(at, F.col("f.deal_id") == F.col("_deal"), "left").select(
        "compile_id", F.col("f.deal_id").alias("deal_id"), F.col("f.sampled_at").alias("fired_at"),
        F.col("f.seq").alias("seq"), F.col("f.rss_bytes").alias("rss_bytes"),
        F.lit("failed").alias("status"), F.lit("out_of_memory").alias("stage"),
        oom_message(F.col("current_stage"), F.col("stage_items_done"), F.col("stage_items_total"),
                    F.col("f.rss_bytes"), F.col("f.limit_bytes")).alias("error"))


def budget_overrun(spans: DataFrame, budgets: DataFrame, now: Column) -> DataFrame:
    """ST3 (batch): a run still going at start + budget is failed/timeout at
    that instant; a budget <= 0 disables the watchdog."""
    j = spans.join(budgets, "compile_id")
    deadline = plus_seconds(F.col("started_at"), F.col("budget_sec"))
    end = F.coalesce(F.col("ended_at"), now)
    fired = (F.col("budget_sec") > 0) & (end > deadline)
    return j.where(fired).select(
        "compile_id", "deal_id", "budget_sec", deadline.alias("fired_at"),
        F.lit("failed").alias("status"), F.lit("timeout").alias("stage"))


def stale_runs(spans: DataFrame, now: Column, minutes: float = 5.0) -> DataFrame:
    """ST4 (batch): a run that has not ended and wrote nothing for
    ``minutes`` is stale (the reader's rule; the writer beats every 4 s)."""
    limit = plus_seconds(now, F.lit(-minutes * 60.0))
    return spans.where(F.col("ended_at").isNull()).select(
        "compile_id", "deal_id", "last_at", (F.col("last_at") < limit).alias("stale"))


def terminal_wins(status_events: DataFrame) -> DataFrame:
    """ST5 (batch): after a compile's first end row, later 'running' rows are
    dropped. The first end is a per-compile aggregate joined back (no window
    over a whole compile)."""
    is_end = F.col("status").isin(*RUN_ENDS)
    first_end = status_events.where(is_end).groupBy("compile_id").agg(
        F.min(F.struct("updated_at", "seq")).alias("_end"))
    j = status_events.join(first_end, "compile_id", "left")
    after = F.struct("updated_at", "seq") > F.col("_end")
    drop = F.coalesce(after, F.lit(False)) & (F.col("status") == "running")
    return j.where(~drop).drop("_end")


def cancel_once(requests: DataFrame, spans: DataFrame) -> DataFrame:
    """ST6 (batch): each request is consumed by the first run it reaches: the
    named run of the deal if it was still going at the request, else (no run
    named, or a blank id) the earliest run of the deal going at that instant.

    No pairs of requests and runs are made. Of a deal's runs in the order of
    their starts, only those that go on longer than all before them can be the
    earliest one going at some instant; their ends rise with their starts, so a
    request's run is the one with the next end, if it has started by then.
    Both steps are running extremes of the sequence primitive.
    """
    runs = spans.select("deal_id", "compile_id", "started_at", F.coalesce("ended_at", "last_at").alias("until"))
    asked = requests.select("request_id", "deal_id", "requested_at", blank_to_null("compile_id").alias("_c"))
    named = (asked.where("_c IS NOT NULL").join(runs, (asked["deal_id"] == runs["deal_id"]) & (F.col("_c") == runs["compile_id"]))
                  .where((F.col("started_at") <= F.col("requested_at")) & (F.col("until") >= F.col("requested_at")))
                  .select("request_id", runs["compile_id"].alias("run")))
    longest = sequence_index(runs.where("deal_id IS NOT NULL AND started_at IS NOT NULL"), ["deal_id"],
                             ["started_at", "compile_id"], maxs=["until"]).where("until = max_until")
    ends = longest.select("deal_id", (-F.unix_micros("until")).alias("back"), F.lit(0).alias("asks"), F.col("compile_id").alias("id"),
                          F.struct("until", "started_at", "compile_id").alias("next"), F.lit(None).cast("timestamp").alias("at"))
    asks = asked.where("_c IS NULL AND deal_id IS NOT NULL").select(
        "deal_id", (-F.unix_micros("requested_at")).alias("back"), F.lit(1).alias("asks"), F.col("request_id").cast("string").alias("id"),
        F.lit(None).cast(ends.schema["next"].dataType).alias("next"), F.col("requested_at").alias("at"), "request_id")
    line = sequence_index(ends.withColumn("request_id", F.lit(None).cast(requests.schema["request_id"].dataType)).unionByName(asks),
                          ["deal_id"], ["back", "asks", "id"], mins=["next"])
    unnamed = line.where("asks = 1 AND min_next.started_at <= at").select("request_id", F.col("min_next.compile_id").alias("run"))
    first = named.unionByName(unnamed).groupBy("request_id").agg(F.min("run").alias("run"))
    return (requests.join(first, "request_id", "left")
            .select("request_id", "deal_id", F.col("compile_id").alias("requested_compile_id"),
                    F.col("run").alias("cancelled_run"), F.col("run").isNotNull().alias("consumed")))


def hourly_repeats(pickups: DataFrame, ts: str = "received_at") -> DataFrame:
    """ST8 (batch): tumbling one-hour counts of repeat pickups."""
    return (pickups.groupBy(F.window(ts, "1 hour").alias("w"))
                   .agg(F.count(F.lit(1)).alias("repeats"))
                   .select(F.col("w.start").alias("window_start"), "repeats"))


def dedup_delivery(deliveries: DataFrame, lease_sec: int = LEASE_MAX_SEC) -> DataFrame:
    """ST9 (batch): a delivery of a compile is kept when it is the first or
    the previous delivery is more than the lease ceiling older."""
    idx = sequence_index(deliveries, ["compile_id"], ["received_at", "seq"])
    j = with_lag(idx, ["compile_id"], ["received_at"])
    gap = F.unix_micros("received_at") - F.unix_micros("prev_received_at")
    keep = F.col("prev_received_at").isNull() | (gap > F.lit(lease_sec * 1_000_000).cast("bigint"))
    return j.select("compile_id", "seq", "received_at", "seq_idx", keep.alias("kept"))


def attempt_overlap(attempts: DataFrame) -> DataFrame:
    """Attempt number per message and whether the previous attempt was
    still running when this one was received."""
    idx = sequence_index(attempts, ["message_key"], ["received_at", "seq"])
    j = with_lag(idx, ["message_key"], ["ended_at"])
    return j.select("message_key", "seq", F.col("seq_idx").alias("attempt"),
                    F.coalesce(F.col("prev_ended_at") > F.col("received_at"), F.lit(False))
                    .alias("overlapped"))


def stage_rate(progress: DataFrame, span: int = 5) -> DataFrame:
    """Per (compile, stage) sample, the instantaneous items/second from
    the previous sample, the rate over the last ``span`` samples (fewer at the
    start), and the remaining items. One sorted pass."""
    keys, look = ["compile_id", "current_stage"], ["stage_items_done", "updated_at"]
    idx = with_previous(progress.select(*keys, "seq", "stage_items_total", *look), keys, ["updated_at", "seq"], look, span - 1)

    def rate(back):
        dt = (F.unix_micros("updated_at") - F.unix_micros(f"prev{back}_updated_at")) / 1e6
        return F.when(dt > 0, (F.col("stage_items_done") - F.col(f"prev{back}_stage_items_done")) / dt)
    window = F.lit(None).cast("double")
    for back in range(1, span):
        window = F.when(F.col("seq_idx") > back, rate(back)).otherwise(window)
    return idx.select(*keys, "seq", "seq_idx", rate(1).alias("rate"), window.alias("rate_window"),
                      (F.col("stage_items_total") - F.col("stage_items_done")).alias("remaining"))


def with_now(df: DataFrame, events: DataFrame, ts: str = "updated_at") -> DataFrame:
    """Attach the data's "now" (the newest event time) as a scalar
    subquery: one partial aggregate, evaluated once, no join."""
    return df.withColumn("now", events.agg(F.max(ts)).scalar())


def run_budgets(status_events: DataFrame) -> DataFrame:
    """P9 budget per run from the documents it parsed (one 'parse' write per
    document in the synthetic data)."""
    from runlens.operators.admission import budget_sec
    docs = status_events.groupBy("compile_id").agg(
        F.count(F.when(F.col("stage") == "parse", 1)).alias("n_docs"))
    return docs.select("compile_id", "n_docs", budget_sec(F.col("n_docs")).alias("budget_sec"))


def sliding_repeats(pickups: DataFrame, ts: str = "received_at", size: str = "1 hour",
                    slide: str = "15 minutes") -> DataFrame:
    """ST8 sliding form: one-hour windows every 15 minutes."""
    return (pickups.groupBy(F.window(ts, size, slide).alias("w"))
                   .agg(F.count(F.lit(1)).alias("repeats"))
                   .select(F.col("w.start").alias("window_start"), "repeats"))
