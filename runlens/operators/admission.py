"""From raw messages to decisions.

The admission chain is one ``CASE`` over columns produced by joins (latest
status per compile, unchanged check per deal, skip list), so every message
is decided in one pass; the order of the ``when`` branches is the
reference's precedence and must not be re-ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import decode as D
from runlens.functions.text import first_nonblank, py_strip
from runlens.operators.status import latest_status

# Fixed values of the reference's admission rules.
MAX_DEQUEUE_COUNT = 3          # poison when dequeue_count > 3
NEAR_POISON_AT = 3             # literal 3 in the warning, not the setting
DO_NOT_RERUN_STAGES = ("timeout", "killed", "out_of_memory")
COMPILE_TIMEOUT_SEC = 1500.0   # floor
COMPILE_SEC_PER_DOC = 45.0
LEASE_MAX_SEC = 4 * 3600
COMPILE_BUDGET_LEASE_FRACTION = 0.75
LANES = ("priority", "normal")  # dispatch order


def lane_union(priority: DataFrame, normal: DataFrame) -> DataFrame:
    """The two queue lanes as one stream of messages, lane-tagged."""
    return (priority.withColumn("lane", F.lit("priority"))
            .unionByName(normal.withColumn("lane", F.lit("normal"))))


def lane_rank(lane: Column) -> Column:
    return F.when(lane == LANES[0], F.lit(0)).otherwise(F.lit(1))


def decode_messages(raw: DataFrame) -> DataFrame:
    """P1 + P2 + P4: decoded object, route and job fields per message."""
    staged = D.decode_stage(raw, "content", "_v", "_peek")
    jc = D.job_columns(staged, "_v")
    route = F.when(F.coalesce(D.vget(F.col("_peek"), "$.kind") == "sow_draft", F.lit(False)),
                   "draft").otherwise("compile")
    return jc.select(
        *[c for c in raw.columns],
        F.col("_v").isNotNull().alias("decoded"), route.alias("route"),
        "job_ok", "compile_id", "deal_id", "manifest_blob_url", "domain_pack", "force",
        "triggered_by", "trigger_kind",
        F.try_variant_get("x_allow_errors", "$", "boolean").alias("opt_allow_errors"),
        F.try_variant_get("x_allow_unverified", "$", "boolean").alias("opt_allow_unverified"),
        F.try_variant_get("x_use_cache", "$", "boolean").alias("opt_use_cache"),
        F.try_variant_get("x_abstain", "$", "double").alias("opt_abstain_threshold"))


def budget_sec(n_docs: Column) -> Column:
    """min(ceiling, max(floor, per_doc * docs)); ceiling never below the
    floor and at most the lease fraction of the lease ceiling."""
    ceiling = max(COMPILE_TIMEOUT_SEC, LEASE_MAX_SEC * COMPILE_BUDGET_LEASE_FRACTION)
    docs = F.coalesce(n_docs, F.lit(0)).cast("double")
    return F.least(F.lit(ceiling), F.greatest(F.lit(COMPILE_TIMEOUT_SEC),
                                              F.lit(COMPILE_SEC_PER_DOC) * docs))


def job_options(jobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Domain pack from job, then manifest context, then manifest
    (blanks count as missing); compile defaults from compile_options; no
    abstain threshold unless they name one."""
    m = manifests.select("deal_id", "context_domain_pack",
                         F.col("domain_pack").alias("manifest_domain_pack"))
    return jobs.join(m, "deal_id", "left").select(
        "message_id", "deal_id",
        first_nonblank("domain_pack", "context_domain_pack", "manifest_domain_pack")
        .alias("domain_pack"),
        F.coalesce("opt_allow_errors", F.lit(True)).alias("allow_errors"),
        F.coalesce("opt_allow_unverified", F.lit(True)).alias("allow_unverified"),
        F.coalesce("opt_use_cache", F.lit(False)).alias("use_cache"),
        F.col("opt_abstain_threshold").alias("abstain_threshold"))


def previous_final(jobs: DataFrame, status_events: DataFrame) -> DataFrame:
    """The last status of the *same* compile; the stage when it is a
    failed timeout / killed / out_of_memory (re-running would repeat it)."""
    return with_last(jobs, last_stages(status_events))


def last_stages(status_events: DataFrame) -> DataFrame:
    """The last status and stage of every compile."""
    own = [c for c in status_events.columns if c in ("compile_id", "deal_id", "status", "stage", "updated_at", "seq")]
    return latest_status(status_events.select(*own)).select(
        "compile_id", F.col("status").alias("prev_status"), F.col("stage").alias("prev_stage"))


def with_last(jobs: DataFrame, last: DataFrame) -> DataFrame:
    """J2 with the ``last_stages`` at hand."""
    blocked = ((F.col("prev_status") == "failed")
               & F.col("prev_stage").isin(*DO_NOT_RERUN_STAGES))
    return (jobs.join(last, "compile_id", "left")
                .withColumn("blocked_stage", F.when(blocked, F.col("prev_stage"))))


def skip_ids(spark, skip_list: str) -> DataFrame:
    """comma-separated ids, trimmed, blanks ignored."""
    parts = F.explode(F.split(F.lit(skip_list or ""), ",")).alias("p")
    return (spark.range(1).select(parts).select(py_strip("p").alias("deal_id"))
                 .where(F.col("deal_id") != "").distinct())


def mark_skipped(jobs: DataFrame, skip: DataFrame) -> DataFrame:
    """Left join against the skip set; Catalyst picks the join by its size."""
    return (jobs.join(skip.withColumn("skip_listed", F.lit(True)), "deal_id", "left")
                .withColumn("skip_listed", F.coalesce("skip_listed", F.lit(False))))


def admission(decoded: DataFrame, status_events: DataFrame, unchanged: DataFrame,
              skip: DataFrame) -> DataFrame:
    """F2 + F3 + F5: one decision per message in the reference's precedence.

    ``unchanged``: deal_id, unchanged (bool) for the deal's current manifest.
    """
    with_prev = previous_final(decoded, status_events)
    with_skip = mark_skipped(with_prev, skip)
    u = unchanged.select("deal_id", F.col("unchanged").alias("_unchanged"))
    j = with_skip.join(u, "deal_id", "left")
    dq = F.col("dequeue_count")
    is_draft = F.col("route") == "draft"
    bad = ~F.col("job_ok")
    exhausted = dq > MAX_DEQUEUE_COUNT
    prev_final = (dq > 1) & F.col("blocked_stage").isNotNull()
    skipped = F.col("skip_listed")
    unchanged_ = ~F.col("force") & F.coalesce(F.col("_unchanged"), F.lit(False))
    decision = (F.when(is_draft, "draft").when(bad, "decode_error")
                 .when(exhausted, "exhausted_retries").when(prev_final, "previous_final")
                 .when(skipped, "skip_listed").when(unchanged_, "skip_unchanged")
                 .otherwise("compile"))
    status = (F.when(is_draft | bad, F.lit(None).cast("string"))
               .when(exhausted | prev_final, "failed").when(skipped, F.lit(None).cast("string"))
               .when(unchanged_, "completed").otherwise("running"))
    stage = (F.when(is_draft | bad, F.lit(None).cast("string"))
              .when(exhausted, "exhausted_retries").when(prev_final, F.col("blocked_stage"))
              .when(skipped, F.lit(None).cast("string"))
              .when(unchanged_, "skipped_unchanged").otherwise("starting"))
    reason = (F.when(is_draft, F.lit(None).cast("string")).when(bad, "decode_error")
               .when(exhausted, "exhausted_retries")
               .when(prev_final, F.when(F.col("blocked_stage") == "timeout", "timed_out_before")
                     .otherwise(F.concat(F.col("blocked_stage"), F.lit("_before")))))
    exit_code = F.when(~is_draft & (bad | exhausted | prev_final), 2).otherwise(0)
    disposition = (F.when(reason.isNotNull(), "poison")
                    .when(decision == "compile", "run").otherwise("ack"))
    return j.select(
        "message_id", "lane", "dequeue_count", "content", "compile_id", "deal_id",
        decision.alias("decision"), status.alias("status"), stage.alias("stage"),
        reason.alias("poison_reason"), exit_code.cast("int").alias("exit_code"),
        (~is_draft & ~bad & (dq >= NEAR_POISON_AT)).alias("near_poison"),
        disposition.alias("disposition"))


def poison_archive(decisions: DataFrame) -> DataFrame:
    """One archive row per rejected message; ids only when decoded."""
    has_job = F.col("poison_reason") != "decode_error"
    return decisions.where(F.col("poison_reason").isNotNull()).select(
        "message_id", F.col("poison_reason").alias("reason"), "dequeue_count",
        F.col("lane").alias("source_queue"), F.col("content").alias("original"),
        F.when(has_job, F.col("deal_id")).alias("deal_id"),
        F.when(has_job, F.col("compile_id")).alias("compile_id"))


def json_string(c: Column) -> Column:
    """A JSON string literal for ``c`` (quoted and escaped by ``to_json``)."""
    return F.regexp_extract(F.to_json(F.array(c)), "^\\[(.*)\\]$", 1)


def brief_outbox(decisions: DataFrame) -> DataFrame:
    """One downstream message per compiled job, base64 of the JSON
    document ``{"dealId", "compileId", "envelopeReady": true}``."""
    doc = F.concat(F.lit('{"dealId": '), json_string(F.col("deal_id")),
                   F.lit(', "compileId": '), json_string(F.col("compile_id")),
                   F.lit(', "envelopeReady": true}'))
    return decisions.where(F.col("decision") == "compile").select(
        "message_id", "deal_id", "compile_id",
        F.translate(F.base64(F.encode(doc, "UTF-8")), "\r\n", "").alias("payload"))


def lane_backlog(raw: DataFrame) -> DataFrame:
    """Messages waiting per lane."""
    return raw.groupBy("lane").agg(F.count(F.lit(1)).alias("messages"))


def dispatch_order(raw: DataFrame) -> DataFrame:
    """Priority lane first, arrival order inside a lane.

    ``lane_pos`` is a per-lane sequence number from the skew-safe sequence
    primitive (a lane holds about half the queue); ``queue_pos`` offsets the
    normal lane by the size of the priority lane (a two-row aggregate).
    """
    from runlens.operators.sequence import sequence_index

    idx = sequence_index(raw.select("message_id", "lane", "received_at"), ["lane"],
                         ["received_at", "message_id"])
    # The priority lane's size, a scalar subquery added to the second lane.
    n_first = raw.where(F.col("lane") == LANES[0]).agg(F.count(F.lit(1))).scalar()
    return idx.select(
        "message_id", "lane", F.col("seq_idx").cast("bigint").alias("lane_pos"),
        (F.col("seq_idx") + F.when(F.col("lane") == LANES[0], F.lit(0)).otherwise(n_first))
        .cast("bigint").alias("queue_pos"))


# The reference's give-up texts.
PREVIOUS_FINAL_ERRORS = {
    "timeout": "compile exceeded COMPILE_TIMEOUT_SEC on an earlier attempt",
    "killed": "the worker was killed mid-run on an earlier attempt",
    "out_of_memory": "the compile ran out of memory on an earlier attempt",
}


def give_up_messages(decisions: DataFrame) -> DataFrame:
    """The status error and the progress error written when a message
    is given up on (retries exhausted, or an earlier attempt cannot
    succeed)."""
    dq = F.col("dequeue_count").cast("string")
    prev = F.element_at(F.create_map(*[F.lit(x) for kv in PREVIOUS_FINAL_ERRORS.items()
                                       for x in kv]), F.col("stage"))
    exhausted = F.col("decision") == "exhausted_retries"
    error = F.when(exhausted, F.concat(F.lit("dequeue_count "), dq, F.lit(f" > {MAX_DEQUEUE_COUNT}"))) \
             .otherwise(F.concat(prev, F.lit("; not re-run (dequeue_count "), dq, F.lit(")")))
    progress = F.when(exhausted, F.concat(
        F.lit("The parse failed "), (F.col("dequeue_count") - 1).cast("string"),
        F.lit(" times and was not retried again. Press Re-parse to try again."))) \
        .otherwise(F.concat(F.upper(F.left(prev, F.lit(1))), F.substr(prev, F.lit(2)),
                            F.lit(", so it was not run again. Press Re-parse to try again.")))
    return decisions.where(F.col("decision").isin("exhausted_retries", "previous_final")).select(
        "message_id", "compile_id", "stage", error.alias("error"), progress.alias("progress_error"))


def path_keys(entries: DataFrame) -> DataFrame:
    """Where each document of a run lives (status, progress, cancel,
    active marker, run index)."""
    return entries.select(
        "compile_id", "deal_id",
        F.concat_ws("/", F.lit("deals"), "deal_id", F.lit("parser-jobs"),
                    F.concat("compile_id", F.lit(".json"))).alias("status_path"),
        F.concat_ws("/", F.lit("deals"), "deal_id", F.lit("latest/compile-progress.json"))
        .alias("progress_path"),
        F.concat_ws("/", F.lit("deals"), "deal_id", F.lit("latest/compile-cancel.json"))
        .alias("cancel_path"),
        F.concat_ws("/", F.lit("_active-compiles"), F.concat("compile_id", F.lit(".json")))
        .alias("marker_path"),
        F.concat_ws("/", F.lit("_parser-runs"), F.left("updated_at", F.lit(10)),
                    F.concat("compile_id", F.lit(".json"))).alias("index_path"))


def queue_head(raw: DataFrame, k: int = 100) -> DataFrame:
    """W3 head of the queue: the next ``k`` messages to dispatch (priority
    lane first, then arrival). ``orderBy().limit(k)`` plans as a
    distributed top-k (each partition keeps k rows), not a global sort."""
    return (raw.select("message_id", "lane", "received_at",
                       lane_rank(F.col("lane")).alias("lane_rank"))
               .orderBy("lane_rank", "received_at", "message_id").limit(k)
               .select("message_id", "lane"))
