"""Trace and progress documents (S9, A6, P23): whole JSON documents built from
the child tables, and read back whatever form their stages have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START_ESTIMATE = 14       # stages expected while a run goes on
PROJECTION = "projection"
PROJECTION_UNKNOWN = 15   # expected in the projection when no stage is known


def _counter(calls: str, field: str) -> Column:
    """A map of ``field`` to its number in the array ``calls`` of a run; as many entries as there are values."""
    names = F.transform(calls, lambda c: c[field])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda v: F.struct(
        v, F.size(F.filter(names, lambda n: n.eqNullSafe(v))).cast("bigint"))))


def trace_documents(runs: DataFrame, timings: DataFrame, calls: DataFrame) -> DataFrame:
    """One trace document per run of ``runs`` (compile_id, deal_id, worker_sha,
    parser_sha, started_at, finished_at, entity_count, atom_count): its stage
    list in order, all its model calls, and their summary. A run's stages and
    calls make one document and so one row; the tables stay the form to query.
    ``timings``: compile_id, stage_no, stage_name, duration_ms, input_count, output_count, warning_count, error_count."""
    stages = timings.groupBy("compile_id").agg(F.array_sort(F.collect_list(F.struct(
        "stage_no", F.col("stage_name").alias("stage"), "duration_ms",
        F.struct(F.col("input_count").alias("input"), F.col("output_count").alias("output")).alias("counts"), "warning_count", "error_count")))
        .alias("stages"))
    each = calls.groupBy("compile_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "call_id", "source", "prompt_size", "max_tokens", "response_size", "latency_sec", "model")))
        .alias("llm_calls"), F.count(F.lit(1)).alias("total_calls"), F.sum("latency_sec").alias("latency"))
    j = runs.join(stages, "compile_id", "left").join(each, "compile_id", "left").select(
        "*", _counter("llm_calls", "source").alias("by_source"), _counter("llm_calls", "model").alias("by_model"))
    none = F.create_map().cast("map<string,bigint>")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    doc = F.struct(
        "compile_id", "deal_id", "worker_sha", F.col("parser_sha").alias("parser_os_sha"), "started_at", "finished_at",
        F.round(seconds, 3).alias("wall_clock_sec"), "entity_count", "atom_count", F.coalesce("llm_calls", F.array()).alias("llm_calls"),
        F.struct(F.coalesce("total_calls", F.lit(0)).alias("total_calls"), F.round(F.coalesce("latency", F.lit(0.0)), 3).alias("total_latency_sec"),
                 F.coalesce("by_source", none).alias("by_source"), F.coalesce("by_model", none).alias("by_model")).alias("llm_call_summary"),
        F.struct(F.coalesce("stages", F.array()).alias("stages")).alias("parser_trace"))
    return j.select("compile_id", F.to_json(doc).alias("trace"))


def _get(v, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def stage_rows(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """The stages of every document (compile_id, ``doc`` VARIANT), in order:
    ``stages``, else ``events``, of the document itself or its parser trace. An
    element of either form counts: live ones name ``stage_name``, input and
    output counts; trace ones ``stage``, ``counts`` and numbers of warnings and
    errors. What is missing is an empty counter or 0; an element that is no
    object is passed over, and does not take a position."""
    d = F.col(doc)

    def listed(path):
        found = _get(d, path, "array<variant>")
        return F.when(F.size(found) > 0, found)
    found = F.coalesce(listed("$.stages"), listed("$.events"), listed("$.parser_trace.stages"), listed("$.parser_trace.events"))
    kept = F.filter(found, lambda e: F.schema_of_variant(e).startswith("OBJECT"))
    rows = documents.select("compile_id", F.posexplode(kept).alias("pos", "e"))
    count = lambda name: _get("e", f"$.{name}", "bigint")
    counts = F.coalesce(_get("e", "$.counts", "map<string,bigint>"), F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("input").alias("k"), count("input_count").alias("v")), F.struct(F.lit("output").alias("k"), count("output_count").alias("v"))),
        lambda x: x["v"].isNotNull())))
    return rows.select("compile_id", (F.col("pos") + 1).cast("bigint").alias("pos"),
                       F.coalesce(_get("e", "$.stage", "string"), _get("e", "$.stage_name", "string")).alias("stage"),
                       F.coalesce(_get("e", "$.duration_ms", "double"), F.lit(0.0)).alias("duration_ms"), counts.alias("counts"),
                       F.coalesce(count("warning_count"), F.lit(0)).alias("warning_count"),
                       F.coalesce(count("error_count"), F.lit(0)).alias("error_count"))


def progress_documents(events: DataFrame) -> DataFrame:
    """Every progress write as the document that its reader gets.
    ``events``: compile_id, deal_id, status, current_stage, stage_phase, stages
    (array, those that are over), started_at, updated_at and the items. While a
    run goes on 14 stages are expected; in the projection one more than are
    over (15 if none is known); when it is done as many as are over. Before its
    first stage a run is ``starting``, with nothing over and no time gone."""
    n = F.size(F.coalesce("stages", F.array())).cast("bigint")
    starting = F.col("status") == "starting"
    total = (F.when(F.col("status") == "done", n)
              .when(F.col("current_stage") == PROJECTION, F.when(n > 0, n + 1).otherwise(PROJECTION_UNKNOWN)).otherwise(START_ESTIMATE))
    gone = F.floor((F.unix_micros("updated_at") - F.unix_micros("started_at")) / 1000)
    return events.select(
        "compile_id", "deal_id", "status", F.when(~starting, F.col("current_stage")).alias("current_stage"),
        F.when(F.col("status") == "running", F.when(F.col("current_stage") != PROJECTION, F.col("stage_phase"))).alias("stage_phase"),
        F.when(starting, F.array().cast(events.schema["stages"].dataType)).otherwise(F.col("stages")).alias("stages"),
        F.when(starting, 0).otherwise(n).alias("stage_count_done"), total.cast("bigint").alias("stage_count_total_estimate"),
        F.when(starting, 0).otherwise(gone).cast("bigint").alias("elapsed_ms"), "stage_items_done", "stage_items_total", "updated_at")
