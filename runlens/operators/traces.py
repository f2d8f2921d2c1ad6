"""Model-call summaries, stage timelines, stage
profiles over the corpus and run-to-run trace comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordered import exact_quantiles
from runlens.operators.sequence import sequence_index


def llm_summary(calls: DataFrame) -> DataFrame:
    """A5: per compile, total calls and latency (rounded to 3), and the same
    by source and by model, as grouping sets of one aggregation."""
    return (calls.groupingSets([["compile_id"], ["compile_id", "source"], ["compile_id", "model"]],
                               "compile_id", "source", "model")
                 .agg(F.count(F.lit(1)).alias("calls"),
                      F.round(F.sum("latency_sec"), 3).alias("latency_sec")))


def stage_timeline(timings: DataFrame) -> DataFrame:
    """Ordered stages of every run with defaults (missing counts 0) and
    the offset at which each stage started (running sum of durations from
    the skew-safe sequence primitive)."""
    t = timings.select(
        "compile_id", "stage_name", "stage_no", "l_partkey", "l_suppkey",
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        F.coalesce("input_count", F.lit(0)).alias("input_count"),
        F.coalesce("output_count", F.lit(0)).alias("output_count"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"))
    idx = sequence_index(t, ["compile_id"], ["stage_no", "l_partkey", "l_suppkey", "duration_ms"],
                         sums=["duration_ms"])
    return idx.select(
        "compile_id", F.col("seq_idx").alias("pos"), "stage_name",
        F.round("duration_ms", 3).alias("duration_ms"),
        F.round(F.col("run_duration_ms") - F.col("duration_ms"), 3).alias("start_ms"),
        "input_count", "output_count", "warning_count", "error_count")


def run_stage_totals(timings: DataFrame) -> DataFrame:
    """Per run: total time, the longest stage and its share (W5). One
    partial aggregate per run; no window over a run's rows."""
    return (timings.groupBy("compile_id")
                   .agg(F.sum("duration_ms").alias("total_ms"),
                        F.max(F.struct("duration_ms", "stage_name")).alias("_m"))
                   .select("compile_id", F.col("_m.stage_name").alias("stage_name"),
                           F.col("_m.duration_ms").alias("duration_ms"), "total_ms",
                           (F.col("_m.duration_ms") / F.col("total_ms")).alias("share")))


def stage_profile(longest: DataFrame) -> DataFrame:
    """A10: how often each stage is the longest one of a run."""
    total = longest.agg(F.count(F.lit(1))).scalar()
    per = longest.groupBy("stage_name").agg(F.count(F.lit(1)).alias("runs_longest"))
    return per.select("stage_name", "runs_longest",
                      F.round(F.col("runs_longest") / total, 6).alias("share_of_runs"))


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """A10: the exact median of ``value`` and the number of rows that have
    one: the one or two middle values, found by sketches and counts."""
    n, mid = exact_quantiles(df, value, lambda n: [(n + 1) // 2, n // 2 + 1])
    median = sum(mid) / len(mid) if mid else None
    return df.sparkSession.createDataFrame([(n, median)], "runs long, median double")


def trace_summary(status_events: DataFrame, calls: DataFrame) -> DataFrame:
    """The comparable summary of a run: counts of each stage written and of
    each (source, model) of its model calls."""
    stages = status_events.groupBy("compile_id", F.concat(F.lit("stage:"), F.col("stage"))
                                   .alias("item")).agg(F.count(F.lit(1)).alias("n"))
    c = calls.groupBy("compile_id", F.concat(F.lit("call:"), F.col("source"), F.lit("/"),
                                             F.col("model")).alias("item")).agg(
        F.count(F.lit(1)).alias("n"))
    return stages.unionByName(c)


def trace_diff(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two runs are the same pipeline when their summaries are equal:
    full outer join of the two summaries per pair, count differing items.
    ``pairs``: compile_id, prev_compile_id."""
    a = pairs.join(summary, "compile_id").select("compile_id", "prev_compile_id", "item",
                                                 F.col("n").alias("n_a"))
    b = (pairs.join(summary.withColumnRenamed("compile_id", "prev_compile_id"), "prev_compile_id")
              .select("compile_id", "prev_compile_id", "item", F.col("n").alias("n_b")))
    full = a.join(b, ["compile_id", "prev_compile_id", "item"], "full_outer")
    diff = full.groupBy("compile_id", "prev_compile_id").agg(
        F.count_if(~F.coalesce(F.col("n_a") == F.col("n_b"), F.lit(False))).alias("differing_items"))
    return diff.withColumn("same_pipeline", F.col("differing_items") == 0)
