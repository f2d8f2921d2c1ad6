"""Status history: latest-state rules, run index, activity and ownership.

"Latest" is computed with ``max_by`` over a (time, sequence) struct: a
partial aggregate, so a compile or deal with millions of rows is reduced
map-side before the shuffle instead of being sorted inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key under ``order`` (ties broken by later columns).

    ``max(struct(order..., row))`` is associative, so Spark combines it
    map-side; the winning row is unpacked again afterwards.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      F.struct(*rest).alias("_row"))
    return (df.groupBy(*keys).agg(F.max(packed).alias("_w"))
              .select(*keys, *[F.col(f"_w._row.{c}").alias(c) for c in rest]))


def latest_status(status_events: DataFrame) -> DataFrame:
    """The last status written for each compile (last write wins)."""
    return latest_by(status_events, ["compile_id"], ["updated_at", "seq"])


def latest_progress(progress_events: DataFrame) -> DataFrame:
    """The last progress document of each deal."""
    return latest_by(progress_events, ["deal_id"], ["updated_at", "seq"])


# Fixed values of the reference's status rules.
TERMINAL_FOR_INDEX = ("completed", "failed", "interrupted")   # F1: not cancelled
RUN_ENDS = ("completed", "failed", "interrupted", "cancelled")  # J6: every end
METADATA_KEYS = ("status", "stage", "deal_id", "compile_id", "updated_at", "elapsed_sec",
                 "worker_sha")
RUN_INDEX_ERROR_MAX = 500
METADATA_MAX = 128


def iso_text(ts):
    """UTC ISO-8601 text with offset, as the writer stamps ``updated_at``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def header_safe(v, limit: int = METADATA_MAX):
    """P10: printable ASCII only, cut to ``limit``; empty becomes null."""
    t = F.left(F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), "[^\\x20-\\x7E]", ""),
               F.lit(limit))
    return F.when(t != "", t)


def bounded_error(e, limit: int = RUN_INDEX_ERROR_MAX):
    """Over ``limit`` chars -> first ``limit - 1`` plus an ellipsis."""
    return (F.when(F.length(e) <= limit, e)
             .otherwise(F.concat(F.left(e, F.lit(limit - 1)), F.lit("…"))))


def run_index(status_events: DataFrame) -> DataFrame:
    """S5 + F1 + P10 + P11 + W6: one index entry per (day, compile) for the
    final statuses; the same compile on the same day keeps its last write.

    Partitioned by ``run_date`` when written, so listing a day prunes to one
    folder, and narrow (no traceback) so readers scan little.
    """
    final = (status_events.where(F.col("status").isin(*TERMINAL_FOR_INDEX))
             .withColumn("updated_at_text", iso_text(F.col("updated_at")))
             .withColumn("run_date", F.left(F.col("updated_at_text"), F.lit(10))))
    last = latest_by(final, ["run_date", "compile_id"], ["updated_at", "seq"])
    meta = {k: header_safe(F.col("updated_at_text") if k == "updated_at" else F.col(k))
            for k in METADATA_KEYS}
    return last.select(
        "run_date", "compile_id", "deal_id", "status", "stage",
        F.col("updated_at_text").alias("updated_at"), "worker_sha", "parser_sha",
        "elapsed_sec", "entity_count", "atom_count", "percent_complete",
        F.when(F.col("error").isNotNull() & (F.col("error") != ""),
               bounded_error(F.col("error"))).alias("error"),
        *[c.alias(f"meta_{k}") for k, c in meta.items()])


def write_run_index(index: DataFrame, path: str) -> None:
    """S5 sink: dynamic partition overwrite of the touched days only."""
    (index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("run_date").parquet(path))


def runs_per_day(index: DataFrame) -> DataFrame:
    """Runs per day, outcome and stage, with rollup subtotals."""
    return (index.rollup("run_date", "status", "stage")
                 .agg(F.count(F.lit(1)).alias("runs")))


def run_spans(status_events: DataFrame) -> DataFrame:
    """Per compile: first and last write, first end, and last status."""
    is_end = F.col("status").isin(*RUN_ENDS)
    return status_events.groupBy("compile_id").agg(
        F.first("deal_id").alias("deal_id"),
        F.min("updated_at").alias("started_at"),
        F.max("updated_at").alias("last_at"),
        F.min(F.when(is_end, F.col("updated_at"))).alias("ended_at"),
        F.max(F.struct("updated_at", "seq", "status")).alias("_last"),
    ).withColumn("last_status", F.col("_last.status")).drop("_last")


def active_runs(markers: DataFrame, status_events: DataFrame) -> DataFrame:
    """Markers of runs that have not ended (any end status, including
    cancelled), as an anti join against the compiles that ended."""
    ended = status_events.where(F.col("status").isin(*RUN_ENDS)).select("compile_id").distinct()
    return markers.join(ended, "compile_id", "left_anti")
