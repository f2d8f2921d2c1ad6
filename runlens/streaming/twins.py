"""Structured Streaming twins of the batch operators ST1-ST3 and ST7; those
whose state ends with a watermark (ST4-ST6, ST8, ST9) are in ``stateful``.

What a rule here needs of a key is one small row: a first time, a last time, a
first hit, the latest document. Each micro-batch is reduced to such rows by JVM
aggregates and merged into a versioned table, of which only the touched buckets
are rewritten. Rows merge in any order and merging twice changes nothing, so a
late row, in whatever batch it arrives, or a batch that is tried again, gives
the rows that the batch rule gives on all data. The table has one row per key,
whatever the number of batches, and is there to be read while the stream runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import admission as A
from runlens.operators import health as H
from runlens.operators.status import RUN_ENDS
from runlens.session import checkpoint_path
from runlens.sources import versioned as V


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A file stream over a landing folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _run_dir(spark: SparkSession, name: str) -> str:
    return checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex[:10]}")


def run_available_now(writer, spark: SparkSession, name: str) -> str:
    """Start ``writer`` (a DataStreamWriter factory taking the run folder)
    with ``Trigger.AvailableNow`` and wait; return the run folder."""
    base = _run_dir(spark, name)
    q = writer(base).option("checkpointLocation", base + "/_checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return base


def write_parts(src: DataFrame, name: str, reduce: Callable[[DataFrame], DataFrame],
                by: Sequence[str] = ("epoch",)) -> DataFrame:
    """Drain ``src``; each micro-batch is written as ``reduce(batch)`` with
    its ``epoch``, replacing what an earlier try of that epoch wrote."""
    spark = src.sparkSession

    def write(base):
        def per_batch(batch: DataFrame, epoch: int) -> None:
            (reduce(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(base + "/parts"))
        return src.writeStream.foreachBatch(per_batch)

    return spark.read.parquet(run_available_now(write, spark, name) + "/parts")


def keep_merged(src: DataFrame, name: str, key: str, **aggs: Column) -> DataFrame:
    """Drain ``src``, keeping ``aggs`` per ``key`` in a versioned table, and
    read it. Every aggregate must read the column that it is named after, so
    that its results merge like its inputs. A table of each of the two newest
    versions stays."""
    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])

    def write(base):
        def per_batch(batch: DataFrame, epoch: int) -> None:
            if not batch.isEmpty():
                V.merge_by_key(batch.sparkSession, base + "/state", reduce(batch.where(F.col(key).isNotNull())), key, reduce)
                V.vacuum(batch.sparkSession, base + "/state")
        return src.writeStream.foreachBatch(per_batch)
    return V.read_versioned(src.sparkSession, run_available_now(write, src.sparkSession, name) + "/state")


# ------------------------------------------------------------------ ST1
def stream_decode(spark: SparkSession, landing: str) -> DataFrame:
    """ST1: decode on arrival; good jobs, drafts and quarantined messages
    go to three sinks."""
    decoded = A.decode_messages(landing_stream(spark, landing, max_files=4))
    sink = (F.when(F.col("route") == "draft", "drafts")
             .when(F.col("job_ok"), "jobs").otherwise("poison"))
    return write_parts(decoded, "stream_decode", lambda b: b.select(
        "message_id", "compile_id", "deal_id", "dequeue_count", sink.alias("sink")), ("sink", "epoch"))


# ------------------------------------------------------------------ ST7
def stream_latest(spark: SparkSession, landing: str, key: str = "deal_id",
                  max_files: int | None = 4) -> DataFrame:
    """ST7: the latest progress document per deal."""
    doc = F.struct("updated_at", "seq", "compile_id", "status", "current_stage", "stage_items_done", "stage_items_total")
    rows = landing_stream(spark, landing, max_files).select(key, doc.alias("doc"))
    return keep_merged(rows, "stream_latest", key, doc=F.max("doc")).select(key, "doc.*")


# ------------------------------------------------------------------ ST2
def stream_oom_first_hit(spark: SparkSession, landing: str, progress_events: DataFrame, max_files: int | None = None) -> DataFrame:
    """ST2: the first sample per run at or over its memory ceiling."""
    hits = H.hits(landing_stream(spark, landing, max_files))
    fired = H.oom_failures(keep_merged(hits, "stream_oom_first_hit", "compile_id", f=F.min("f")), progress_events)
    return fired.select("compile_id", "deal_id", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fired_at"),
                        "seq", "rss_bytes", "status", "stage", "error")


# ------------------------------------------------------------------ ST3
def stream_spans(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """One row per run: first write, last write, first end."""
    end = F.when(F.col("status").isin(*RUN_ENDS), F.col("updated_at"))
    rows = landing_stream(spark, landing, max_files).select("compile_id", "deal_id", F.col("updated_at").alias("started_at"),
                                                            F.col("updated_at").alias("last_at"), end.alias("ended_at"))
    return keep_merged(rows, "stream_spans", "compile_id", deal_id=F.min("deal_id"), started_at=F.min("started_at"),
                       last_at=F.max("last_at"), ended_at=F.min("ended_at"))


def stream_budget_overrun(spark: SparkSession, landing: str, budgets: DataFrame,
                          max_files: int | None = None) -> DataFrame:
    """ST3: runs that went on beyond their budget; "now" is the newest write."""
    spans = stream_spans(spark, landing, max_files)
    return H.budget_overrun(spans, budgets.select("compile_id", "budget_sec"), spans.agg(F.max("last_at")).scalar())
