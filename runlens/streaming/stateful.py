"""Streams that answer while they run and forget what is over (ST4-ST6, ST8, ST9).

Every stream here has a watermark: how late a row may come. What it keeps is
bounded by that and by the rule's own horizon (the lease, the longest silence,
the longest run), and is dropped by event time. Windows, sessions and the
stream-stream join are Spark's own operators; the two rules that need the
order of a key's rows are keyed processors, which answer at once and take an
answer back by a correction row when a late row changes it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType

from runlens.functions.text import blank_to_null
from runlens.operators.health import LEASE_MAX_SEC
from runlens.operators.status import RUN_ENDS
from runlens.session import ship_package
from runlens.streaming.twins import run_available_now

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSING = "(closing row)"
LATE = f"{LEASE_MAX_SEC} seconds"   # how late a row may come: the longest a message is leased


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to the end of what has landed; its rows go to
    a file sink as they come, and are read back."""
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)   # keyed state outside of the heap
    ship_package(spark)

    def write(base):
        return stream.writeStream.outputMode("append").format("parquet").option("path", base + "/rows")
    return spark.read.schema(stream.schema).parquet(run_available_now(write, spark, name) + "/rows")


# ------------------------------------------------------------- keyed state
BUCKETS = 512   # a Python call and a state entry are for a bucket of compiles, not for each


def _bucket() -> Column:
    return F.pmod(F.xxhash64("compile_id"), F.lit(BUCKETS)).alias("bucket")


class Buckets(StatefulProcessor):
    """Keyed rules whose state is one entry per bucket of compiles: the compiles
    in it that are not over, each with the time (ms) at which it is forgotten.
    A bucket is woken at the first of these times."""

    ENTRY = ""   # fields of a compile's entry after compile_id and until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", f"timer long, runs array<struct<compile_id:string,until:long,{self.ENTRY}>>")

    def _load(self) -> tuple[int | None, dict]:
        timer, runs = self.state.get() if self.state.exists() else (None, [])
        # plain tuples: nested Rows cannot be stored again
        return timer, {x[0]: tuple([tuple(r) for r in v] if isinstance(v, list) else v for v in x[1:]) for x in runs}

    def _store(self, timer: int | None, runs: dict, now: int, fired: bool) -> None:
        """Forget what is over at ``now``, like a timer of each compile would."""
        left = {k: x for k, x in runs.items() if x[0] >= now}
        wake = min((x[0] for x in left.values()), default=None)
        if timer is not None and wake != timer and not fired:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.state.clear()
            return
        if wake != timer or fired:
            self.handle.registerTimer(wake)
        self.state.update((wake, [(k, *x) for k, x in left.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, runs = self._load()
        now, new = timerValues.getCurrentWatermarkInMs(), defaultdict(list)
        for r in rows:
            new[r.compile_id].append(r)
        for k, own in new.items():
            runs[k] = yield from self.rule(k, own, runs.get(k), now * 1000)
        self._store(timer, runs, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, runs = self._load()
        self._store(timer, runs, timerValues.getCurrentWatermarkInMs(), True)
        return iter(())

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ ST5
class FirstEnd(Buckets):
    """Passes a run's rows, but 'running' ones only up to its first end. Kept
    per run: the first end, and the running rows passed that an end which is
    still to come could precede (none is older than the watermark)."""

    ENTRY = "end_us:long,end_seq:long,passed:array<struct<us:long,seq:long,stage:string>>"

    def __init__(self, lease_sec: int):
        self.lease_ms = lease_sec * 1000

    def rule(self, key, rows, known, wm) -> Iterator[Row]:
        until, end_us, end_seq, passed = known or (None, None, None, [])
        new = [(r.us, r.seq, r.status, r.stage) for r in rows]
        ends = [x[:2] for x in new if x[2] in RUN_ENDS] + ([(end_us, end_seq)] if end_us is not None else [])
        end = min(ends, default=None)
        keep = [(us, seq, stage) for us, seq, stage in passed if end is None or (us, seq) <= end]
        for us, seq, stage in passed:
            if end is not None and (us, seq) > end:
                yield Row(compile_id=key, us=us, seq=seq, status="running", stage=stage, correction=True)
        for us, seq, status, stage in new:
            if status != "running" or end is None or (us, seq) <= end:
                yield Row(compile_id=key, us=us, seq=seq, status=status, stage=stage, correction=False)
                if status == "running":
                    keep.append((us, seq, stage))
        until = max([x[0] for x in new] + [(until or 0) * 1000 - self.lease_ms * 1000]) // 1000 + self.lease_ms
        return until, end[0] if end else None, end[1] if end else None, [x for x in keep if x[0] > wm]


def terminal_wins(status: DataFrame, lease_sec: int = LEASE_MAX_SEC, late: str = LATE) -> DataFrame:
    """ST5 on a stream of (compile_id, seq, status, stage, updated_at): rows as
    they come, and a row with ``correction`` for a running row that a late end
    turned out to precede. A run is forgotten ``lease_sec`` after its last row:
    by then its message is free again and a row is a new run's."""
    rows = status.withWatermark("updated_at", late).select(
        _bucket(), "compile_id", "updated_at", F.unix_micros("updated_at").alias("us"), "seq", "status", "stage")
    return rows.groupBy("bucket").transformWithState(
        FirstEnd(lease_sec), "compile_id string, us long, seq long, status string, stage string, correction boolean", "append", "EventTime")


def without_corrected(rows: DataFrame) -> DataFrame:
    """What stands when the corrections are applied: both sides are equal on
    the row's key, which occurs once."""
    key = ["compile_id", "us", "seq"]
    return rows.where("NOT correction").join(rows.where("correction").select(*key), key, "left_anti").drop("correction")


# ------------------------------------------------------------------ ST9
class Redelivery(Buckets):
    """Says of every delivery of a compile whether the one before is more than
    the lease older. Kept: deliveries newer than the watermark, and the last
    one before it while it can still hold a lease."""

    ENTRY = "near:array<struct<us:long,seq:long,kept:boolean>>"

    def __init__(self, lease_sec: int):
        self.lease_us = lease_sec * 1_000_000

    def rule(self, key, rows, known, wm) -> Iterator[Row]:
        near = known[1] if known else []
        every = sorted([(*x, False) for x in near] + [(r.us, r.seq, True, True) for r in rows], key=lambda x: x[:2])
        state, before = [], None
        for us, seq, kept, new in every:
            now = (kept if before is None else us - before > self.lease_us)
            if new or now != kept:
                yield Row(compile_id=key, us=us, seq=seq, kept=now, correction=not new)
            state.append((us, seq, now))
            before = us
        old = [x for x in state if x[0] <= wm]
        state = [x for x in old[-1:] if x[0] > wm - self.lease_us] + state[len(old):]
        return (before + self.lease_us) // 1000 + 1, state


def dedup_delivery(deliveries: DataFrame, lease_sec: int = LEASE_MAX_SEC, late: str = LATE) -> DataFrame:
    """ST9 on a stream of (compile_id, seq, received_at): every delivery with
    ``kept`` as it comes, and a row with ``correction`` where a late delivery
    before it makes it a redelivery after all."""
    rows = deliveries.withWatermark("received_at", late).select(_bucket(), "compile_id", "received_at", F.unix_micros("received_at").alias("us"), "seq")
    return rows.groupBy("bucket").transformWithState(
        Redelivery(lease_sec), "compile_id string, us long, seq long, kept boolean, correction boolean", "append", "EventTime")


def last_word(rows: DataFrame) -> DataFrame:
    """One row per delivery: a correction only ever takes ``kept`` back."""
    return rows.groupBy("compile_id", "us", "seq").agg(F.bool_and("kept").alias("kept"))


def drop_redelivery(deliveries: DataFrame, lease_sec: int = LEASE_MAX_SEC) -> DataFrame:
    """ST9, best effort and without Python: a compile's deliveries after its
    first are dropped until the watermark is a lease behind it. What is in one
    micro-batch counts as near, however far apart it is."""
    return deliveries.withWatermark("received_at", f"{lease_sec} seconds").dropDuplicatesWithinWatermark(["compile_id"])


# ------------------------------------------------------------------ ST8
def repeat_counts(pickups: DataFrame, ts: str = "received_at", size: str = "1 hour", slide: str | None = None,
                  late: str = LATE) -> DataFrame:
    """ST8 on a stream: tumbling or sliding counts, each window once it is closed."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (pickups.withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("repeats"))
                   .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "repeats"))


# ------------------------------------------------------------------ ST4
def silences(status: DataFrame, minutes: float, late: str = LATE) -> DataFrame:
    """ST4 on a stream: a session per stretch of a run without a silence of
    ``minutes``, once that silence is over. An end adds no silence of its own,
    and ``ended`` says whether the session holds one; without one the run went
    stale after ``last_at``. (A table gives all its sessions.)"""
    end = F.col("status").isin(*RUN_ENDS)
    gap = F.when(end, F.lit("1 microsecond")).otherwise(F.lit(f"{round(minutes * 60_000_000)} microseconds"))
    return (status.withWatermark("updated_at", late)
                  .groupBy("compile_id", F.session_window("updated_at", gap).alias("w"))
                  .agg(F.max("updated_at").alias("last_at"), F.max(end).alias("ended"))
                  .select("compile_id", F.col("w.start").alias("since"), "last_at", "ended"))


def stale_now(sessions: DataFrame) -> DataFrame:
    """The runs that have gone stale: none of a run's closed sessions has an
    end; the last one tells since when. A run that has come back is told so by
    its next session, when that is closed."""
    return (sessions.groupBy("compile_id").agg(F.max("last_at").alias("last_at"), F.max("ended").alias("ended"))
                    .where("NOT ended").drop("ended"))


# ------------------------------------------------------------------ ST6
def cancels(requests: DataFrame, status: DataFrame, silence: str, longest: str, apart: str = "4 hours",
            late: str = LATE) -> DataFrame:
    """ST6 on two streams: requests (request_id, deal_id, compile_id,
    requested_at) meet the runs of their deal that were going on. A run is a
    session of its writes, and is known when it is silent for ``silence`` or
    longer; ``longest`` bounds how long it goes on, and ``apart`` by how much
    one stream can be ahead of the other: so long a request is kept. One that
    meets no run comes out alone, when none can come."""
    end = F.when(F.col("status").isin(*RUN_ENDS), F.col("updated_at"))
    runs = (status.withWatermark("updated_at", late).groupBy("deal_id", "compile_id", F.session_window("updated_at", silence).alias("w"))
                  .agg(F.min("updated_at").alias("started_at"), F.max("updated_at").alias("last_at"), F.min(end).alias("ended_at"))
                  .select(F.col("deal_id").alias("run_deal"), F.col("compile_id").alias("run"), "started_at",
                          F.coalesce("ended_at", "last_at").alias("until"), F.window_time("w").alias("closed_at")))
    asked = requests.withWatermark("requested_at", late).withColumn("_c", blank_to_null("compile_id"))
    met = (F.expr("deal_id = run_deal AND requested_at >= started_at AND requested_at <= until")
           & (F.col("_c").isNull() | (F.col("_c") == F.col("run")))
           & F.expr(f"requested_at <= closed_at AND requested_at >= closed_at - INTERVAL {longest} - INTERVAL {silence} - INTERVAL {apart}"))
    return asked.join(runs, met, "left_outer").select("request_id", "deal_id", "compile_id", "requested_at", "run", "started_at")


def consumed_by(pairs: DataFrame) -> DataFrame:
    """The first run that each request reached."""
    first = F.min(F.when(F.col("run").isNotNull(), F.struct("started_at", "run"))).alias("m")
    return pairs.groupBy("request_id", "deal_id", F.col("compile_id").alias("requested_compile_id")).agg(first).select(
        "request_id", "deal_id", "requested_compile_id", F.col("m.run").alias("cancelled_run"), F.col("m").isNotNull().alias("consumed"))


# ------------------------------------------------------------ landing in order
def land_in_order(df: DataFrame, ts: str, path: str, jitter_sec: int, files: int = 8, closing_days: float | None = None) -> None:
    """Write ``df`` as ``files`` files in the order in which its rows arrive:
    up to ``jitter_sec`` after their event time, so out of order by that much.
    ``closing_days``: a last file with a row of that much later that closes
    every window before it; its texts are ``CLOSING`` (a null key would be
    filtered out below the watermark), all else is null."""
    spark = df.sparkSession
    arrives = F.unix_micros(ts) + F.pmod(F.xxhash64(*df.columns), F.lit(jitter_sec * 1_000_000))
    df.withColumn("_arrives", arrives).repartitionByRange(files, "_arrives").drop("_arrives").write.parquet(path)
    if closing_days is not None:
        last = df.agg(F.max(ts).alias(ts)).select(*[
            F.timestamp_micros(F.unix_micros(ts) + F.lit(round(closing_days * 86_400_000_000))).alias(c) if c == ts
            else F.lit(CLOSING if df.schema[c].dataType == StringType() else None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        last.coalesce(1).write.mode("append").parquet(path)
    _set_times(spark, path)


def _set_times(spark: SparkSession, path: str) -> None:
    """A file source takes files in the order of their times: those of the
    first write by the number in their names, then those of a later write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for x in fs.listStatus(p) if x.getPath().getName().startswith("part-")]
    by_job: dict[str, list] = {}
    for x in found:
        by_job.setdefault(x.getPath().getName().split("-", 2)[2][:36], []).append(x)
    jobs = sorted(by_job.values(), key=lambda own: min(x.getModificationTime() for x in own))
    for k, x in enumerate(x for own in jobs for x in sorted(own, key=lambda x: x.getPath().getName())):
        fs.setTimes(x.getPath(), 1_700_000_000_000 + 1000 * k, -1)
