"""Ordered per-key positions and running aggregates that survive hot keys.

``Window.partitionBy(key)`` hands every row of one key to one task. Here the
table is range-partitioned on (keys, order) instead, so a key with a third of
all rows is split over many tasks; the layout is written once to the shared
folder, plain JVM windows run inside each (range partition, key), and one
carry row per range partition continues the numbering across its borders.
There is one plan at every size. Lags and moving frames are equi-joins on
(keys, position), which shuffle evenly whatever the key skew.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpoint_path


def sequence_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: Sequence[str] = (), xors: Sequence[str] = (),
                   maxs: Sequence[str] = (), mins: Sequence[str] = (),
                   partitions: int | None = None) -> DataFrame:
    """Add ``seq_idx`` (1-based position inside the key), ``run_<c>`` for
    ``c in sums`` (inclusive running sum as double, nulls skipped, null while
    no value was seen), ``xor_<c>`` for ``c in xors`` (inclusive running
    exclusive or of a bigint column), and ``max_<c>``, ``min_<c>`` (inclusive
    running maximum, minimum of any ordered type, nulls skipped).

    ``order`` must make rows unique inside a key, so that the numbering is
    deterministic. Null keys are a group of their own.
    """
    keys, order, sums, xors = list(keys), list(order), list(sums), list(xors)
    tops = [("max", F.max, F.greatest, c) for c in maxs] + [("min", F.min, F.least, c) for c in mins]
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.columns
    path = checkpoint_path(spark, f"sequence-{uuid.uuid4().hex[:12]}")
    (df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
       .write.parquet(path))
    pinned = spark.read.parquet(path)

    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = pinned.withColumn("_cnt", F.row_number().over(w).cast("bigint"))
    for c in sums:
        local = local.withColumn(f"_sum_{c}", F.sum(F.col(c).cast("double")).over(so_far))
    for c in xors:
        local = local.withColumn(f"_xor_{c}", F.bit_xor(F.col(c)).over(so_far))
    for kind, agg, _, c in tops:
        local = local.withColumn(f"_{kind}_{c}", agg(c).over(so_far))

    # One row per range partition: its first and last key, and what the rows
    # of the last key add up to there.
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_k"))
    per = pinned.groupBy("_pid", *keys).agg(
        F.count(F.lit(1)).alias("c"),
        *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in sums],
        *[F.bit_xor(F.col(c)).alias(f"x_{c}") for c in xors], *[agg(c).alias(f"{kind}_{c}") for kind, agg, _, c in tops])
    last = F.struct("c", *[f"s_{c}" for c in sums], *[f"x_{c}" for c in xors], *[f"{kind}_{c}" for kind, _, _, c in tops])
    bounds = per.groupBy("_pid").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"),
                                     F.max_by(last, key).alias("last"))
    upto = Window.partitionBy("last_key").orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    glob = Window.orderBy("_pid")
    cum = bounds.select(
        "_pid", "first_key", "last_key", F.sum("last.c").over(upto).alias("c"),
        *[F.sum(f"last.s_{c}").over(upto).alias(f"s_{c}") for c in sums],
        *[F.bit_xor(f"last.x_{c}").over(upto).alias(f"x_{c}") for c in xors],
        *[agg(f"last.{kind}_{c}").over(upto).alias(f"{kind}_{c}") for kind, agg, _, c in tops])
    goes_on = F.lag("last_key").over(glob).eqNullSafe(F.col("first_key"))
    carried = ["c", *[f"s_{c}" for c in sums], *[f"x_{c}" for c in xors], *[f"{kind}_{c}" for kind, _, _, c in tops]]
    offsets = cum.select("_pid", "first_key",
                         *[F.when(goes_on, F.lag(x).over(glob)).alias(f"_off_{x}") for x in carried])
    # The broadcast side has one row per range partition, whatever the input.
    joined = local.join(F.broadcast(offsets), "_pid")
    here = key.eqNullSafe(F.col("first_key"))

    def plus(column: str, off: str):
        both = F.col(column).isNotNull() | (here & F.col(off).isNotNull())
        zero = F.lit(0)
        return F.when(both, F.coalesce(F.col(column), zero) + F.when(here, F.coalesce(F.col(off), zero)).otherwise(zero))

    out = [F.col(c) for c in base]
    out.append(plus("_cnt", "_off_c").cast("bigint").alias("seq_idx"))
    out += [plus(f"_sum_{c}", f"_off_s_{c}").cast("double").alias(f"run_{c}") for c in sums]
    out += [F.coalesce(F.col(f"_xor_{c}"), F.lit(0)).bitwiseXOR(
        F.when(here, F.coalesce(F.col(f"_off_x_{c}"), F.lit(0))).otherwise(F.lit(0))).cast("bigint").alias(f"xor_{c}")
        for c in xors]
    out += [both(F.col(f"_{kind}_{c}"), F.when(here, F.col(f"_off_{kind}_{c}"))).alias(f"{kind}_{c}") for kind, _, both, c in tops]
    return joined.select(*out)


def with_lag(indexed: DataFrame, keys: Sequence[str], cols: Sequence[str],
             k: int = 1, prefix: str = "prev_") -> DataFrame:
    """Values of ``cols`` from the row ``k`` positions earlier in the key.

    An equi-join on (keys, seq_idx): every (key, index) pair is unique, so
    the shuffle is even however many rows one key has.
    """
    keys = list(keys)
    prev = indexed.select(*keys, (F.col("seq_idx") + k).alias("seq_idx"),
                          *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return indexed.join(prev, [*keys, "seq_idx"], "left")
