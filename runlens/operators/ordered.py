"""Rows before a row, and middle values, without a global sort.

``with_previous`` is one sorted pass: the table is range-partitioned on
(keys, order) once, every task walks its rows in order and looks back as far as
they go, and only the first rows of a range, which look back over its border,
are settled afterwards, from the last rows of the ranges before it (a halo of
as many rows as the rule looks back).
``exact_quantiles`` narrows down by mergeable quantile sketches until what lies
between two values is few enough to be picked from.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from runlens.session import checkpoint_path, cut_lineage, ship_package


def _starts(batch: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row's key differs from the one before (the first row: yes)."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k).combine_chunks()
        same = pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        null = c.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (null[1:] & null[:-1]))
    return new


def _walk(keys: list[str], cols: list[str], k: int, names: list[str]):
    """The sorted pass over one range; the last ``k`` rows are held back, to
    be looked back on, and to be marked when they turn out to be the last."""
    def walk(batches):
        pid, held, done, seen, first_run = TaskContext.get().partitionId(), None, 0, 0, True
        schema = None

        def tell(table, idx, lo, hi, tail):
            """Rows ``lo`` to ``hi`` of ``table`` with what stands before them."""
            nonlocal seen
            out = table.slice(lo, hi - lo)
            at = np.arange(lo, hi)
            for back in range(1, k + 1):
                there = idx[lo:hi] > back
                # what the range no longer holds was held back long enough
                take = pa.array(np.where(there, at - back, 0), mask=~there)
                for c in cols:
                    out = out.append_column(f"prev{back}_{c}", table.column(c).take(take))
            rows = np.arange(seen, seen + hi - lo)
            seen += hi - lo
            out = out.append_column("seq_idx", pa.array(idx[lo:hi])).append_column("_pid", pa.array(np.full(hi - lo, pid, np.int32)))
            out = out.append_column("_row", pa.array(rows)).append_column("_head", pa.array(rows < k)).append_column(
                "_tail", pa.array(np.full(hi - lo, tail)))
            return out.select(names).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            new = _starts(table, keys)
            at = np.arange(len(new))
            run = np.maximum.accumulate(np.where(new, at, 0))
            idx = (at - run + 1).astype(np.int64)
            idx[run == 0] += done          # rows of the run before the table's first row
            # the rows held back were not told yet, but the k before them were kept along
            told = 0 if held is None else table_told
            hi = max(told, table.num_rows - k)
            yield from tell(table, idx, told, hi, False)
            keep = max(0, hi - k)
            held, table_told, done = table.slice(keep), hi - keep, int(idx[keep] - 1) if keep < len(idx) else 0
            held_idx = idx[keep:]
        if held is not None and held.num_rows > table_told:
            yield from tell(held, held_idx, table_told, held.num_rows, True)
    return walk


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], k: int = 1,
                  partitions: int | None = None) -> DataFrame:
    """``df`` with ``seq_idx`` (1-based position inside the key) and, for each
    of ``cols`` and each number up to ``k``, ``prev<number>_<col>``: its value
    so many rows before in the key, null where there is none.

    ``order`` must make rows unique inside a key. Null keys are a group of
    their own. One scan and one exchange: ranges of (keys, order), so a hot key
    is split; the result is written once and its border rows are settled by
    tables of ``2 k`` rows a range.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    spark = df.sparkSession
    ship_package(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = {f.name: f for f in df.schema}
    back = [(i, c) for i in range(1, k + 1) for c in cols]
    schema = StructType([*df.schema, *[StructField(f"prev{i}_{c}", fields[c].dataType) for i, c in back], StructField("seq_idx", LongType()),
                         StructField("_pid", IntegerType()), StructField("_row", LongType()), StructField("_head", BooleanType()),
                         StructField("_tail", BooleanType())])
    path = checkpoint_path(spark, f"ordered-{uuid.uuid4().hex[:12]}")
    (df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
       .mapInArrow(_walk(keys, cols, k, schema.names), schema).write.parquet(path))
    told = spark.read.schema(schema).parquet(path)
    key = F.struct(*keys)
    edge = told.where("_head OR _tail").select(key.alias("key"), *order, *[c for c in cols if c not in order], "seq_idx", "_pid", "_row", "_head", "_tail")
    # One row per range: its first and last key, and how many rows of the last key it holds.
    ends = edge.groupBy("_pid").agg(F.min_by("key", "_row").alias("first_key"), F.max_by("key", "_row").alias("last_key"),
                                    F.max_by("seq_idx", "_row").alias("c"))
    by_pid = Window.orderBy("_pid")
    upto = Window.partitionBy("last_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = ends.withColumn("c", F.sum("c").over(upto))
    offsets = cum.select("_pid", "first_key", F.when(F.lag("last_key").over(by_pid).eqNullSafe(F.col("first_key")),
                                                     F.lag("c").over(by_pid)).alias("before"))
    # The first rows of every range, looked back from over the last rows of those before: neighbours here are neighbours there.
    line = Window.partitionBy("key").orderBy(*order)
    fixed = (edge.select("_pid", "_row", "_head", *[F.lag(c, i).over(line).alias(f"_fix{i}_{c}") for i, c in back])
                 .where("_head").drop("_head"))
    j = told.join(F.broadcast(offsets), "_pid").join(F.broadcast(fixed), ["_pid", "_row"], "left")
    goes_on = key.eqNullSafe(F.col("first_key"))
    return j.select(*df.columns, (F.col("seq_idx") + F.when(goes_on, F.coalesce("before", F.lit(0))).otherwise(0)).alias("seq_idx"),
                    *[F.when(F.col("_head"), F.col(f"_fix{i}_{c}")).otherwise(F.col(f"prev{i}_{c}")).alias(f"prev{i}_{c}") for i, c in back])


ACCURACY = 10_000    # of a sketch: a rank is right to one in so many
FEW = 50_000         # values that are picked from directly


def exact_quantiles(df: DataFrame, value: str, ranks) -> tuple[int, list]:
    """(rows with a value, the values of the 1-based ``ranks(rows)``), exactly.

    Each round asks a sketch of what is left for two values around the ranks
    and counts what lies below and between; the counts decide, so an inexact
    sketch costs a round, never the result. What lies between shrinks by
    ``ACCURACY``-fold or so, until it is ``FEW`` values or a single one.
    """
    rows = cut_lineage(df.select(F.col(value).alias("v")).where("v IS NOT NULL"))
    n, low, high = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return 0, []
    wanted, below, inside = sorted(ranks(n)), 0, n
    while inside > FEW and low != high:
        part = rows.where(F.col("v").between(low, high))
        first, last = ((r - below) / inside for r in (wanted[0], wanted[-1]))
        near = [max(0.0, first - 2 / ACCURACY), min(1.0, last + 2 / ACCURACY)]
        a, b = part.agg(F.percentile_approx("v", near, ACCURACY)).first()[0]
        under, between = part.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if not (below + under < wanted[0] and wanted[-1] <= below + under + between):
            a, b, under, between = low, high, 0, inside   # the sketch missed
        if between == inside:
            # equal values, or no progress: count the values themselves
            a, under, between = _heaviest(part, wanted[0] - below)
            if below + under + between < wanted[-1]:
                return n, [exact_quantiles(df, value, lambda _, r=r: [r])[1][0] for r in wanted]
            b = a
        below, inside, low, high = below + under, between, a, b
    if low == high:
        return n, [low] * len(wanted)
    left = [r.v for r in rows.where(F.col("v").between(low, high)).orderBy("v").limit(inside).collect()]   # FEW at most
    return n, [left[r - below - 1] for r in wanted]


def _heaviest(rows: DataFrame, rank: int) -> tuple:
    """(value, rows below, rows equal) at ``rank`` by counts per value."""
    per = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("v"))
    v, c, s = per.withColumn("s", upto).where(F.col("s") >= rank).orderBy("s").limit(1).select("v", "c", "s").first()
    return v, s - c, c
