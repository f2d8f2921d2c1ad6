"""Looking back over range borders, exact middle values, projections in parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import atoms as A
from runlens.operators import ordered as O
from runlens.operators import traces as TR


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_previous_rows_equal_window(spark, partitions):
    """Hot and null keys, runs shorter than the halo, ranges of a few rows, small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3 if partitions == 7 else 10000)
    try:
        df = spark.range(0, 400).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 31 == 1, F.lit(None))
             .otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), (F.col("id") % 5).alias("g"),
            (F.col("id") * 7 % 100).alias("t"), F.col("id").alias("e"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v"),
            F.timestamp_seconds("id").alias("at"))
        w = Window.partitionBy("k", "g").orderBy("t", "e")
        want = df.withColumn("seq_idx", F.row_number().over(w).cast("bigint"))
        for i in (1, 2, 3, 4):
            for c in ("v", "at"):
                want = want.withColumn(f"prev{i}_{c}", F.lag(c, i).over(w))
        got = O.with_previous(df, ["k", "g"], ["t", "e"], ["v", "at"], 4, partitions=partitions)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert O.with_previous(df.limit(0), ["k"], ["t", "e"], ["v"], 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few", [3, 50_000])
def test_exact_median(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    monkeypatch.setattr(O, "ACCURACY", 20)
    rnd = random.Random(few)
    cases = [[], [None], [4.0], [1.0, 2.0], [3.0, None, 1.0, 2.0], [7.0] * 40, [7.0] * 20 + [8.0] * 20, [1.0] + [5.0] * 30 + [9.0] * 31,
             [rnd.random() for _ in range(1001)], [rnd.gauss(0, 1) for _ in range(1000)], [float(rnd.randrange(4)) for _ in range(777)]]
    for values in cases:
        have = sorted(v for v in values if v is not None)
        k = len(have)
        want = (have[(k - 1) // 2] + have[k // 2]) / 2 if have else None
        df = spark.createDataFrame([(v,) for v in values], "share double")
        assert tuple(TR.exact_median(df, "share").first()) == (k, want), values[:5]


def test_projection_in_parts_equals_rollup(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        ui = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 <> 1 THEN concat('d', id % 7) END AS deal_id",
                                         "id % 4 = 0 AS verified", "concat('t', id % 5) AS atom_type")
        got = A.project_with(
            ui, "deal_id", lambda rows: (len(rows), int(rows["verified"].sum()), frozenset(rows["atom_type"])),
            lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] | b[2]),
            lambda key, s: {"deal_id": key, "atoms": s[0], "verified_atoms": s[1], "atom_types": ",".join(sorted(s[2]))},
            "deal_id string, atoms long, verified_atoms long, atom_types string")
        assert sorted(map(str, got.collect())) == sorted(map(str, A.envelope_rollup(ui).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
