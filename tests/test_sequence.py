"""The skew-safe sequence primitive equals a plain window, hot and null keys included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators.sequence import sequence_index, with_lag


def test_range_equals_window(spark):
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 31 == 1, F.lit(None))
         .otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string"))).alias("k"),
        (F.col("id") * 7 % 1000).alias("t"), F.col("id").alias("e"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("v"), F.xxhash64("id").alias("x"),
        F.when(F.col("id") % 9 > 2, F.struct(F.col("id") * 31 % 71, F.col("id").cast("string"))).alias("s"))
    w = Window.partitionBy("k").orderBy("t", "e")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = (df.withColumn("seq_idx", F.row_number().over(w).cast("bigint"))
              .withColumn("run_v", F.sum(F.col("v").cast("double")).over(upto))
              .withColumn("xor_x", F.bit_xor("x").over(upto))
              .withColumn("max_v", F.max("v").over(upto)).withColumn("min_s", F.min("s").over(upto)))
    got = sequence_index(df, ["k"], ["t", "e"], sums=["v"], xors=["x"], maxs=["v"], mins=["s"], partitions=7)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_null_sums_stay_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, 2.0), ("a", 4, None)],
                               "k string, t long, v double")
    got = sequence_index(df, ["k"], ["t"], sums=["v"], partitions=4)
    assert [r.run_v for r in got.orderBy("t").collect()] == [None, None, 2.0, 2.0]


def test_lag_join(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, t long")
    idx = sequence_index(df, ["k"], ["t"], partitions=3)
    got = sorted((r.k, r.t, r.prev_t) for r in with_lag(idx, ["k"], ["t"]).collect())
    assert got == [("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("b", 1, None)]
