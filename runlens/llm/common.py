"""Helpers shared by the operators: shared-folder tables, folding equal
texts, connected components, byte-level word and shingle hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import runlens
from runlens.session import ensure_checkpoint_dir

# Functions of this package travel to the executors by value, so a cluster
# needs no copy of it on the Python path of its workers.
cloudpickle.register_pickle_by_value(runlens)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage
    ends there and a lost executor costs no recomputation of what is above."""
    path = scratch(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def used_up(*tables: DataFrame) -> None:
    """Delete written tables of this operator that nothing reads any more: what
    was made of them is written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over. Spark deletes them
    when the driver's JVM collects what refers to them, which it seldom does by
    itself while it has memory to spare; called after steps that moved much."""
    spark._jvm.System.gc()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected ``links`` (a, b) as (node, root),
    root the smallest node reachable. Large-star/small-star: each round is two
    map-side combined aggregations and joins on the node, the table is written
    between rounds, and no neighbourhood is ever gathered in one row."""
    e = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    e = staged(e, "links")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours of u hang on the smallest one around u
        large = (both.join(low, "u").filter("v > u AND v <> m")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours of u, and u, hang on the smallest of them
        small = (large.join(low2, "u")
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                      .select("e.u", "e.v").filter("u <> v").distinct())
        nxt = staged(small, "links")
        if nxt.count() == e.count() and nxt.exceptAll(e).isEmpty():
            break
        used_up(e)
        e = nxt
    used_up(nxt)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._scratch = e._scratch
    return out


class Bitmap:
    """A bitmap of fixed size over a column's values; it only thins out what
    an exact join meets later."""

    def __init__(self, values: DataFrame, column: str):
        low = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
        words_ = values.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
        self.bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
        self.bits[words_["w"].to_numpy()] = words_["b"].to_numpy().view(np.uint64)

    def holds(self, v: np.ndarray) -> np.ndarray:
        b = v & np.uint64((1 << BITMAP_BITS) - 1)
        return (self.bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1


# --- words and shingles of many texts at once ------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5
BITMAP_BITS = 26


def pieces(pdf: pd.DataFrame, limit: int, text: str = "x"):
    """Pieces of a batch that hold about ``limit`` code points of ``text``, or
    one longer text."""
    size = np.fromiter((0 if t is None else len(t) for t in pdf[text]), np.int64, len(pdf))
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1, append=1 << 62))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield pdf.iloc[lo:hi]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    """1, P, P**2, ... modulo 2**64."""
    out = np.full(max(n, 1), _P, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and each text's word count.

    A word is a run of ``[^\\x20\\x09-\\x0D]`` over UTF-8, A-Z lower-cased.
    A null text has none.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    sp = _SPACE[buf]
    first = np.flatnonzero(sp[:-1] & ~sp[1:]) + 1
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
    last = np.flatnonzero(~sp[:-1] & sp[1:]) + 1
    lens = last - first
    body = ~sp
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    val = _BYTE[_LOWER[buf[body]]] * _powers(int(lens.max()))[pos]
    h = mix(np.add.reduceat(val, np.cumsum(lens) - lens) + lens.astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    upto = np.searchsorted(first, ends + 1 - 1, side="right")
    return h, np.diff(np.concatenate(([0], upto)))


def shingles(h: np.ndarray, n: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts whose words ``words`` gave, and
    their number per text; a text of 1 to k-1 words has one, of all its words."""
    out_n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.cumsum(n) - n
    if not int(out_n.sum()):
        return np.empty(0, np.uint64), out_n
    at = np.repeat(starts, out_n) + (np.arange(int(out_n.sum())) - np.repeat(np.cumsum(out_n) - out_n, out_n))
    left = np.repeat(starts + n, out_n) - at
    pw = _powers(k + 1)
    pad = np.concatenate((h, np.zeros(k, np.uint64)))
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        s += np.where(left > j, mix(pad[at + j] + pw[j]), np.uint64(0)) * pw[j]
    return mix(s + np.minimum(left, k).astype(np.uint64)), out_n
