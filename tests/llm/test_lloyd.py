"""Operator 11 against a plain version and DuckDB."""

import hashlib
import math

import duckdb
import pytest
from conftest import SF

from runlens.llm import lloyd

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < 131072 for c in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own)]
    got = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {j: sum(r[2] for r in got if r[1] == j) for j in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in got), key=str)


def run(df, **kw):
    return sorted(map(tuple, lloyd.cluster(df, **kw).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    assert len({r[1] for r in want}) > 3
    got = run(df)
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, con.execute(lloyd.oracle_sql()).fetchall()), key=str) == want


@pytest.mark.parametrize("block", [1, 24, 64])
def test_odd_vectors(spark, monkeypatch, block):
    """Nulls, wrong lengths, values that are no numbers or out of range, ties,
    repeated rows, a null id, negative components, fewer vectors than centroids."""
    monkeypatch.setattr(lloyd, "PIECE", 3)
    one = [0.25] * 64
    rows = [(1, one), (2, one), (2, one), (3, None), (4, []), (5, [1.0] * 63), (6, [1.0] * 65), (7, [None] + [1.0] * 63),
            (8, [float("nan")] * 64), (9, [float("inf")] * 64), (10, [3e38] * 64), (11, [-131071.5] * 64), (None, [-0.0001] * 64),
            (12, [i / 7 for i in range(64)]), (13, [-i / 7 for i in range(64)])]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    for c in ("piece", "block", "n", "data", "cluster", "distance", "v"):
        df = df.withColumn(c, F.lit("clash"))
    assert run(df, block=block) == plain([(r.vec_id, r.embedding) for r in df.collect()])
    assert run(df.limit(0)) == []
    many = [(i, [((i * 37 + d * d) % 101 - 50) / 9 for d in range(64)]) for i in range(120)]
    assert run(spark.createDataFrame(many, SCHEMA), block=block) == plain([tuple(r) for r in spark.createDataFrame(many, SCHEMA).collect()])
