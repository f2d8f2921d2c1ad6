"""Operator 11: exact centroid clustering, Lloyd's rounds sharded by dimension.

The vectors are whole numbers from the start, so every sum is exact and the
result is the same whatever the order of rows, tasks or retries.

* The table is cut both ways and written once: a row holds a piece of ``PIECE``
  vectors in one block of ``BLOCK`` dimensions.
* A round's column-block tasks compute the partial squared distances of a piece
  to the centroid slices of their block. The reduction by piece adds the
  blocks and takes the argmin: it moves one number per vector, block and
  centroid, whatever the dimension, and no group has more rows than blocks.
* The labels go back to the pieces; every shard adds up its own dimensions and
  updates its own slice of the centroids.

Only the centroids (k x d numbers) reach the driver, between rounds. The
labels are written every round, so a lost executor costs a part of one round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import staged

DIM = 64
SCALE = 1024
SEED = 3
K = 8
ROUNDS = 10
BLOCK = 16                # dimensions in a block
PIECE = 2048              # vectors in a piece
LIMIT = 1 << 27           # components below it keep a squared distance within 64 bits


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as whole numbers."""
    x = F.col(embedding).cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float(LIMIT) / scale)))  # NaN is above every number
    return (vectors.filter(F.coalesce((F.size(x) == dim) & ok, F.lit(False)))
                   .select(F.col(vec_id).cast("bigint").alias("vec_id"),
                           F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("int")).alias("v")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hash of ``<seed>:<vec_id>`` (a null id
    last; ties: the smaller vector)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = rows.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in top], np.int64)


def _cut(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """(piece, block, n, data): block -1 holds the ids, the others the int32
    matrix of the piece's vectors in the block's dimensions."""
    def cut(batches):
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            ids = batch.column("vec_id")
            for lo in range(0, len(v), PIECE):
                some, own = v[lo:lo + PIECE], ids.slice(lo, PIECE)
                key = (part << 32) + count
                count += 1
                cells = [(-1, own.fill_null(0).to_numpy().tobytes() + own.is_null().cast(pa.uint8()).to_numpy().tobytes())]
                cells += [(b, np.ascontiguousarray(some[:, b * block:(b + 1) * block]).tobytes()) for b in range(-(-dim // block))]
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array([key] * len(cells), pa.int64()), "block": pa.array([b for b, _ in cells], pa.int32()),
                    "n": pa.array([len(some)] * len(cells), pa.int32()), "data": pa.array([d for _, d in cells], pa.binary())})
    return rows.select("vec_id", "v").mapInArrow(cut, "piece long, block int, n int, data binary")


def _assign(cells: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """(piece, labels, dist): every vector's nearest centroid and squared
    distance; ties go to the smaller number."""
    k = len(centroids)

    def partial(batches):
        for pdf in batches:
            out = []
            for b, n, data in zip(pdf["block"], pdf["n"], pdf["data"]):
                x = np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)
                c = centroids[:, b * block:(b + 1) * block]
                out.append(np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1).tobytes())
            yield pd.DataFrame({"piece": pdf["piece"], "n": pdf["n"], "part": out})

    def reduce(pdf):
        d = sum(np.frombuffer(p, np.int64).reshape(-1, k) for p in pdf["part"])
        at = d.argmin(axis=1)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "labels": [at.astype(np.int32).tobytes()],
                             "dist": [d[np.arange(len(d)), at].tobytes()]})
    return (cells.filter("block >= 0").mapInPandas(partial, "piece long, n int, part binary")
                 .groupBy("piece").applyInPandas(reduce, "piece long, labels binary, dist binary"))


def _update(cells: DataFrame, labels: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """The floor of the mean of every centroid's vectors, a slice per block;
    a centroid without vectors stays."""
    k = len(centroids)

    def add(batches):
        total: dict = {}
        for pdf in batches:
            for b, n, data, at in zip(pdf["block"], pdf["n"], pdf["data"], pdf["labels"]):
                x, at = np.frombuffer(data, np.int32).reshape(n, -1), np.frombuffer(at, np.int32)
                s, c = total.setdefault(b, (np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)))
                np.add.at(s, at, x)
                c += np.bincount(at, minlength=k)
        rows = [(int(b), j, d, int(s[j, d]), int(c[j])) for b, (s, c) in total.items() for j in range(k) if c[j] for d in range(s.shape[1])]
        yield pd.DataFrame(rows, columns=["block", "j", "d", "s", "c"])
    sums = (cells.filter("block >= 0").join(labels.select("piece", "labels"), "piece")
                 .mapInPandas(add, "block int, j int, d int, s long, c long")
                 .groupBy("block", "j", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("c").alias("c")))
    out = centroids.copy()
    for r in sums.collect():   # one number per centroid and dimension
        out[r.j, r.block * block + r.d] = int(r.s) // r.c
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, rounds: int = ROUNDS,
            dim: int = DIM, scale: int = SCALE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    per vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null, NaN or infinite,
    as whole numbers floor(scale * x). A component of 2**27 or more (131,072
    before scaling) is out of range like an infinite one, because its squared
    distance would not fit a long. Centroids start as the k kept vectors of
    smallest hash (all, if there are fewer). Repeated rows count each, equal
    vectors can start several centroids (the smaller number then takes all), a
    null id never comes before others as a start and is returned as null, an
    empty table gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, vec_id, embedding, dim, scale)
    centroids = first_centroids(rows, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    cells = staged(_cut(rows, dim, block), "lloyd-cells")
    for _ in range(rounds):
        labels = staged(_assign(cells, centroids, block), "lloyd-labels")
        moved = _update(cells, labels, centroids, block)
        if (moved == centroids).all():   # the next rounds would change nothing
            break
        centroids = moved
    labels = staged(_assign(cells, centroids, block), "lloyd-labels")

    def rows_of(batches):
        for pdf in batches:
            for n, data, at, dist in zip(pdf["n"], pdf["data"], pdf["labels"], pdf["dist"]):
                ids = pd.arrays.IntegerArray(np.frombuffer(data, np.int64, n).copy(), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool))
                yield pd.DataFrame({"vec_id": ids, "cluster": np.frombuffer(at, np.int32), "distance": np.frombuffer(dist, np.int64)})
    placed = staged(cells.filter("block = -1").join(labels, "piece").mapInPandas(rows_of, "vec_id long, cluster int, distance long"), "lloyd-placed")
    sums = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    about = spark.createDataFrame(
        [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL, a table expression per round."""
    def nearest(c: str) -> str:
        return f"""SELECT r, j, dist FROM (SELECT r, j, dist, row_number() OVER (PARTITION BY r ORDER BY dist, j) AS o
  FROM (SELECT x.r, c.j, sum((x.q - c.q) * (x.q - c.q))::BIGINT AS dist FROM x JOIN {c} c ON x.d = c.d GROUP BY x.r, c.j)) WHERE o = 1"""
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS v
  FROM embeddings WHERE coalesce(len(embedding) = {dim} AND len(list_filter(embedding, lambda e: coalesce(abs(e) < {LIMIT / scale}, false))) = {dim}, false))""",
             f"x AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS d, unnest(v) AS q FROM kept)",
             f"""c0 AS MATERIALIZED (SELECT j, unnest(range(1, {dim + 1})) AS d, unnest(v) AS q FROM (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1)::INT AS j, v FROM kept) WHERE j < {k})"""]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest(f'c{i}')})")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.j, c.d, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
  SELECT j, d, ((s - ((s % n) + n) % n) // n)::BIGINT AS q FROM (SELECT a.j, x.d, sum(x.q)::HUGEINT AS s, count(*) AS n
    FROM a{i} a JOIN x ON a.r = x.r GROUP BY a.j, x.d)) m ON c.j = m.j AND c.d = m.d)""")
    parts.append(f"f AS MATERIALIZED ({nearest(f'c{rounds}')})")
    parts.append(f"h AS (SELECT j, sha256(string_agg(q::VARCHAR, ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY j)")
    return "WITH " + ",\n".join(parts) + """
SELECT kept.vec_id, f.j AS cluster, f.dist AS distance, (sum(f.dist) OVER (PARTITION BY f.j))::BIGINT AS cluster_inertia,
       (sum(f.dist) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM f JOIN kept USING (r) JOIN h USING (j)"""
