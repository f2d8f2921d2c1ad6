"""Operator 3: minimum-cost-flow resharding.

From the bytes of the old shards and the capacities of the new ones, a
minimum-cost flow says how many bytes go from each old shard to each new one
(a byte that stays costs nothing, one that moves costs one). Whole blocks
(files) realise it; blocks on a border are split by rows. Only blocks that
move or split are rewritten, all others stay where they are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import scratch, staged

SLICES = 4096  # row groups (by hash) that a split block is divided into
CHUNK_BITS = 12  # rows numbered together when slots are dealt


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes per (old shard, new shard) that move the fewest bytes.

    Successive shortest paths from the old shards to the new ones: the graph
    has one node per shard, so its size is the number of shards. The
    capacities must sum to the supplies at least.
    """
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new shards cannot hold the old ones")
    flow: dict[tuple[int, int], int] = {}
    left, room = dict(supply), dict(capacity)
    cost = lambda i, j: 0 if i == j else 1
    for _ in range(4 * (len(supply) + 1) * (len(capacity) + 1)):
        if not any(left.values()):
            return {k: v for k, v in flow.items() if v}
        dist: dict[tuple[str, int], int] = {("o", i): 0 for i, v in left.items() if v}
        came: dict[tuple[str, int], tuple[str, int] | None] = dict.fromkeys(dist)
        changed = True
        while changed:  # Bellman-Ford: returning flow has negative cost
            changed = False
            for kind, k in list(dist):
                for nxt, c in ([(("n", j), cost(k, j)) for j in capacity] if kind == "o" else
                               [(("o", i), -cost(i, k)) for i in supply if flow.get((i, k))]):
                    if dist[kind, k] + c < dist.get(nxt, 1 << 60):
                        dist[nxt], came[nxt], changed = dist[kind, k] + c, (kind, k), True
        end = min((x for x in dist if x[0] == "n" and room[x[1]]), key=lambda x: (dist[x], x[1]))
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        most = min([left[path[0][1]], room[end[1]], *(flow[b[1], a[1]] for a, b in steps if a[0] == "n")])
        for a, b in steps:
            if a[0] == "o":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + most
            else:
                flow[b[1], a[1]] -= most
        left[path[0][1]] -= most
        room[end[1]] -= most
    raise AssertionError("no flow found")


def even(total: int, n: int) -> dict[int, int]:
    return {j: total // n + (j < total % n) for j in range(n)}


def deal_blocks(blocks: dict, need: dict[int, int]) -> tuple[dict, list, dict[int, int]]:
    """Place whole blocks where they fit, largest first, into the target with
    the most bytes still needed: (block -> shard, blocks to split, what the
    split ones have to bring)."""
    need, placed, split = dict(need), {}, []
    for b in sorted(blocks, key=lambda b: (-blocks[b], b)):
        to = max(need, key=lambda j: (need[j], -j))
        if blocks[b] <= need[to]:
            placed[b] = to
            need[to] -= blocks[b]
        else:
            split.append(b)
    return placed, split, need


def deal_slices(slices: dict, need: dict[int, int]) -> dict:
    """Every slice goes to the target that lacks the most bytes, largest first."""
    heap = [(-v, j) for j, v in sorted(need.items())]
    heapq.heapify(heap)
    out = {}
    for s in sorted(slices, key=lambda s: (-slices[s], s)):
        v, j = heapq.heappop(heap)
        out[s] = j
        heapq.heappush(heap, (v + slices[s], j))
    return out


def reshard(docs: DataFrame, block: str, new_shards: int, old_shards: int, doc_id: str = "doc_id",
            text: str = "text", out: str | None = None) -> DataFrame:
    """Rows of ``docs`` with ``size`` and their new ``shard``, after the
    affected blocks were rewritten below ``out`` as ``shard=<n>`` folders.

    ``block`` names the column that says which block (file) a row lies in;
    blocks were dealt to the old shards in the order of their names. A row's
    size is its text's UTF-8 bytes (null: none) plus 1. The new capacities
    are equal. Nulls, repeated rows and equal ids are rows like any other. An
    empty table needs no move and gives an empty result. Columns of the input
    named ``size`` or ``shard`` are replaced.
    """
    spark = docs.sparkSession
    out = out or scratch(spark, "shards")
    # The row travels as one column, so no name of the input can clash.
    sized = docs.drop("size", "shard").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.drop("size", "shard").columns]).alias("row"), F.col(block).cast("string").alias("block"),
        F.col(doc_id).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"))
    # One row per block (file): the list of files that the driver holds anyway.
    blocks = {r.b: r.s for r in sized.groupBy(F.col("block").alias("b")).agg(F.sum("size").alias("s")).collect()}
    old = {b: k % old_shards for k, b in enumerate(sorted(blocks, key=str))}
    supply = {i: sum(s for b, s in blocks.items() if old[b] == i) for i in range(old_shards)}
    flow = min_cost_flow(supply, even(sum(supply.values()), new_shards))
    placed, splits = {}, {}
    for i in range(old_shards):
        need = {j: v for (o, j), v in flow.items() if o == i}
        if need:
            at, split, lacks = deal_blocks({b: s for b, s in blocks.items() if old[b] == i}, need)
            placed |= at
            splits |= {b: (i, lacks) for b in split}
    # Rows of a split block are grouped by a hash that also holds the row's
    # place, so that equal rows do not fall into one slice.
    slice_of = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(SLICES)).cast("int")
    place = spark.createDataFrame([(b, j, b in placed and j == old[b]) for b, j in placed.items()],
                                  "b string, shard int, stays boolean")
    whole = sized.join(F.broadcast(place), F.col("block").eqNullSafe(F.col("b")))
    stay = whole.filter("stays").select("row.*", "size", "shard")
    moved = whole.filter("NOT stays").select("row", "size", "shard")
    if splits:
        names = spark.createDataFrame([(b,) for b in splits], "b string")
        border = staged(sized.join(F.broadcast(names), F.col("block").eqNullSafe(F.col("b")), "left_semi").withColumn("slice", slice_of), "border")
        got = border.groupBy("block", "slice").agg(F.sum("size").alias("s")).collect()
        rows = []
        for i in {i for i, _ in splits.values()}:
            lacks = next(v for k, v in splits.values() if k == i)
            mine = {(r.block, r.slice): r.s for r in got if splits[r.block][0] == i}
            rows += [(b, s, j) for (b, s), j in deal_slices(mine, lacks).items()]
        cut = spark.createDataFrame(rows, "b string, s int, shard int")
        # At most (border blocks x SLICES) rows; there is a border block per flow arc at most.
        moved = moved.unionByName(border.join(F.broadcast(cut), F.col("block").eqNullSafe(F.col("b")) & (F.col("slice") == F.col("s")))
                                  .select("row", "size", "shard"))
    n = max(new_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // new_shards)))
    moved = moved.withColumn("salt", salt).repartition(n, "shard", "salt").select("row.*", "size", "shard")
    moved.write.partitionBy("shard").parquet(out)
    rewritten = spark.read.schema(moved.schema).parquet(out).select(*[F.col(f"`{c}`") for c in moved.columns])
    return stay.unionByName(rewritten)


def with_slots(placed: DataFrame, name: str = "slots") -> DataFrame:
    """Number the rows of each shard without gaps from 0.

    Runs of 2**CHUNK_BITS rows of a task are numbered apart; their counts,
    one row per run and shard, add up to the runs' first slots.
    """
    rows = staged(placed.drop("slot").select(F.struct(*[F.col(f"`{c}`") for c in placed.drop("slot").columns]).alias("row"), "shard",
                                             F.monotonically_increasing_id().alias("at"))
                        .withColumn("chunk", F.shiftright("at", CHUNK_BITS)), name)
    per = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("at"))
    return (rows.withColumn("k", inside).join(first, ["shard", "chunk"])
                .select("row.*", (F.col("first") + F.col("k") - 1).cast("bigint").alias("slot")))
