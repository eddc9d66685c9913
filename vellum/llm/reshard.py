"""Resharding by minimum-cost flow: which bytes of which old shard go to which new one, then which rows, then new files."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, small_join

#: Rows and bytes of a block at about most; a block is sorted in one task.
ROWS_PER_BLOCK, BYTES_PER_BLOCK = 200_000, 256 << 20
BLOCK = ["old_shard", "size_class", "bucket"]
#: What each document counts besides its text, in bytes.
EACH = 16


def min_cost_flow(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, of which as few as can be go to a shard of another number.

    Staying costs 0 a byte and moving 1, so what moves passes one node between all old and all new shards: the graph has
    len(sizes) + len(capacities) edges and one for each number that both have. Distances by reduced costs, then as much flow as
    shortest ways hold, until all is placed; which old shard's bytes go on to which new one is then read off in their order.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards hold less than the old ones have")
    n, m = len(sizes), len(capacities)
    source, between, sink = n + m, n + m + 1, n + m + 2
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 3)]  # edges: to, room, cost, place of the reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(sizes):
        edge(source, i, s, 0)
        if i < m:
            edge(i, n + i, s, 0)
        edge(i, between, s, 1)
    for j, c in enumerate(capacities):
        edge(between, n + j, sum(sizes), 0)
        edge(n + j, sink, c, 0)
    potential, left = [0] * len(graph), sum(sizes)
    while left:
        far: list[float] = [float("inf")] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for b, room, price, _ in graph[a]:
                if room and (to := d + price + potential[a] - potential[b]) < far[b]:
                    far[b] = to
                    heapq.heappush(heap, (to, b))
        for a, d in enumerate(far):
            if d < float("inf"):
                potential[a] += int(d)
        left -= _fill(graph, potential, source, sink)
    used = [{b: graph[b][back][1] for b, _, _, back in edges} for edges in graph[:n]]
    stay = {(i, i): s for i in range(min(n, m)) if (s := used[i][n + i])}
    away = [(i, s) for i in range(n) if (s := used[i][between])]
    free = [[b - n, s] for b, _, _, back in graph[between] if n <= b < n + m and (s := graph[b][back][1])]
    out, k = dict(stay), 0
    for i, s in away:
        while s:
            j, room = free[k]
            part = min(s, room)
            out[i, j] = out.get((i, j), 0) + part
            s, free[k][1] = s - part, room - part
            k += free[k][1] == 0
    return out


def _fill(graph: list[list[list[int]]], potential: list[int], source: int, sink: int) -> int:
    """Sends what edges without reduced cost hold, depth first; each edge that leads nowhere is tried once."""
    at, total, way, on_way = [0] * len(graph), 0, [], {source}
    a = source
    while True:
        if a == sink:
            amount = min(graph[x][k][1] for x, k in way)
            for x, k in way:
                graph[x][k][1] -= amount
                graph[graph[x][k][0]][graph[x][k][3]][1] += amount
            total += amount
            a, way, on_way = source, [], {source}
            continue
        while at[a] < len(graph[a]):
            b, room, price, _ = graph[a][at[a]]
            if room and b not in on_way and price + potential[a] - potential[b] == 0:
                break
            at[a] += 1
        if at[a] < len(graph[a]):
            way.append((a, at[a]))
            a = graph[a][at[a]][0]
            on_way.add(a)
        elif a == source:
            return total
        else:
            on_way.discard(a)
            a, k = way.pop()
            at[a] = k + 1


@dataclass
class Plan:
    """Where rows go. buckets: (old_shard, size_class, buckets); cuts: (block, cuts, targets); begins: (part, begin), first slots.

    old_shards: how many there were; changed: the shards whose rows don't stay as they were, new ones among them.
    """

    buckets: DataFrame
    cuts: DataFrame
    begins: DataFrame
    old_shards: int
    changed: list[int]


def _laid(rows: DataFrame, old_shards: int) -> DataFrame:
    """Rows under old_shard, size, size_class and tie alone, with all their own columns in `row`. A shard that isn't one is number old_shards."""
    own = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]).alias("row")
    known = F.col("old_shard").between(0, old_shards - 1)
    shard = F.when(known, F.col("old_shard")).otherwise(old_shards).cast("int")
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0).cast("long"))
    others = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name in ("doc_id", "size", "tie")]
    tie = F.xxhash64(*others)
    out = rows.select(own, shard.alias("old_shard"), size.alias("size"), tie.alias("tie"), F.col("doc_id").alias("doc_id"))
    return out.withColumn("size_class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))


def _blocks(laid: DataFrame, buckets: DataFrame) -> DataFrame:
    # a class of an old shard is cut into as many buckets as its rows need
    return small_join(laid, buckets, BLOCK[:2]).withColumn("bucket", F.pmod("tie", "buckets").cast("int")).withColumn("block", F.concat_ws("-", *BLOCK)).drop("buckets")


def _in_blocks(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds shard and in_block, the place among the block's rows of that shard: one shuffle by block."""
    joined = small_join(blocks, cuts, "block")
    largest = [F.col("size").desc(), "doc_id", "tie"]
    order = Window.partitionBy("block").orderBy(*largest).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(order) - F.col("size") / 2
    placed = joined.withColumn("middle", middle).withColumn("shard", F.expr("element_at(targets, 1 + size(filter(cuts, c -> c <= middle)))"))
    return placed.withColumn("in_block", F.row_number().over(Window.partitionBy("block", "shard").orderBy(*largest)) - 1)


def plan(rows: DataFrame, capacities: list[int] | int, old_shards: int, scratch: Scratch) -> Plan:
    """Where rows (doc_id, size, old_shard, and tie, if rows of one doc_id and size differ) go.

    capacities: bytes that each new shard is to hold, or a number of new shards of equal size. Each old shard is
    laid out in blocks, large documents first, and the flow cuts that line: what stays comes first, so the cuts
    fall among the smallest documents and a shard misses its capacity by a few small documents.
    A null or negative size counts 0; an old_shard that is null or isn't one of 0 to old_shards - 1 is none, and its rows
    move. The driver gets one row for each block (ROWS_PER_BLOCK rows or BYTES_PER_BLOCK bytes of one size class of an old
    shard) and each block's part in a shard.
    """
    spark = rows.sparkSession
    bare = rows.select("doc_id", "size", "old_shard", *[c for c in ("tie",) if c in rows.columns])
    laid = scratch.table(_laid(bare, old_shards).drop("row"), "laid")
    classes = laid.groupBy(*BLOCK[:2]).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    classes = [(c.old_shard, c.size_class, max(-(-c.n // ROWS_PER_BLOCK), -(-c.bytes // BYTES_PER_BLOCK), 1)) for c in classes]
    buckets = spark.createDataFrame(classes, "old_shard int, size_class int, buckets long")
    cut = _blocks(laid, buckets)
    blocks = sorted(cut.groupBy(*BLOCK).agg(F.sum("size").alias("bytes")).collect(), key=lambda b: (b.old_shard, -b.size_class, b.bucket))
    sizes = [0] * (old_shards + 1)
    for b in blocks:
        sizes[b.old_shard] += b.bytes
    if isinstance(capacities, int):
        capacities = [sum(sizes) // capacities + (k < sum(sizes) % capacities) for k in range(capacities)]
    # rows without a shard are an old one whose number no new one has
    here = len(capacities) if len(capacities) > old_shards else old_shards
    flow = min_cost_flow([*sizes[:old_shards], *[0] * (here - old_shards), sizes[old_shards]], capacities)
    ways: dict[int, list[int]] = {}
    for i, j in flow:
        ways.setdefault(old_shards if i == here else i, []).append(j)
    cuts = {}
    for i in range(old_shards + 1):
        to = sorted(ways.get(i, []), key=lambda j: (j != i, j))
        cuts[i] = list(zip(accumulate(flow[here if i == old_shards else i, j] for j in to), to, strict=True)) or [(0, min(i, len(capacities) - 1))]
    table, at = [], dict.fromkeys(range(old_shards + 1), 0)
    for b in blocks:
        begin, end = at[b.old_shard], at[b.old_shard] + b.bytes
        at[b.old_shard] = end
        ahead = [(stop - begin, j) for stop, j in cuts[b.old_shard] if stop > begin] or cuts[b.old_shard][-1:]
        most = next((k for k, (stop, _) in enumerate(ahead) if stop >= end - begin), len(ahead) - 1)
        table.append(("-".join(str(b[c]) for c in BLOCK), [stop for stop, _ in ahead[:most]], [j for _, j in ahead[: most + 1]]))
    where = spark.createDataFrame(table, "block string, cuts array<long>, targets array<int>")
    counts = sorted(_in_blocks(cut, where).groupBy("shard", "block", "old_shard").count().collect())
    first, starts = {}, []
    for c in counts:
        starts.append((f"{c.shard}/{c.block}", first.get(c.shard, 0)))
        first[c.shard] = first.get(c.shard, 0) + c["count"]
    begins = spark.createDataFrame(starts, "part string, begin long")
    moved = {x for c in counts if c.shard != c.old_shard for x in (c.shard, c.old_shard)}
    return Plan(buckets, where, begins, old_shards, sorted(moved))


def placed(rows: DataFrame, where: Plan) -> DataFrame:
    """rows with `shard` and `slot` (gapless from 0 in each shard), as planned for these rows; columns of these names are replaced.

    Ties and repeated rows each keep a place of their own; an empty table stays empty.
    """
    out = _in_blocks(_blocks(_laid(rows, where.old_shards), where.buckets), where.cuts)
    out = small_join(out.withColumn("part", F.concat_ws("/", "shard", "block")), where.begins, "part")
    kept = [F.col(f"row.`{c}`").alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return out.select(*kept, "shard", (F.col("begin") + F.col("in_block")).alias("slot"))


def affected(where: Plan) -> Column:
    """Of rows with old_shard: whether that shard is rewritten."""
    inside = F.col("old_shard").between(0, where.old_shards - 1)
    return ~F.coalesce(inside, F.lit(False)) | F.col("old_shard").isin(where.changed)


def rewrite(rows: DataFrame, where: Plan, uri: str) -> list[int]:
    """Writes the changed shards to uri/shard=<n>, slots in each row, and returns their numbers; shards that stay as they were aren't read into it.

    rows: those of the plan with all their columns, texts among them. Rows travel once, to their block's task, which writes
    its part of each shard it goes to.
    """
    placed(rows.where(affected(where)), where).drop("old_shard").write.mode("overwrite").partitionBy("shard").parquet(uri)
    return where.changed


def rewritten(rows: DataFrame, where: Plan, uri: str) -> DataFrame:
    """All rows after rewrite(): those of changed shards as the new files have them, the others from where they are."""
    rest = placed(rows.where(~affected(where)), where).drop("old_shard")
    if not rewrite(rows, where, uri):
        return rest
    back = rows.sparkSession.read.schema(rest.schema).parquet(uri)
    return back if set(range(where.old_shards)) <= set(where.changed) else rest.unionByName(back)


def documents_in_shards(docs: DataFrame, old_shards: int) -> DataFrame:
    """docs with size (bytes of the text and EACH), old_shard by a hash of doc_id, and tie, a hash of the text; columns of these names are replaced."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + EACH).cast("long")
    shard = F.pmod(F.xxhash64("doc_id", F.lit("old")), F.lit(old_shards)).cast("int")
    kept = [c for c in docs.columns if c.lower() not in ("size", "old_shard", "tie", "shard", "slot")]
    return docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("size", size).withColumn("old_shard", shard).withColumn("tie", F.xxhash64("text"))


def reshard(rows: DataFrame, capacities: list[int] | int, old_shards: int, scratch: Scratch) -> DataFrame:
    """rows (doc_id, size, old_shard, ...) with shard and slot; cases as in `plan` and `placed`."""
    return placed(rows, plan(rows, capacities, old_shards, scratch))
