"""Sharding by Karmarkar-Karp differencing.

Groups (documents with equal texts) are indivisible.  Every group starts as a
partial partition with its bytes in one shard and nothing in the others.  The
two partial partitions with the largest spread are combined again and again,
oppositely ordered: the heaviest shard of one joins the lightest of the other.

The groups are dealt out to parts by their hash; a task differences a part's
groups down to one partial partition.  What the parts leave is differenced in
the same way, level by level, FAN partial partitions to one, until one is left:
all on the executors, so that neither a task nor the driver holds more than a
part's groups or FAN partial partitions.  A group of any number of copies is
one item with a weight.

Defined results: null text has no bytes and counts as equal to other null
texts only; every row's size is its bytes plus 1.  A group that alone is
heavier than a shard's share stays whole.  Rows that are equal in every column
get slots of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import broadcast_if_small, checkpoint

SHARDS = 8
#: Groups of equal texts are dealt into at least so many parts, and more where a
#: part would have more than PART_ROWS rows; so many parts become one in a level.
TASKS, PART_ROWS, FAN = 256, 200_000, 256
#: Parts into which a shard's rows are dealt to number them.
PARTS = 512


def difference(parts: list[tuple[list[int], object]]) -> tuple[list[int], list]:
    """Combine partial partitions: (bytes of each shard, a label of it).

    Gives the bytes of each shard and, for each shard, the (label, shard of
    that label's partition) pairs that it consists of.
    """
    if not parts:
        return [], []
    shards = len(parts[0][0])
    heap = []
    for at, (sums, label) in enumerate(parts):
        order = sorted(range(shards), key=lambda k: (-sums[k], k))
        ranked = [sums[k] for k in order]
        heap.append((ranked[-1] - ranked[0], at, ranked, [(label, k) if sums[k] else None for k in order]))
    heapify(heap)
    at = len(parts)
    while len(heap) > 1:
        _, _, a, inside_a = heappop(heap)
        _, _, b, inside_b = heappop(heap)
        joined = [(a[k] + b[-1 - k], (inside_a[k], inside_b[-1 - k])) for k in range(shards)]
        order = sorted(range(shards), key=lambda k: (-joined[k][0], k))
        sums = [joined[k][0] for k in order]
        heappush(heap, (sums[-1] - sums[0], at, sums, [joined[k][1] for k in order]))
        at += 1
    _, _, sums, inside = heap[0]
    return sums, [list(_leaves(x)) for x in inside]


def _leaves(tree):
    """Labels in a tree of pairs; `None` is an empty shard.  A label's leaf is (label, int)."""
    stack = [tree]
    while stack:
        x = stack.pop()
        if x is None:
            continue
        if isinstance(x[1], int):
            yield x
        else:
            stack += x


def shard(docs: DataFrame, shards: int = SHARDS, tasks: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    tasks = tasks or max(TASKS, docs.count() // PART_ROWS)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("")).alias("same"),
    )
    groups = rows.groupBy("same").agg(F.sum("size").alias("weight")).withColumn("task", F.pmod(F.xxhash64("same"), F.lit(tasks)).cast("int"))

    dealt = _level(groups.select("task", F.col("same").alias("label"), F.lit(0).alias("part"), "weight"), shards, "string").withColumnsRenamed({"label": "same", "to": "part"})
    dealt = checkpoint(dealt.drop("from"))
    where = None  # (task, part) of the first level -> task and part of the last
    count = tasks
    while count > 1:
        count = -(-count // FAN)
        now = dealt if where is None else dealt.join(broadcast_if_small(where), ["task", "part"]).select(F.col("up").alias("task"), F.col("up_part").alias("part"), "weight")
        nodes = now.groupBy("task", "part").agg(F.sum("weight").alias("weight"))
        up = _level(nodes.select(F.pmod("task", F.lit(count)).cast("int").alias("task"), F.col("task").alias("label"), "part", "weight"), shards, "int")
        up = checkpoint(up.select(F.col("label").alias("low"), F.col("from").alias("low_part"), F.col("task").alias("up"), F.col("to").alias("up_part")))
        if where is None:
            where = up.withColumnsRenamed({"low": "task", "low_part": "part"})
        else:
            where = where.withColumnsRenamed({"up": "low", "up_part": "low_part"}).join(broadcast_if_small(up), ["low", "low_part"]).select("task", "part", "up", "up_part")
        where = checkpoint(where)
    placed = dealt.select("task", "part", "same") if where is None else dealt.join(broadcast_if_small(where), ["task", "part"]).select(F.col("up_part").alias("part"), "same")
    return _number(rows.join(checkpoint(placed.select("same", F.col("part").alias("shard"))), "same"), shards)


def _level(nodes: DataFrame, shards: int, kind: str) -> DataFrame:
    """Differences each task's partial partitions; nodes: task, label (of the
    partial partition), part (of that) and weight.  Gives task, label, from (its
    part), to (the part of the task's result) and weight."""

    def run(batches):
        yield from _each_task(batches, shards, kind)

    ordered = nodes.repartition("task").sortWithinPartitions("task", "label", "part")
    return ordered.mapInArrow(run, f"task int, label {kind}, from int, to int, weight long")


def _each_task(batches, shards: int, kind: str):
    held: dict[object, list[int]] = {}
    now = None

    def done():
        if not held:
            return
        order = sorted(held, key=lambda k: (-max(held[k]), k))
        _, inside = difference([(held[label], k) for k, label in enumerate(order)])
        rows = [(order[k], part, to, held[order[k]][part]) for to, leaves in enumerate(inside) for k, part in leaves]
        kinds = [pa.string() if kind == "string" else pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([now] * len(rows), pa.int32()), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], ["task", "label", "from", "to", "weight"])

    for b in batches:
        for task, label, part, weight in zip(*(b.column(k).to_pylist() for k in range(4))):
            if task != now:
                yield from done()
                held, now = {}, task
            held.setdefault(label, [0] * shards)[part] = weight
    yield from done()


def _number(placed: DataFrame, shards: int) -> DataFrame:
    """Slots without gaps in each shard, without one task for each shard: rows
    are numbered within parts, and each part starts where the one before ends."""
    parted = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "same"), F.lit(PARTS)).cast("int"))
    ends = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # at most shards x PARTS rows
    starts = ends.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "same")
    return (
        parted.withColumn("row", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
