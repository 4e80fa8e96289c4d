"""Sharding by longest processing time: equal texts stay together, shard sizes come out near equal.

Groups go by descending size to the least-loaded shard of a heap. Groups of one size are
interchangeable, so the driver sees a row for each different size, not for each group: D different
sizes sum to at least D*D/2 bytes, so there are at most sqrt(2 * total bytes) of them. Sorted by Spark,
they stream through the heap in blocks; a run of equal sizes longer than a few rounds of all shards is
dealt by arithmetic, exactly as the heap would deal it one by one.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_ROWS, columns, free, prefix_sum, shared_dir, spread_join, staged

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 8
#: Rounds of all shards up to which equal groups go through the heap one by one.
HEAP_ROUNDS = 4
#: Rows of the plan that the driver holds at a time.
PLAN_ROWS = 500_000


def deal_equal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of ``size`` each shard gets if they go one by one to the least-loaded shard (ties: lower index).

    The j-th item that shard i takes starts at load ``loads[i] + j * size``; the heap serves starts in
    ascending order, so the level below which ``count`` starts lie is found by bisection.
    """
    if size <= 0:
        least = min(range(len(loads)), key=lambda i: (loads[i], i))
        return [count if i == least else 0 for i in range(len(loads))]
    below = lambda level: [max(0, (level - x) // size + 1) if level >= x else 0 for x in loads]
    low, high = min(loads) - 1, max(loads) + size * count
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    got = below(low)
    left = count - sum(got)
    for i, x in enumerate(loads):
        if left and low + 1 >= x and (low + 1 - x) % size == 0:
            got[i] += 1
            left -= 1
    return got


def lpt_plan(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """For (size, count) rows, larger sizes first: (size, first rank, rank after the last, shard), ranks counting the groups of one size."""
    heap = [(0, i) for i in range(shards)]
    for size, count in histogram:
        got = [0] * shards if count > 1 else None
        if got is None:
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            yield size, 0, 1, i
            continue
        if count <= HEAP_ROUNDS * shards:
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                got[i] += 1
        else:
            loads = [load for _, load in sorted((i, load) for load, i in heap)]
            got = deal_equal(loads, size, count)
            heap = [(load + n * size, i) for i, (load, n) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        upto = 0
        for i, n in enumerate(got):
            if n:
                yield size, upto, upto + n, i
                upto += n


def _plan_table(groups: DataFrame, shards: int) -> DataFrame:
    """The plan as a staged table; its rows pass through the driver in blocks."""
    spark = groups.sparkSession
    histogram = groups.groupBy("weight").agg(F.count("*").alias("n")).orderBy(F.desc("weight"))
    path = f"{shared_dir(spark)}/shard-plan-{uuid.uuid4().hex}"
    names = ("weight", "first", "after", "shard")
    schema = pa.schema([(n, pa.int64()) for n in names])
    empty = [tuple()] * 4
    wrote = False
    for block in batched(lpt_plan(((r["weight"], r["n"]) for r in histogram.toLocalIterator()), shards), PLAN_ROWS):
        spark.createDataFrame(pa.table(list(map(pa.array, zip(*block, strict=True))), schema=schema)).write.mode("append").parquet(path)
        wrote = True
    if not wrote:
        spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in empty], schema=schema)).write.parquet(path)
    return spark.read.schema("weight long, first long, after long, shard long").parquet(path)


def text_group(text: Column) -> Column:
    """Equal texts have equal groups; null texts are a group of their own."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"null"))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long")


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Staged ``rows`` (group, size) to (group, shard, n), n its rows."""
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("n")), "shard-groups")
    plan = _plan_table(groups, shards)
    near = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    ranked = prefix_sum(groups, ["weight"], ["group"], F.lit(1), "rank")
    placed = ranked.join(near, "weight").where("rank >= first and rank < after")
    return staged(placed.select("group", F.col("shard").cast("int").alias("shard"), "n"), "shard-placed")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` shards; one row per input row.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Rows with equal texts share a
    shard; null texts form one group of their own, an empty text is another. A row's size is its
    text's UTF-8 bytes (null: 0) plus 8. ``slot`` numbers a shard's rows from 0 without gaps, by
    doc_id and text_crc32, null ids last. Repeated rows and null doc_ids are rows like any other; other
    columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    rows = staged(docs.select("doc_id", row_size(text).alias("size"), crc.alias("text_crc32"), text_group(text).alias("group")), "shard-rows")
    dealt = spread_join(rows, group_shards(rows, shards), "group", "n").select("doc_id", "size", "text_crc32", "shard")
    return prefix_sum(dealt, ["shard"], ["doc_id", "text_crc32"], F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with all its columns and ``shard``, in place of a column of that name; texts move once, to meet their group's shard."""
    group = text_group(docs["text"])
    placed = group_shards(staged(docs.select(group.alias("group"), row_size(docs["text"]).alias("size")), "shard-rows"), shards)
    kept = [c for c in docs.columns if c.lower() != "shard"]
    own, n = free(docs, "_group", "_n")
    joined = spread_join(docs.select(*columns(docs, kept), group.alias(own)), placed.withColumnsRenamed({"group": own, "n": n}), own, n)
    return joined.select(*columns(joined, [*kept, "shard"]))
