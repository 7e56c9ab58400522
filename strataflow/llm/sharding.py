"""Sharding by longest-processing-time scheduling.

Groups (rows with equal texts) are the jobs, their bytes the processing times. Sorted by size, largest first, each
group goes to the least loaded shard of a heap; ties go to the lower shard number. Groups of one size are
interchangeable, so the histogram (size, number of groups) is scheduled rather than the groups: it has at most
sqrt(2 x total bytes) entries, because distinct sizes 1, 2, ..., D already sum to D(D+1)/2. One task reads it in order and
holds nothing but the shards' loads. A run of many equal groups is placed in closed form, which gives what the heap would
give.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize

#: Runs up to this length go through the heap one group at a time; longer ones in closed form.
HEAP_RUN = 64


def place_run(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` equal groups each shard gets when each goes to the least loaded; updates loads."""
    n = len(loads)
    taken = [0] * n
    if count <= HEAP_RUN:
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            taken[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
    else:
        # Shard j offers the keys (loads[j] + t * size, j); the heap takes the `count` smallest of them.
        low, high = min(loads), min(loads) + count * size
        while low < high:
            mid = (low + high) // 2
            if sum((mid - load) // size + 1 for load in loads if load <= mid) >= count:
                high = mid
            else:
                low = mid + 1
        taken = [(low - load) // size + 1 if load <= low else 0 for load in loads]
        excess = sum(taken) - count
        for shard in range(n - 1, -1, -1):
            if excess and taken[shard] and loads[shard] + (taken[shard] - 1) * size == low:
                taken[shard] -= 1
                excess -= 1
    for shard in range(n):
        loads[shard] += taken[shard] * size
    return taken


def scheduled(histogram: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, cumulative numbers of its groups up to each shard) for each size of the histogram, which comes largest first."""
    loads = [0] * n_shards
    for size, count in histogram:
        yield size, list(itertools.accumulate(place_run(loads, size, count)))


def schedule(histogram: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    return list(scheduled(sorted(histogram, reverse=True), n_shards))


def _schedules(histogram: DataFrame, n_shards: int) -> DataFrame:
    """group_size, ends of histogram(group_size, count), by one task that holds a batch at a time."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[int, int]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        plan = scheduled(entries(), n_shards)
        while some := list(itertools.islice(plan, 10_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int64()))], names=["group_size", "ends"]
            )

    ordered = histogram.select("group_size", "count").repartition(1).sortWithinPartitions(F.desc("group_size"))
    return ordered.mapInArrow(planned, "group_size long, ends array<long>")


def lpt_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard every row, rows of equal texts together, the shards' bytes as near to equal as LPT makes them.

    Returns id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (unsigned; 0 for null), shard and slot
    (0, 1, ... without gaps in each shard). Null texts form one group, empty texts another. Repeated rows are kept, each
    with a slot of its own. An empty table gives no rows. Other columns, whatever their names, are not looked at.
    """
    text = F.col(f"`{text_col}`")
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("text_key"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")), "shard-groups")
    plan = materialize(_schedules(groups.groupBy("group_size").count(), n_shards), "shard-plan")
    # A group's rank among those of its size: offset of its bucket plus its place in the bucket, so that a size which
    # most groups share is ranked by many tasks.
    n_buckets = 64 + groups.count() // 1_000_000
    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(n_buckets)))
    before = Window.partitionBy("group_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("group_size", "bucket")
        .count()
        .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .join(plan, "group_size")
        .select("group_size", "bucket", "before", "ends")
    )
    in_bucket = Window.partitionBy("group_size", "bucket").orderBy("text_key")
    placed = (
        bucketed.withColumn("place", F.row_number().over(in_bucket) - 1)
        .join(offsets, ["group_size", "bucket"])
        .select(
            "text_key",
            F.size(F.filter("ends", lambda e: e <= F.col("before") + F.col("place"))).cast("int").alias("shard"),
        )
    )
    assigned = materialize(
        rows.join(placed, "text_key").select(
            "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_buckets)).alias("part")
        ),
        "shard-assigned",
    )
    starts = (
        assigned.groupBy("shard", "part")
        .count()
        .select(
            "shard",
            "part",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("start"),
        )
    )
    in_part = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        assigned.withColumn("place", F.row_number().over(in_part) - 1)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
    )
