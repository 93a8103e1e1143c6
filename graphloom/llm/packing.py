"""Filling containers of fixed capacity with whole items.

Sizes are whole numbers up to the capacity, so an instance of any number of items is a histogram of at
most ``capacity`` rows. Only that histogram comes to the driver. There the Martello-Toth reduction fixes
sets of items that dominate every alternative (alone, an exact partner, the largest partner where only
one more fits, a dominating pair where only two more fit), each as many times as the counts allow; the
rest is placed by best fit, largest first, again by count. The plan says which ranks of which size go to
which run of containers: below 4 groups for each size, so its length depends on the capacity alone and
it is broadcast. Items get their rank within their size by a window over bounded buckets of that size
(a size held by very many items is cut into buckets by the hash of the id), and look up their container.

Defined cases: an item without size (null or 0) needs no container and does not come out; an item
larger than the capacity is cut into full pieces and a rest, and only such an item; equal sizes are
ranked by id; repeated ids are separate items. Container numbers run from 0 without gaps.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokenizer import token_counts
from graphloom.sources.tables import cut_lineage, read_table

#: Items of one size that are ranked in one bucket.
BUCKET_ROWS = 200_000


class _Counts:
    """A multiset of sizes that can be asked for its smallest members and the largest that fits."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest members, one member of size ``without`` set aside."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.count[s] - (s == without))
            if len(out) >= k:
                break
        return out

    def largest_to(self, room: int, without: tuple[int, ...]) -> int | None:
        """The largest member of at most ``room`` when one member of each size in ``without`` is set aside."""
        at = bisect_right(self.sizes, room) - 1
        while at >= 0:
            s = self.sizes[at]
            if self.count[s] > without.count(s):
                return s
            at -= 1
        return None


def reduce_dominated(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: ([(sizes of a container, how many such containers)], rest of the histogram)."""
    left, fixed = _Counts(histogram), []

    def fix(sizes: tuple[int, ...], times: int) -> None:
        for s in sizes:
            left.take(s, times)
        fixed.append((sizes, times))

    def times(sizes: tuple[int, ...]) -> int:
        return min(left.count[s] // sizes.count(s) for s in sizes)

    changed = True
    while changed:
        changed = False
        for size in list(reversed(left.sizes)):
            while left.count.get(size):
                room = capacity - size
                few = left.smallest(3, size)
                if room in left.count and times((size, room)):
                    fix((size, room), times((size, room)))  # an exact partner leaves nothing to improve
                elif not few or few[0] > room:
                    fix((size,), left.count[size] if few[:1] != [size] or 2 * size > capacity else 1)
                elif len(few) < 2 or few[0] + few[1] > room:
                    other = left.largest_to(room, (size,))  # only one more fits: the largest is best
                    fix((size, other), 1 if len(few) < 2 else max(1, times((size, other)) if few[0] + few[1] > room else 1))
                elif len(few) == 3 and sum(few) > room:
                    a = left.largest_to(room - few[0], (size,))
                    single = left.largest_to(room, (size,))
                    b = left.largest_to(room - a, (size, a)) if a is not None else None
                    second = left.largest_to(room // 2, (size,))
                    if a is None or b is None or a < single or (second is not None and b < second):
                        break
                    fix((size, a, b), times((size, a, b)))  # no feasible pair has a larger first or second
                else:
                    break
                changed = True
    return fixed, left.count


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(size, first rank, end rank, first container, items of that size in each)], number of containers)."""
    if any(not 0 < s <= capacity for s in histogram):
        raise ValueError("sizes must lie between 1 and the capacity")
    fixed, rest = reduce_dominated(histogram, capacity)
    used: dict[int, int] = {}
    slots: list[tuple[int, int, int, int, int]] = []

    def place(size: int, each: int, containers: int, first: int) -> None:
        at = used.get(size, 0)
        slots.append((size, at, at + each * containers, first, each))
        used[size] = at + each * containers

    total = 0
    for sizes, n in fixed:
        for s in sorted(set(sizes)):
            place(s, sizes.count(s), n, total)
        total += n
    room: list[tuple[int, int, int]] = []  # (free room, first container, containers), sorted
    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            at = bisect_left(room, (size, -1, -1))
            if at < len(room):  # the fullest containers that still take it
                free, first, many = room.pop(at)
                some = min(n, many)
                if some < many:
                    insort(room, (free, first + some, many - some))
                each = 1
                while some * (each + 1) <= n and free - size * (each + 1) >= 0 and some == many and not _between(room, size, free - size * each):
                    each += 1
                place(size, each, some, first)
                n -= some * each
                if free - size * each:
                    insort(room, (free - size * each, first, some))
            else:
                each = min(capacity // size, n)
                some = n // each
                place(size, each, some, total)
                if capacity - size * each:
                    insort(room, (capacity - size * each, total, some))
                total += some
                n -= some * each
    return slots, total


def _between(room: list[tuple[int, int, int]], low: int, high: int) -> bool:
    """Whether some container has free room from low to below high."""
    at = bisect_left(room, (low, -1, -1))
    return at < len(room) and room[at][0] < high


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(container_id, id, piece_no, size) of each item of ``sizes`` (id, size)."""
    spark = sizes.sparkSession
    n = F.col(size_col)
    items = (
        sizes.where(n > 0)
        .select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece_no"), n.alias("n"))
        .select("id", "piece_no", F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("size"))
    )
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan_containers(histogram, capacity)
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    large = [(s, -(-c // bucket_rows)) for s, c in histogram.items() if c > bucket_rows]
    if large:
        cut = F.broadcast(spark.createDataFrame(large, "size int, buckets int"))  # at most `capacity` rows
        items = items.join(cut, "size", "left")
    else:
        items = items.withColumn("buckets", F.lit(1))
    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.coalesce("buckets", F.lit(1))).cast("int")).drop("buckets")
    in_bucket = Window.partitionBy("size", "bucket").orderBy("id", "piece_no")
    offsets = bucketed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("m")).withColumn(
        "offset", F.sum("m").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    )
    ranked = bucketed.withColumn("rank", F.row_number().over(in_bucket) - 1)
    if large:
        ranked = ranked.join(offsets.select("size", "bucket", "offset"), ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))

    def look_up(batches):
        plan = shared.value
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            wide = int(plan[:, 2].max()) + 1 if len(plan) else 1
            at = np.searchsorted(plan[:, 0] * wide + plan[:, 1], size * wide + rank, side="right") - 1
            slot = plan[at]
            container = slot[:, 3] + (rank - slot[:, 1]) // slot[:, 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(container), batch.column(0), batch.column(1), batch.column(2)], names=["container_id", id_col, "piece_no", size_col]
            )

    kind = sizes.schema[id_col].dataType.simpleString()
    return ranked.select("id", "piece_no", "size", F.col("rank").cast("long")).mapInArrow(look_up, f"container_id bigint, `{id_col}` {kind}, piece_no int, `{size_col}` int")


def token_capacity(spark, root: str) -> int:
    """The token capacity in ``size_limits`` (one row)."""
    return read_table(spark, root, "size_limits").where((F.col("table_name") == "documents") & (F.col("unit") == "token")).first()["max_size"]


def pack_documents(spark, root: str, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    sizes = cut_lineage(token_counts(read_table(spark, root, "documents"), name=tokenizer))
    return pack(sizes, token_capacity(spark, root))


def container_fill(spark, root: str) -> DataFrame:
    """Items and used size of each container."""
    return pack_documents(spark, root).groupBy("container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used"))
