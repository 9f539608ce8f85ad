"""Contiguous sharding with the smallest possible largest shard.

Equal texts form one atomic group. Groups stand in the order of their text digests; the smallest
shard capacity into which the ordered groups fit is searched by bisection, each capacity checked by
filling greedily, and the shards are cut within that capacity.

How it scales: documents are reduced to narrow rows once; group sizes are sums that combine before
the shuffle, so that a group with a third of all rows is no burden. Prefix sums run inside 4,096 blocks
of the digest space and over the 4,096 block totals. The search never sees the groups themselves: it
knows, for at most a few thousand equal-width buckets, the first and the last group end, which bounds
where a greedy fill can stop; each pass looks closer at the ranges that are still undecided, until the
capacity is certain. The driver holds those bounded bucket tables and the cuts, nothing else. A row's shard follows from
comparing its digest with the cut digests, and slots are counted in lanes, so that no task numbers a
whole shard.

Null texts count as empty ones. Repeated rows are rows of the same group. An empty table gives an
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.text import whole
from barloom.session import written

BUCKETS = 4096


def group_edges(rows: DataFrame) -> DataFrame:
    """(digest, bytes, edge): the groups in digest order, with the bytes up to and including each."""
    groups = (
        rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
        # the leading twelve bits: blocks are ranges of the digest order
        .withColumn("block", F.floor(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") / 16))
    )
    totals = groups.groupBy("block").agg(F.sum("bytes").alias("block_bytes"))
    before = totals.select(
        "block", (F.sum("block_bytes").over(Window.orderBy("block")) - F.col("block_bytes")).alias("before")
    )
    inside = F.sum("bytes").over(
        Window.partitionBy("block").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    )
    # 4,096 rows at most
    return groups.withColumn("inside", inside).join(F.broadcast(before), "block").select(
        "digest", "bytes", (F.col("before") + F.col("inside")).alias("edge")
    )


class Buckets:
    """First and last edge of each non-empty bucket of the ranges looked at."""

    def __init__(self, edges: DataFrame, ranges: list[tuple[int, int]]):
        bucket, span = F.lit(None).cast("long"), F.lit(None).cast("int")
        per_range = max(1, BUCKETS // len(ranges))
        for n, (low, high) in enumerate(ranges):
            width = max(1, -(-(high - low + 1) // per_range))
            here = F.col("edge").between(low, high)
            bucket = F.when(here, F.floor((F.col("edge") - low) / width)).otherwise(bucket)
            span = F.when(here, n).otherwise(span)
        found = (
            edges.select("edge", span.alias("span"), bucket.alias("bucket")).where("span is not null")
            .groupBy("span", "bucket").agg(F.min("edge").alias("first"), F.max("edge").alias("last"))
            .select("first", "last").collect()  # at most BUCKETS rows
        )
        self.first = sorted(r["first"] for r in found)
        self.last = sorted(r["last"] for r in found)

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest edge that is at most x; equal if it is known."""
        at = bisect_right(self.first, x) - 1
        if at < 0:
            return 0, 0
        if self.last[at] <= x:
            return self.last[at], self.last[at]
        if self.first[at] == self.last[at]:
            return self.first[at], self.first[at]
        return self.first[at], x


def greedy(buckets: Buckets, capacity: int, shards: int, side: int) -> list[int]:
    """Where a greedy fill cuts, at least (side 0) or at most (side 1)."""
    cuts, start = [], 0
    for _ in range(shards):
        start = buckets.floor(start + capacity)[side]
        cuts.append(start)
    return cuts


def bisect_capacity(buckets: Buckets, low: int, high: int, total: int, shards: int, side: int) -> int:
    """The smallest capacity in [low, high] whose greedy fill takes everything; ``high`` does."""
    while low < high:
        middle = (low + high) // 2
        if greedy(buckets, middle, shards, side)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def smallest_capacity(edges: DataFrame, total: int, biggest: int, shards: int) -> int:
    even = -(-total // shards)
    low, high = max(even, biggest), max(even, even + biggest - 1)
    buckets = Buckets(edges, [(1, total)])
    while True:
        # fills are known within bounds: a capacity fits if it fits at the least, and fails if it fails at the most
        high = bisect_capacity(buckets, low, high, total, shards, side=0)
        low = bisect_capacity(buckets, low, high, total, shards, side=1)
        if low == high:
            return low
        lower, upper = greedy(buckets, low, shards, 0), greedy(buckets, high, shards, 1)
        # an edge matters between where a fill can stop at the earliest and at the latest
        buckets = Buckets(edges, merged([(max(1, a), max(1, min(total, b))) for a, b in zip(lower, upper)]))


def neighbours(edges: DataFrame, x: int) -> tuple[int, int]:
    """The largest edge up to x and the smallest from x on."""
    row = edges.agg(
        F.max(F.when(F.col("edge") <= x, F.col("edge"))).alias("below"),
        F.min(F.when(F.col("edge") >= x, F.col("edge"))).alias("above"),
    ).first()
    return row["below"] or 0, row["above"]


def cut_points(edges: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and shards - 1 cuts: each the edge nearest to an even share of what is
    left, but never beyond the capacity, nor so early that the rest would not fit any more."""
    row = edges.agg(F.max("edge").alias("total"), F.max("bytes").alias("biggest")).first()
    if row["total"] is None:
        return 0, [0] * (shards - 1)
    total, capacity = row["total"], smallest_capacity(edges, row["total"], row["biggest"], shards)
    earliest = {shards: total}  # the rest fits into the shards after s if s ends there or later
    for s in range(shards - 1, 0, -1):
        goal = earliest[s + 1] - capacity
        earliest[s] = neighbours(edges, goal)[1] if goal > 0 else 0
    cuts, start = [], 0
    for s in range(1, shards):
        even = start + (total - start) // (shards - s + 1)
        latest, goal = start + capacity, max(even, earliest[s])
        below, above = neighbours(edges, min(goal, total))
        choices = [x for x in (below, above) if x is not None and max(start, earliest[s]) <= x <= latest]
        start = min(choices, key=lambda x: (abs(x - even), x)) if choices else max(start, earliest[s])
        cuts.append(start)
    return capacity, cuts


def shard_of(edges: DataFrame, cuts: list[int]) -> Column:
    """The number of cuts at or before a row's group."""
    digests = {r["edge"]: bytes(r["digest"]) for r in edges.where(F.col("edge").isin(cuts)).select("edge", "digest").collect()}
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + ((F.col("digest") > F.lit(digests[cut])).cast("int") if cut else F.lit(1))
    return shard


def shard_documents(docs: DataFrame, shards: int = 8, lanes: int = 1024) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless
    from 0 in its shard), grown_shard (null under this law), and the capacity that was found."""
    text = whole("text")
    rows = written(docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    ), "shard-rows")
    edges = written(group_edges(rows), "shard-edges")
    capacity, cuts = cut_points(edges, shards)
    placed = rows.withColumn("shard", shard_of(edges, cuts)).withColumn(
        "lane", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(lanes)).cast("int")
    )
    counts = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("first")
    )
    number = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "digest"))
    # shards x lanes rows at most
    return placed.withColumn("number", number).join(F.broadcast(offsets), ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"),
    )
