"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has SLOTS slots; each shard owns VNODES virtual nodes at hashed slots. A row
belongs to the first virtual node at or after its slot. A shard takes no more than its
capacity: what is over goes on clockwise to the next virtual node whose shard has
room, round by round, so that nearer rows come first. Which rows of a slot go where
follows from counts only, so the walk runs over the SLOTS counts (a fixed number) and
yields ranges of ranks per slot; the rows take their shard from these by a join.

With no slack the capacities are the exact quotas, and counts are at most one apart.
With slack e no shard holds more than ceil((1 + e) * rows / shards), and fewer rows move
when a shard is added.

Nulls and empty texts have no bytes; rows without a doc_id are placed by their text.
Ties of equal rows are broken at will (the rows are equal). An empty table gives an
empty result. `placed` carries all columns; `shards` reads the two it names.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents

SLOTS = 1 << 14
VNODES = 64


def virtual_nodes(shards: int) -> list[tuple[int, int]]:
    """(slot, shard) in ring order. A shard's nodes do not depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 5) % SLOTS, s) for s in range(shards) for v in range(VNODES))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, first place in the shard) for all rows of all slots."""
    nodes, room = virtual_nodes(shards), list(room)
    at = [slot for slot, _ in nodes]
    loads = [0] * shards
    waiting = [(bisect_left(at, slot) % len(nodes), slot, 0, n) for slot, n in sorted(counts.items()) if n]
    out = []
    while waiting:
        over = []
        for node, slot, lo, hi in sorted(waiting):
            shard = nodes[node][1]
            take = min(room[shard], hi - lo)
            if take:
                out.append((slot, lo, lo + take, shard, loads[shard]))
                room[shard] -= take
                loads[shard] += take
            if lo + take < hi:
                over.append((node, slot, lo + take, hi))
        waiting = []
        for node, slot, lo, hi in over:
            step = next(k for k in range(1, len(nodes) + 1) if room[nodes[(node + k) % len(nodes)][1]])
            waiting.append(((node + step) % len(nodes), slot, lo, hi))
    return out


def _point(doc_id, text):
    return F.xxhash64(doc_id, F.xxhash64(text), F.lit(23))


def placed(docs: DataFrame, shards: int = 40, slack: float = 0.0) -> DataFrame:
    """All columns of `docs` with `shard` and `slot`, its place in the shard, gapless from 0.

    The rows are dealt by ring slot once, for their rank in the slot; no shard and no
    group of equal texts meets in one task.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    point = _point(docs["doc_id"], docs["text"])
    slot = F.pmod(point, F.lit(SLOTS))
    counts = {r["__slot"]: r["n"] for r in docs.select(slot.alias("__slot")).groupBy("__slot").agg(F.count("*").alias("n")).collect()}
    ranges = walk(counts, shards, capacities(sum(counts.values()), shards, slack))
    table = spark.createDataFrame(ranges, "__slot long, __lo long, __hi long, shard int, __first long")
    order = Window.partitionBy("__slot").orderBy("__point", "doc_id")
    rows = docs.select(*own).withColumns({"__point": point, "__slot": slot}).withColumn("__rank", F.row_number().over(order) - 1)
    found = rows.join(table, "__slot").where("__rank >= __lo AND __rank < __hi")
    return found.select(*[F.col(f"`{c}`") for c in own], "shard", (F.col("__first") + F.col("__rank") - F.col("__lo")).alias("slot"))


def shards(docs: DataFrame, n: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = documents(docs, "doc_id", "text")
    # the two hashes stand for the text from here on
    narrow = named.select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = placed(narrow.withColumnRenamed("h", "text"), n)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
