"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.plans.ranking import global_rank
from worksift.plans.storage import written

RING = 1 << 48


@dataclass(frozen=True)
class Piece:
    """Rows ``first`` to ``last`` (exclusive) of the ring's order, their shard and first slot."""

    arc: int
    first: int
    last: int
    shard: int
    slot: int


def virtual_nodes(shards: int, copies: int) -> list[tuple[int, int]]:
    """Sorted (point, shard) of every virtual node; the points of a shard do not depend on how many
    shards there are."""
    return sorted((int(md5(f"shard-{s}-{c}".encode()).hexdigest()[:12], 16), s) for s in range(shards) for c in range(copies))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: the even share, or ``1 + slack`` times it. Without slack the first
    ``rows % shards`` shards take one row more, so that all rows have a place."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allocate(counts: list[int], owners: list[int], limits: list[int]) -> list[Piece]:
    """Walks the arcs clockwise: an arc's rows go to its virtual node's shard, and those that find
    it full continue to the next node whose shard has room. ``counts`` is per arc, so this is the
    plan for any number of rows; it has fewer than arcs + shards pieces, as a piece ends with an
    arc or with a shard's room."""
    used = [0] * len(limits)
    pieces, at = [], 0
    for arc, count in enumerate(counts):
        step = arc
        while count:
            shard = owners[step % len(owners)]
            take = min(count, limits[shard] - used[shard])
            if take:
                pieces.append(Piece(arc, at, at + take, shard, used[shard]))
                used[shard] += take
                at += take
                count -= take
            step += 1
    return pieces


def shard(docs: DataFrame, shards: int = 8, copies: int = 64, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard`` of every row.

    A row's place on the ring is a hash of its ``doc_id``; its home is the next virtual node
    clockwise. A full shard passes rows on, in ring order, so every shard holds its capacity at
    most; without slack the counts differ by one at most (law ``rows``). Rows are numbered around
    the ring by one range shuffle of ids; equal ids are next to each other and still count one by
    one, null ids have one place, and repeated rows each have a slot of their own. Only the
    ``shards * copies`` arc counts reach the driver. ``size`` is the text's UTF-8 bytes plus 1 (null:
    1), ``text_crc32`` its unsigned crc32 (null: that of nothing). An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("bigint")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.alias("place"),
        F.monotonically_increasing_id().alias("read_at"),
    )
    # The order read breaks ties, so rows that agree in everything still spread over tasks.
    rows = written(rows, "ring-rows")
    order = [F.col(c).asc_nulls_first() for c in ("place", "doc_id", "text_crc32", "size", "read_at")]
    ranked = global_rank(rows, order, "rank")
    nodes = virtual_nodes(shards, copies)
    owners = [s for _, s in nodes]
    ranked = ranked.withColumn("arc", _arc(F.col("place"), [p for p, _ in nodes]))
    counted = {r["arc"]: r["n"] for r in ranked.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    # Places after the last point belong to the first node, around the end of the ring.
    owners.append(owners[0])
    counts = [counted.get(a, 0) for a in range(len(owners))]
    pieces = allocate(counts, owners, capacities(sum(counts), shards, slack))
    kinds = "in_arc int, first bigint, last bigint, shard int, slot_first bigint"
    plan = spark.createDataFrame([(p.arc, p.first, p.last, p.shard, p.slot) for p in pieces], kinds)
    home = F.element_at(F.array(*[F.lit(s) for s in owners]), F.col("arc") + 1)
    inside = (F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("last"))
    # At most arcs + shards + 1 rows, so the side is bounded by the parameters.
    return ranked.join(F.broadcast(plan), (F.col("arc") == F.col("in_arc")) & inside).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot_first") + F.col("rank") - 1 - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        home.alias("home_shard"),
    )


def _arc(place: Column, points: list[int], cells: int = 4096) -> Column:
    """How many points lie before a place. The ring is cut into equal cells; for a cell without a
    point the number is looked up, and only places in the other cells are compared with points."""
    width = RING // cells
    cell = F.floor(place / width).cast("int")
    table = F.array(*[F.lit(bisect_left(points, c * width)) for c in range(cells)])
    split = sorted({p // width for p in points})
    exact = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < place))
    return F.when(cell.isin(*split), exact).otherwise(F.element_at(table, cell + 1))
