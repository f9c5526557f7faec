"""N-gram Jaccard join by size-banded tiles with bitmap signatures.

Sets are banded by size. Within a band sets differ in few shingles, so the hash space is cut into one
part more than two near sets can differ in: they agree in one part as a whole, and rows meet in
tiles named by band, part and the part's hash. In a tile parity bitmaps come first: every
bit that differs is at least one shingle of one set only, which bounds the overlap from above. What
the bound leaves is settled by intersecting the sorted sets. Nothing here is probabilistic but the
64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import mix, partitions, slices, whole_text
from worksift.llm.components import components
from worksift.llm.forest import shingle_sets
from worksift.plans.storage import written

SHINGLE = 3
LEVEL = (90, 100)  # links have 100 * intersection >= 90 * union
STEP = 3  # a band spans sizes that grow by 10/9 so many times
TILE = 512  # rows of a tile compared with as many others by bitmaps
LINK_ROWS, LINK_BYTES = 2048, 1 << 24  # the same for rows with their whole sets


def largest_partner(size: int) -> int:
    """The largest set that a set of ``size`` can be near to: it holds the smaller one's shingles."""
    return LEVEL[1] * size // LEVEL[0]


@lru_cache(maxsize=1)
def bands() -> list[tuple[int, int]]:
    """First size of each band, and the parts that its sets are cut into.

    Partners of a band's sets are in it or at the beginning of the next. Two near sets of ``s`` and
    ``t`` shingles differ in at most (s + t) * (u - i) / (u + i) with i/u the level."""
    out, first = [], 1
    while first < 1 << 31:
        after = first
        for _ in range(STEP):
            after = largest_partner(after) + 1
        most = after - 1
        differ = (most + largest_partner(most)) * (LEVEL[1] - LEVEL[0]) // (LEVEL[1] + LEVEL[0])
        out.append((first, differ + 1))
        first = after
    return out


@lru_cache(maxsize=1)
def _firsts() -> np.ndarray:
    return np.array([first for first, _ in bands()], np.int64)


def schemes(size: int) -> list[tuple[int, bool]]:
    """The bands that a set of ``size`` meets others in, and whether it is one of the band's own."""
    own = int(np.searchsorted(_firsts(), size, "right")) - 1
    first = bands()[own][0]
    return [(own, True), *([(own - 1, False)] if own and largest_partner(first - 1) >= size else [])]


@lru_cache(maxsize=1024)
def _cuts(parts: int) -> np.ndarray:
    """Where the parts of the hash space begin; the first begins at 0."""
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def part_keys(shingles: np.ndarray, band: int) -> np.ndarray:
    """One key per part of a sorted set: equal where band, part and the part's shingles are equal."""
    parts = bands()[band][1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles), dtype=np.uint64)])
    ends = np.concatenate([[0], np.searchsorted(shingles, _cuts(parts)), [len(shingles)]])
    of = mix(np.uint64(band << 32) + np.arange(parts, dtype=np.uint64))
    return mix(of ^ (sums[ends[1:]] - sums[ends[:-1]])).astype(np.int64)


def bits_of(band: int) -> int:
    """Bits of the signatures compared in a band: two to four per shingle."""
    return max(64, 1 << (2 * bands()[band][0]).bit_length())


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """A bit is set where an odd number of shingles fall on it."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def narrowed(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of the same set with fewer bits."""
    while len(words) * 64 > bits:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


_SKETCH = "doc_id bigint, n_shingles bigint, hash_a bigint, hash_b bigint, bitmap binary, keys array<struct<key: bigint, band: int, own: boolean>>"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row the size, two hashes, bitmap and part keys of its set; empty sets have neither."""
    kind = pa.struct([("key", pa.int64()), ("band", pa.int32()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"), SHINGLE)
            hashes, bitmaps, keys, ends = ([], []), [], [], [0]
            for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True):
                own = sets[end - n : end]
                if not n:
                    for c in (*hashes, bitmaps):
                        c.append(None)
                    ends.append(ends[-1])
                    continue
                hashes[0].append(int(mix(np.bitwise_xor.reduce(mix(own), keepdims=True) + np.uint64(n)).astype(np.int64)[0]))
                hashes[1].append(int(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True).astype(np.int64)[0]))
                met = schemes(n)
                bitmaps.append(bitmap(own, bits_of(met[0][0])).tobytes())
                for band, is_own in met:
                    made = part_keys(own, band)
                    keys.append((made, np.full(len(made), band, np.int32), np.full(len(made), is_own)))
                ends.append(ends[-1] + sum(len(k[0]) for k in keys[len(keys) - len(met) :]))
            flat = [np.concatenate([k[j] for k in keys]) if keys else np.zeros(0, t) for j, t in enumerate((np.int64, np.int32, bool))]
            inner = pa.StructArray.from_arrays([pa.array(c) for c in flat], fields=[*kind])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(hashes[0], pa.int64()), pa.array(hashes[1], pa.int64()),
                 pa.array(bitmaps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)],
                ["doc_id", "n_shingles", "hash_a", "hash_b", "bitmap", "keys"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text()).mapInArrow(run, _SKETCH)


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the sets in ``nodes`` (``node, hash_a, hash_b, doc_id`` of a member)."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text())
    # Null ids are members like any other, but are never the only one that an equal id could mix up.
    wanted = text.where("doc_id is not null").join(nodes.where("doc_id is not null"), "doc_id").select("node", "hash_a", "hash_b", "text")
    unnamed = nodes.where("doc_id is null").select("node", "hash_a", "hash_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"), SHINGLE)
            out = []
            for n, end, a, b in zip(counts.tolist(), np.cumsum(counts).tolist(), *(batch.column(c).to_pylist() for c in ("hash_a", "hash_b")), strict=True):
                own = sets[end - n : end]
                same = n and b == int(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True).astype(np.int64)[0])
                out.append(own.tobytes() if same else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "shingles"])

    found = wanted.mapInArrow(run, "node bigint, shingles binary").where("shingles is not null")
    if unnamed.isEmpty():
        return found.dropDuplicates(["node"])

    def all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"), SHINGLE)
            own = [sets[e - n : e] for n, e in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True) if n]
            b = [int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True).astype(np.int64)[0]) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["hash_b", "shingles"])

    more = text.where("doc_id is null").mapInArrow(all_sets, "hash_b bigint, shingles binary").join(unnamed, "hash_b")
    return found.unionByName(more.select("node", "shingles")).dropDuplicates(["node"])


def near_sets(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: the intersection of two sorted sets against the level."""
    if LEVEL[1] * min(len(a), len(b)) < LEVEL[0] * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEVEL[1] * common >= LEVEL[0] * (len(a) + len(b) - common)


def members(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tile, node, band, own``: sets that agree with another in a part of a band, and each tile's
    ``hub``, its own set that agrees with others most often. Tiles with the same sets are the same
    tile, so copies that agree in all parts but one meet once."""
    cells = nodes.select("node", F.explode("keys").alias("k")).select(F.col("k.key").alias("tile"), "node", "k.band", "k.own")
    company = cells.groupBy("tile").agg(F.count("*").alias("n"), F.max("own").alias("some_own")).where("n > 1 and some_own").select("tile")
    met = written(cells.join(written(company, "company"), "tile", "left_semi"), "met")
    often = written(met.where("own").groupBy("node").agg(F.count("*").alias("often")), "often")
    prints = met.groupBy("tile").agg(
        F.count("*").alias("n"), F.min("band").alias("band"),
        F.bit_xor(F.xxhash64("node", "own")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "own", "node")).alias("y"),
    )
    kept = written(prints.groupBy("band", "n", "x", "y").agg(F.min("tile").alias("tile")).select("tile"), "tiles")
    rows = written(met.join(kept, "tile", "left_semi"), "members")
    first = F.max_by("node", F.struct("often", -F.col("node")))
    return rows, written(rows.where("own").join(often, "node").groupBy("tile").agg(first.alias("hub")), "hubs")


def hub_pairs(met: DataFrame, hubs: DataFrame) -> DataFrame:
    """``a, b``: each set with two hubs of its tiles, the one it meets most often and the smallest. They
    connect most copies by few comparisons."""
    often = met.join(hubs, "tile").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    two = often.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("x"), F.min("hub").alias("y"))
    return two.select(F.col("node").alias("a"), F.explode(F.array("x", "y")).alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) whose whole sets (``node, shingles``) are near. A set comes once, ahead of the
    partners that it is paired with as ``a``."""
    partners = pairs.join(sets.withColumnRenamed("node", "b"), "b").select("a", "b", "shingles")
    own = pairs.select("a").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("bigint").alias("b"), "shingles")
    grouped = own.unionByName(partners).repartition(partitions(pairs.sparkSession), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if b is None:
                    mine = other
                elif near_sets(mine, other):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return grouped.mapInArrow(run, "a bigint, b bigint")


def dealt(rows: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """``rows`` (``tile, node, component, ...``) dealt into pairs of blocks of a tile, so that every two
    rows of a tile that differ in ``component`` meet once or twice. Rows of the tile's largest
    component only stand on the right, so a tile that is nearly connected is one pass over its rows.
    Tiles are counted first and blocks follow from the counts; no task holds more than two blocks."""
    size = F.sum(F.length(weight)) if weight else F.lit(0)
    blocks = lambda n, bytes_: F.greatest(F.ceil(n / most), F.ceil(bytes_ / LINK_BYTES), F.lit(1)).cast("int")
    of = rows.groupBy("tile", "component").agg(F.count("*").alias("n"), size.cast("bigint").alias("size"))
    tiles = of.groupBy("tile").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"), F.max_by("size", F.struct("n", "component")).alias("major_size"),
        F.sum("n").alias("n"), F.max("n").alias("in_major"), F.sum("size").alias("size"), F.count("*").alias("kinds"),
    )
    mixed = written(
        tiles.where("kinds > 1").select(
            "tile", "major", blocks(F.col("n") - F.col("in_major"), F.col("size") - F.col("major_size")).alias("lefts"),
            blocks(F.col("n"), F.col("size")).alias("rights"),
        ),
        "mixed",
    )
    # The join's sides are plain shuffles, so that a hot tile's rows may be split over tasks.
    known = rows.join(mixed, "tile").withColumn("minor", F.col("component") != F.col("major"))
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), block("rights").alias("j"), F.lit(False).alias("left")))
    left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(block("lefts").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    cells = F.when(F.col("minor"), F.concat(right, left)).otherwise(right)
    placed = known.withColumn("cell", F.explode(cells)).select("*", "cell.i", "cell.j", "cell.left").drop("cell", "lefts", "rights", "major")
    return placed.repartition(partitions(rows.sparkSession), "tile", "i", "j").sortWithinPartitions("tile", "i", "j")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    key, sides = None, ([], [])
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["tile"], row["i"], row["j"])
            if here != key:
                if all(sides):
                    yield sides
                key, sides = here, ([], [])
            sides[not row["left"]].append(row)
    if all(sides):
        yield sides


def bounded(left: list[dict], right: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left row the right rows of other components that sizes and bitmaps leave, and the most
    shingles they can share: sets of s and t shingles whose bitmaps differ in d bits share (s + t - d) / 2
    at most. Of two rows that both stand on the left the first by node looks at the other; rows that
    are not a band's own meet in their own."""
    bits = bits_of(left[0]["band"])
    of = lambda rows: np.stack([narrowed(np.frombuffer(r["bitmap"], np.uint64), bits) for r in rows])
    column = lambda rows, c: np.array([r[c] for r in rows])
    a, b = of(left), of(right)
    sizes, nodes, component, minor, own = (column(right, c) for c in ("n_shingles", "node", "component", "minor", "own"))
    step = max(1, (1 << 18) // (len(b) * b.shape[1]))
    for at in range(0, len(a), step):
        differ = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
        for k, d in enumerate(differ, at):
            row = left[k]
            total = sizes + row["n_shingles"]
            most = (total - d) // 2
            near = (LEVEL[1] * most >= LEVEL[0] * (total - most)) & (component != row["component"]) & (own | row["own"])
            near &= ~minor | (nodes > row["node"])
            if near.any():
                found = np.flatnonzero(near)
                yield k, found, most[found] / (total[found] - most[found])


def mixed_rows(met: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of tiles whose sets are of several components of ``found`` (``node, component``), with
    size, bitmap and component."""
    columns = nodes.select("node", "n_shingles", "bitmap")
    tagged = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = tagged.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = written(ends.where("x <> y").select("tile"), "mixed-tiles")
    return written(tagged.join(mixed, "tile", "left_semi").join(columns, "node"), "mixed-rows")


def best_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: each set of a mixed tile with the one of another component that it can share most with."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(batches):
            out = {(left[k]["node"], right[near[np.argmax(share)]]["node"]) for k, near, share in bounded(left, right)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in sorted(out)], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt(rows, TILE).mapInArrow(best, "a bigint, b bigint").distinct()


def remaining(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: links between sets of different components of mixed tiles (``mixed_rows``), as many
    as connect what the exact join connects. All pairs of a tile are compared by bitmaps, pairs of
    sets are intersected where they meet, and only links that connect leave a task."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(batches):
            marked = set()
            for k, near, _ in bounded(left, right):
                marked.add(left[k]["node"])
                marked.update(right[j]["node"] for j in near.tolist())
            if marked:
                tile = pa.array([left[0]["tile"]] * len(marked), pa.int64())
                yield pa.RecordBatch.from_arrays([tile, pa.array(sorted(marked), pa.int64())], ["tile", "node"])

    flagged = written(dealt(rows, TILE).mapInArrow(flag, "tile bigint, node bigint").distinct(), "close")
    whole = written(rows.join(flagged, ["tile", "node"]).join(sets, "node"), "close-rows")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(batches):
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            out = []
            others = [np.frombuffer(r["shingles"], np.uint64) for r in right]
            for k, near, share in bounded(left, right):
                mine = np.frombuffer(left[k]["shingles"], np.uint64)
                for j in near[np.argsort(-share, kind="stable")].tolist():
                    x, y = root(left[k]["component"]), root(right[j]["component"])
                    if x != y and near_sets(mine, others[j]):
                        parent[x] = y
                        out.append((left[k]["node"], right[j]["node"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt(whole, LINK_ROWS, "shingles").mapInArrow(link, "a bigint, b bigint")


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (``doc_id, text``).

    Equal sets are one node; near nodes are linked, exactly; ``component_id`` is the smallest ``doc_id``
    reached (nulls do not count; null where only null ids are reached). Null and empty texts, and
    texts without words, have empty sets and link with nothing. Rows may repeat, ids may be shared by
    several texts, texts may be of any length; an empty table gives an empty one.
    """
    sketch = written(sketches(docs), "sketches")
    named = sketch.where("hash_a is not null")
    one = named.groupBy("hash_a", "hash_b").agg(
        F.min("doc_id").alias("head"), F.min("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"), F.first("keys").alias("keys")
    )
    nodes = written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    met, hubs = members(nodes)
    some = met.select("node").distinct()
    places = nodes.select("node", "hash_a", "hash_b", F.col("head").alias("doc_id"))
    sets = written(sets_of(docs, places.join(some, "node", "left_semi")), "sets")
    # Links in three rounds: to hubs, to the likeliest set of another component, and all that is left.
    first = written(hub_pairs(met, hubs), "pairs")
    links = written(confirmed(first, sets), "links")
    joined = written(components(links), "linked")
    second = written(best_pairs(mixed_rows(met, nodes, joined)).join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(confirmed(second, sets), "links"))
    joined = written(components(links), "linked")
    more = written(remaining(mixed_rows(met, nodes, joined), sets), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    of_node = nodes.join(joined, "node", "left").select("hash_a", "hash_b", "head", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("head").alias("component_id"))
    ids = written(of_node.join(smallest, "component").select("hash_a", "hash_b", "component_id"), "component-ids")
    return sketch.select("doc_id", "n_shingles", "hash_a", "hash_b").join(ids, ["hash_a", "hash_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("hash_a").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
