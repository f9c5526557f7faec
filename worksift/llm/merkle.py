"""A Merkle manifest of documents, its trees stored in van Emde Boas order.

Leaves hash whole rows. Every language has a tree of arity 8 over its rows in ``doc_id`` order, and
the languages' roots have one above them. Trees are stored as blocks, aligned subtrees of up to 512
leaves; a block's nodes lie in van Emde Boas order, so where a node or its siblings lie is arithmetic
alone, and a path down a block touches few runs of bytes whatever the size of a cache line. Block
roots are the leaves of the next round, so a tree of any size takes a logarithmic number of rounds,
each over 512 times fewer rows than the one before, and no task holds more than a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import partitions
from worksift.plans.ranking import global_rank
from worksift.plans.storage import written

ARITY = 8
HEIGHT = 3  # edges from a full block's root to its leaves: 512 of them
_HEX = 64  # characters of a digest

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<place: int, others: string>>"
_BLOCK = "tree bigint, block bigint, total bigint, nodes binary, root binary, ids array<bigint>, changed array<binary>"


def nodes_in(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=16)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """The place of every node of a full tree, by depth and then from left to right: the upper half of
    the levels is stored first, then every subtree below it, each by the same rule."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    below = nodes_in(levels - top)
    first = nodes_in(top) + below * np.arange(ARITY**top)[:, None]
    return (*addresses(top), *[(first + within).reshape(-1) for within in addresses(levels - top)])


def height_of(leaves: int) -> int:
    """Edges from the root to the leaves: levels are hashed while several nodes remain."""
    height = 0
    while ARITY**height < leaves:
        height += 1
    return height


def digest(parts: bytes) -> bytes:
    """H of digests one after the other, as hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


class Block:
    """A subtree's digests in van Emde Boas order; places that a ragged last run leaves free are 0."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.leaves, self.height = leaves, height

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        nodes = np.zeros((nodes_in(height + 1), 32), np.uint8)
        level = leaves
        for depth in range(height, -1, -1):
            nodes[addresses(height + 1)[depth][: len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
            if depth:
                level = [digest(b"".join(level[k : k + ARITY])) for k in range(0, len(level), ARITY)]
        return cls(nodes.tobytes(), len(leaves), height)

    def level(self, above: int) -> str:
        """The nodes ``above`` edges over the leaves, from left to right, as hex text."""
        count = -(-self.leaves // ARITY**above)
        return self.nodes[addresses(self.height + 1)[self.height - above][:count]].tobytes().hex()

    def paths(self) -> Iterator[list[tuple[int, str]]]:
        """For each leaf the place in its run and the run's others, from the leaf's level up to the
        root's children."""
        levels = [self.level(above) for above in range(self.height)]
        runs: list[list[tuple[int, str]]] = []
        for text in levels:
            here = []
            for at in range(0, len(text), ARITY * _HEX):
                run = text[at : at + ARITY * _HEX]
                here += [(k, run[: k * _HEX] + run[(k + 1) * _HEX :]) for k in range(len(run) // _HEX)]
            runs.append(here)
        for leaf in range(self.leaves):
            yield [here[leaf // ARITY**above] for above, here in enumerate(runs)]

    def leaf(self, place: int) -> bytes:
        return self.nodes[addresses(self.height + 1)[self.height][place]].tobytes()


def folded(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and the others of its runs give."""
    for place, others in path:
        cut = place * _HEX
        leaf = hashlib.sha256((others[:cut] + leaf + others[cut:]).encode()).hexdigest()
    return leaf


def proof_digest(path: list[tuple[int, str]]) -> str:
    return hashlib.sha256("".join(others for _, others in path).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, _field(text)).cast("binary"), 256))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``lang, doc_id, leaf, changed`` per row: ``changed`` is the leaf of the row with its text's A-Z
    lower-cased where ``tampered`` holds, else null. Only the five named columns are read."""
    columns = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("n_chars").cast("bigint").alias("n_chars"), "text"
    )
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    return columns.select("lang", "doc_id", _leaf(F.col("text")).alias("leaf"), F.when(tampered, _leaf(lowered)).alias("changed"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """Runs of rows with equal first two columns, in batches sorted by these."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def _blocks(rows: DataFrame, full: int) -> DataFrame:
    """One round: rows (``tree, place, total, leaf, id, changed``, ``place`` from 0) to blocks of height
    ``full``. ``total`` counts the tree's leaves of this round; a tree of one block is as high as it needs."""
    block = F.floor(F.col("place") / ARITY**full).cast("bigint").alias("block")
    dealt = (
        rows.select("tree", block, "place", "total", "leaf", "id", "changed")
        .repartition(partitions(rows.sparkSession), "tree", "block")
        .sortWithinPartitions("tree", "block", "place")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), group in _groups(batches):
            total = group[0][3]
            made = Block.build([r[4] for r in group], min(full, height_of(total)))
            values = [tree, block, total, made.nodes.tobytes(), made.nodes[0].tobytes(), [r[5] for r in group], [r[6] for r in group]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                ["tree", "block", "total", "nodes", "root", "ids", "changed"],
            )

    return dealt.mapInArrow(run, _BLOCK)


class Rounds(NamedTuple):
    """Trees as rounds of blocks of height ``full``, the leaves' blocks first."""

    blocks: list[DataFrame]
    full: int

    def last(self, blocks: DataFrame) -> DataFrame:
        """The only blocks of their trees in a round: their roots are the trees'."""
        return blocks.where(F.col("total") <= ARITY**self.full)

    def others(self, blocks: DataFrame) -> DataFrame:
        return blocks.where(F.col("total") > ARITY**self.full)


def _rounds(rows: DataFrame, full: int, label: str) -> Rounds:
    """The blocks of all trees, round by round, until every tree has one."""
    made = Rounds([written(_blocks(rows, full), label)], full)
    while not (more := made.others(made.blocks[-1])).isEmpty():
        above = more.select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("total") / ARITY**full).cast("bigint").alias("total"),
            F.col("root").alias("leaf"), F.col("block").alias("id"), F.lit(None).cast("binary").alias("changed"),
        )
        made.blocks.append(written(_blocks(above, full), label))
    return made


def _roots(rounds: Rounds) -> DataFrame:
    parts = [rounds.last(blocks).select("tree", "root") for blocks in rounds.blocks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _below(rounds: Rounds, above: DataFrame) -> DataFrame:
    """The blocks of the first round with the path over their roots and the roots that it ends in.
    ``above``: ``tree, path, subroot, top`` of whole trees."""
    upper = None
    for k, blocks in reversed([*enumerate(rounds.blocks)]):
        known = rounds.last(blocks).join(above, "tree")
        if upper is not None:
            known = known.unionByName(rounds.others(blocks).join(upper, ["tree", "block"]))
        if k == 0:
            return known
        upper = written(_paths(known, rounds.full), "paths")


def _paths(known: DataFrame, full: int) -> DataFrame:
    """``tree, block, path, subroot, top`` of the leaves of blocks, which are blocks of the round before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            above = [(p["place"], p["others"]) for p in row["path"]]
            block = Block(row["nodes"], len(row["ids"]), min(full, height_of(row["total"])))
            paths = [[{"place": p, "others": o} for p, o in [*path, *above]] for path in block.paths()]
            n = len(paths)
            kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * n, pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(paths, kind),
                 pa.array([row["subroot"]] * n, pa.binary()), pa.array([row["top"]] * n, pa.binary())],
                ["tree", "block", "path", "subroot", "top"],
            )

    return known.select("tree", "total", "nodes", "ids", "path", "subroot", "top").mapInArrow(
        run, f"tree bigint, block bigint, path {_PATH}, subroot binary, top binary"
    )


class Manifest(NamedTuple):
    """The stored trees: ``rounds`` of blocks of the languages' trees, ``above`` each language's place in
    the tree over them (``tree, path, subroot, top``), ``langs`` their numbers (``lang, tree, n``)."""

    rounds: Rounds
    above: DataFrame
    langs: DataFrame


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Builds and stores the trees of ``docs``. Rows of a language are ordered by ``doc_id`` (null
    first), rows that share it by their leaf; rows that are equal in whole are leaves each. A null
    language is one of its own, before the others. Null values and empty texts have leaves of their
    own kind (``-`` and ``0:``). An empty table has no trees. Rows are never gathered by language:
    one range shuffle of digests ranks them, however many rows a language or an id has.
    """
    no_change = F.lit(False) if tampered is None else tampered
    # Written before they are sorted, as sampling a range reads its input once more. Equal leaves are
    # exchangeable; the last key only deals many of them over several ranges.
    rows = written(leaves(docs, no_change).withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "leaf-rows")
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "leaf", "spread")]
    ranked = written(global_rank(rows, order, "rank").drop("spread"), "leaves")
    langs = ranked.groupBy("lang").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    langs = written(global_rank(langs, [F.col("first")], "tree"), "langs")
    same = F.col("r.lang").eqNullSafe(F.col("l.lang"))
    placed = ranked.alias("r").join(langs.alias("l"), same).select(
        "tree", (F.col("rank") - F.col("first")).alias("place"), F.col("n").alias("total"), "leaf", F.col("doc_id").alias("id"), "changed"
    )
    rounds = _rounds(placed, height, "blocks")
    roots = written(_roots(rounds), "subroots")
    count = roots.agg(F.count("*").alias("total"))  # a single row
    over = _rounds(
        roots.crossJoin(F.broadcast(count)).select(
            F.lit(0).cast("bigint").alias("tree"), (F.col("tree") - 1).alias("place"), "total", F.col("root").alias("leaf"),
            F.col("tree").alias("id"), F.lit(None).cast("binary").alias("changed"),
        ),
        height,
        "top-blocks",
    )
    top = _roots(over).select(F.lit(0).cast("bigint").alias("tree"), F.array().cast(_PATH).alias("path"), F.col("root").alias("subroot"), F.col("root").alias("top"))
    paths = _paths(_below(over, top), height).drop("tree", "subroot").withColumnRenamed("block", "tree")
    above = written(paths.join(roots.withColumnRenamed("root", "subroot"), "tree"), "above")
    return Manifest(rounds, above, langs)


def verified(made: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row: the siblings are
    fetched from the stored blocks, and the root is folded from the changed leaf, or else the original,
    and these. An empty run of siblings adds nothing to the proof."""
    known, full = _below(made.rounds, made.above), made.rounds.full
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            above = [(p["place"], p["others"]) for p in row["path"]]
            n, top = len(row["ids"]), row["top"].hex()
            block = Block(row["nodes"], n, min(full, height_of(row["total"])))
            out = []
            for place, (path, changed) in enumerate(zip(block.paths(), row["changed"], strict=True)):
                path += above
                leaf = block.leaf(place)
                out.append((leaf.hex(), proof_digest(path), folded((changed or leaf).hex(), path)))
            leaf, proof, fold = ([r[k] for r in out] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(leaf), pa.array([row["subroot"].hex()] * n), pa.array([top] * n),
                 pa.array(proof), pa.array(fold), pa.array([x == top for x in fold])],
                names,
            )

    return known.select("total", "nodes", "ids", "changed", "path", "subroot", "top").mapInArrow(
        run, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def third(column: str = "doc_id") -> Column:
    """Holds for ids whose decimal text has a crc32 that 3 divides; never for null."""
    return F.coalesce(F.crc32(F.col(column).cast("bigint").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Every row's proof against the manifest of ``docs``, with the texts of a third of the ids tampered
    with after it was made."""
    return verified(manifest(docs, third(), height))
