"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every tree keeps the documents sorted by its own order of signature symbols. A document's candidates
are the neighbours it shares a prefix with; where a region of the tree is crowded, more symbols of
the order decide who is looked at first, so most copies are connected by a bounded number of pairs
each. What is not connected by then is compared with all of its region. Candidates are confirmed on
whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import data, mix, packed, partitions, slices, unpacked, whole_text, words
from worksift.llm.components import components
from worksift.plans.storage import written

SHINGLE = 5
DEPTH = 3  # symbols every tree's region starts with: a pair at 0.85 shares them with 0.61
SYMBOLS = 256  # one byte each, compared to estimate the similarity
NEAR, HUBS = 8, 4  # most similar neighbours, and most connected ones, proposed first per document and tree
REGION = 1024  # neighbours in the order that a document is first compared with
BLOCK = 512  # rows of a region compared at once with as many others when what is left is looked at
LINK_ROWS, LINK_BYTES = 2048, 1 << 24  # the same for rows with their whole sets


class Level(NamedTuple):
    """What counts as near: a link has ``share[1] * intersection >= share[0] * union``; pairs are
    looked at whose symbols estimate ``estimate`` at least and which share a region in one of
    ``trees`` trees."""

    share: tuple[int, int]
    estimate: float
    trees: int

    @property
    def least(self) -> int:
        return int(self.estimate * SYMBOLS)


# 0.85 less 4.9 standard errors of 256 symbols: a pair at 0.85 is missed with 1.1e-6, and by all trees
# with 1.09e-5, so with 1.2e-5 together.
AT_85 = Level((85, 100), 0.74, 12)
# 0.80 less 4.8 standard errors: missed with 1.7e-6. A pair at 0.80 shares a region with 0.51, so 16
# trees miss 1.0e-5 of such pairs.
AT_80 = Level((80, 100), 0.68, 16)
TREES = 16  # at most

_ODD = mix(np.arange(1, 1 + SYMBOLS + TREES * DEPTH, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_FLIP = mix(np.arange(100_001, 100_001 + SYMBOLS + TREES * DEPTH, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, one after the other, and their number.

    A text of fewer than ``k`` words has one shingle, its whole word sequence; without words none.
    """
    raw, starts = data(texts)
    hashed, per, _ = words(raw, starts)
    ends = np.cumsum(per)
    parts, counts = [], np.zeros(len(per), np.int64)
    full = hashed[: max(len(hashed) - k + 1, 0)].copy()
    for j in range(1, k):
        full = mix(full + np.uint64(j)) + hashed[j : j + len(full)]
    full = mix(full)
    for row, (n, end) in enumerate(zip(per.tolist(), ends.tolist(), strict=True)):
        if n >= k:
            own = np.unique(full[end - n : end - k + 1])
        elif n:
            seed = np.uint64(n)
            for h in hashed[end - n : end]:
                seed = mix(np.array([seed ^ h]))[0]
            own = np.array([seed], np.uint64)
        else:
            continue
        counts[row] = len(own)
        parts.append(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def signatures(sets: np.ndarray, counts: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte symbols (rows of ``SYMBOLS``) and tree prefixes (rows of ``trees``) of non-empty sets."""
    starts = np.cumsum(counts) - counts
    low = (sets >> np.uint64(16)).astype(np.uint32)
    least = np.empty((SYMBOLS + trees * DEPTH, len(counts)), np.uint32)
    for j in range(len(least)):
        least[j] = np.minimum.reduceat((low ^ _FLIP[j]) * _ODD[j], starts)
    symbols = ((least[:SYMBOLS] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).T
    deep = least[SYMBOLS:].astype(np.uint64).reshape(trees, DEPTH, -1)
    prefix = np.repeat(np.arange(trees, dtype=np.uint64)[:, None], len(counts), axis=1)
    for d in range(DEPTH):
        prefix = mix(prefix * np.uint64(31) + deep[:, d])
    return np.ascontiguousarray(symbols), prefix.T.astype(np.int64)


def _class_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, trees: int) -> DataFrame:
    """``doc_id, n_shingles, class, prefixes, symbols`` per row; equal sets have equal classes, and
    an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"))
            some = np.flatnonzero(counts)
            ends = np.cumsum(counts)
            classes, prefixes, symbols = ([None] * len(counts) for _ in range(3))
            if len(some):
                bytes_of, tree_of = signatures(sets, counts[some], trees)
                for at, row in enumerate(some.tolist()):
                    classes[row] = _class_of(sets[ends[row] - counts[row] : ends[row]])
                    prefixes[row] = tree_of[at].tolist()
                    symbols[row] = bytes_of[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array(classes, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(symbols, pa.binary()),
                ],
                ["doc_id", "n_shingles", "class", "prefixes", "symbols"],
            )

    kinds = "doc_id bigint, n_shingles bigint, class binary, prefixes array<bigint>, symbols binary"
    return docs.select("doc_id", whole_text()).mapInArrow(run, kinds)


def _near(symbols: np.ndarray, fresh: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Proposals among rows that are neighbours in a tree: (row, partner, symbols agreed). Rows
    before ``fresh`` were compared with each other already."""
    agreed = np.zeros((len(symbols), len(symbols)), np.int16)
    for at in range(0, len(symbols), 32):
        same = symbols[at : at + 32, None, :] == symbols[None, :, :]
        agreed[at : at + 32] = same.sum(axis=2, dtype=np.int16)
    np.fill_diagonal(agreed, 0)
    close = agreed >= least
    degree = close.sum(axis=1)
    # The most similar partners, and the ones most others are close to: a text that all its copies
    # stem from is nearest to few of them, but close to all.
    for score, most in ((agreed, NEAR), (np.where(close, degree[None, :], 0), HUBS)):
        score = np.where(close, score, 0)
        take = min(most, len(symbols) - 1)
        best = np.argpartition(-score, take - 1, axis=1)[:, :take]
        rows = np.repeat(np.arange(len(symbols)), take)
        partners = best.reshape(-1)
        good = (score[rows, partners] > 0) & ((rows >= fresh) | (partners >= fresh))
        yield rows[good], partners[good], agreed[rows[good], partners[good]]


def candidates(classes: DataFrame, level: Level) -> DataFrame:
    """``a, b, agreed, hub``: pairs of classes (``class, prefixes, symbols``, one row each) that are
    neighbours in some tree, each once. ``a`` proposed ``b``; a class proposes at most
    ``(NEAR + HUBS)`` partners per tree. These are the pairs to begin with: ``remaining`` looks at
    all others.

    Regions without company are dropped while they are 8-byte keys. The others are range-partitioned
    by region and order, so a large region is cut where its order says, and scanned in
    overlapping runs: every document meets the ``REGION / 2`` to ``REGION`` neighbours around it.
    """
    tree = classes.select("class", F.posexplode("prefixes").alias("tree", "region"))
    shared = tree.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    tree = tree.join(shared, "region", "left_semi")
    rows = tree.join(classes.select("class", "symbols"), "class").select(
        "region",
        F.expr(f"substring(concat(symbols, symbols), tree * {SYMBOLS // level.trees} + 1, 32)").alias("order"),
        "class",
        "symbols",
    )
    rows = written(rows, "forest")
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "region", "order").sortWithinPartitions("region", "order")

    def propose(symbols: list[bytes], names: list[bytes], fresh: int) -> pa.RecordBatch | None:
        matrix = np.frombuffer(b"".join(symbols), np.uint8).reshape(len(symbols), SYMBOLS)
        found = list(_near(matrix, fresh, level.least))
        name = np.array([*names, b""], object)[:-1]
        a = np.concatenate([name[rows] for rows, _, _ in found])
        b = np.concatenate([name[partners] for _, partners, _ in found])
        agreed = np.concatenate([n for _, _, n in found])
        hub = np.repeat([False, True], [len(n) for _, _, n in found])
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(agreed, pa.int32()), pa.array(hub)],
            ["a", "b", "agreed", "hub"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, symbols, names, fresh = None, [], [], 0
        for batch in batches:
            for here, _, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != region or len(names) == REGION:
                    if len(names) > max(1, fresh) and (out := propose(symbols, names, fresh)):
                        yield out
                    if here != region:
                        symbols, names, fresh = [], [], 0
                    else:
                        symbols, names, fresh = symbols[REGION // 2 :], names[REGION // 2 :], REGION // 2
                region = here
                symbols.append(value)
                names.append(name)
        if len(names) > max(1, fresh) and (out := propose(symbols, names, fresh)):
            yield out

    found = ranged.mapInArrow(run, "a binary, b binary, agreed int, hub boolean")
    by_first = F.col("a") < F.col("b")
    once = found.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.max(by_first).alias("forward"), F.max("agreed").alias("agreed"), F.max("hub").alias("hub")
    )
    return once.select(
        F.when(F.col("forward"), F.col("x")).otherwise(F.col("y")).alias("a"),
        F.when(F.col("forward"), F.col("y")).otherwise(F.col("x")).alias("b"),
        "agreed",
        "hub",
    )


def _dealt(rows: DataFrame, most: int, most_bytes: int | None = None) -> DataFrame:
    """``rows`` (``region, class, component`` and others) dealt into cells, each of a block of left
    rows and a block of right rows of one region, so that every two rows of a region that differ in
    ``component`` meet in one cell. The rows of a region's largest component need not meet each
    other: left are only those of the other components. Blocks hold about ``most`` rows, and about
    ``most_bytes`` of ``shingles``.
    """
    weight = F.sum(F.length("shingles")) if most_bytes else F.lit(0)
    share = lambda n, size: F.greatest(F.ceil(n / most), F.ceil(size / (most_bytes or 1)), F.lit(1)).cast("int")
    of = rows.groupBy("region", "component").agg(F.count("*").alias("n"), weight.cast("bigint").alias("size"))
    regions = of.groupBy("region").agg(
        F.max_by("component", F.struct("n", "component")).alias("major"),
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("n").alias("in_major"),
        F.max_by("size", F.struct("n", "component")).alias("major_size"), F.count("*").alias("kinds"),
    )
    mixed = regions.where("kinds > 1").select(
        "region", "major",
        share(F.col("n") - F.col("in_major"), F.col("size") - F.col("major_size")).alias("lefts"),
        share(F.col("n"), F.col("size")).alias("rights"),
    )
    known = rows.join(mixed, "region").withColumn("minor", F.col("component") != F.col("major"))
    block = lambda count: F.pmod(F.xxhash64("class"), F.col(count)).cast("int")
    upto = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    cell = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    right = F.transform(upto("lefts"), lambda i: cell(i, block("rights"), False))
    left = F.when(F.col("minor"), F.transform(upto("rights"), lambda j: cell(block("lefts"), j, True)))
    dealt = known.withColumn("cell", F.explode(F.concat(right, F.coalesce(left, F.array().cast("array<struct<i:int,j:int,left:boolean>>")))))
    others = [c for c in rows.columns if c not in ("region",)]
    placed = dealt.select("region", "cell.i", "cell.j", "cell.left", "minor", *others)
    return placed.repartition(partitions(rows.sparkSession), "region", "i", "j").sortWithinPartitions("region", "i", "j")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """Left and right rows of each cell of ``_dealt`` that has both."""
    key, sides = None, ([], [])
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["region"], row["i"], row["j"])
            if here != key:
                if all(sides):
                    yield sides
                key, sides = here, ([], [])
            sides[not row["left"]].append(row)
    if all(sides):
        yield sides


def _close(left: list[dict], right: list[dict], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each left row the right rows of other components that agree with it in ``least`` symbols
    and did not meet it in an earlier tree, and the symbols agreed. Two left rows of a region meet
    twice, once on either side: only the first by class counts."""
    tell = lambda rows, c: np.frombuffer(b"".join(r[c] for r in rows), np.uint8).reshape(len(rows), SYMBOLS)
    a, b = tell(left, "symbols"), tell(right, "symbols")
    place = {c: k for k, c in enumerate(sorted({r["component"] for r in (*left, *right)}))}
    component = np.array([place[r["component"]] for r in right])
    deep = np.array([r["prefixes"] for r in right], np.int64)
    minor = np.array([r["minor"] for r in right])
    names = np.array([*(r["class"] for r in right), b""], object)[:-1]
    tree = left[0]["tree"]
    for at in range(0, len(a), 32):
        agreed = (a[at : at + 32, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
        for k, some in enumerate(agreed, at):
            row = left[k]
            near = np.flatnonzero((some >= least) & (component != place[row["component"]]))
            if len(near):
                met = (deep[near, :tree] == np.array(row["prefixes"][:tree], np.int64)).any(axis=1)
                near = near[~met & (~minor[near] | (names[near] > row["class"]))]
            if len(near):
                yield k, near, some[near]


def remaining(classes: DataFrame, found: DataFrame, sets_of: Callable[[DataFrame], DataFrame], level: Level) -> DataFrame:
    """``a, b``: links between classes of different components of ``found`` (``node, component``),
    as many as connect what whole sets connect. Every two classes that share a region in some tree
    are compared, however crowded it is; nothing is proposed, capped or cut.

    Regions within one component are dropped first. In the others rows are compared by symbols in
    cells of bounded size, and only the rows with a close partner in another component are dealt
    again with their sets (``sets_of`` makes ``class, shingles`` of given classes). Sets are compared
    where they meet, so the pairs themselves are never rows.
    """
    tree = (
        classes.select("class", F.posexplode("prefixes").alias("tree", "region"))
        .join(found.withColumnRenamed("node", "class"), "class", "left")
        .select("region", "tree", "class", F.coalesce("component", "class").alias("component"))
    )
    ends = tree.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    mixed = ends.where("x <> y").select("region")
    columns = classes.select("class", "prefixes", "symbols")
    rows = written(tree.join(mixed, "region", "left_semi").join(columns, "class"), "mixed-regions")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(batches):
            marked = set()
            for k, near, _ in _close(left, right, level.least):
                marked.add(left[k]["class"])
                marked.update(right[j]["class"] for j in near.tolist())
            if marked:
                region = pa.array([left[0]["region"]] * len(marked), pa.int64())
                yield pa.RecordBatch.from_arrays([region, pa.array(sorted(marked), pa.binary())], ["region", "class"])

    flagged = _dealt(rows, BLOCK).mapInArrow(flag, "region bigint, class binary").distinct()
    flagged = written(flagged, "close-rows")
    sets = written(sets_of(flagged.select("class").distinct()), "close-sets")
    whole = written(rows.join(flagged, ["region", "class"]).join(sets, "class"), "close-regions")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _cells(batches):
            parent: dict[bytes, bytes] = {}

            def root(x: bytes, parent: dict[bytes, bytes] = parent) -> bytes:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            out = []
            others = [np.frombuffer(r["shingles"], np.uint64) for r in right]
            for k, near, agreed in _close(left, right, level.least):
                mine = np.frombuffer(left[k]["shingles"], np.uint64)
                for j in near[np.argsort(-agreed, kind="stable")].tolist():
                    x, y = root(left[k]["component"]), root(right[j]["component"])
                    if x != y and _linked(mine, others[j], level):
                        parent[x] = y
                        out.append((left[k]["class"], right[j]["class"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return _dealt(whole, LINK_ROWS, LINK_BYTES).mapInArrow(link, "a binary, b binary")


def _linked(mine: np.ndarray, other: np.ndarray, level: Level) -> bool:
    common = len(np.intersect1d(mine, other, assume_unique=True))
    return level.share[1] * common >= level.share[0] * (len(mine) + len(other) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, level: Level) -> DataFrame:
    """The pairs (``a, b``) whose whole sets (``class, shingles``) reach the level. The partner's
    set is joined to each pair; the proposer's own set comes once, ahead of its pairs. A proposer
    has few pairs, so no task gathers a hub's."""
    partners = pairs.join(sets.withColumnRenamed("class", "b"), "b").select("a", "b", "shingles")
    own = pairs.select("a").distinct().join(sets.withColumnRenamed("class", "a"), "a")
    both = own.select("a", F.lit(None).cast("binary").alias("b"), "shingles").unionByName(partners)
    grouped = both.repartition(partitions(pairs.sparkSession), "a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = np.frombuffer(raw, np.uint64)
                if b is None:
                    mine = other
                    continue
                if _linked(mine, other, level):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return grouped.mapInArrow(run, "a binary, b binary")


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes in ``nodes`` (``class, doc_id`` of a member)."""
    wanted = docs.select("doc_id", whole_text()).join(nodes, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"))
            ends, out = np.cumsum(counts), []
            for row, name in enumerate(batch.column("class").to_pylist()):
                own = sets[ends[row] - counts[row] : ends[row]]
                # Ids may repeat with other texts: only the class's own set counts.
                out.append(own.tobytes() if len(own) and _class_of(own) == name else None)
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(out, pa.binary())], ["class", "shingles"])

    made = wanted.select("doc_id", "text", "class").mapInArrow(run, "class binary, shingles binary")
    return made.where("shingles is not null").dropDuplicates(["class"])


def groups(docs: DataFrame, level: Level = AT_85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows of equal sets are one class; classes whose sets reach the level are linked, and
    ``component_id`` is the smallest ``doc_id`` a row reaches (nulls do not count; null where only
    null ids are reached). ``kept`` marks rows whose id is that; repeated rows of that id are all
    marked. Null and empty texts, and texts without words, have no shingles, link with nothing and
    are kept. An empty table gives an empty one; only ``doc_id`` and ``text`` are read.

    Pairs are confirmed in three rounds: first each class with its most similar and its most connected
    partner, then all other proposals between classes not connected yet, then all pairs of a region
    that are not connected still (``remaining``). A pair at 0.85 shares a region with a
    probability of 1 - 0.39**12, crowded or not, and is missed with 1.2e-5, the estimate's misses
    included; at 0.80, with ``AT_80``, with 1.2e-5 too.
    """
    sketch = written(sketches(docs, level.trees), "sketches")
    named = sketch.where("class is not null")
    heads = named.groupBy("class").agg(F.min("doc_id").alias("head"))
    one = (
        named.join(heads.withColumnRenamed("class", "_class"), (F.col("class") == F.col("_class")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .select("class", "doc_id", "prefixes", "symbols")
        .dropDuplicates(["class"])
    )
    classes = written(one, "classes")
    pairs = written(candidates(classes, level), "pairs")
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()

    def sets_of(some: DataFrame) -> DataFrame:
        # Null ids are a member like any other but cannot be joined by id; their texts come by class.
        nodes = classes.where("doc_id is not null").select("class", "doc_id").join(some, "class", "left_semi")
        unnamed = classes.where("doc_id is null").select("class").join(some, "class", "left_semi")
        return _sets_of(docs, nodes).unionByName(_sets_of_unnamed(docs, unnamed))

    sets = written(sets_of(ends), "sets")

    either = pairs.select("a", "b", "agreed", "hub", F.col("a").alias("end")).union(
        pairs.select("a", "b", "agreed", "hub", F.col("b").alias("end"))
    )
    best = either.groupBy("end").agg(
        F.max_by(F.struct("a", "b"), F.struct("agreed", "a", "b")).alias("close"),
        F.max_by(F.struct("a", "b"), F.struct("hub", "agreed", "a", "b")).alias("hub"),
    )
    first = best.select(F.explode(F.array("close", "hub")).alias("p")).select("p.*").distinct()
    links = written(confirmed(written(first, "first-pairs"), sets, level), "links")
    found = written(components(links), "linked")
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    rest = (
        pairs.join(first, ["a", "b"], "left_anti")
        .join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .where(~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)))
        .select("a", "b")
    )
    more = written(confirmed(written(rest, "other-pairs"), sets, level), "links")
    links = links.unionByName(more)
    joined = written(components(links), "linked")
    last = written(remaining(classes, joined, sets_of, level), "links")
    if not last.isEmpty():
        joined = components(links.unionByName(last))
    of_class = heads.join(joined.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "head", F.coalesce("component", "class").alias("component")
    )
    smallest = of_class.groupBy("component").agg(F.min("head").alias("component_id"))
    ids = written(of_class.join(smallest, "component").select("class", "component_id"), "component-ids")
    whole = sketch.select("doc_id", "n_shingles", "class").join(ids, "class", "left")
    named_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select(
        "doc_id", "n_shingles", named_id.alias("component_id"), F.col("doc_id").eqNullSafe(named_id).alias("kept")
    )


def _sets_of_unnamed(docs: DataFrame, classes: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is null").select("doc_id", whole_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, counts = shingle_sets(batch.column("text"))
            parts = [sets[e - n : e] for n, e in zip(counts, np.cumsum(counts), strict=True) if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(p) for p in parts], pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())],
                ["class", "shingles"],
            )

    return rows.mapInArrow(run, "class binary, shingles binary").join(classes, "class", "left_semi").dropDuplicates(["class"])


def deduplicate(docs: DataFrame, level: Level = AT_85) -> DataFrame:
    """The rows of ``docs`` whose id is its group's smallest, with their columns, whatever these are
    called. Rows that repeat id and text stay once; texts that differ under one id are separate
    documents, as in ``groups``."""
    rows = packed(docs)
    marks = groups(docs, level).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    repeated = written(
        rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id"), "repeated-ids"
    )
    if repeated.isEmpty():
        return unpacked(kept, docs)
    again = F.col("doc_id").eqNullSafe(F.col("_id"))
    # Texts are only dealt by their content where an id is not unique.
    few = kept.join(repeated, again, "left_semi").withColumn("_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_key"])
    return unpacked(kept.join(repeated, again, "left_anti").unionByName(few.drop("_key")), docs)
