"""Spelling variants: words one edit apart, found by walking a trie that is a table.

The trie of all words is an edge table (root, node, symbol, ahead), its nodes named by their prefix;
``ahead`` are the symbols that follow. States (word, position, node, edits) are joined with the edges
level by level: a state without an edit takes one where the trie branches off its word, a state with
one edit follows its word's remaining symbols or ends. States that reach the end of a word name a
neighbour.

Three things keep the frontier small. A pair one edit apart agrees either in the first half of the
shorter word or in its last half, so every word is walked forwards and backwards, and edits are only taken in
the second half, where the trie is sparse. An edit is only taken where the ``AHEAD`` symbols behind
it agree too, and the state goes on behind these. And words are cut into pieces of ``PIECE`` symbols: a
piece's trie hangs below a root named by all that comes before the piece, and what follows the piece must agree as
a whole, so the walk takes ``PIECE`` levels however long words are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import slices, whole_text
from worksift.plans.storage import run_dir, written

PIECE = 16
AHEAD = 3
LEAST = 7  # code points of a word
OFTEN = 2  # occurrences of a word
TIMES = 10  # a form occurs so many times as often
DROP = 31  # one in so many runs of a document loses a code point

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# Within a run the leftmost match starts at its first letter, so whole runs are found and no parts.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_TEXT_BYTES = 1 << 23  # texts whose words are counted together


def words_in(text: str, doc_id: int | None) -> Counter:
    """The words of one text and how often each occurs, after the code points that go are gone."""
    lowered = text.encode().translate(_LOWER).decode()
    found = Counter(_RUN.findall(lowered))
    if doc_id is None:
        return found
    start, out = zlib.crc32(b"%d:" % doc_id), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that occur ``OFTEN`` times over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = Counter(), 0
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update(words_in(text, doc))
                size += len(text)
            if size >= _TEXT_BYTES:
                yield _counts(found)
                found, size = Counter(), 0
        yield _counts(found)

    parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text()).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


def _digests(word: str, lengths: list[int]) -> dict[int, bytes]:
    """A digest of each prefix of the given lengths; the empty one's is empty."""
    h, at, out = hashlib.md5(usedforsecurity=False), 0, {}
    for n in sorted(set(lengths)):
        h.update(word[at:n].encode())
        at, out[n] = n, h.digest() if n else b""
    return out


def pieces_of(word: str) -> Iterator[tuple[bytes, str, int, int, bytes, bytes]]:
    """The word's pieces, forwards and backwards: root, symbols, first place of an edit, first node that
    others may take, and what follows the piece and the piece less its last symbol.

    Pieces that lie before any place of an edit are left out."""
    n = len(word)
    other = word[::-1]
    for mark, here, back in ((b"f", word, other), (b"b", other, word)):
        edit, node = n // 2, (n - 1) // 2
        if n < PIECE:
            yield mark, here, edit, node, b"", b""
            continue
        firsts = range(max(0, -(-(node - PIECE + 1) // PIECE)) * PIECE, n + 1, PIECE)
        heads = _digests(here, [*firsts])
        ends = [max(0, n - at - PIECE + k) for at in firsts for k in (0, 1)]
        tails = _digests(back, ends)
        for k, at in enumerate(firsts):
            yield (
                mark + heads[at], here[at : at + PIECE], max(0, edit - at), max(0, node - at),
                tails[ends[2 * k]], tails[ends[2 * k + 1]],
            )


_ENTRY = pa.schema(
    [("id", pa.int64()), ("root", pa.binary()), ("piece", pa.string()), ("size", pa.int32()), ("edit", pa.int32()),
     ("first", pa.int32()), ("tail", pa.binary()), ("tail_before", pa.binary())]
)


def entries(words: DataFrame) -> DataFrame:
    """All pieces of all words (``id, word``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(batches, "word"):
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for root, piece, edit, first, tail, before in pieces_of(word):
                    rows.append((i, root, piece, len(piece), edit, first, tail, before))
                    if len(rows) == 1 << 14:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)

    kinds = "id bigint, root binary, piece string, size int, edit int, first int, tail binary, tail_before binary"
    return words.select("id", "word").mapInArrow(run, kinds)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)


def edges(known: DataFrame) -> DataFrame:
    """The edge table ``depth, root, node, symbol, ahead``, stored by depth."""
    spark = known.sparkSession
    places = F.sequence(F.col("first"), F.col("size") - 1)
    made = (
        known.where("size > first")
        .select("root", "piece", F.explode(places).alias("depth"))
        .select(
            "depth", "root", F.expr("left(piece, depth)").alias("node"), F.expr("substring(piece, depth + 1, 1)").alias("symbol"),
            F.expr(f"substring(piece, depth + 2, {AHEAD})").alias("ahead"),
        )
        .distinct()
    )
    path = f"{run_dir(spark)}/edges-{uuid.uuid4().hex}"
    made.write.partitionBy("depth").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def edited(known: DataFrame, branch: DataFrame, depth: int) -> DataFrame:
    """States after an edit at ``depth``: ``id, root, node, rest, tail``, the node ``AHEAD`` symbols further.

    A symbol takes the place of the word's, or is put before it. Of two words that differ by a replaced
    symbol the lower meets the higher, of two lengths the shorter the longer, so a pair is found once."""
    rest = F.expr(f"substring(piece, {depth + 1})")
    ways = [F.struct(F.lit(True).alias("puts"), F.expr(f"substring(piece, {depth + 1}, {PIECE - 1 - depth})").alias("rest"), F.col("tail_before").alias("tail"))]
    ways.append(F.when(F.col("size") > depth, F.struct(F.lit(False).alias("puts"), F.expr(f"substring(piece, {depth + 2})").alias("rest"), F.col("tail").alias("tail"))))
    waiting = (
        known.where((F.col("edit") <= depth) & (F.col("size") >= depth))
        .select("id", "root", F.expr(f"left(piece, {depth})").alias("node"), F.left(rest, F.lit(1)).alias("own"), F.explode(F.array_compact(F.array(*ways))).alias("way"))
        .select("id", "root", "node", "own", "way.puts", "way.rest", "way.tail", F.expr(f"left(way.rest, {AHEAD})").alias("ahead"))
    )
    other = F.when(F.col("puts"), F.col("symbol") != F.col("own")).otherwise(F.col("symbol") > F.col("own"))
    return waiting.join(branch, ["root", "node", "ahead"]).where(other).select(
        "id", "root", F.concat("node", "symbol", "ahead").alias("node"), F.expr(f"substring(rest, {AHEAD + 1})").alias("rest"), "tail"
    )


def followed(states: DataFrame, branch: DataFrame) -> DataFrame:
    """States with an edit one symbol further, where the trie has it."""
    steps = branch.select("root", "node", F.col("symbol").alias("next"))
    return states.withColumn("next", F.expr("left(rest, 1)")).join(steps, ["root", "node", "next"], "left_semi").select(
        "id", "root", F.concat("node", "next").alias("node"), F.expr("substring(rest, 2)").alias("rest"), "tail"
    )


def neighbours(words: DataFrame) -> DataFrame:
    """``a, b``: ids of words (``id, word``) one inserted, deleted or replaced code point apart, both ways."""
    known = written(entries(words), "pieces")
    trie = edges(known)
    if known.isEmpty():
        return known.select(F.col("id").alias("a"), F.col("id").alias("b"))
    levels = known.agg(F.max("size")).first()[0]
    ended, entering, states = [], {}, None
    for depth in range(PIECE):
        branch = trie.where(F.col("depth") == depth).drop("depth")
        here = [*([states] if states is not None else []), *entering.pop(depth, [])]
        states = None
        if here:
            both = here[0] if len(here) == 1 else here[0].unionByName(here[1])
            states = written(followed(both, branch), "states")
            ended.append(states.where("rest = ''").drop("rest"))
            states = states.where("rest <> ''")
        if depth <= levels:
            fresh = written(edited(known, branch, depth), "states")
            ended.append(fresh.where("rest = ''").drop("rest"))
            entering[depth + 1 + AHEAD] = [fresh.where("rest <> ''")]
        elif not entering:
            break
    found = ended[0]
    for part in ended[1:]:
        found = found.unionByName(part)
    ends = known.select(F.col("id").alias("b"), "root", F.col("piece").alias("node"), "tail")
    pairs = found.join(ends, ["root", "node", "tail"]).select(
        F.explode(F.array(F.struct(F.col("id").alias("a"), "b"), F.struct(F.col("b").alias("a"), F.col("id").alias("b")))).alias("p")
    )
    return pairs.select("p.a", "p.b").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents (``doc_id, text``).

    Null and empty texts have no words, an empty table none; rows that repeat are counted as often as
    they occur. Rows without an id lose no code points. Words and runs may be of any length. A form is the near
    word of largest ``n``, of several the smallest in code-point order. ``root`` follows forms, whose
    counts rise tenfold each time, by doubling.
    """
    words = written(written(counted(docs), "counted").withColumn("id", F.monotonically_increasing_id()), "words")
    near = written(neighbours(words), "near")
    other = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = near.join(other, "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form", "b")).alias("best")
    )
    known = words.join(best.withColumnRenamed("a", "id"), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"),
    )
    known = written(known.select("id", "word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"), F.col("best.b").alias("to")), "forms")
    steps = known.where("to is not null").select("id", "to")
    while True:
        further = steps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        stepped = written(steps.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = stepped.select("id", "to")
        if stepped.where("moved").isEmpty():
            break
    roots = steps.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return known.join(roots, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
