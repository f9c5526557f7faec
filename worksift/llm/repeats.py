"""Exact removal of long repeated strings with a logarithmic family of sparse suffix arrays.

Every string of ``LENGTH`` bytes is represented by one suffix that starts inside it: the one whose
first ``SEED`` bytes have the least hash of all that the string holds (the first on a tie). Equal
strings choose the same suffix at the same place, so no match is lost, and only about one suffix in
35 is kept. A suffix entry stands for the run of strings that chose it.

Suffixes are dealt by their hash. Where they meet, each batch of text brings its suffix array, which
is merge-scanned against the levels that earlier batches left; then it becomes a level itself, and
levels of equal size merge, so a suffix is moved a logarithmic number of times. Runs equal in
whole are settled there. Only where a match begins or ends are the single strings compared, by
128-bit hashes, dealt anew so that a suffix common to very many documents is spread.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from worksift.llm.common import data, files_folder, mix, offsets, open_files, packed, unpacked
from worksift.plans.storage import written

LENGTH = 100  # bytes of the strings that must not repeat
SEED = 32  # bytes a suffix is chosen and dealt by
_CHOICES = LENGTH - SEED + 1
_SLICE = 1 << 17  # strings worked on at once
_PLACE = np.uint64((1 << 18) - 1)
BATCH_BYTES = 8 << 20  # text of a batch
SHARE_BYTES = 24 << 20  # text per task where suffixes meet

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_N = _SLICE + 2 * LENGTH + 2
_UP = [_powers(b, _N) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), _N) for b in _BASES]
_VALUE = [mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(k << 40)) for k in (1, 2)]


def _sums(raw: np.ndarray, k: int = 0) -> np.ndarray:
    """Running sums of weighted bytes, from which any string's hash follows."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[k][raw] * _UP[k][: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
    """Hashes of the strings between places, equal for equal strings wherever they stand."""
    return mix((sums[stop] - sums[start]) * _DOWN[k][start])


def runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix entries of consecutive texts: the first string of each run, how many strings it has,
    the hash of the seed, and the hash of the run's whole content and where the seed lies in it."""
    parts = []
    valid = np.zeros(len(raw) + 1, np.int8)
    long_enough = np.diff(starts) >= LENGTH
    np.add.at(valid, starts[:-1][long_enough], 1)
    np.add.at(valid, starts[1:][long_enough] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).view(bool)
    for at in range(0, max(len(raw) - LENGTH + 1, 0), _SLICE):
        piece = raw[at : at + _SLICE + LENGTH - 1]
        ok = np.flatnonzero(valid[at : at + len(piece) - LENGTH + 1])
        if not len(ok):
            continue
        sums = _sums(piece)
        n = len(piece) - SEED + 1
        seeds = mix((sums[SEED:] - sums[:n]) * _DOWN[0][:n])
        least = (seeds & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= _CHOICES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = _CHOICES - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        chosen = (least[ok] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        count = np.diff(np.append(first, len(ok)))
        start, seed = ok[first], chosen[first]
        content = _hash(sums, start, start + count + LENGTH - 1)
        lies = (seed - start).astype(np.uint64)
        parts.append((start + at, count, seeds[seed], mix(content ^ mix(lies * np.uint64(1 << 16) + count.astype(np.uint64)))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class Family:
    """Suffix arrays of seeds by level. A level is sorted seeds and where their entries are."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, seeds: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Scans a new batch against itself and all levels, adds it, and merges levels of about equal
        size. Returns the seeds met more than once, as far as this batch has part in it."""
        order = np.argsort(seeds, kind="stable")
        seeds, where = seeds[order], where[order]
        met = [seeds[1:][seeds[1:] == seeds[:-1]]]
        for level, _ in self.levels:
            small, large = (seeds, level) if len(seeds) <= len(level) else (level, seeds)
            at = np.searchsorted(large, small)
            met.append(small[large[np.minimum(at, len(large) - 1)] == small] if len(large) else small[:0])
        self.levels.append((seeds, where))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, places = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(both, kind="stable")  # two sorted runs: one merge
            self.levels.append((both[order], places[order]))
        return np.unique(np.concatenate(met))

    def entries(self, seeds: np.ndarray) -> np.ndarray:
        """Where the entries of the given sorted seeds are."""
        out = []
        for level, where in self.levels:
            if len(seeds):
                at = np.minimum(np.searchsorted(seeds, level), len(seeds) - 1)
                out.append(where[seeds[at] == level])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


# Rows between the steps: to whom, from which batch, what kind, and arrays in one binary value.
_ROW = "share int, batch bigint, kind int, body binary"
_NAMES = ["share", "batch", "kind", "body"]
ENTRIES, WHOLE, EDGE, STRINGS = range(4)


def _home(batch: int, shares: int) -> int:
    """The share that passes on what a batch has settled by itself. Batch numbers are a partition
    number above and a count below; both spread."""
    return ((batch >> 32) * 31 + batch) % shares


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal or different lengths as one compressed value."""
    raw = [np.ascontiguousarray(a) for a in arrays]
    head = struct.pack("<B", len(raw)) + b"".join(struct.pack("<cBQ", a.dtype.kind.encode(), a.itemsize, len(a)) for a in raw)
    return pa.compress(head + b"".join(a.tobytes() for a in raw), codec="zstd", asbytes=True) + struct.pack(
        "<Q", len(head) + sum(a.nbytes for a in raw)
    )


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[:-8], struct.unpack("<Q", body[-8:])[0], codec="zstd", asbytes=True)
    at, kinds = 1, []
    for _ in range(raw[0]):
        kind, width, n = struct.unpack_from("<cBQ", raw, at)
        kinds.append((np.dtype(f"{kind.decode()}{width}"), n))
        at += 10
    out = []
    for dtype, n in kinds:
        out.append(np.frombuffer(raw, dtype, n, at))
        at += dtype.itemsize * n
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _NAMES)


def batches_of(docs: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """Writes the rows in batches of about ``size`` bytes of text (one larger text is a batch of its
    own) to files in the run's shared folder. The stored result, ``batch, path, first, length,
    n_bytes``, names every batch; files of lost tasks are not named by it."""
    folder = files_folder(docs.sparkSession, f"texts-{uuid.uuid4().hex}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, made, stream, at = [], 0, 0, None, 0
        part = TaskContext.get().partitionId()

        def flush():
            nonlocal stream, at, waiting, held, made
            if stream is None:
                system, root = open_files(folder)
                system.create_dir(root)
                flush.name = f"{part:06d}-{uuid.uuid4().hex}.texts"
                stream = system.open_output_stream(f"{root}/{flush.name}", compression=None)
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for r in rows:
                    writer.write_batch(r)
            raw = sink.getvalue()
            stream.write(raw)
            out = {"batch": [(part << 32) + made], "path": [flush.name], "first": [at], "length": [raw.size], "n_bytes": [held]}
            at, made, waiting, held = at + raw.size, made + 1, [], 0
            return pa.RecordBatch.from_pydict(out)

        for rows in parts:
            start = 0
            sizes = np.diff(offsets(rows.column("text"))).tolist() if rows.num_rows else []
            for row, n in enumerate(sizes):
                if held and held + n > size:
                    if row > start:
                        waiting.append(rows.slice(start, row - start))
                    yield flush()
                    start = row
                held += n
            if rows.num_rows > start:
                waiting.append(rows.slice(start))
        if waiting:
            yield flush()
        if stream is not None:
            stream.close()

    kinds = "batch bigint, path string, first bigint, length bigint, n_bytes bigint"
    names = written(docs.mapInArrow(run, kinds), "texts")
    return names.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def _open(path: str, first: int, length: int) -> pa.RecordBatch:
    system, name = open_files(path)
    with system.open_input_file(name) as stream:
        stream.seek(first)
        raw = stream.read(length)
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return table.to_batches()[0]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """Document ids in order; null ids come before all others."""
    return batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _repeats(one: np.ndarray, two: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Marks all but the first of the rows that agree in both hashes; ``ties`` give the order, the
    least significant first. Only rows whose first hash repeats are ordered in full."""
    out = np.zeros(len(one), bool)
    order = np.argsort(one)
    values = one[order]
    same = values[1:] == values[:-1]
    some = np.append(False, same) | np.append(same, False) if len(one) else out
    at = order[some]
    if len(at):
        at = at[np.lexsort((*(t[at] for t in ties), two[at], one[at]))]
        x, y = one[at], two[at]
        out[at[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return out


def _entries(shares: int):
    """Step 1, per batch: its suffix entries by share. Of equal runs in the batch only the first
    goes on; the others are settled at once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part.to_pylist():
                batch = _open(name["path"], name["first"], name["length"])
                raw, starts = data(batch.column("text").fill_null(""))
                start, count, seed, content = runs(raw, starts)
                ids = _ids(batch)
                doc = np.searchsorted(starts, start, "right") - 1
                again = _repeats(seed, content, start, doc, ids[doc])
                out = []
                if again.any():
                    body = _pack(start[again].astype(np.uint32), count[again].astype(np.uint8))
                    out.append((_home(name["batch"], shares), name["batch"], WHOLE, body))
                start, count, seed, content, doc = (x[~again] for x in (start, count, seed, content, doc))
                share = (seed >> np.uint64(20)) % np.uint64(shares)
                by = np.argsort(share, kind="stable")
                cuts = np.searchsorted(share[by], np.arange(shares + 1, dtype=np.uint64))
                for s in range(shares):
                    p = by[cuts[s] : cuts[s + 1]]
                    if len(p):
                        p = p[np.argsort(start[p])]
                        used, at = np.unique(doc[p], return_inverse=True)
                        body = _pack(seed[p], content[p], start[p].astype(np.uint32), count[p].astype(np.uint8), at.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), np.diff(ids[used], prepend=0), used.astype(np.uint32))
                        out.append((s, name["batch"], ENTRIES, body))
                if out:
                    yield _rows(out)

    return run


def _by_share(rows: DataFrame, shares: int) -> DataFrame:
    return rows.repartitionById(shares, "share").sortWithinPartitions("share", "batch", "kind")


def _each_share(parts: Iterator[pa.RecordBatch], begin, take, finish) -> Iterator[pa.RecordBatch]:
    """Feeds rows of one share after the other; rows already settled pass through."""
    state, share = None, None
    for part in parts:
        passed = []
        for row in part.to_pylist():
            if row["kind"] in (WHOLE, EDGE):
                passed.append((0, row["batch"], row["kind"], row["body"]))
                continue
            if row["share"] != share:
                if state is not None:
                    yield from finish(state)
                state, share = begin(), row["share"]
            take(state, row["batch"], _unpack(row["body"]))
        if passed:
            yield _rows(passed)
    if state is not None:
        yield from finish(state)


def _to_batches(batch: np.ndarray, kinds: list[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Results dealt back to the batches they concern: (kind, which rows, arrays)."""
    for kind, which, arrays in kinds:
        at = np.flatnonzero(which)
        if not len(at):
            continue
        at = at[np.argsort(batch[at], kind="stable")]
        names, first = np.unique(batch[at], return_index=True)
        out = []
        for name, lo, hi in zip(names, first, np.append(first[1:], len(at)), strict=True):
            out.append((0, int(name), kind, _pack(*(a[at[lo:hi]] for a in arrays))))
        yield _rows(out)


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, per share: batch after batch into the family. Entries of a seed met more than once
    are compared: a run whose content came earlier is repeated as a whole; the first runs of seeds
    with several contents go on as edges."""

    def begin():
        return Family(), [], []

    def take(state, batch, arrays):
        family, kept, met = state
        met.append(family.add(arrays[0], (np.int64(len(kept)) << 32) + np.arange(len(arrays[0]))))
        kept.append((batch, arrays[1:]))

    def finish(state):
        family, kept, met = state
        seeds = np.unique(np.concatenate(met))
        where = np.sort(family.entries(seeds))
        if not len(where):
            return
        cols = [[] for _ in range(6)]
        lows = np.searchsorted(where >> 32, np.arange(len(kept) + 1))
        for number, (batch, (content, start, count, at, deltas, used)) in enumerate(kept):
            p = where[lows[number] : lows[number + 1]] & 0xFFFFFFFF
            ids = np.cumsum(deltas)
            for col, x in zip(cols, (content[p], start[p], count[p], ids[at[p]], used[at[p]], np.full(len(p), batch)), strict=True):
                col.append(x)
        content, start, count, ids, doc, batch = (np.concatenate(c) for c in cols)
        seed = np.concatenate([np.zeros(0, np.uint64), *_seeds_of(family, seeds, where)])
        order = np.lexsort((start, doc, batch, ids, content, seed))
        content, start, count, batch, seed = (x[order] for x in (content, start, count, batch, seed))
        new_seed = np.append(True, seed[1:] != seed[:-1])
        new = new_seed | np.append(True, content[1:] != content[:-1])
        group = np.cumsum(new_seed) - 1
        several = np.bincount(group, weights=new)[group] > 1
        yield from _to_batches(batch, [(WHOLE, ~new, (start, count)), (EDGE, new & several, (start, count))])

    yield from _each_share(parts, begin, take, finish)


def _seeds_of(family: Family, seeds: np.ndarray, where: np.ndarray) -> list[np.ndarray]:
    """The seed of each entry in ``where`` (sorted)."""
    out = np.zeros(len(where), np.uint64)
    for level, places in family.levels:
        at = np.minimum(np.searchsorted(seeds, level), len(seeds) - 1)
        hit = seeds[at] == level
        out[np.searchsorted(where, places[hit])] = level[hit]
    return [out]


def _gathered(rows: Iterator[dict], kind: int) -> tuple[np.ndarray, np.ndarray]:
    found = [_unpack(r["body"]) for r in rows if r["kind"] == kind]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))


def _string_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the strings that start at the sorted places."""
    out = [np.zeros(len(at), np.uint64) for _ in range(2)]
    lo = 0
    while lo < len(at):
        base = at[lo]
        hi = int(np.searchsorted(at, base + _SLICE, "left"))
        piece, here = raw[base : at[hi - 1] + LENGTH], at[lo:hi] - base
        for k in (0, 1):
            out[k][lo:hi] = _hash(_sums(piece, k), here, here + LENGTH, k)
        lo = hi
    return out[0], out[1]


def _strings(shares: int):
    """Step 3, per batch with edges: the hashes of the single strings, by share; of equal strings in
    the batch only the first goes on."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part.to_pylist():
                out = [(_home(name["batch"], shares), name["batch"], WHOLE, r["body"]) for r in name["rows"] if r["kind"] == WHOLE]
                start, count = _gathered(name["rows"], EDGE)
                if len(start):
                    batch = _open(name["path"], name["first"], name["length"])
                    raw, starts = data(batch.column("text").fill_null(""))
                    at = np.sort(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))
                    one, two = _string_hashes(raw, at)
                    ids = _ids(batch)
                    doc = np.searchsorted(starts, at, "right") - 1
                    again = _repeats(one, two, at, doc, ids[doc])
                    if again.any():
                        body = _pack(at[again].astype(np.uint32), np.ones(again.sum(), np.uint8))
                        out.append((_home(name["batch"], shares), name["batch"], WHOLE, body))
                    at, one, two, doc = (x[~again] for x in (at, one, two, doc))
                    share = one % np.uint64(shares)
                    by = np.argsort(share, kind="stable")
                    cuts = np.searchsorted(share[by], np.arange(shares + 1, dtype=np.uint64))
                    for s in range(shares):
                        p = by[cuts[s] : cuts[s + 1]]
                        if len(p):
                            p = p[np.argsort(at[p])]
                            used, place = np.unique(doc[p], return_inverse=True)
                            body = _pack(one[p], two[p], at[p].astype(np.uint32), place.astype(np.uint32), np.diff(ids[used], prepend=0), used.astype(np.uint32))
                            out.append((s, name["batch"], STRINGS, body))
                if out:
                    yield _rows(out)

    return run


def _settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4, per share: of equal strings all but the first are repeated."""

    def take(state, batch, arrays):
        one, two, at, place, deltas, used = arrays
        state.append((one, two, at, np.cumsum(deltas)[place], used[place], np.full(len(at), batch)))

    def finish(state):
        one, two, at, ids, doc, batch = (np.concatenate(c) for c in zip(*state, strict=True))
        state.clear()
        which = _repeats(one, two, at, doc, batch, ids)
        yield from _to_batches(batch, [(WHOLE, which, (at, np.ones(len(at), np.uint8)))])

    yield from _each_share(parts, list, take, finish)


def _with_rows(names: DataFrame, rows: DataFrame) -> DataFrame:
    """Every batch with the results that concern it: a few compressed values, as long as the batch's
    own text allows."""
    found = rows.groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct("kind", "body")).alias("rows"))
    return names.join(found, F.col("batch") == F.col("_batch"), "left").drop("_batch")


def _covered(size: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which bytes lie in a repeated string: ``counts`` strings from each place on."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + LENGTH - 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove(docs: DataFrame, texts: bool = False, batch_bytes: int = BATCH_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Every row of ``docs``, with its columns but ``text``, and ``n_bytes, n_removed, n_spans, kept_sha256``, and with ``texts``
    also ``span_starts, span_ends`` (removed byte spans of the whole text) and ``kept_text``.

    A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a row before
    in ``doc_id`` order, or in the same row further left. Null ids come first; among rows of equal
    id, the order they were read in decides, so of repeated rows the first keeps its text. Strings
    never cross rows; null texts are empty, and texts shorter than a string keep every byte.
    ``kept_text`` leaves out bytes of characters that a cut went through. Columns named like results
    are replaced; an empty table gives an empty one.
    """
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    made += ", span_starts array<bigint>, span_ends array<bigint>, kept_text string" if texts else ""
    new = StructType.fromDDL(made)
    rest = docs.drop(*new.names)
    names = batches_of(rest, batch_bytes)
    total = names.agg(F.sum("n_bytes")).first()[0] or 0
    shares = max(8, -(-total // share_bytes))
    # A batch is a large piece of work: each has a task of its own.
    many = max(1, names.count())
    spread = names.repartition(many)
    found = _by_share(spread.mapInArrow(_entries(shares), _ROW), shares).mapInArrow(_scan, _ROW)
    found = written(found, "repeats")
    edges = _with_rows(names, found).where("rows is not null").repartition(many)
    finer = 3 * shares  # there are more single strings at the edges than suffixes
    settled = _by_share(edges.mapInArrow(_strings(finer), _ROW), finer).mapInArrow(_settle, _ROW)
    settled = written(settled, "settled")
    schema = StructType([*rest.drop("text").schema.fields, *new.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part.to_pylist():
                batch = _open(name["path"], name["first"], name["length"])
                raw, starts = data(batch.column("text").fill_null(""))
                gone = _covered(len(raw), *_gathered(name["rows"] or [], WHOLE))
                kept = batch.drop_columns(["text"])
                for at in range(0, batch.num_rows, 512):
                    rows = [_outcome(raw[lo:hi], gone[lo:hi], texts) for lo, hi in zip(starts[at : at + 512], starts[at + 1 : at + 513], strict=False)]
                    rows = rows[: batch.num_rows - at]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
                    columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(new.names))]
                    yield pa.RecordBatch.from_arrays([*kept.slice(at, 512).columns, *columns], schema.names)

    return _with_rows(names, settled).repartition(many).mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut from ``text``, and ``n_chars`` counted anew
    where there is such a column; all other columns keep their values, whatever they are called. Rows
    that lose their whole text stay, empty."""
    rest = unpacked(remove(packed(docs), texts=True).withColumnRenamed("kept_text", "text"), docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def _outcome(raw: np.ndarray, gone: np.ndarray, texts: bool) -> tuple:
    removed = int(gone.sum())
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = (raw[~gone] if removed else raw).tobytes()
    out = (len(raw), removed, len(change) // 2, hashlib.sha256(kept).hexdigest())
    if not texts:
        return out
    return (*out, change[::2].tolist(), change[1::2].tolist(), kept.decode("utf-8", "ignore"))
