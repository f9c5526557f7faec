"""Token ids in bit-packed files: every id takes the least number of bits the vocabulary needs.

File: the magic, blocks of packed ids, then an index (document ids, token counts, block offsets) and
a fixed-size tail that names its place. Every block but the last holds ``BLOCK`` ids, so the block
of an id follows from its number and its bytes from the offsets: ids can be read anywhere, and a
block is unpacked by numpy shifts alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worksift.llm.common import files_folder, open_files, partitions, slices, whole_text
from worksift.plans.storage import written

MAGIC = b"packids1"
BLOCK = 1 << 13  # ids in a block, a multiple of 64
_TAIL = "<QQQQQ8s"  # index place, documents, ids, blocks, bits
_READ = 64  # blocks unpacked at once


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64 ids fill ``bits`` words of 64 bits, the first id lowest. The last group is padded with 0."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 1), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:, :bits]).astype("<u8", copy=False)


def unpack(raw: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block, as u32."""
    packed = np.frombuffer(raw, "<u8").reshape(-1, bits)
    out = np.empty((len(packed), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | packed[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = value & mask
    return out.reshape(-1)[:count]


class Writer:
    """Packs documents into one file; only a block's worth of ids is held."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.offsets: list[int] = []
        self.place = len(MAGIC)
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK * 16:
            self._flush(self.waiting - self.waiting % BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        for at in range(0, upto, BLOCK):
            raw = pack(ids[at : min(at + BLOCK, upto)], self.bits).tobytes()
            self.offsets.append(self.place)
            self.stream.write(raw)
            self.place += len(raw)
        self.open, self.waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        total = sum(self.counts)
        self._flush(self.waiting)
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        index = known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes()
        index += np.array(self.offsets, "<u8").tobytes()
        self.stream.write(index)
        self.stream.write(struct.pack(_TAIL, self.place, len(ids), total, len(self.offsets), self.bits, MAGIC))
        return total


class Reader:
    """Random access to a file's ids by their number, and its documents in order."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = struct.unpack(_TAIL, self._at(size - struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
        place, docs, self.total, blocks, self.bits, magic = tail
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed ids, or cut short")
        index = self._at(place, docs * 17 + blocks * 8)
        known = np.frombuffer(index, np.uint8, docs)
        ids = np.frombuffer(index, "<i8", docs, docs)
        self.docs = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(index, "<i8", docs, docs * 9)
        self.offsets = np.append(np.frombuffer(index, "<u8", blocks, docs * 17), np.uint64(place)).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        raw = self.stream.read(size)
        if len(raw) != size:
            raise ValueError("file cut short")
        return raw

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, -(-stop // BLOCK)
        raw = self._at(self.offsets[first], self.offsets[last] - self.offsets[first])
        # Full blocks hold whole groups of 64, so a run of blocks unpacks as one.
        found = unpack(raw, min(last * BLOCK, self.total) - first * BLOCK, self.bits)
        return found[start - first * BLOCK : stop - first * BLOCK]

    def checksums(self) -> list[int]:
        """Crc32 of every document's ids as little-endian u32, a run of blocks at a time."""
        ends = np.cumsum(self.counts)
        sums, at, doc, crc = [], 0, 0, 0
        while doc < len(ends):
            stop = min(at + BLOCK * _READ, self.total)
            ids = self.ids(at, stop)
            while doc < len(ends) and ends[doc] <= stop:
                here = max(at, ends[doc] - self.counts[doc])
                sums.append(zlib.crc32(ids[here - at : ends[doc] - at].tobytes(), crc))
                doc, crc = doc + 1, 0
            if doc < len(ends):
                here = max(at, ends[doc] - self.counts[doc])
                crc = zlib.crc32(ids[here - at :].tobytes(), crc)
            at = stop
        return sums


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from 256 on, in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


# Fixed value: how byte-level pre-tokenizers cut a text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file does nothing but cut by the byte-level pattern and merge."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    steps = (spec.get("normalizer"), spec.get("truncation"), spec.get("padding"))
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    return (
        model.get("type", "BPE") == "BPE"
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and not any(steps)
        and not any(odd)
    )


class Encoder:
    """Ids exactly as the tokenizers library gives them for a byte-level BPE file, several times
    faster: where the file's merges make its ids in rising order, merging by the least id is merging
    by the first rule, which the tiktoken library does on the same vocabulary. Files with other
    merges or any further step (a normaliser, another pre-tokenizer, dropout, ...), texts that hold
    a special token's string, and texts whose runs of blanks are too long for the pattern's matcher are
    left to the tokenizers library.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path, pattern)

    def _ranked(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if not plain_byte_level(spec) or pattern != BYTE_LEVEL_PATTERN:
            return None
        of = byte_characters()
        ranks = {bytes(of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get("".join(p)) for p in pairs]
        singles = [i for piece, i in ranks.items() if len(piece) == 1]
        if None in made or made != sorted(set(made)) or len(made) + len(singles) != len(ranks) or max(singles) > made[0]:
            return None
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the matcher backtracks over a run of blanks and has a bounded stack
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def write(docs: DataFrame, tokenizer: str, pattern: str, vocabulary: int, end_id: int) -> DataFrame:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending ``doc_id`` order.

    One file per range of documents, in the run's shared folder; the result, one row per file
    (``part, path, n_docs, n_ids``), is stored, and only files it names count, so files left by lost
    tasks are never read. Null ids come first; equal ids are ordered by a hash of the text, and
    repeated rows are repeated documents. Null texts are empty: only the end id is written.
    """
    folder, bits = files_folder(docs.sparkSession, f"ids-{uuid.uuid4().hex}"), bits_for(vocabulary)
    if end_id >= vocabulary:
        raise ValueError("end_id is outside the vocabulary")
    order = (F.col("doc_id").asc_nulls_first(), "_tie")
    ranged = (
        docs.select("doc_id", whole_text())
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sink = load(tokenizer, pattern), None
        part = TaskContext.get().partitionId()
        for batch in slices(batches, "text", 1 << 21):
            if sink is None:
                files, root = open_files(folder)
                files.create_dir(root)
                path = f"{root}/{part:06d}-{uuid.uuid4().hex}.ids"
                stream = files.open_output_stream(path)
                sink = Writer(stream, bits)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sink.add(doc, np.append(encoder(text), np.uint32(end_id)))
        if sink is not None:
            total = sink.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "path": [path.rpartition("/")[2]], "n_docs": [len(sink.docs)], "n_ids": [total]}
            )

    files = written(ranged.mapInArrow(run, "part bigint, path string, n_docs bigint, n_ids bigint"), "id-files")
    return files.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, read back.

    ``start`` counts the ids of all documents before it: files are summed in ``part`` order (one row
    per file), places inside a file come from its index.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.select("path", "first").repartition(partitions(files.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, name = open_files(path)
                with system.open_input_file(name) as stream:
                    found = Reader(stream, stream.size())
                    sums = found.checksums()
                ends = np.cumsum(found.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.docs, pa.int64()),
                        pa.array(ends - found.counts + first),
                        pa.array(found.counts),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
