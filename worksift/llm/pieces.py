"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

Text is normalised by longest-prefix matches against the model's compiled character map. Every byte
of the normalised text remembers the original byte its rule began at, so a piece, which is a span
of normalised bytes, projects to a span of original bytes. Segmentation itself is the library's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from worksift.llm.common import slices, whole_text

_SPACE = "▁".encode()  # what a space becomes


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 prefixes, then the replacements.

    Layout (public format): a little-endian u32 with the trie's size in bytes, the trie as u32
    units, and the replacements as NUL-ended strings. A unit holds a label in its low byte, a flag
    for a value at bit 8, and the offset of its children above.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest mapped prefix of ``text[at:]`` (0: none) and its replacement."""
        if not self.units:
            return 0, b""
        found, value = 0, 0
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for length, byte in enumerate(text[at:], 1):
            node ^= byte
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found, value = length, self.units[node] & 0x7FFFFFFF
        if not found:
            return 0, b""
        return found, self.texts[value : self.texts.index(b"\0", value)]


class Normalizer:
    """Normalised bytes of a text and, for each of them and the end, the original byte it stems from."""

    def __init__(self, spec, symbols: tuple[bytes, ...] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.squeeze = spec.remove_extra_whitespaces
        self.dummy = spec.add_dummy_prefix
        self.space = _SPACE if spec.escape_whitespaces else b" "
        self.identity = not self.map.units and not self.symbols and not self.squeeze

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.identity:  # only spaces change: the same result without a walk over the bytes
            raw = np.frombuffer(text, np.uint8)
            width = np.where(raw == 32, len(self.space), 1)
            places = np.repeat(np.arange(len(raw)), width)
            lead = self.space if self.dummy else b""
            out = lead + text.replace(b" ", self.space)
            return out, np.concatenate([np.zeros(len(lead), np.int64), places, [len(raw)]])
        out, places = self._walk(text)
        if not out:
            return b"", np.array([len(text)])
        if self.dummy:
            out, places = self.space + out, [places[0]] * len(self.space) + places
        return out, np.array([*places, len(text)] if not self.squeeze else [*places, self._end])

    def _walk(self, text: bytes) -> tuple[bytes, list[int]]:
        """Rule by rule; with ``squeeze``, spaces at both ends go and runs become one."""
        out, places, at = bytearray(), [], 0
        blank = self.squeeze  # whether the last character was a space, or there was none
        end = 0
        while at < len(text):
            taken, put = self._rule(text, at)
            if blank:
                put = put.lstrip(b" ")
            for byte in put:
                if byte == 32:
                    if self.squeeze and blank:
                        continue
                    out += self.space
                    places += [at] * len(self.space)
                else:
                    out.append(byte)
                    places.append(at)
                blank = self.squeeze and byte == 32
            at += taken
            if put and not blank:
                end = at
        self._end = end
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space) :], places[-len(self.space) :]
        return bytes(out), places

    def _rule(self, text: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.symbols:
            if text.startswith(symbol, at):
                return len(symbol), symbol
        taken, put = self.map.longest(text, at)
        if taken:
            return taken, put
        lead = text[at]
        taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return taken, text[at : at + taken]


class Pieces:
    """A model with its normaliser and the normalised length of every piece."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(model, "rb") as file:
            spec = proto.ModelProto.FromString(file.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        kind = proto.ModelProto.SentencePiece
        symbols = tuple(p.piece.encode() for p in spec.pieces if p.type == kind.USER_DEFINED)
        self.normalize = Normalizer(spec.normalizer_spec, symbols)
        self.width = np.array([1 if p.type == kind.BYTE else len(p.piece.encode()) for p in spec.pieces])
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN}
        self.digits = [str(i).encode() for i in range(len(spec.pieces))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last original byte of every piece. A piece made of part of one rule's
        output has the span of the whole rule's input start, so spans can be empty but never
        overlap backwards."""
        normal, places = self.normalize(text.encode())
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if self.unknown and not self.unknown.isdisjoint(ids):
            width = self._surface_widths(text)
        ends = np.cumsum(width)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        return places[ends - width], places[ends]

    def _surface_widths(self, text: str) -> np.ndarray:
        """Widths where unknown pieces stand for whole runs of characters."""
        found = self.library.encode(text, out_type="immutable_proto").pieces
        return np.array([len(p.surface.replace(" ", _SPACE.decode()).encode()) for p in found])


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str, spans: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array of int), ``decoded`` (text) and, with ``spans``,
    ``starts`` and ``ends`` (arrays of long: original UTF-8 byte spans).

    A null or empty text has no ids, no spans and decodes to an empty text. Rows are judged one by
    one, so repeated rows and ids give repeated results, and an empty table an empty one. Columns
    named like the results are replaced. ``model`` is a path every executor can open.
    """
    made = ["ids", "decoded", *(["starts", "ends"] if spans else [])]
    rest = [c for c in docs.columns if c not in made]
    kept = docs.select(*rest)
    extra = "ids array<int>, decoded string" + (", starts array<bigint>, ends array<bigint>" if spans else "")
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches, "text", 1 << 21):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = pieces.encode(texts)
            columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([pieces.library.decode(i) for i in ids], pa.string())]
            if spans:
                both = [pieces.spans(t, i) for t, i in zip(texts, ids, strict=True)]
                columns += [pa.array([b[k] for b in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*rest, *made])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes`` of every row: the digests of
    ``encode``'s results, made where they arise so that id lists never leave the task.
    ``covered_bytes`` sums the lengths of the original spans."""
    rows = docs.select("doc_id", whole_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in slices(batches, "text", 1 << 21):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "covered_bytes": []}
            texts = batch.column("text").to_pylist()
            for text, ids in zip(texts, pieces.encode(texts), strict=True):
                starts, ends = pieces.spans(text, ids)
                digits = pieces.digits
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(b",".join([digits[i] for i in ids])).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest())
                out["covered_bytes"].append(int((ends - starts).sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **out})

    return rows.mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint"
    )
