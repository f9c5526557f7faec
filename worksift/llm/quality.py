"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, and
probabilities calibrated by one temperature."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from worksift.llm.common import data, mix, packed, slices, unpacked, whole_text, words

SAMPLE_ROWS = 6_000  # labelled rows a model is fitted on, at most
SAMPLE_BYTES = 24_000_000  # and the bytes of their texts
LONG_BYTES = SAMPLE_BYTES // 100  # longer texts are taken after the others
WORD_BITS, SHAPE_BITS = 14, 10
DIMENSIONS = 64
HIDDEN = 32
EPOCHS = 400
THRESHOLD = 0.3
_NONZERO = 8  # entries of an index vector that are not 0
_STEP = 1 << 17  # words worked on at once

# Kinds of bytes, by which the shape of a word is told.
_KIND = np.full(256, 7, np.int64)
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "#*$%&|<>"]] = 6


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its shape, and the number of words of each text.

    The shape tells the kinds of its first and last byte, whether all letters are capitals, its
    length, and whether the word is one of the three before it."""
    raw, starts = data(texts)
    hashed, per, first = words(raw, starts, lower=False)
    if not len(hashed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), per
    solid = ~np.isin(raw, (9, 10, 11, 12, 13, 32))
    length = np.add.reduceat(solid, first, dtype=np.int64)
    capitals = np.add.reduceat(_KIND[raw] == 1, first, dtype=np.int64)
    smalls = np.add.reduceat(_KIND[raw] == 0, first, dtype=np.int64)
    size = np.digitize(length, (2, 4, 13))
    shout = (capitals > 0) & (smalls == 0) & (length > 1)
    doc = np.repeat(np.arange(len(per)), per)
    again = np.zeros(len(hashed), bool)
    for back in (1, 2, 3):
        again[back:] |= (hashed[back:] == hashed[:-back]) & (doc[back:] == doc[:-back])
    shape = _KIND[raw[first]]
    for part, count in ((_KIND[raw[first + length - 1]], 8), (size, 4), (shout, 2), (again, 2)):
        shape = shape * count + part
    return (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64), shape, per


def index_vectors(count: int, seed: int) -> np.ndarray:
    """Fixed sparse random vectors: a few entries of +1 and -1 each, placed by hashes."""
    out = np.zeros((count, DIMENSIONS), np.float32)
    rows = np.arange(count, dtype=np.uint64) + np.uint64(seed << 32)
    for k in range(_NONZERO):
        h = mix(rows * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        np.add.at(out, (np.arange(count), (h % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def context_vectors(ids: np.ndarray, per: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Random indexing: each bucket's own index vector and those of the two words on either side of
    all its places, unit length. Buckets never met keep their index vector."""
    total = index.copy()
    doc = np.repeat(np.arange(len(per)), per)
    for at in range(0, len(ids), _STEP):
        lo, hi = max(at - 2, 0), min(at + _STEP + 2, len(ids))
        part, home = ids[lo:hi], doc[lo:hi]
        around = np.zeros((len(part), DIMENSIONS), np.float32)
        for step in (1, 2):
            if len(part) <= step:
                continue
            near = (home[step:] == home[:-step])[:, None]
            around[step:] += index[part[:-step]] * near
            around[:-step] += index[part[step:]] * near
        own = slice(at - lo, at - lo + min(_STEP, len(ids) - at))
        for d in range(DIMENSIONS):
            total[:, d] += np.bincount(part[own], around[own, d], len(index)).astype(np.float32)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pooled(ids: np.ndarray, shapes: np.ndarray, per: np.ndarray, of_word: np.ndarray, of_shape: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and log length of every text; zeros without words."""
    out = np.zeros((len(per), 2 * DIMENSIONS + 1), np.float32)
    ends = np.cumsum(per)
    n = np.maximum(per, 1)[:, None]
    for row in range(len(per)):  # whole texts; a long one in steps
        for at in range(ends[row] - per[row], ends[row], _STEP):
            part = slice(at, min(at + _STEP, ends[row]))
            out[row, :DIMENSIONS] += of_word[ids[part]].sum(axis=0)
            out[row, DIMENSIONS:-1] += np.bincount(shapes[part], minlength=len(of_shape)).astype(np.float32) @ of_shape
    out[:, :-1] /= n
    out[:, -1] = np.log1p(per) / 10
    return out


@dataclass
class Model:
    """Word and shape vectors, scaling, network weights and the temperature."""

    of_word: np.ndarray
    of_shape: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.maximum(((x - self.mean) / self.scale).astype(np.float64) @ w1 + b1, 0)
        return hidden @ w2 + b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = pooled(*features(texts), self.of_word, self.of_shape)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Two layers, fitted by Adam on all rows at once with a small weight penalty."""
    rng = np.random.default_rng(seed)
    layers = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    first, second = ([np.zeros_like(w) for w in layers] for _ in range(2))
    for epoch in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = layers
        raw = x @ w1 + b1
        hidden = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
        error = (p - y) / len(y)
        back = np.outer(error, w2) * (raw > 0)
        slopes = [x.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ error + 1e-4 * w2, np.array([error.sum()])]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            step = (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
            layers[k] = layers[k] - 0.01 * step
    return layers


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    z = np.where(y == 1, logits, -logits)
    return float(grid[np.argmin([np.logaddexp(0, -z / t).mean() for t in grid])])


def held_out(doc_id: Column) -> Column:
    """Rows labels are never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of the labelled rows to learn from: in the order of a hash of the id, the
    first ``SAMPLE_ROWS`` of at most ``SAMPLE_BYTES`` each. Ids labelled both ways are left out."""
    return usable(docs, labels).where(F.col("size") <= SAMPLE_BYTES).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(SAMPLE_ROWS)


def usable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality, size`` of the rows that may be learned from."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other").select("doc_id", "quality")
    )
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size")).where("size > 0")
    return known.join(sizes, "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from a bounded sample of labelled rows that are not held out; null, with a warning if
    there are labels, without rows of both. A sample that lacks a label which the table has is an
    error. Only word buckets of the sample reach the driver, two numbers a word.

    A text that does not fit into what is left of ``SAMPLE_BYTES`` is passed over, and texts over
    ``LONG_BYTES`` come last, so that one of them does not take the place of a hundred others."""
    chosen, size = [], 0
    for row in sorted(sample(docs, labels).collect(), key=lambda r: r["size"] > LONG_BYTES):
        if size + row["size"] <= SAMPLE_BYTES:
            size += row["size"]
            chosen.append((row["doc_id"], row["quality"]))
    if len({q for _, q in chosen}) < 2:
        kinds = usable(docs, labels).select("quality").distinct().count()
        if kinds == 2:
            raise ValueError(f"no sample of both labels within {SAMPLE_ROWS} rows and {SAMPLE_BYTES} bytes")
        if kinds:
            warnings.warn("only one label to learn from: every score is 0.5", stacklevel=2)
        return None
    spark = docs.sparkSession
    # At most SAMPLE_ROWS rows of two numbers.
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, quality int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, shapes, per = features(batch.column("text"))
            ends = np.cumsum(per)
            cut = lambda x: [x[e - n : e].astype(np.uint16).tobytes() for n, e in zip(per, ends, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "quality": batch.column("quality"),
                    "words": pa.array(cut(ids), pa.binary()),
                    "shapes": pa.array(cut(shapes), pa.binary()),
                }
            )

    rows = (
        docs.select("doc_id", whole_text()).join(picked, "doc_id")
        .mapInArrow(run, "doc_id bigint, quality int, words binary, shapes binary")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    per = np.array([len(r["words"]) // 2 for r in rows])
    ids = np.frombuffer(b"".join(r["words"] for r in rows), np.uint16).astype(np.int64)
    shapes = np.frombuffer(b"".join(r["shapes"] for r in rows), np.uint16).astype(np.int64)
    y = np.array([r["quality"] for r in rows])
    of_word = context_vectors(ids, per, index_vectors(1 << WORD_BITS, 1))
    of_shape = context_vectors(shapes, per, index_vectors(1 << SHAPE_BITS, 2))
    x = pooled(ids, shapes, per, of_word, of_shape)
    model = Model(of_word, of_shape, x.mean(0), x.std(0) + 1e-3, [])
    z = (x - model.mean) / model.scale
    # One row in four calibrates and is not trained on.
    held = np.array([mix(np.array([r["doc_id"]], np.int64).astype(np.uint64))[0] % np.uint64(4) == 0 for r in rows])
    if len(set(y[~held])) < 2 or not held.any():
        held = np.zeros(len(y), bool)
    model.layers = train(z[~held], y[~held])
    part = held if held.any() else ~held
    model.temperature = max(1.0, temperature(model.logits(x[part]), y[part]))
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` (distinct column names) with ``held_out, score, predicted``; columns of these names are replaced.

    The score is the calibrated probability of label 1 from the whole text alone; null and empty
    texts are scored as texts without words. Without labels to learn from, every score is 0.5.
    Repeated rows score alike; an empty table gives an empty one. Vectors and weights (5 MB at any
    size of the input) are broadcast.
    """
    made = ("held_out", "score", "predicted")
    rest = docs.drop(*made)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in slices(batches, "_text"):
            texts = batch.column("_text")
            scores = known.scores(texts) if known else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, "score"])

    schema = StructType([*rest.schema.fields, StructField("score", DoubleType())])
    scored = rest.select("*", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)
    return scored.select(
        *names, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted as label 1, with their columns, whatever these are called."""
    return unpacked(classify(packed(docs), labels).where("predicted = 1"), docs)
