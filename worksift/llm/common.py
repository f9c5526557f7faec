"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksift.plans.storage import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows that travel to Python at once. Whole texts may be long, so a batch of Spark's default
    10,000 rows could hold gigabytes; the session's value is only ever lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``most_bytes`` bytes, so that
    working arrays stay small. A single longer value is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def offsets(values: pa.Array) -> np.ndarray:
    """Start of each value in the data buffer and, last, the end of the last (string or binary)."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    kind = np.int64 if wide else np.int32
    found = np.frombuffer(values.buffers()[1], kind, len(values) + 1 + values.offset)
    return found[values.offset :].astype(np.int64)


def data(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and each value's start (and the end)."""
    ends = offsets(values)
    buffer = values.buffers()[2]
    if buffer is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def whole_text(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as one, so that no name of theirs can meet a name that
    an operator works with. ``unpacked`` undoes it."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    return docs.select("doc_id", "text", *([row.alias("row")] if rest else []))


def unpacked(rows: DataFrame, like: DataFrame, made: Sequence[str] = ()) -> DataFrame:
    """Rows of ``packed`` with the columns of ``like``, which was packed, and then those of ``made``."""
    rest = [c for c in like.columns if c not in ("doc_id", "text")]
    of = {c: F.col(f"row.c{k}") for k, c in enumerate(rest)}
    return rows.select(*[of[c].alias(c) if c in of else F.col(c) for c in like.columns], *made)


def files_folder(spark: SparkSession, label: str) -> str:
    """A folder for an operator's own files, below the shared folder of this run, with the scheme and
    host of the file system that Spark itself resolves it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir(spark)}/{label}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of consecutive values in ``raw``, the
    number of words of each value, and the start of each word. Words never cross a value's end.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    new = np.empty(len(raw), bool)
    new[0] = True
    np.copyto(new[1:], space[:-1])
    new[starts[:-1][starts[:-1] < len(raw)]] = True
    new &= ~space
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64), first
    value = _BYTE[_LOWER[raw] if lower else raw]
    value[space] = 0
    # Place within the word decides a byte's weight: odd multipliers, powers of one constant.
    place = np.arange(len(raw))
    place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    value *= _power(int(place.max()) + 1)[place]
    hashed = mix(np.add.reduceat(value, first))
    per = np.searchsorted(first, starts[1:]) - np.searchsorted(first, starts[:-1])
    return hashed, per, first


_POWERS = {0: np.ones(1, np.uint64)}


def _power(n: int) -> np.ndarray:
    """Powers of an odd constant, modulo 2**64."""
    have = _POWERS[0]
    while len(have) < n:
        step = np.uint64(pow(0x9E3779B97F4A7C15, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _POWERS[0] = have if len(have) <= 1 << 20 else have[: 1 << 20]
    return have


# Schemes of Hadoop's connectors and the names of the same stores here.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def store_uri(folder: str) -> str:
    """A folder with a scheme as Spark writes it (``file:/x``, ``s3a://bucket/x``), as a URI of the store.
    A path without a scheme is refused: Spark and a task could take it for different places."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"the folder has no scheme: {folder}")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def open_files(folder: str):
    """A file system for ``folder`` (as ``files_folder`` gives it), and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(store_uri(folder))
