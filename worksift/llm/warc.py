"""WARC archives: records written as gzip members, and a sequential reader that checks them.

The reader inflates one member at a time in bounded pieces, frames the block by Content-Length and
verifies block and payload digests. Records with equal payloads are stored once; the others are
``revisit`` records that keep the HTTP header (and so the payload's length) and its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksift.llm.common import files_folder, open_files, partitions
from worksift.plans.storage import written

_PIECE = 1 << 16
_MAX_HEADER = 1 << 20
DATE = "2024-01-01T00:00:00Z"  # capture time: the tables hold none


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, row_id: str, url: str, payload: bytes, payload_digest: str, refers_to: int | None = None) -> bytes:
    """One uncompressed record. A revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{row_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


class _Members:
    """The inflated bytes of one gzip member after another, never more than asked for."""

    def __init__(self, stream):
        self.stream, self.rest, self.inflate = stream, b"", None

    def begin(self) -> bool:
        """Starts the next member; false at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(_PIECE)
        self.inflate = zlib.decompressobj(31) if self.rest else None
        return bool(self.rest)

    def some(self) -> bytes:
        """The next piece of the member, empty at its end."""
        while not self.inflate.eof:
            raw = self.inflate.decompress(self.rest or self.inflate.unconsumed_tail, _PIECE)
            self.rest = self.inflate.unused_data if self.inflate.eof else b""
            if raw:
                return raw
            if not self.inflate.eof and not self.inflate.unconsumed_tail:
                self.rest = self.stream.read(_PIECE)
                if not self.rest:
                    raise ValueError("archive ends inside a record")
        return b""


def records(stream) -> Iterator[dict]:
    """Records of an archive in order: ``headers`` (lower-case names) and what its block held:
    ``length`` (the HTTP Content-Length), ``stored`` (payload bytes read), ``sha1`` (of them).
    A digest or length that does not agree raises ``ValueError``; payloads are never held whole."""
    members = _Members(stream)
    while members.begin():
        held = b""

        def head() -> list[str]:
            nonlocal held
            while b"\r\n\r\n" not in held:
                piece = members.some()
                if not piece or len(held) > _MAX_HEADER:
                    raise ValueError("record without a header end")
                held += piece
            top, _, held = held.partition(b"\r\n\r\n")
            return top.decode("utf-8").split("\r\n")

        first, *lines = head()
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(headers["content-length"])
        outer = hashlib.sha1()
        http = head()
        top = "\r\n".join(http).encode() + b"\r\n\r\n"
        outer.update(top)
        left -= len(top)
        inner, stored = hashlib.sha1(), 0
        while left:
            piece = held[:left] if held else members.some()
            if not piece:
                raise ValueError("record shorter than its Content-Length")
            held = held[len(piece) :] if held else piece[left:]
            piece = piece[:left]
            outer.update(piece)
            inner.update(piece)
            stored += len(piece)
            left -= len(piece)
        while piece := members.some():
            held += piece
        if held != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")
        found = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http[1:])}
        sha1 = base64.b32encode(inner.digest()).decode()
        if headers["warc-block-digest"] != "sha1:" + base64.b32encode(outer.digest()).decode():
            raise ValueError("block digest differs")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha1:" + sha1:
            raise ValueError("payload digest differs")
        yield {"headers": headers, "length": int(found["content-length"]), "stored": stored, "sha1": sha1}


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes a record per page (``page_id, url, html``) into archives in the run's shared folder.

    Of pages with equal payloads of at least ``least`` bytes, those with the smallest non-null
    ``page_id`` are responses and the others revisit it; repeated rows with that id are all
    responses. A group that has null ids only is all responses. Null html is an empty payload, a
    null url an empty one. The result, one row per archive, is stored; only archives it names are
    read, so files of lost tasks do not matter. An empty table gives no archive.
    """
    folder = files_folder(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    # Only digests and ids are grouped, counted in every task first, so a payload that a third of
    # the pages share is a few rows. Pages with a payload of their own are not joined at all.
    repeated = (
        rows.select(key.alias("sha"), "page_id")
        .where(F.col("sha").isNotNull())
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "first")
    )
    marked = (
        rows.withColumn("sha", F.coalesce(key, F.concat(F.lit("own-"), F.col("page_id").cast("string"))))
        .join(repeated, "sha", "left")
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
        .select("page_id", "url", "html", "refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, n = None, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                system, root = open_files(folder)
                system.create_dir(root)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                stream = system.open_output_stream(f"{root}/{name}", compression=None)
            for row in batch.to_pylist():
                payload = row["html"].encode()
                refers = row["refers_to"]
                kind = "response" if refers is None else "revisit"
                row_id = "" if row["page_id"] is None else str(row["page_id"])
                raw = record(kind, row_id, row["url"], payload, digest(payload), refers)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                stream.write(packer.compress(raw) + packer.flush())
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64())})

    archives = written(marked.mapInArrow(run, "path string, n_records bigint"), "archives")
    return archives.withColumn("path", F.concat(F.lit(folder + "/"), "path"))


def read(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, one task
    per archive at a time, each read sequentially and verified."""
    spread = archives.select("path").repartition(partitions(archives.sparkSession))

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = open_files(path)
                out = []
                with system.open_input_stream(name, compression=None) as stream:
                    for found in records(stream):
                        headers = found["headers"]
                        out.append(
                            {
                                "page_id": number(headers["warc-record-id"]),
                                "payload_bytes": found["length"],
                                "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                                "record_type": headers["warc-type"],
                                "refers_to": number(headers.get("warc-refers-to")),
                            }
                        )
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, kinds)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

    return spread.mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    )
