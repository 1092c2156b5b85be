"""WARC archives, and the normaliser of archives that are one gzip stream.

`write_archives` writes pages as WARC files of which each is a single gzip
stream, as some crawlers leave them: no record can be read without inflating
all before it.  `normalise` inflates every such file once, rewrites each record
as a gzip member of its own, turns records whose payload another one keeps into
revisits, and writes a sidecar with the offset of each record.  `read_records`
reads records back, each from its own place.

Files are written under fresh names below the shared folder; only those that a
finished task reports are ever read, so a lost executor leaves no half archive
in use.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import encoded, map_arrow
from pairloom.llm.exact import keepers
from pairloom.session import materialise, scratch_path

GZIP = 31
CHUNK = 1 << 20
# An archive is closed at the first record beyond either bound.
ARCHIVE_BYTES = 64 << 20
ARCHIVE_RECORDS = 100_000
# Bytes of an archive that one task reads back.
RUN_BYTES = 16 << 20
# Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _block(headers: list[tuple[str, str]], content: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + END + content + END


def response(page_id, url: str | None, payload: bytes) -> bytes:
    """A response record; line ends in the url would break the header and are percent-encoded."""
    target = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    return _block(
        [("WARC-Type", "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), *target,
         ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http;msgtype=response")],
        http + payload,
    )


def revisit(record: "Record", keep_id) -> bytes:
    """The record without its payload, pointing at the page that keeps it."""
    kept = [(k, v) for k, v in record.headers if k not in ("WARC-Type", "Content-Length")]
    return _block(
        [("WARC-Type", "revisit"), *kept, ("WARC-Refers-To", _name(keep_id)),
         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")],
        record.http + END,
    )


class Record:
    """A parsed record: its WARC headers, the HTTP header, the payload."""

    def __init__(self, head: bytes, content: bytes) -> None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.headers = [tuple(line.split(": ", 1)) for line in lines[1:]]
        self.by_name = dict(self.headers)
        self.raw = head + END + content + END
        self.http, _, self.payload = content.partition(END)

    @property
    def payload_bytes(self) -> int:
        """Of the full payload, which a revisit leaves out."""
        if self.by_name["WARC-Type"] == "response":
            return len(self.payload)
        fields = dict(line.split(": ", 1) for line in self.http.decode().split("\r\n")[1:])
        return int(fields["Content-Length"])


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip stream of one or several members, piece by piece."""
    machine = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            if part := machine.decompress(data, 4 * CHUNK):
                yield part
            data = machine.unconsumed_tail
            if machine.eof:
                data, machine = machine.unused_data, zlib.decompressobj(GZIP)
    if part := machine.flush():
        yield part


def records(stream) -> Iterator[Record]:
    """The records of a compressed archive in one pass, holding one record at a time."""
    held = bytearray()
    parts = inflated(stream)

    def upto(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while upto(1):
        while (at := held.find(END)) < 0:
            if not upto(len(held) + 1):
                raise ValueError("an archive ends inside a header")
        head = bytes(held[:at])
        size = next(int(x[16:]) for x in head.decode().split("\r\n") if x.lower().startswith("content-length: "))
        start = at + len(END)
        if not upto(start + size + len(END)):
            raise ValueError("an archive ends inside a record")
        yield Record(head, bytes(held[start : start + size]))
        del held[: start + size + len(END)]


def opened(uri: str):
    """(file system, path) of a location as the cluster names it."""
    return fs.FileSystem.from_uri(uri)


class _Archive:
    """A file being written as a single gzip stream."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = opened(self.uri)
        self.out = system.open_output_stream(path, compression=None)
        self.gzip = zlib.compressobj(1, wbits=GZIP)
        self.bytes = self.records = 0

    def add(self, record: bytes) -> int:
        self.out.write(self.gzip.compress(record))
        self.bytes += len(record)
        self.records += 1
        return self.records - 1

    def close(self) -> None:
        self.out.write(self.gzip.flush())
        self.out.close()

    @property
    def full(self) -> bool:
        return self.bytes >= ARCHIVE_BYTES or self.records >= ARCHIVE_RECORDS


def _folder(df: DataFrame, label: str) -> str:
    folder = scratch_path(df.sparkSession, label)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return folder


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a response record per row into archives of one gzip stream each: path, seq, page_id, digest, sha256, size."""
    folder = folder or _folder(pages, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder)
                seq = archive.add(response(page_id, url, payload))
                rows.append((archive.uri, seq, page_id, payload_digest(payload), hashlib.sha256(payload).hexdigest(), len(payload)))
                if archive.full:
                    archive.close()
                    archive = None
            names = ["path", "seq", "page_id", "digest", "sha256", "size"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)
        if archive:
            archive.close()

    narrow = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), encoded("html").alias("payload"))
    return materialise(map_arrow(narrow, run, "path string, seq bigint, page_id bigint, digest string, sha256 string, size bigint"))


def revisits(written: DataFrame, least: int = 0) -> DataFrame:
    """path, seq, keep_id of records whose payload (of at least so many bytes) another record keeps.

    Payloads are equal when both digests are: payloads of one SHA-1 can be made.
    """
    rows = written.where(F.col("size") >= least).select(
        F.concat_ws(":", "digest", "sha256").alias("digest"), "page_id", F.struct("path", "seq").alias("row")
    )
    return keepers(materialise(rows), "digest", "page_id", "row").where(~F.col("kept")).select("row.path", "row.seq", "keep_id")


def normalise(written: DataFrame, again: DataFrame, folder: str | None = None, level: int = 6) -> DataFrame:
    """Rewrites every archive record by record: path, offset, length per record; a sidecar <path>.idx has the same.

    `again` names the records that become revisits.  An archive's list of them
    is bounded by its number of records.
    """
    folder = folder or _folder(written, "members")
    lists = again.groupBy("path").agg(F.collect_list(F.struct("seq", "keep_id")).alias("again"))
    paths = materialise(written.select("path").distinct())
    # One archive a task: the number is given, for rows as small as these would else be put together.
    todo = paths.join(lists, "path", "left").repartition(max(1, paths.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, turned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keeps = {x["seq"]: x["keep_id"] for x in turned or ()}
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, path = opened(source)
                to, name = opened(target)
                offsets, lengths, lines, at = [], [], [], 0
                with system.open_input_stream(path, compression=None) as stream, to.open_output_stream(name, compression=None) as out:
                    for seq, record in enumerate(records(stream)):
                        body = revisit(record, keeps[seq]) if seq in keeps else record.raw
                        machine = zlib.compressobj(level, wbits=GZIP)
                        member = machine.compress(body) + machine.flush()
                        out.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        lines.append(json.dumps({"id": record.by_name["WARC-Record-ID"], "offset": at, "length": len(member)}))
                        at += len(member)
                with to.open_output_stream(f"{name}.idx", compression=None) as out:
                    out.write("".join(line + "\n" for line in lines).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["path", "offset", "length"],
                )

    return materialise(map_arrow(todo, run, "path string, offset bigint, length bigint"))


def read_records(index: DataFrame) -> DataFrame:
    """Reads each record from its place: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response whose payload doesn't have its stated digest is an error.  Each
    archive's records are read by a task for every RUN_BYTES.
    """
    index = index.select("path", "offset", "length", F.floor(F.col("offset") / RUN_BYTES).alias("run"))
    runs = index.select("path", "run").distinct().count()
    index = index.repartition(max(1, runs), "path", "run").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != uri:
                    system, name = opened(path)
                    uri, file = path, system.open_input_file(name)
                raw = zlib.decompress(file.read_at(length, offset), wbits=GZIP)
                head, _, content = raw.partition(END)
                record = Record(head, content[: -len(END)])
                named, kind = record.by_name, record.by_name["WARC-Type"]
                digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(record.payload) != digest:
                    raise ValueError(f"payload of {named['WARC-Record-ID']} in {path} is damaged")
                rows.append((
                    _page(named["WARC-Record-ID"]), named.get("WARC-Target-URI"), record.payload_bytes, digest, kind,
                    _page(named.get("WARC-Refers-To")), record.payload if kind == "response" else None,
                ))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return map_arrow(
        index.select("path", "offset", "length"),
        run,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary",
    )


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written, normalised and read back: one record per row of pages.

    Of equal payloads of at least `least` bytes the largest page_id (null is
    smallest) is a response, of repeated rows of that page one; the others are
    revisits.  A null html is an empty payload; a null url leaves its header
    out.  An empty table gives an empty result; other columns are ignored.
    """
    written = write_archives(pages)
    return read_records(normalise(written, revisits(written, least)))
