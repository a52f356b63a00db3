"""WARC archives: written from pages, read back sequentially.

Each record is one gzip member, so a reader can take the file front to back
with one decompressor a record and never needs more than the record at hand.
Pages whose payload was seen under a smaller page id become ``revisit``
records without a payload, as the WARC 1.1 revisit profile has it.

Tasks write archives of bounded size straight to the shared folder under names
that no other attempt uses, and return a manifest row for each finished
archive. Only archives in the manifest are read, so what a lost or repeated
task leaves behind does no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.llm.common import scratch_path, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are stored each time.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
LEVEL = 6
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length: *(\d+)", re.I)


class WarcError(ValueError):
    """A record that is cut short, badly framed, or fails its digest."""


def _open(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "r":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of its bytes that must be used up."""
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        unpacker = zlib.decompressobj(31)

        def data():
            nonlocal rest
            while True:
                try:
                    out = unpacker.decompress(rest, READ_BYTES)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                rest = unpacker.unconsumed_tail
                if out:
                    yield out
                if unpacker.eof:
                    rest = unpacker.unused_data
                    return
                if not rest and not (rest := stream.read(READ_BYTES)):
                    raise WarcError("the archive ends inside a record")
        yield data()


def read_record(data: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, framed by its content length and verified."""
    buffer = bytearray()
    for part in data:
        buffer += part
        if (end := buffer.find(b"\r\n\r\n")) >= 0:
            break
    else:
        raise WarcError("a record without the end of its header")
    first, *lines = buffer[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise WarcError(f"not a WARC record: {first[:20]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    for part in data:
        buffer += part
    block = bytes(buffer[end + 4:end + 4 + size])
    if len(block) != size or buffer[end + 4 + size:] != b"\r\n\r\n":
        raise WarcError("a record that is not as long as its content length says")
    _verify(headers.get("warc-block-digest"), block, "block")
    return headers, block


def _verify(named: str | None, data: bytes, what: str) -> None:
    if named is not None and named != f"sha256:{hashlib.sha256(data).hexdigest()}":
        raise WarcError(f"the {what} does not have its digest")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """Payload (None for a revisit) and full payload length; a payload is verified."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    size = int(_HTTP_LENGTH.search(head)[1])
    if not mark:
        raise WarcError("a block without the end of its HTTP header")
    if headers["warc-type"] == "revisit":
        return None, size
    if len(payload) != size:
        raise WarcError("a payload that is not as long as its HTTP header says")
    _verify(headers["warc-payload-digest"], payload, "payload")
    return payload, size


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload a smaller page id has."""
    known = pages.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    return (known.distinct().join(first, "digest").where("refers_to is not null and not page_id <=> refers_to")
            .select("page_id", "digest", "refers_to"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES,
                   date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page and return the manifest: path, n_records, n_bytes.

    ``pages``: page_id (long), url, html. ``folder`` is a path or URI that
    pyarrow can write to on every executor.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    r = revisits(p, min_revisit_bytes).toDF("r_page", "r_digest", "refers_to")
    p = p.join(r, (p.digest == r.r_digest) & p.page_id.eqNullSafe(r.r_page), "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                data = record(page_id, url, html.encode(), refers_to, date)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        cols = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                         ["path", "n_records", "n_bytes"])

    return written(p.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Every archive is read front to back by one task; framing and digests are
    verified and a fault raises ``WarcError``. ``payload`` is null for
    revisits, and for all records unless ``with_payload``.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, n = [], 0, 0
                with _open(path, "r") as stream:
                    for data in members(stream):
                        headers, block = read_record(data)
                        payload, size = payload_of(headers, block)
                        rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"],
                                     number(headers.get("warc-refers-to")), size, headers["warc-payload-digest"].removeprefix("sha256:"),
                                     payload if with_payload else None))
                        n, held = n + 1, held + (size if with_payload else 200)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if n != expected:
                    raise WarcError(f"{path} has {n} records, its manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    m = manifest.select("path", "n_records")
    return m.repartition(max(1, m.count()), "path").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back; one row per input row.

    Null html is an empty payload; a null url is an empty URI, and control
    characters and blanks in a url are percent-encoded; a null page_id is never
    referred to, but may refer. Repeated rows of the smallest page id are all
    responses. An empty table writes nothing and gives an empty result; other
    columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), with_payload=False).drop("payload", "url")
