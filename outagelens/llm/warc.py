"""WARC archives: one gzip member per record, written by the tasks and read back as a stream."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import run_folder, stored

CHUNK = 1 << 16            # bytes read at a time
ARCHIVE_BYTES = 256 << 20  # compressed size at which a task opens its next archive
MIN_REVISIT = 100          # smaller payloads are always stored


# ---------------------------------------------------------------- record format

def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + b"\r\n" + payload + b"\r\n\r\n") + gz.flush()


class DigestError(ValueError):
    """A record whose payload does not have the digest or the length its header states."""


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of a binary stream, in order.

    The stream is read in chunks; every gzip member is inflated incrementally
    and framed by its Content-Length, and a stated SHA-256 is verified unless
    the record is a revisit, which carries no payload. Truncated members, bad
    frames and wrong digests raise.
    """
    raw = stream.read(CHUNK)
    while raw:
        gz, text, headers, need, crc = zlib.decompressobj(31), bytearray(), None, 0, None
        while not gz.eof:
            if not raw:
                raise DigestError("the archive ends inside a record")
            text += gz.decompress(raw)
            raw = gz.unused_data if gz.eof else stream.read(CHUNK)
            if headers is None and (end := text.find(b"\r\n\r\n")) >= 0:
                version, *lines = bytes(text[:end]).decode().split("\r\n")
                if not version.startswith("WARC/"):
                    raise DigestError(f"not a record: {version[:40]}")
                headers = {k: v for k, _, v in (line.partition(": ") for line in lines)}
                need = int(headers["Content-Length"])
                del text[:end + 4]
        if headers is None or len(text) != need + 4 or text[need:] != b"\r\n\r\n":
            raise DigestError("a record is not framed by its Content-Length")
        payload = bytes(text[:need])
        stated = headers.get("WARC-Payload-Digest", "")
        if headers.get("WARC-Type") != "revisit" and stated and stated != digest(payload):
            raise DigestError(f"wrong digest of {headers.get('WARC-Record-ID')}")
        yield headers, payload
        raw = raw or stream.read(CHUNK)


def digest(payload: bytes) -> str:
    return f"sha256:{hashlib.sha256(payload).hexdigest()}"


# ---------------------------------------------------------------- writing and reading with Spark

def _filesystem(folder: str):
    """(file system, path) of a folder named by a URI or a plain path, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Write one record per row to ``folder`` and return the manifest (archive, records, bytes).

    Of the rows with equal payloads of at least 100 bytes the one with the
    smallest id becomes a response, the others revisits that refer to it.
    Rows whose id is null and smaller payloads are always responses (a row
    without an id is no target either). Null payloads are empty. Rows that
    repeat an id with the same payload: the first written is indistinguishable
    from the others, all are responses.

    A task writes its records in order to files named by partition, under a
    name of the attempt first and then renamed, so a repeated or speculative
    task leaves the same files and the manifest lists only finished ones.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha2(F.col("payload"), 256)).withColumn("n", F.octet_length("payload"))
    groups = (rows.where(f"n >= {MIN_REVISIT} and id is not null").groupBy("sha")
              .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    linked = rows.join(groups, "sha", "left").withColumn(
        "refers", F.expr(f"case when n >= {MIN_REVISIT} and id <> first then first end"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        number, out, name, size, count, made = 0, None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{base}/part-{task.partitionId():06d}-{number:04d}.warc.gz"
            where.move(name, final)
            made.append((final, count, size))
            out = None

        for batch in batches:
            for key, url, payload, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha", "refers"))):
                if out is None:
                    name = f"{base}/.part-{task.partitionId():06d}-{number:04d}.attempt-{task.taskAttemptId()}"
                    out, size, count = where.open_output_stream(name), 0, 0
                body = payload.encode()
                revisit = refers is not None
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{key}>"),
                           ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
                           ("WARC-Payload-Digest", f"sha256:{sha}"), ("Payload-Length", str(len(body)))]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                ("WARC-Refers-To", f"<urn:page:{refers}>")]
                data = record(headers, b"" if revisit else body)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    number += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
                                          pa.array([m[2] for m in made], pa.int64())], names=["archive", "records", "bytes"])

    return stored(linked.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives of a manifest: (record_id, record_type, url, payload_digest, payload_bytes,
    refers_to, payload). A revisit has no payload, but the digest and length of the full one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _filesystem(folder)
        names = ["record_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for head, payload in read_records(stream):
                        revisit = head["WARC-Type"] == "revisit"
                        length = int(head["Payload-Length"])
                        if not revisit and length != len(payload):
                            raise DigestError(f"wrong length of {head['WARC-Record-ID']}")
                        rows.append((head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], head["WARC-Payload-Digest"],
                                     length, head.get("WARC-Refers-To"), None if revisit else payload))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    paths = manifest.select("archive")
    spread = max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 4, 10_000))
    return paths.repartition(spread).mapInArrow(
        read, "record_id string, record_type string, url string, payload_digest string, payload_bytes long, "
              "refers_to string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = run_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, id_col, url_col, payload_col), folder)
