"""WARC archives: a writer with one gzip member per record, and a splittable reader."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.files import opened_by
from tablewright.llm.tables import checked_broadcast, stored
from tablewright.runtime import scratch_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_SHARED = 1000
#: Bytes of an archive that one task scans; bytes read from storage at once.
SPLIT_BYTES, BLOCK_BYTES = 32 << 20, 1 << 20

MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = "record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes bigint, payload binary"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _member(kind: str, record_id: str, refers_to: str | None, url: str | None, digest: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(refers_to or '')}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``record_type, record_id, refers_to, url, payload_digest, payload``, an archive per task; returns the list of files.

    An archive gets its final name only when it is whole, and that name is the task's, so a task that runs again
    replaces its own file. A NULL payload is empty, a NULL url is left out, line breaks in either are escaped.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = opened_by(folder)
        files.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        draft, count, size = f"{root}/.draft-{uuid.uuid4().hex}", 0, 0
        with files.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                names = batch.schema.names
                for row in zip(*(batch.column(names.index(n)) for n in ("record_type", "record_id", "refers_to", "url", "payload_digest", "payload"))):
                    kind, record_id, refers_to, url, digest, payload = (v.as_py() for v in row)
                    size += out.write(member := _member(kind, record_id, refers_to, url, digest, payload or b"")) or len(member)
                    count += 1
        final = f"{folder.rstrip('/')}/part-{part:05d}.warc.gz"
        files.move(draft, opened_by(final)[1])
        yield pa.RecordBatch.from_pydict({"path": [final], "bytes": [size], "records": [count]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stored(records.mapInArrow(write, MANIFEST), "warc-files")


class _Source:
    """Bytes of a file by position, read in blocks; only one block is kept."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.block = handle, size, 0, b""

    def at(self, position: int) -> bytes:
        """Some bytes from ``position`` on, none at the end of the file."""
        if not self.start <= position < self.start + len(self.block):
            self.handle.seek(position)
            self.start, self.block = position, self.handle.read(BLOCK_BYTES)
        return self.block[position - self.start:]

    def find_magic(self, position: int, end: int) -> int | None:
        """The first gzip magic that starts in ``position`` to ``end - 1``."""
        tail = b""
        while position - len(tail) < end:
            piece = tail + self.at(position)
            if len(piece) == len(tail):
                return None
            hit = piece.find(MAGIC)
            if hit >= 0:
                found = position - len(tail) + hit
                return found if found < end else None
            position, tail = position + len(piece) - len(tail), piece[-2:]
        return None


def _header(data: bytes) -> dict[str, str] | None:
    """The fields of a WARC header, None if it is none; ``data`` starts at the record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    fields = dict(line.split(": ", 1) for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    return fields | {"": str(end + 4)}


def _decoded(source: _Source, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the member at ``start``; None if no whole WARC record starts there."""
    inflate, parts, seen, position, header = zlib.decompressobj(31), [], 0, start, None
    try:
        while not inflate.eof:
            if not (piece := source.at(position)):
                return None
            parts.append(out := inflate.decompress(piece))
            position, seen = position + len(piece) - len(inflate.unused_data), seen + len(out)
            if header is None:
                header = _header(head := b"".join(parts))
                parts = [head]
                if header is None and (b"\r\n\r\n" in head or inflate.eof or not b"WARC/1."[:seen] == head[:7]):
                    return None
    except zlib.error:
        return None
    data, at, length = b"".join(parts), int(header[""]), int(header["content-length"])
    return (header, data[at:at + length], position) if len(data) >= at + length else None


def records_between(handle, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of the records that start in ``start`` to ``end - 1``; the last one is read beyond the end.

    A magic counts only if a WARC header and the whole member decode from it; after a record its end is tried
    first, so bytes inside members are searched only at the start of a range and behind damage.
    """
    source, position = _Source(handle, size), start
    while (found := source.find_magic(position, end)) is not None:
        record = _decoded(source, found)
        position = record[2] if record else found + 1
        if record:
            yield record[0], record[1]


def _fields(header: dict[str, str], block: bytes) -> tuple:
    split = block.find(b"\r\n\r\n")
    http = block[:split].decode("latin-1").lower() if split >= 0 else ""
    length = next((v.strip() for k, _, v in (line.partition(":") for line in http.split("\r\n")) if k == "content-length"), "")
    payload = block[split + 4:] if split >= 0 else block
    kind = header["warc-type"]
    size = int(length) if kind == "revisit" and length.isdigit() else len(payload)
    strip = lambda name: header[name].strip("<>") if name in header else None
    digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return kind, strip("warc-record-id"), strip("warc-refers-to"), header.get("warc-target-uri"), digest, size, payload if kind != "revisit" else None


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in ``files`` (``path, bytes``), whose byte ranges are dealt to tasks.

    Damaged members are passed over. A file that stores a whole gzipped WARC record inside a payload, uncompressed, would
    show that one too, if a range starts inside the outer record.
    """
    spark = files.sparkSession
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    tasks = max(1, ranges.count())
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                held, count = [], 0
                files, local = opened_by(path)
                with files.open_input_file(local) as handle:
                    for header, block in records_between(handle, size, start, min(size, start + split_bytes)):
                        held.append(_fields(header, block))
                        count += len(block)
                        if count > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, count = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    # Ranges go round the tasks one by one; the session may allow fewer tasks than there are ranges.
    width = min(tasks, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4)
    return ranges.repartition(width).mapInArrow(read, RECORDS)


def page_records(pages: DataFrame) -> DataFrame:
    """The record of each page: of equal payloads of at least ``LEAST_SHARED`` bytes that with the largest id is kept, the others refer to it.

    Ids that are NULL come after all others; if all are NULL, all are kept. Rows that share the largest id are all kept.
    """
    body = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    body = body.withColumn("payload_digest", F.sha1("payload"))
    large = body.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("payload_digest")
    shared = large.agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    linked = body.join(checked_broadcast(stored(shared)), "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return linked.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"),
                         F.when(revisit, name("first_id")).alias("refers_to"), "url", "payload_digest", "payload")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes a record per page and reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``.

    NULL html is an empty payload; equal rows have a record each.
    """
    spark: SparkSession = pages.sparkSession
    files = write_warc(page_records(pages), scratch_path(spark, "warc"))
    back = read_warc(files)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(.*)$", 1), F.lit("")).cast("bigint")
    digest = F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(F.sha1("payload"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type",
                       number("refers_to").alias("refers_to"), "url")
