"""WARC archives: a writer of one gzip member for each record, and a salvage reader.

The writer's tasks write files of bounded size to a folder that all executors share (any file system that
pyarrow opens by its URI); every attempt uses names of its own and only the files that the finished job lists count, so
a repeated task leaves nothing double. Records with a payload that an earlier page has become revisits.

The salvage reader checks every member (CRC, header, length, digest). After a failed check it looks
for the next place where a valid member or version line stands, recovers the records from there on,
and logs the bytes between as quarantined. Within a member of several records it does the same; of a member that is cut short or
corrupt it takes what can be inflated.

Cases: a null page is an empty payload. Null URLs become ``urn:none``. Rows that repeat the smallest page id of a payload are
all responses. A page without an id has the record id ``urn:page:none``, read back as null; it is a revisit if a page with an id has its
payload, else a response (SQL's ``page_id = first`` calls that a revisit of nothing, but its bytes would be stored nowhere). A page id on
several payloads gives a record for each, a revisit only where that payload's first page is another. An empty table gives no
files and no records. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir, small_batches

#: Compressed bytes after which the writer begins a new file: the reader holds a file in memory.
FILE_BYTES = 8 << 20
#: Files that a task reads back, as long as that needs no more than so many tasks.
FILES_PER_TASK, MOST_TASKS = 2, 20_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base-32 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC, _VERSION, HEAD_END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
CUT = "gzip: the member is cut short"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit record without the payload where first is given."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if first is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", REVISIT)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


class Damaged(ValueError):
    """A record that fails a check."""


class Marks:
    """Where a mark next stands in a file's bytes: its place is kept until a search begins beyond it, so that many searches take one pass."""

    def __init__(self, data: bytes, mark: bytes):
        self.data, self.mark, self.asked, self.found = data, mark, 0, -1

    def after(self, at: int) -> int:
        """The first place from ``at`` on, the length of the bytes where there is none."""
        if not self.asked <= at <= self.found:
            found = self.data.find(self.mark, at)
            self.asked, self.found = at, len(self.data) if found < 0 else found
        return self.found


def parse_record(data: bytes, start: int = 0, ends: Marks | None = None) -> tuple[dict[str, str], bytes, int]:
    """The header, the block and the end of the record that starts at a place; raises Damaged."""
    if data[start : start + len(_VERSION)] != _VERSION:
        raise Damaged("no version line")
    end = (ends or Marks(data, HEAD_END)).after(start)
    if end == len(data):
        raise Damaged("no end of the header")
    header = {}
    at = data.find(b"\r\n", start)
    if not data[start + len(_VERSION) : at].strip().isdigit():
        raise Damaged("no version line")
    while at < end:
        stop = data.find(b"\r\n", at + 2)
        name, colon, value = data[at + 2 : stop].partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = stop
    length = header.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    at = end + 4
    block = data[at : at + int(length)]
    if len(block) < int(length) or data[at + int(length) : at + int(length) + 4] != b"\r\n\r\n":
        raise Damaged("the block is cut short or its length is wrong")
    digest = header.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise Damaged("the block's digest is wrong")
    return header, block, at + int(length) + 4


def _inflate(data: bytes, start: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at a place, where it ends, and what is wrong with it, if anything: then the content is what
    comes before the damage."""
    unpack, out, at = zlib.decompressobj(31), io.BytesIO(), start
    try:
        while not unpack.eof and at < len(data):
            out.write(unpack.decompress(data[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(data))
    except zlib.error as error:
        # The failed call's bytes are lost; once more, byte by byte from there.
        again, trouble = zlib.decompressobj(31), f"gzip: {error}"
        again.decompress(data[start:at])
        try:
            for at in range(at, min(at + (1 << 16), len(data))):
                out.write(again.decompress(data[at : at + 1]))
        except zlib.error:
            pass
        return out.getvalue(), at, trouble
    if not unpack.eof:
        return out.getvalue(), at, CUT
    return out.getvalue(), at - len(unpack.unused_data), None


def _records(plain: bytes):
    """Yield ('record', start, end, header, block) and ('gap', start, end, reason, None) over a member's content."""
    at, begin, reason = 0, None, None
    ends, versions = Marks(plain, HEAD_END), Marks(plain, _VERSION)
    while at < len(plain):
        try:
            header, block, end = parse_record(plain, at, ends)
        except Damaged as error:
            if begin is None:
                begin, reason = at, str(error)
            at = versions.after(at + 1)
            continue
        if begin is not None:
            yield "gap", begin, at, reason, None
            begin = None
        yield "record", at, end, header, block
        at = end
    if begin is not None:
        yield "gap", begin, len(plain), reason, None


def _member(data: bytes, start: int, ends: Marks) -> tuple[list[tuple], int, str | None]:
    """Of the gzip member or plain record at a place what salvage() yields, where it ends, and what is wrong with the member; raises
    Damaged if nothing can be had of it."""
    if data[start : start + 3] != _MAGIC:
        header, block, end = parse_record(data, start, ends)
        return [("record", start, end - start, header, block)], end, None
    plain, end, trouble = _inflate(data, start)
    found = list(_records(plain))
    if trouble is None:
        within = lambda x: x[3] if x[1:3] == (0, len(plain)) else f"{x[3]} (bytes {x[1]} to {x[2]} of the member's content)"
        return [(x[0], start, end - start, within(x) if x[0] == "gap" else x[3], x[4]) for x in found], end, None
    # Without the member's CRC only a digest shows that a block is whole; what comes before a cut has not been touched.
    good = [x for x in found if x[0] == "record" and (trouble == CUT or x[3].get("warc-block-digest", "").startswith("sha1:"))]
    if not good:
        raise Damaged(trouble)
    lost, at = [], 0
    for x in [*good, ("end", len(plain), len(plain))]:
        if x[1] > at:
            lost.append(f"{at} to {x[1]}")
        at = x[2]
    note = f"{trouble}; of its content {len(good)} records are recovered" + (f", lost are bytes {', '.join(lost)}" if lost else "")
    return [("record", start, end - start, header, block) for _, _, _, header, block in good], end, note


def salvage(data: bytes):
    """Yield ('record', offset, length, header, block) and ('gap', offset, length, reason, None) over a file's bytes. A record in a gzip
    member has the member's offset and length, and so has a gap between the records of a sound member. A damaged member gives the
    records before its damage, then a gap from its start on."""
    at, begin, reason = 0, None, None
    ends, members, versions = Marks(data, HEAD_END), Marks(data, _MAGIC), Marks(data, _VERSION)
    while at < len(data):
        try:
            found, end, trouble = _member(data, at, ends)
        except Damaged as error:
            if begin is None:
                begin, reason = at, str(error)
            at = min(members.after(at + 1), versions.after(at + 1))
            continue
        if begin is not None:
            yield "gap", begin, at - begin, reason, None
            begin = None
        yield from found
        if trouble is None:
            at = end
        else:
            # A version line in what was inflated is a stored block's, whose records have been had.
            begin, reason = at, trouble
            at = min(members.after(at + 1), versions.after(end))
    if begin is not None:
        yield "gap", begin, len(data) - begin, reason, None


def mark_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """page_id, url, payload and first (the page a record revisits, else null). Only ids and digests are shuffled to find
    the first pages; one more shuffle by page id and digest joins them with the payloads."""
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = rows.select("page_id", "digest", F.length("payload").alias("n")).filter(F.col("n") >= least)
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).filter("pages > 1")
    later = keys.join(firsts.select("digest", "first"), "digest").filter("first IS NOT NULL AND NOT page_id <=> first")
    later = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct()
    marked = rows.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return marked.select("page_id", "url", "payload", "first")


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, first) as .warc.gz files into a folder; returns the list of files (path, records, bytes)."""

    def run(batches):
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        parts, held, n, files = [], 0, 0, 0

        def flush():
            nonlocal parts, held, n, files
            name = f"{stem}-{files:04d}.warc.gz"
            with target.open_output_stream(f"{root}/{name}", compression=None) as out:
                for x in parts:
                    out.write(x)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [held]}, schema=_FILES)
            parts, held, n, files = [], 0, 0, files + 1
            return row

        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                member = gzip_member(build_record(page, url, payload, first))
                parts.append(member)
                held += len(member)
                n += 1
                if held >= FILE_BYTES:
                    yield flush()
        if parts:
            yield flush()

    rows = records.select("page_id", "url", "payload", "first")
    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


_READ = (
    "kind string, path string, offset long, length long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_READ_ARROW = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def _page(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _row(path: str, found, with_payload: bool) -> dict:
    kind, offset, length, header, block = found
    row = dict.fromkeys(_READ_ARROW.names) | {"kind": kind, "path": path, "offset": offset, "length": length}
    if kind == "gap":
        return row | {"reason": header}
    kind_of = header.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in header.get("content-type", "") else block
    digest, size = sha1_base32(payload), len(payload)
    if kind_of == "revisit":
        digest = header.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = int(header["x-payload-length"]) if header.get("x-payload-length", "").isdigit() else None
    return row | {
        "page_id": _page(header.get("warc-record-id")), "url": header.get("warc-target-uri"), "record_type": kind_of, "refers_to": _page(header.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload else None,
    }


def _batches(path: str, data: bytes, with_payload: bool):
    """What salvage() yields of a file, in batches of 512 rows or 4 MB of payloads."""
    held, size = [], 0
    for found in salvage(data):
        held.append(_row(path, found, with_payload))
        size += len(held[-1]["payload"] or b"")
        if len(held) >= 512 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=_READ_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_READ_ARROW)


def read_archives(spark: SparkSession, paths: list[str], with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of archive files (kind 'record' or 'gap'). A file is one unit of work."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(path.as_py(), data.as_py() or b"", with_payload)

    if not paths:
        return spark.createDataFrame([], _READ)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, _READ)


def read_written(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """What read_archives() gives, of the files that write_archives() lists: the list stays a table, whose tasks read the files themselves. A file
    from which fewer or more records come than were written is an error."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, place = fs.FileSystem.from_uri(path)
                with source.open_input_stream(place, compression=None) as file:
                    data = file.read()
                read = 0
                for rows in _batches(path, data, with_payload):
                    read += rows.column(0).to_pylist().count("record")
                    yield rows
                if read != wanted:
                    raise RuntimeError(f"{path}: {wanted} records were written, {read} are read")

    # Some MB for each task, whose number no hash of a short list of files decides.
    parts = max(1, min(-(-files.count() // FILES_PER_TASK), MOST_TASKS))
    return files.select("path", "records").repartition(parts).mapInArrow(run, _READ)


def archive_pages(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages as WARC records and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(mark_revisits(pages, least), folder)
    found = read_written(files, with_payload=False).filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
