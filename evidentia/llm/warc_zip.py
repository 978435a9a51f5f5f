"""WARC records in ZIP-packaged web archives.

``write_archives`` packs records into archive files of about ARCHIVE_BYTES in a
shared folder: a ZIP with the stored member archive/data.warc.gz (one gzip member a
record), its index indexes/index.cdxj and datapackage.json. Each task names its files
itself, and a written table lists those of the tasks that succeeded.

``records_of`` reads such files, its own or others', of any size, in two steps. One
task an archive reads its end record, ZIP64 locator and end record, central directory
with ZIP64 sizes, the stored members' places and the index lines. The lines are dealt
out by the part of the file that they point to, and each record is read by its own
seek and range. Nothing is extracted; only the ranges asked for are read. ``records``
does the same for archives that are binary cells, as Spark's binaryFile source gives
them for stores that only Spark can open; such an archive ends at 2 GB.

Equal payloads of at least `least` bytes become one response, that with the
smallest page_id, and revisits that refer to it.

Nulls: a null payload is an empty payload, a null url has no target header. A
null page_id never is the first of several; rows that repeat the first's page_id
are responses as well. A damaged or missing archive or record gives a row with its
error and no payload, never an exception. Empty tables give empty results, and other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, shared_folder, slices, written

ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PAGE = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


SALTS = 16  # parts of a payload that many pages repeat


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to of pages (page_id, url, payload): the page that a repeated payload refers to.

    Digests of repeated payloads alone are gathered, but every page moves once to learn what it refers to; those of one payload
    are dealt over SALTS parts.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("payload", F.lit(bytearray())).alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_size", F.octet_length("payload")).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    firsts = rows.where(F.col("_size") >= least).groupBy("_sha1", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    firsts = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    return rows.join(firsts, ["_sha1", "_size", "_salt"], "left").select("page_id", "url", "payload", refers.alias("refers_to"))


# ---------------------------------------------------------------- writing
def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"<{PAGE}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {page_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {page_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def index_key(url: str | None) -> str:
    """The url as the first word of an index line, without what could be taken for the line's second word or its JSON."""
    return one_line(url or "-").replace(" ", "%20").replace("{", "%7B")


def archive(rows: list[tuple[int | None, str | None, bytes, int | None]], zip64: bool = False) -> bytes:
    """A ZIP-packaged archive of the records of rows (page_id, url, payload, refers_to)."""
    data, index = io.BytesIO(), []
    for page_id, url, payload, refers_to in rows:
        member = gzip.compress(record(page_id, url, payload, refers_to), 4, mtime=0)
        line = {"url": url, "digest": payload_digest(payload), "offset": data.tell(), "length": len(member), "filename": RECORDS.rpartition("/")[2]}
        index.append(f"{index_key(url)} 20240101000000 {json.dumps(line)}")
        data.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((RECORDS, data.getvalue()), (INDEX, "\n".join(sorted(index)).encode()), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                f.write(content)
    return out.getvalue()


def archived(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive and content: ZIP archives of the records of rows (page_id, url, payload, refers_to), in the order that tasks meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in archives_of(batches, archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


def archives_of(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[tuple[str, bytes]]:
    from pyspark import TaskContext

    n = 0
    for batch in batches:
        for part in slices(batch, "payload", archive_bytes):
            yield f"{TaskContext.get().partitionId():06d}-{n:06d}.wacz", archive(list(zip(*(column(part, c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")))))
            n += 1


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with or without a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archive files of the records of rows to a shared folder; returns the written table of their archive (path) and size.

    A task that runs twice leaves files under two names, of which the table lists one.
    """
    folder = folder or f"{shared_folder(rows.sparkSession)}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = uuid.uuid4().hex
        for name, content in archives_of(batches, archive_bytes):
            path = f"{folder}/{attempt}-{name}"
            store, inside = opened(path)
            store.create_dir(inside.rpartition("/")[0], recursive=True)
            with store.open_output_stream(inside) as out:
                out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64())], ["archive", "size"])

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, size long"), "archives")[0]


# ---------------------------------------------------------------- reading
class Damaged(ValueError):
    pass


Read = Callable[[int, int], bytes]  # (offset, length) -> bytes


def exactly(read: Read, offset: int, length: int) -> bytes:
    got = read(offset, length)
    if offset < 0 or len(got) != length:
        raise Damaged(f"{length} bytes at {offset} are not there")
    return got


def directory(read: Read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP archive: name -> (method, stored bytes, bytes, offset of the local header)."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = exactly(read, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise Damaged("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = exactly(read, tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise Damaged("no ZIP64 locator")
        record64 = exactly(read, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != b"PK\6\6":
            raise Damaged("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    entries, at, out = exactly(read, start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\1\2" or at + 46 > len(entries):
            raise Damaged("bad central directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, at + 20)
        offset = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        stored, full, offset = wide_sizes(extra, stored, full, offset)
        out[name] = (method, stored, full, offset)
        at += 46 + n_name + n_extra + n_comment
    return out


def wide_sizes(extra: bytes, stored: int, full: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset of a directory entry, from its ZIP64 field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4)) if at + 4 + n // 8 * 8 <= len(extra) else []
            try:
                full = values.pop(0) if full == 0xFFFFFFFF else full
                stored = values.pop(0) if stored == 0xFFFFFFFF else stored
                offset = values.pop(0) if offset == 0xFFFFFFFF else offset
            except IndexError:
                raise Damaged("short ZIP64 field") from None
        at += 4 + n
    return stored, full, offset


def member_place(read: Read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """First byte and length of a member's data."""
    _, stored, _, offset = entry
    local = exactly(read, offset, 30)
    if local[:4] != b"PK\3\4":
        raise Damaged("no local header")
    return offset + 30 + sum(struct.unpack_from("<HH", local, 26)), stored


def member(read: Read, entry: tuple[int, int, int, int]) -> bytes:
    """A whole small member, such as an index."""
    data = exactly(read, *member_place(read, entry))
    if entry[0] == 0:
        return data
    if entry[0] != 8:
        raise Damaged(f"compression method {entry[0]}")
    try:
        return zlib.decompress(data, -15)
    except zlib.error as e:
        raise Damaged(str(e)) from None


def index_lines(read: Read, members: dict[str, tuple[int, int, int, int]]) -> Iterator[str]:
    """The JSON of each index line of an archive, not yet parsed: what follows the second blank, or the first '{' in other lines; plain and gzipped indexes."""
    for name, entry in members.items():
        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx", ".cdx.gz")):
            data = member(read, entry)
            for line in (gzip.decompress(data) if name.endswith(".gz") else data).decode("utf-8", "replace").split("\n"):
                third = "".join(line.split(" ", 2)[2:]).lstrip()
                if third.startswith("{"):
                    yield third
                elif "{" in line:
                    yield line[line.find("{") :]


def parse_record(raw: bytes) -> dict:
    """A WARC record's type, page, url, and its payload's size, digest and bytes (none for a revisit)."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise Damaged("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    out = {"record_type": fields.get("warc-type"), "page_id": page_of(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri"), "refers_to": page_of(fields.get("warc-refers-to", "")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    if out["record_type"] == "revisit":
        sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return out | {"payload_bytes": int(sizes[0]) if sizes else None, "payload": None}
    found = payload_digest(payload)
    if out["payload_digest"] not in (None, found):
        raise Damaged("the payload's digest differs")
    return out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}


def page_of(name: str) -> int | None:
    number = name.strip("<>").removeprefix(PAGE)
    return int(number) if number.lstrip("-").isdigit() else None


#: What a damaged or foreign archive may raise.
FAULTS = (Damaged, ValueError, TypeError, KeyError, OverflowError, OSError, EOFError, zlib.error, struct.error)


def record_places(read: Read, size: int) -> Iterator[tuple[int, int]]:
    """First byte and length of each record that an archive's indexes name; raises one of FAULTS for a damaged archive, gives it for a damaged line."""
    members = directory(read, size)
    places = {n.rpartition("/")[2]: member_place(read, e) for n, e in members.items() if n.startswith("archive/") and e[0] == 0}
    for text in index_lines(read, members):
        try:
            line = json.loads(text)
            start, length = places[line["filename"]]
            at, n = int(line["offset"]), int(line["length"])
            if at < 0 or n < 0 or at + n > length:
                raise Damaged("a record lies outside its member")
            yield start + at, n
        except FAULTS as e:
            yield e


def read_record(read: Read, at: int, n: int) -> dict:
    try:
        raw = exactly(read, at, n)
        return parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw) | {"offset": at, "length": n}
    except FAULTS as e:
        return {"error": named_fault(e)}


def named_fault(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def read_archive(read: Read, size: int) -> Iterator[dict]:
    """The records that the indexes of a ZIP-packaged archive name, each read by its own range."""
    try:
        for place in record_places(read, size):
            yield {"error": named_fault(place)} if isinstance(place, Exception) else read_record(read, *place)
    except FAULTS as e:
        yield {"error": named_fault(e)}


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "offset": pa.int64(), "length": pa.int64(), "error": pa.string()}


RECORDS_SCHEMA = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, offset long, length long, error string"
READ_BYTES = 8 << 20  # of an archive that one task reads in a row


def batch_of(names: list[str], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([r.get(c) for r in rows], t) for c, t in FIELDS.items()]], ["archive", *FIELDS])


def records(archives: DataFrame) -> DataFrame:
    """All records of archives (archive, content), with their place in the archive; error is set where something is damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(column(batch, "archive").to_pylist(), column(batch, "content")):
                view = memoryview(content.as_buffer() or b"") if content.is_valid else memoryview(b"")
                rows = list(read_archive(lambda at, n, view=view: bytes(view[at : at + n]), len(view)))
                yield batch_of([name] * len(rows), rows)

    return archives.select("archive", "content").mapInArrow(run, RECORDS_SCHEMA)


class Ranges:
    """Reads ranges of one file at a time."""

    def __init__(self, path: str):
        store, inside = opened(path)
        self.path, self.file = path, store.open_input_file(inside)
        self.size = self.file.size()

    def __call__(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            return b""
        self.file.seek(offset)
        return self.file.read(length)


TASK_BYTES = 32 << 20  # of archives for each task of the second step, about


def records_of(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """All records of archive files, for the paths in column archive; like records().

    The lines of the indexes are small beside what they point to, so the number of
    tasks that read records comes from the archives' sizes (column size), if they are known.
    """
    if tasks is None:
        known = archives.agg(F.sum("size")).first()[0] or 0 if "size" in archives.columns else 0
        tasks = max(archives.sparkSession.sparkContext.defaultParallelism, -(-known // TASK_BYTES))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in column(batch, "archive").to_pylist():
                found: list = []
                try:
                    read = Ranges(path)
                    for place in record_places(read, read.size):
                        found.append((-1, 0, named_fault(place)) if isinstance(place, Exception) else (*place, None))
                        if len(found) == 50_000:
                            yield line_batch(path, found)
                            found = []
                except (*FAULTS, AttributeError) as e:
                    found.append((-1, 0, named_fault(e)))
                yield line_batch(path, found)

    def line_batch(path: str, found: list) -> pa.RecordBatch:
        at, n, error = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(error, pa.string())], ["archive", "offset", "length", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for batch in batches:
            paths, at, n, errors = (column(batch, c).to_pylist() for c in ("archive", "offset", "length", "error"))
            rows, names, held = [], [], 0
            for path, offset, length, error in zip(paths, at, n, errors):
                try:
                    if error is None and (read is None or read.path != path):
                        read = Ranges(path)
                    rows.append({"error": error} if error is not None else read_record(read, offset, length))
                except FAULTS as e:
                    rows.append({"error": named_fault(e)})
                names.append(path)
                held += rows[-1].get("payload_bytes") or 0
                if held >= READ_BYTES:
                    yield batch_of(names, rows)
                    rows, names, held = [], [], 0
            yield batch_of(names, rows)

    lines = archives.select("archive").mapInArrow(indexed, "archive string, offset long, length long, error string")
    part = F.expr(f"offset div {READ_BYTES}")
    return lines.repartition(tasks, "archive", part).sortWithinPartitions("archive", "offset").mapInArrow(run, RECORDS_SCHEMA)
