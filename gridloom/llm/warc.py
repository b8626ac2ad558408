"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Archives are files of gzip members, of one record or many each, plain files of
records, or both in turn. The reader goes through a file by byte ranges and holds one
record at a time. It checks each member's checksum, each record's header, length and
payload digest. Where a check fails it searches for the next member or version line
that starts a valid record, goes on there, and logs the bytes between as quarantined.
Of a member that fails, the records stay whose own digests prove them; the member's
bytes are logged all the same. If only its checksum fails its end is known, and reading goes
on there; else the search begins inside it, and records that it gave aren't given again.

Defined cases: null html is an empty payload; a null url becomes an empty target;
control characters in urls are percent-encoded; among equal payloads of at least
`least` bytes the largest page_id is the response, repeated rows of it are all
responses, and a null page_id is never the largest unless all are null. A very long
payload is a record like any other, up to what a value of Spark holds. A header line
that begins with a blank goes on with the line before. An empty table writes no
archive. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Read, closed, range_reader, write_file
from .common import bounded, partitions, written

VERSION, MEMBER = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
FILE_BYTES = 16 << 20
#: Parts of a hot digest's pages.
SALTS = 16
#: Bytes of an archive that are read at once, that are decompressed at once, and that come out at once.
BLOCK, WINDOW, OUT = 1 << 20, 16 << 10, 1 << 18
#: The most bytes of a member's records that are held until its checksum is met; of more, the member is read twice.
HELD = 8 << 20
MARK = re.compile(re.escape(MEMBER) + rb"|WARC/1\.")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        head, gap, rest = self.block.partition(b"\r\n\r\n")
        return rest if gap and head.startswith(b"HTTP/") else self.block

    @property
    def digest(self) -> str | None:
        name, _, value = self.headers.get("warc-payload-digest", "").partition(":")
        return base64.b32decode(value).hex() if name == "sha1" and re.fullmatch("[A-Z2-7]{32}", value) else None


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(rid: str) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", rid.strip())
    return int(number[1]) if number and number[1] else None


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A record's bytes; with refers_to it is a revisit, which has no payload but its digest and length."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", digest),
    ]
    block = HTTP + payload
    if refers_to is not None:
        block = HTTP
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """Bytes of an archive by position; one block of them is held."""

    def __init__(self, read: Read, size: int) -> None:
        self.read, self.size, self.at, self.held = read, size, 0, b""
        self.searched = (0, -1)

    def __call__(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        if start >= stop:
            return b""
        if start < self.at or stop > self.at + len(self.held):
            self.at, self.held = start, self.read(start, min(self.size, max(stop, start + BLOCK)))
        return self.held[start - self.at : stop - self.at]

    def header_end(self, start: int) -> int:
        """Where the next empty line begins, -1 without one; what a search has found is known to those that begin behind it."""
        since, found = self.searched
        if since <= start <= found:
            return found
        if since <= start and found < 0 < since:
            return -1
        at = start
        while at < self.size:
            part = self(at, at + BLOCK)
            if (k := part.find(b"\r\n\r\n")) >= 0:
                self.searched = (start, at + k)
                return at + k
            at += max(1, len(part) - 3)
        self.searched = (max(start, 1), -1)
        return -1

    def mark(self, start: int) -> int:
        """Where the next member or version line may begin; the end without one."""
        while start < self.size:
            part = self(start, start + BLOCK)
            if found := MARK.search(part):
                return start + found.start()
            start += max(1, len(part) - 6)  # a mark may lie across two blocks
        return self.size


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header, whose first line is its version. A line that begins with a blank goes on with the field before."""
    headers: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and last:
            headers[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        last = name.decode("utf-8", "replace").strip().lower()
        headers[last] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        raise ValueError("content length")
    return headers


def proof(record: Record) -> bool | None:
    """Whether the payload has the digest that the header names; None where it names none for it."""
    if record.headers.get("warc-type") != "response" or not record.digest:
        return None
    return record.digest == hashlib.sha1(record.payload).hexdigest()


def parse(data: Archive, at: int) -> tuple[Record, int]:
    """The record at a version line and where it ends; ValueError names the check that failed."""
    if data(at, at + 7) != b"WARC/1.":
        raise ValueError("version line")
    stop = data.header_end(at)
    if stop < 0:
        raise ValueError("header end")
    headers = fields(data(at, stop))
    start = stop + 4
    end = start + int(headers["content-length"])
    if end + 4 > data.size or data(end, end + 4) != b"\r\n\r\n":
        raise ValueError("record end")
    record = Record(headers, data(start, end))
    if proof(record) is False:
        raise ValueError("payload digest")
    return record, end + 4


def deflated_from(data: Archive, at: int) -> int:
    """Where the compressed bytes of a gzip member begin."""
    flags, pos = data(at + 3, at + 4), at + 10
    if not flags or flags[0] & 0xE0:
        raise ValueError("gzip header")
    if flags[0] & 4:
        pos += 2 + int.from_bytes(data(pos, pos + 2), "little")
    for bit in (8, 16):  # a name, a comment
        if flags[0] & bit:
            while (part := data(pos, pos + 256)) and b"\0" not in part:
                pos += len(part)
            pos += part.find(b"\0") + 1
    return pos + 2 * (flags[0] >> 1 & 1)


class Member:
    """A gzip member, decompressed as its records are asked for. Its checksum is compared here, so that what comes before an error isn't lost."""

    def __init__(self, data: Archive, at: int) -> None:
        self.data, self.held, self.z = data, bytearray(), zlib.decompressobj(-15)
        self.pos, self.tail, self.sum, self.size, self.broken = deflated_from(data, at), b"", 0, 0, False

    @property
    def end(self) -> int:
        """Where the member ends, once all of it was read, or how far it was read."""
        return min(self.data.size, self.pos - len(self.z.unused_data) + 8) if self.z.eof else self.pos - len(self.tail)

    def inflated(self) -> bytes:
        """What the next window gives; up to a bad byte if there is one."""
        before = self.z.copy()
        try:
            return self.z.decompress(self.tail, OUT)
        except zlib.error:
            out, self.z, self.broken = [], before, True
            for k in range(len(self.tail)):
                try:
                    out.append(self.z.decompress(self.tail[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out)

    def more(self) -> bool:
        if self.broken:
            raise ValueError("gzip member")
        if self.z.eof:
            return False
        if not self.tail:
            self.tail = self.data(self.pos, self.pos + WINDOW)
            self.pos += len(self.tail)
        out = self.inflated()
        if not self.tail and not out and not self.z.eof:
            raise ValueError("gzip end")
        self.tail = b"" if self.broken else self.z.unconsumed_tail
        self.sum, self.size = zlib.crc32(out, self.sum), self.size + len(out)
        self.held += out
        return True

    def filled(self, n: int) -> bool:
        while len(self.held) < n and self.more():
            pass
        return len(self.held) >= n

    def records(self) -> Iterator[Record]:
        while self.filled(1):
            if not self.filled(7) or not self.held.startswith(b"WARC/1."):
                raise ValueError("version line")
            looked = 0
            while (stop := self.held.find(b"\r\n\r\n", looked)) < 0:
                looked = max(0, len(self.held) - 3)
                if not self.more():
                    raise ValueError("header end")
            headers = fields(bytes(self.held[:stop]))
            end = stop + 4 + int(headers["content-length"])
            if not self.filled(end + 4) or self.held[end : end + 4] != b"\r\n\r\n":
                raise ValueError("record end")
            yield Record(headers, bytes(self.held[stop + 4 : end]))
            del self.held[: end + 4]
        at = self.pos - len(self.z.unused_data)
        if self.data(at, at + 8) != (self.sum & 0xFFFFFFFF).to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little"):
            raise ValueError("gzip checksum")


Stretch = tuple[int, int, "Record | None", str]


def member(data: Archive, at: int) -> tuple[Iterator[Stretch], int, str, int]:
    """What a member holds, how far it goes, the check it failed, and how many records it gave. It is read once more if it holds much, as its checksum comes last."""
    m, kept, size, n, why = None, [], 0, 0, ""
    try:
        m = Member(data, at)
        for record in m.records():
            n += 1
            size += len(record.block)
            kept = [*kept, record] if size <= HELD else []
        if not n:
            why = "empty member"
    except ValueError as e:
        why = str(e)
    end = m.end if m else at + 1

    def found() -> Iterator[Stretch]:
        for _, record in zip(range(n), kept if size <= HELD else Member(data, at).records(), strict=False):
            good = proof(record)
            if why:
                if good:
                    yield at, end, record, ""
            elif good is False:
                yield at, end, None, "payload digest"
            else:
                yield at, end, record, ""

    return found(), end, why, n


def name_of(record: Record) -> bytes:
    return hashlib.blake2b(repr(sorted(record.headers.items())).encode(), digest_size=16).digest()


def salvage(archive: bytes | Archive) -> Iterator[Stretch]:
    """start, end, record and failed check of every stretch of an archive; a gap has no record. Records of one member have its start and end.

    While the search is inside a member that failed, the names of the records it gave are held.
    """
    data = archive if isinstance(archive, Archive) else Archive(lambda a, z: archive[a:z], len(archive))
    at, bad, said = 0, None, ""
    given: Counter[bytes] = Counter()
    inside = 0
    while at < data.size:
        failed, stretches, end, n = "", iter(()), at, 1
        if at >= inside:
            given.clear()
        if zipped := data(at, at + 3) == MEMBER:
            stretches, end, failed, n = member(data, at)
        else:
            try:
                record, end = parse(data, at)
                stretches = iter([(at, end, record, "")])
            except ValueError as e:
                failed = str(e)
        if failed:
            if bad is None:
                bad, said = at, failed
            for stretch in stretches:
                if at < inside and given[name_of(stretch[2])]:
                    given[name_of(stretch[2])] -= 1
                    continue
                given[name_of(stretch[2])] += 1
                yield stretch
            if zipped and failed == "gzip checksum":
                at = end
                continue
            inside = max(inside, end if zipped and n else 0)
            at = data.mark(at + 1)
            continue
        if at < inside and not zipped and given[name_of(record)]:
            given[name_of(record)] -= 1
            at = end
            continue
        if bad is not None:
            yield bad, at, None, said
            bad = None
        yield from stretches
        at = end
    if bad is not None:
        yield bad, data.size, None, said


def write(pages: DataFrame, folder: str, least: int = 1000, zipped: bool = True, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes page_id, url, html as archives; returns file, records, bytes of each, a written table."""
    own = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= least
    groups = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).where(long)
    groups = groups.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # A digest that many pages have is met in SALTS places, should the groups be too many to be told to all tasks.
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    groups = written(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "first-pages")
    joined = salted.join(bounded(groups), ["digest", "salt"], "left").withColumn("refers_to", F.when(long & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:08d}-{seq:06d}.warc" + ".gz" * zipped
            write_file(folder, name, b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)], "bytes": [size]})

        for b in it:
            for page_id, url, payload, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = render(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                if zipped:
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                held.append(data)
                size += len(data)
                if size >= file_bytes:
                    yield flush()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    done = joined.select("page_id", "url", "payload", "refers_to").sortWithinPartitions("page_id").mapInArrow(run, "file string, records long, bytes long")
    return written(done, "warc-files")


ROWS = "file string, start long, stop long, failed string, headers map<string,string>, digest string, payload binary"
_ROWS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("failed", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _rows(path: str, archive: bytes | Archive) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for start, stop, record, why in salvage(archive):
        payload = record.payload if record else b""
        rows.append((path, start, stop, None, list(record.headers.items()), record.digest, payload) if record else (path, start, stop, why, None, None, None))
        size += len(payload) + 1000
        if size >= 4 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def read(spark: SparkSession, folder: str, files: DataFrame | None = None, ranges: bool = True) -> DataFrame:
    """A row for each record or gap: file, start, stop, failed, headers, digest, payload; digest is the hexadecimal form of the header's.

    Read are the files named in `files` (file: names in the folder), or all of the
    folder. They are read by ranges; with ranges=False whole, which serves stores that
    only Spark opens and needs archives that fit in memory.
    """

    def by_ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column("path").to_pylist():
                source = range_reader(path)
                yield from _rows(path, Archive(source, source.size))
                closed(source)

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield from _rows(path, content.as_py())

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder) if files is None or not ranges else None
    if not ranges:
        if files is not None:
            found = found.join(files.select("file"), F.element_at(F.split("path", "/"), -1) == F.col("file"), "left_semi")
        return found.select("path", "content").mapInArrow(whole, ROWS)
    paths = found.select("path") if files is None else files.select(F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("path"))
    return paths.repartition(partitions(spark), "path").mapInArrow(by_ranges, ROWS)


def quarantined(records: DataFrame) -> DataFrame:
    """The log of byte gaps."""
    return records.where("failed is not null").select("file", "start", "stop", "failed")


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read."""
    header = lambda k: F.element_at("headers", k)
    page = lambda k: F.regexp_extract(header(k), r"<urn:page:(-?\d+)>", 1)
    number = lambda k: F.when(F.length(page(k)) > 0, page(k).cast("long"))
    revisit = header("warc-type") == "revisit"
    return records.where("failed is null").select(
        number("warc-record-id").alias("page_id"),
        F.when(revisit, header("x-payload-length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        header("warc-type").alias("record_type"),
        F.when(revisit, number("warc-refers-to")).alias("refers_to"),
    )


def archived(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as archives in folder, reads back the files that were committed, and returns pages_of what was read."""
    files = write(pages, folder)
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return pages_of(read(spark, folder, files))
