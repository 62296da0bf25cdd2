"""Web archives: pages as WARC records in ZIP packages, and a reader that fetches records by range.

A package is a ZIP file whose members are stored, not compressed: `archive/N.warc.gz` (one gzip member
a record) and `indexes/N.cdxj` (one line a record with its offset and length). Every task writes
packages of its own under a new name and reports them; the table of reports, not a listing of the
folder, says what exists, so that files of lost tasks do no harm. The reader parses the central
directory (ZIP64 too) from the end of a file, reads the indexes, deals ranges of records over all
tasks and reads no more than these. Members without an index are scanned record by record.

Of pages with equal payloads (SHA-256 of the html in UTF-8) one is written whole, the others refer to
it. Defined results: null html is an empty payload; null urls have no target; a null page_id comes
after all others and is written as `-`; of repeated rows one is the response if their page_id is the
smallest; an empty table gives no packages and no rows; further columns are not read. A payload of any
length is one record, held in memory once by one task. Paths are those that pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import common

MEMBER_BYTES, MEMBER_RECORDS = 64 << 20, 50_000  # a member of a package is closed after that much
READ_BYTES = 4 << 20  # records next to each other are read together up to this size
COPIES = 10_000  # repeats of a row that are dealt out together
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- files by range ----------------------------------------------------------------------------
def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", uri))
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tasks need it; its folder exists afterwards."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(p)
    return files.makeQualified(p).toString()


@dataclass
class Member:
    """An entry of a central directory; start is where its header stands."""

    name: str
    method: int
    flags: int
    packed: int
    size: int
    start: int


class Package:
    """A ZIP file that is read by ranges only."""

    END, END64, LOCATOR, ENTRY, HEADER = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
    MANY16, MANY32 = 0xFFFF, 0xFFFFFFFF

    def __init__(self, file) -> None:
        """file: has size() and read_at(length, offset)."""
        self.file, self.length = file, file.size()
        tail_at = max(0, self.length - 22 - 0xFFFF)
        tail = self.at(tail_at, self.length - tail_at)
        end = tail.rfind(self.END)
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(self.END, 0, end)
        if end < 0:
            raise ValueError("no end of a central directory")
        self.entries, size, offset = struct.unpack_from("<HII", tail, end + 10)
        stop = tail_at + end  # the directory ends here
        if self.entries == self.MANY16 or size == self.MANY32 or offset == self.MANY32:
            locator = self.at(stop - 20, 20) if stop >= 20 else b""
            if locator[:4] == self.LOCATOR:
                near = stop - 20 - 56  # where the record is if bytes were put in front of the file
                stop = struct.unpack_from("<Q", locator, 8)[0]
                stop = stop if self.at(stop, 4) == self.END64 else near
                record = self.at(stop, 56)
                if record[:4] != self.END64:
                    raise ValueError("no ZIP64 end of a central directory")
                self.entries, size, offset = struct.unpack_from("<QQQ", record, 32)
        self.shift = stop - size - offset  # bytes in front of the first member
        self.first, self.stop = offset + self.shift, stop

    def at(self, offset: int, length: int) -> bytes:
        out = self.file.read_at(length, offset)
        if len(out) < length:
            raise ValueError("the file ends too early")
        return bytes(out)

    def members(self) -> Iterator[Member]:
        """The entries of the central directory, which is read in portions."""
        held, at = b"", self.first
        for _ in range(self.entries):
            while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
                more = min(1 << 20, self.stop - at)
                if more <= 0:
                    raise ValueError("the central directory ends too early")
                held, at = held + self.at(at, more), at + more
            if held[:4] != self.ENTRY:
                raise ValueError("no entry of a central directory")
            flags, method = struct.unpack_from("<HH", held, 8)
            packed, size, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", held, 20)
            start = struct.unpack_from("<I", held, 42)[0]
            name, extra = held[46 : 46 + name_n], held[46 + name_n : 46 + name_n + extra_n]
            size, packed, start = self._wide(extra, size, packed, start)
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, size, start + self.shift)
            held = held[46 + name_n + extra_n + comment_n :]

    def _wide(self, extra: bytes, *narrow: int) -> list[int]:
        """Sizes and offsets of which those that do not fit stand in the ZIP64 field, in this order."""
        out, at = list(narrow), 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                return [next(values) if v == self.MANY32 else v for v in out]
            at += 4 + n
        return out

    def data(self, m: Member) -> int:
        """Where a stored member's bytes begin."""
        if m.method or m.flags & 1:
            raise ValueError(f"{m.name} is compressed or encrypted")
        header = self.at(m.start, 30)
        if header[:4] != self.HEADER:
            raise ValueError("no header of a member")
        return m.start + 30 + sum(struct.unpack_from("<HH", header, 26))

    def lines(self, m: Member) -> Iterator[bytes]:
        start, rest = self.data(m), b""
        for at in range(0, m.size, 1 << 20):
            *whole, rest = (rest + self.at(start + at, min(1 << 20, m.size - at))).split(b"\n")
            yield from whole
        if rest:
            yield rest


# --- records -----------------------------------------------------------------------------------
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, sha1: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(raw: bytes) -> dict:
    """page, url, record_type, payload (None for a revisit), payload_bytes, payload_digest, refers_to and intact of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = _fields(head)
    size = int(f["content-length"])
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    named = lambda k: re.sub("^<urn:page:|>$", "", f[k]) if k in f else None
    told, told_digest = int(_fields(http).get("content-length", -1)), f.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = f["warc-type"] != "revisit"
    own = (len(payload), digest(payload)) if whole else (told, told_digest)
    return {
        "page": named("warc-record-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "payload": payload if whole else None, "payload_bytes": own[0],
        "payload_digest": own[1], "refers_to": named("warc-refers-to"), "intact": own == (told, told_digest) and len(rest) >= size,
    }


class _Stream:
    """What zipfile writes to: a stream that cannot seek."""

    def __init__(self, out) -> None:
        self.write, self.flush = out.write, out.flush


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the records of a task to a new package and report it."""
    uri = f"{folder}/{uuid.uuid4().hex}.wacz"
    out, package, member, index, at, records, n = None, None, None, [], 0, 0, 0

    def close() -> None:
        nonlocal member, index, at, n
        member.close()
        package.writestr(f"indexes/{n:05d}.cdxj", "".join(index))
        member, index, at, n = None, [], 0, n + 1

    for b in batches:
        for r in b.to_pylist():
            if package is None:
                files, path = opened(uri)
                out = files.open_output_stream(path)
                package = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED)
            if member is None:
                member = package.open(f"archive/{n:05d}.warc.gz", "w", force_zip64=True)
            sha1 = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress(record(r["page"], r["url"], sha1, r["bytes"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["refers_to"])) + z.flush()
            member.write(raw)
            index.append(f"{r['page']} {json.dumps({'offset': at, 'length': len(raw), 'digest': sha1, 'filename': f'{n:05d}.warc.gz'})}\n")
            at, records = at + len(raw), records + 1
            if at >= MEMBER_BYTES or len(index) >= MEMBER_RECORDS:
                close()
    if package is not None:
        if member is not None:
            close()
        package.close()
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [uri], "bytes": [size], "records": [records]})


def _page(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to packages; (path, bytes, records) of each package."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("key", F.sha2(F.col("html").cast("binary"), 256))
    facts = p.select("page_id", "url", "key", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("bytes"))
    facts = common.cut(facts.groupBy(*facts.columns).agg(F.count("*").alias("copies")), "warc-pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    firsts = common.cut(facts.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")), "warc-firsts")
    rows = common.skewed_join(facts, firsts, ["key"], "n")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    again = rows.withColumn("more", F.col("copies") - is_first.cast("long")).where("more > 0")
    again = again.select(_page(F.col("page_id")).alias("page"), "url", "sha1", "bytes", _page(F.col("first.page_id")).alias("refers_to"), "more", F.explode(F.expr(f"sequence(1L, more, {COPIES}L)")).alias("k"))
    again = again.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    again = again.select("page", "url", "sha1", "bytes", "refers_to", F.lit(None).cast("string").alias("html"), F.explode(F.expr(f"sequence(k, least(more, k + {COPIES - 1}L))")).alias("k")).drop("k")
    f = firsts.select(F.col("key").alias("f_key"), F.col("first.page_id").alias("f_page"), F.col("first.url").alias("f_url"))
    whole = p.join(f, (F.col("key") == F.col("f_key")) & F.col("page_id").eqNullSafe(F.col("f_page")) & F.col("url").eqNullSafe(F.col("f_url")), "left_semi")
    if not facts.where("copies > 1").isEmpty():  # equal rows are one response
        whole = whole.groupBy("page_id", "url", "key").agg(F.first("html").alias("html"))
    whole = whole.select(_page(F.col("page_id")).alias("page"), "url", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").cast("long").alias("bytes"), F.lit(None).cast("string").alias("refers_to"), "html")
    told = "path string, bytes long, records long"
    packages = [x.mapInArrow(lambda it: _write(it, folder), told) for x in (whole, again.select(*whole.columns))]
    return common.cut(packages[0].unionByName(packages[1]), "warc-packages")


# --- reading -----------------------------------------------------------------------------------
def _scanned(package: Package, m: Member) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of a stored member without an index: gzip members, or plain records by their lengths."""
    start, at = package.data(m), 0
    while at < m.size:
        if package.at(start + at, 2) == b"\x1f\x8b":
            z, n = zlib.decompressobj(31), 0
            while not z.eof:
                part = package.at(start + at + n, min(1 << 16, m.size - at - n))
                z.decompress(part)
                n += len(part) - len(z.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                head += package.at(start + at + len(head), min(1 << 12, m.size - at - len(head)))
            head = head.partition(b"\r\n\r\n")[0]
            n = len(head) + 4 + int(_fields(head)["content-length"]) + 4
        yield start + at, n
        at += n


def ranges_of(path: str) -> Iterator[tuple[int, int]]:
    """Offset in the file and length of each record of a package, from its indexes where it has them."""
    files, local = opened(path)
    with files.open_input_file(local) as file:
        package = Package(file)
        members = {m.name: m for m in package.members()}
        indexed = set()
        for name, m in members.items():
            if name.startswith("indexes/") and name.endswith(".cdxj"):
                starts: dict[str, int] = {}
                for line in package.lines(m):
                    entry = json.loads(line[line.index(b"{") :])
                    target = "archive/" + entry["filename"]
                    if target not in starts:
                        starts[target] = package.data(members[target])
                    yield starts[target] + int(entry["offset"]), int(entry["length"])
                indexed |= starts.keys()
        for name, m in members.items():
            if name not in indexed and re.search(r"\.warc(\.gz)?$", name):
                yield from _scanned(package, m)


RECORD = "path string, page string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of packages (path): path, page, url, record_type, payload, payload_bytes, payload_digest, refers_to and intact.

    payload_bytes and payload_digest are those of the bytes read, of a revisit those of its headers;
    intact: they are as the headers say. Without payloads the column payload is null.
    """

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                found: list[tuple] = []
                for at, n in ranges_of(path):
                    found.append((path, at, n))
                    if len(found) >= 10_000:
                        yield pd.DataFrame(found, columns=["path", "at", "length"])
                        found = []
                yield pd.DataFrame(found, columns=["path", "at", "length"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        schema = pa.schema([("path", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())])
        for b in batches:
            todo = list(zip(b["path"].to_pylist(), b["at"].to_pylist(), b["length"].to_pylist(), strict=True))
            i = 0
            while i < len(todo):
                j, end = i + 1, todo[i][1] + todo[i][2]
                while j < len(todo) and todo[j][0] == todo[i][0] and todo[j][1] == end and end + todo[j][2] - todo[i][1] <= READ_BYTES:
                    end += todo[j][2]
                    j += 1
                if todo[i][0] != path:
                    if file is not None:
                        file.close()
                    path = todo[i][0]
                    files, local = opened(path)
                    file = files.open_input_file(local)
                raw = bytes(file.read_at(end - todo[i][1], todo[i][1]))
                rows = []
                for _, at, n in todo[i:j]:
                    one = raw[at - todo[i][1] : at - todo[i][1] + n]
                    r = parsed(zlib.decompress(one, 31) if one[:2] == b"\x1f\x8b" else one)
                    rows.append({"path": path} | r | ({} if payloads else {"payload": None}))
                yield pa.RecordBatch.from_pylist(rows, schema)
                i = j
        if file is not None:
            file.close()

    spark = packages.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the paths of one portion of the table would be looked at one after another
    spots = common.cut(packages.select("path").repartition(tasks).mapInPandas(locate, "path string, at long, length long"), "warc-ranges")
    spots = spots.repartition(tasks, "path", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("path", "at")
    return spots.mapInArrow(fetch, RECORD)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_archives(write_archives(common.read(spark, sf_dir, "pages")), payloads=False)
    number = lambda c: F.when(F.col(c) != "-", F.col(c).cast("long"))
    return r.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")
