"""WARC records in ZIP packages: a streaming writer and a range reader.

A package holds ``archive/data.warc.gz`` (one gzip member per record), ``indexes/index.cdxj``
(where each record lies) and ``datapackage.json``, all stored, not compressed.  The reader
parses the end record, the ZIP64 end record and locator, and the central directory; locates the
stored members; reads the index; and reads runs of records by byte range from inside the
package.  Nothing is extracted and no package is held in memory.

Packages lie under the folder that ``spark.checkpoint.dir`` names and are opened through
pyarrow's file systems.  Every task attempt writes under a name of its own and reports it when
the package is complete, so lost executors leave no half package in the list.

Defined results: a null html is an empty payload, a null url gives a record without target; all
records with a payload under LEAST bytes, or with the smallest id of their payload (repeated
rows too), are responses; null ids are never the smallest unless there is no other.  Ids may be of
any type that a cast to text and back keeps.  An empty table writes no package and reads no rows;
further columns of the input are left out, so their names can't clash.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.core.durable import cut, shared_path

LEAST = 100
#: A package is closed and the next begun beyond so many bytes.
PACKAGE_BYTES = 1 << 28
#: A range read covers so many bytes or records at most, and one record at least.
RUN_BYTES, RUN_RECORDS = 1 << 20, 256
#: A reading task covers about so many bytes of packages; tables below that are spread over all shuffle partitions.
TASK_BYTES = 1 << 27
DATE = "1970-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

WANT, READ = 0xFFFFFFFF, 0xFFFF


# --- ZIP -----------------------------------------------------------------------------------


class Packer:
    """Writes stored ZIP members to a stream that cannot seek; sizes follow each member's data."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # announces 64-bit sizes after the data
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, WANT, WANT, len(self.name), len(extra)) + self.name + extra)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        first = self.at
        for name, crc, size, start in self.members:
            big = self.zip64 or size >= WANT or start >= WANT
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            s, o = (WANT, WANT) if big else (size, start)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        length, n = self.at - first, len(self.members)
        if self.zip64 or n >= READ or first >= WANT or length >= WANT:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, first))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, READ, READ, WANT, WANT, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, length, first, 0))


def read_at(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"{length} bytes wanted at {start}, {len(data)} there")
    return data


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, compressed size, size, offset of the local header) from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(file, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, first, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if tail_at + at >= 20:
        sign, _, end64, _ = struct.unpack("<IIQI", read_at(file, tail_at + at - 20, 20))
        if sign == 0x07064B50:
            sign, _, _, _, _, _, _, count, length, first = struct.unpack("<IQHHIIQQQQ", read_at(file, end64, 56))
            if sign != 0x06064B50:
                raise ValueError("no ZIP64 end record where the locator points")
    data, at, out = read_at(file, first, length), 0, {}
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if head[0] != 0x02014B50:
            raise ValueError("broken central directory")
        method, packed, plain, n, m, k, offset = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name, extra = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, long = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                plain = next(wide) if plain == WANT else plain
                packed = next(wide) if packed == WANT else packed
                offset = next(wide) if offset == WANT else offset
            extra = extra[4 + long :]
        out[name] = (method, packed, plain, offset)
        at += 46 + n + m + k
    return out


def member(file, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes start, and how many there are."""
    method, packed, _, offset = entry
    if method != 0:
        raise ValueError("only stored members can be read by range")
    head = read_at(file, offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed


# --- WARC ----------------------------------------------------------------------------------


def record(page, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member with a WARC record."""
    name = lambda x: "<urn:page>" if x is None else f"<urn:page:{quote(x, safe='')}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member."""
    while data:
        unpacked = zlib.decompressobj(31)
        plain = unpacked.decompress(data) + unpacked.flush()
        if not unpacked.eof:
            raise ValueError("cut-off record")
        data = unpacked.unused_data
        head, _, rest = plain.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


# --- distributed ---------------------------------------------------------------------------


def _open(path: str):
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _page(name: str) -> str | None:
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name != "<urn:page>" else None


def _writer(folder: str, package_bytes: int, zip64: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        packer = out = None
        index: list[str] = []

        def close() -> None:
            packer.end()
            packer.begin(INDEX)
            for k in range(0, len(index), 4096):
                packer.write("".join(index[k : k + 4096]).encode())
            packer.end()
            packer.begin("datapackage.json")
            packer.write(json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(index)}).encode())
            packer.end()
            packer.close()
            out.close()
            done.append((name, packer.at, len(index)))

        for batch in batches:
            for row in batch.to_pylist():
                if packer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = system.open_output_stream(f"{base}/{name}")
                    packer, index = Packer(out, zip64), []
                    packer.begin(ARCHIVE)
                data = record(row["page"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["digest"], row["kind"], row["refers_to"])
                where = {"offset": packer.size, "length": len(data), "status": 200}
                index.append(f"{quote(row['page'] or '', safe='')} {DATE} {json.dumps(where)}\n")
                packer.write(data)
                if packer.at >= package_bytes:
                    close()
                    packer = None
        if packer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{n}", "bytes": b, "records": r} for n, b, r in done])

    return pack


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes every row as a record; returns (path, bytes, records) of the packages."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size")
    )
    shared = (
        rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    records = rows.join(shared, "digest", "left").select(
        F.col("page").cast("string").alias("page"), "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first").cast("string")).alias("refers_to")
    )
    return cut(records.mapInArrow(_writer(folder, package_bytes, zip64), "path string, bytes long, records long"))


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, length) of runs of records, absolute in the package."""
    for batch in batches:
        for path, size in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            system, name = _open(path)
            runs: list[dict] = []
            with system.open_input_file(name) as file:
                found = directory(file, size)
                base, length = member(file, found[ARCHIVE])
                at, left = member(file, found[INDEX])
                rest = b""
                start, count, end = 0, 0, 0
                while left:
                    data = rest + read_at(file, at, min(left, 1 << 20))
                    at, left = at + min(left, 1 << 20), left - min(left, 1 << 20)
                    lines = data.split(b"\n")
                    rest = lines.pop()
                    for line in lines:
                        where = json.loads(line.split(b" ", 2)[2])
                        if count and (count >= RUN_RECORDS or where["offset"] + where["length"] - start > RUN_BYTES):
                            runs.append({"path": path, "start": base + start, "length": end - start})
                            start, count = where["offset"], 0
                        count, end = count + 1, where["offset"] + where["length"]
                if count:
                    runs.append({"path": path, "start": base + start, "length": end - start})
                if end != length or rest:
                    raise ValueError(f"the index of {path} does not cover its archive")
            if runs:
                yield pa.RecordBatch.from_pylist(runs)


_READ = "page string, url string, payload_bytes long, payload_digest string, kind string, refers_to string"
_READ_SCHEMA = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.string())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in batch.to_pylist():
            system, name = _open(run["path"])
            out = []
            with system.open_input_file(name) as file:
                for fields, block in parse(read_at(file, run["start"], run["length"])):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                    size = int(fields["x-payload-length"])
                    if kind == "response" and (said != hashlib.sha256(payload).hexdigest() or size != len(payload)):
                        raise ValueError(f"damaged payload in {run['path']}")
                    out.append(
                        {
                            "page": _page(fields["warc-record-id"]),
                            "url": fields.get("warc-target-uri"),
                            "payload_bytes": size,
                            "payload_digest": said,
                            "kind": kind,
                            "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, schema=_READ_SCHEMA)


def read_packages(packages: DataFrame, id_type: str = "string") -> DataFrame:
    """page, url, payload_bytes, payload_digest, kind, refers_to of every record of packages (path, bytes)."""
    spark = packages.sparkSession
    size = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))  # a number, so that runs are not coalesced for being short rows
    runs = packages.select("path", "bytes").mapInArrow(_locate, "path string, start long, length long")
    found = runs.repartition(tasks, "path", "start").mapInArrow(_fetch, _READ)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Writes the pages to packages in the shared folder and reads them back."""
    packages = write_packages(pages, shared_path(pages.sparkSession, "wacz"), id_col, **options)
    return read_packages(packages, pages.schema[id_col].dataType.simpleString())
