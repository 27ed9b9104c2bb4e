"""Operator 7, WARC: ZIP packages of compressed records, whose members are located and range-read in place."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, written

#: Members of a package: the records, each a gzip stream of its own, and their places.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.txt"
#: Payload bytes after which a task begins another package, and after which a reader passes its records on.
PACKAGE_BYTES, READ_BYTES = 64 << 20, 16 << 20
#: Fixed signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, LOCATOR64, END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(name: str | None) -> str | None:
    return unquote(name[10:-1]) if name and name != "<urn:page>" else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record with the HTTP header only. Ids are text."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The fields of one record, with the payload (None for a revisit) and the HTTP header's payload length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    return {"page_id": page_of(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": page_of(fields.get("WARC-Refers-To")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "payload": payload if kind == "response" else None}


class _Package:
    """One ZIP file being written; its members are stored, as the records are compressed already."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, where = fs.FileSystem.from_uri(self.path)
        store.create_dir(where.rpartition("/")[0], recursive=True)
        self.stream = store.open_output_stream(where)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = self.payload = 0

    def add(self, data: bytes, payload: int) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.index.append(f"{self.at} {len(packed)}")
        self.at += len(packed)
        self.payload += payload

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return {"path": self.path, "records": len(self.index)}


def write_packages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into ZIP packages under `folder` and return the table of packages (path, records).

    Of rows with one payload, the one with the largest id is a response and the others revisit it; payloads are one
    if their SHA-1 digests are. Rows that share the largest id are all responses, as are rows of a payload whose ids
    are all null; null html is an empty payload, a null URL leaves its header out, and an empty table gives no
    package. Ids may be of any type that has a text form, and null or repeated. A payload, however long, is held by
    one task. Columns other than these three are left out, whatever their names. A task that runs again writes new
    packages, and only those of the attempt that succeeded are in the table.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    shared = written(rows.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1 and latest is not null").drop("n"), "shared")
    typed = rows.join(shared, "digest", "left").withColumn("refers_to", F.expr("if(latest is not null and not page_id <=> latest, latest, null)"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        package = None
        for batch in batches:
            for page, address, text, other in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                package = package or _Package(folder)
                payload = text.encode()
                package.add(record(page, address, payload, other, date), len(payload))
                if package.payload >= PACKAGE_BYTES:
                    yield pd.DataFrame([package.close()])
                    package = None
        if package:
            yield pd.DataFrame([package.close()])

    told = typed.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    return written(told.mapInPandas(write, "path string, records long"), "packages")


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of a ZIP file's stored members, by its central directory, in ZIP64 form or not."""
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        at = tail.rfind(LOCATOR64, 0, end)
        if at < 0:
            raise ValueError("no ZIP64 locator")
        file.seek(struct.unpack_from("<Q", tail, at + 8)[0])
        wide = file.read(56)
        if wide[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    file.seek(start)
    listed, found, at = file.read(length), {}, 0
    for _ in range(count):
        if listed[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, names, extras, notes, local = *struct.unpack_from("<H8xII", listed, at + 10), *struct.unpack_from("<HHH", listed, at + 28), struct.unpack_from("<I", listed, at + 42)[0]
        name, extra = listed[at + 46 : at + 46 + names].decode(), listed[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain, packed, local = (next(wide) if v == 0xFFFFFFFF else v for v in (plain, packed, local))
            extra = extra[4 + n :]
        at += 46 + names + extras + notes
        if method == 0:
            file.seek(local)
            head = file.read(30)
            if head[:4] != LOCAL:
                raise ValueError("no local header")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
    return found


def record_ranges(packages: DataFrame) -> DataFrame:
    """(path, start, length): where every record lies, from the packages' directories and indexes alone.

    No packages give no rows, a path that is listed twice gives its records twice, and a null path is an error.
    """

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as file:
                    places = members(file, file.size())
                    file.seek(places[INDEX][0])
                    lines = file.read(places[INDEX][1]).decode().split("\n")
                at = [tuple(map(int, line.split())) for line in lines if line]
                yield pd.DataFrame({"path": path, "start": [places[ARCHIVE][0] + a for a, _ in at], "length": [n for _, n in at]})

    return packages.select("path").mapInPandas(locate, "path string, start long, length long")


def read_records(ranges: DataFrame, payloads: bool = True, id_type: str = "long") -> DataFrame:
    """Range-read and parse records; responses are verified against their digest. `payloads` adds html.

    Rows of `ranges` are read one by one, repeated ones repeatedly; no rows give none. A task passes records on after
    READ_BYTES of payload, so it holds that and one record, however long. `id_type` is the type of the page ids,
    which archives hold as text; a record without one has a null. Further columns are left out.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part in batch.groupby("path", sort=False):
                store, where = fs.FileSystem.from_uri(path)
                out, size = [], 0
                with store.open_input_file(where) as file:
                    for start, length in zip(part["start"], part["length"]):
                        file.seek(start)
                        one = parsed(zlib.decompress(file.read(length), 31))
                        payload = one.pop("payload")
                        if payload is not None and (digest(payload), len(payload)) != (one["payload_digest"], one["payload_bytes"]):
                            raise ValueError(f"damaged record at {start} of {path}")
                        out.append(one | ({"html": payload.decode() if payload is not None else None} if payloads else {}))
                        size += len(payload or b"") if payloads else 0
                        if size >= READ_BYTES:
                            yield pd.DataFrame(out)
                            out, size = [], 0
                if out:
                    yield pd.DataFrame(out)

    kinds = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    found = ranges.select("path", "start", "length").mapInPandas(read, kinds + ", html string" * payloads)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` to packages in the shared folder and read every record back: see write_packages() for odd rows."""
    packages = write_packages(pages, f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}")
    spread = packages.repartition(max(1, min(packages.count(), 10_000)), "path")
    return read_records(record_ranges(spread), payloads=False, id_type=dict(pages.dtypes)["page_id"])
