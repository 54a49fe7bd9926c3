"""WARC records in ZIP-packaged archives: written by tasks, read back by ranges.

An archive is a ZIP file whose members are stored without compression: ``archive/data.warc.gz`` (WARC
records, each a gzip member of its own), ``indexes/index.cdxj`` (a line a record: place and length in that
member) and ``datapackage.json``. A reader parses the central directory (and the ZIP64 one, where sizes, offsets
or counts need it), finds the stored members, reads the index, and then only the byte ranges of records, many
tasks to an archive. Nothing is extracted.

Writing tasks return the archives they have closed; only those in the table of finished tasks count, so
what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: An archive is closed when its data reach it.
ARCHIVE_BYTES = 256 << 20
#: Neighbouring records are fetched in one read of about this size.
READ_BYTES = 4 << 20
#: Bytes of archives that a task reads, about.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


# ---- archives -------------------------------------------------------------------------------------------------


class ZipMember:
    def __init__(self, name: str, method: int, size: int, header: int) -> None:
        self.name, self.method, self.size, self.header = name, method, size, header


def read_directory(read, length: int) -> dict[str, ZipMember]:
    """The members of a ZIP file of ``length`` bytes; ``read(offset, size)`` gives a byte range."""
    tail_at = max(0, length - (1 << 16) - 22 - 20)
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature may also stand in a comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of central directory is missing")
        count, size, start = struct.unpack_from("<QQQ", wide, 32)
    directory, at, members = read(start, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                values = [v for (v,) in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                whole = values.pop(0) if whole == 0xFFFFFFFF else whole
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        members[name] = ZipMember(name, method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_range(read, member: ZipMember) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many there are."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the archive, and can't be read by ranges")
    header = read(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"the local header of {member.name} is damaged")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + n_name + n_extra, member.size


class _Out(io.RawIOBase):
    """A sink that can't seek, and counts."""

    def __init__(self, to) -> None:
        self.to, self.at = to, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.to.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class ArchiveWriter:
    def __init__(self, to, zip64: bool = False) -> None:
        """``zip64`` uses the wide fields even where the archive wouldn't need them."""
        self.zip64 = zip64
        self.zip = zipfile.ZipFile(_Out(to), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, record: bytes, about: dict) -> None:
        packed = zlib.compress(record, 6, 31)
        self.member.write(packed)
        self.index.append(json.dumps(about | {"offset": self.at, "length": len(packed)}, separators=(",", ":")))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        keys = "".join(f"{i:012d} {line}\n" for i, line in enumerate(self.index))
        self.zip.writestr(INDEX, keys.encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX}]}))
        if self.zip64:
            _close_wide(self.zip)
        self.zip.close()


def _close_wide(archive: zipfile.ZipFile) -> None:
    """Writes the directory with every size and offset in ZIP64 fields, and both ZIP64 end records."""
    out, start = archive.fp, archive.fp.tell()
    for info in archive.filelist:
        name = info.filename.encode()
        extra = struct.pack("<HHQQQ", 1, 24, info.file_size, info.compress_size, info.header_offset)
        out.write(struct.pack("<4s4B4HL2L5H2L", b"PK\x01\x02", 45, 3, 45, 0, info.flag_bits, info.compress_type, 0, 33, info.CRC, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
    end, n = out.tell(), len(archive.filelist)
    out.write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, end - start, start))
    out.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
    out.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    archive._didModify = False  # the end is written


def index_of(read, length: int) -> list[dict]:
    """What an archive's index says of each record, with absolute places."""
    members = read_directory(read, length)
    for name in (DATA, INDEX):
        if name not in members:
            raise ValueError(f"the archive has no {name}")
    base, size = stored_range(read, members[DATA])
    at, n = stored_range(read, members[INDEX])
    out = []
    for line in read(at, n).decode().splitlines():
        entry = json.loads(line.split(" ", 1)[1])
        if entry["offset"] + entry["length"] > size:
            raise ValueError("an index entry points beyond the archive's data")
        out.append(entry | {"offset": base + entry["offset"]})
    return out


# ---- records --------------------------------------------------------------------------------------------------


def _urn(page_id: int | None, payload: str) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:x-payload:{payload}>"


def _page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:x-page:") : -1]) if urn and urn.startswith("<urn:x-page:") else None


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with an HTTP message around the payload, or a revisit record of one with an equal payload."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": _urn(refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    block = http + (payload if refers_to is None else b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest and length."""
    top, _, rest = record.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
    out = {"page_id": _page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": int(head["x-payload-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": _page_of(head.get("warc-refers-to")), "payload": None}
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != out["payload_bytes"]:
            raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
        out["payload"] = payload
    return out


# ---- tables ---------------------------------------------------------------------------------------------------


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, html, bytes, digest, keeper): keeper is the largest id with an equal payload, if that counts as a revisit's target."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    # a stored table of repeated payloads alone: broadcast if it is small, else a join whose hot keys Spark splits
    groups = stored(groups.select("digest", "keeper"), "repeated")
    return rows.join(groups, "digest", "left").select("id", "url", "html", "bytes", "digest", F.when(F.col("id").isNull() | (F.col("id") < F.col("keeper")), F.col("keeper")).alias("keeper"))


def write_archives(pages: DataFrame, to: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record per row into archives below ``to`` (default: the shared folder); a stored table (path, records, bytes) of them.

    * The payload is the text's UTF-8; null is as empty. Of rows with equal payloads of ``LEAST_REVISIT`` bytes or more, those
      with the largest id are responses and the others revisits of it; a null id is never referred to.
    * A null URL is written as about:blank. An empty table writes no archive. Further columns are ignored.
    """
    spark = pages.sparkSession
    folder = to or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        open_one: list = []

        def close() -> None:
            name, sink, writer = open_one.pop()
            writer.close()
            sink.close()
            done.append((name, len(writer.index), files.get_file_info(name).size))

        for batch in batches:
            for key, url, html, digest, keeper in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not open_one:
                    name = f"{base}/{uuid.uuid4().hex}.wacz"  # a repeated task never writes over another's file
                    sink = files.open_output_stream(name)
                    open_one.append((name, sink, ArchiveWriter(sink, zip64)))
                writer = open_one[0][2]
                writer.add(make_record(key, url, html.encode(), digest, keeper), {"id": key})
                if writer.at >= archive_bytes:
                    close()
        if open_one:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    rows = with_references(pages, id_col, url_col, html_col).select("id", "url", "html", "digest", "keeper")
    found = rows.mapInArrow(write, "path string, records long, bytes long")
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return stored(found.withColumn("path", F.concat(F.lit(scheme), "path")), "archives")


_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (a table with a column ``path``): page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = _file_system(path)
                with files.open_input_file(name) as f:
                    entries = index_of(lambda at, n, f=f: f.read_at(n, at), f.size())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(entries), pa.string()), pa.array([e["offset"] for e in entries], pa.int64()), pa.array([e["length"] for e in entries], pa.int64())], ["path", "offset", "length"])

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            i, found = 0, []
            while i < len(rows):
                j, end = i + 1, rows[i][1] + rows[i][2]
                while j < len(rows) and rows[j][0] == rows[i][0] and rows[j][1] == end and end - rows[i][1] < READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if rows[i][0] != path:
                    if source is not None:
                        source.close()
                    path = rows[i][0]
                    files, name = _file_system(path)
                    source = files.open_input_file(name)
                data = source.read_at(end - rows[i][1], rows[i][1])
                for _, at, n in rows[i:j]:
                    found.append(parse_record(zlib.decompress(data[at - rows[i][1] : at - rows[i][1] + n], 31)))
                i = j
                if sum(len(x["payload"] or b"") for x in found[-256:]) > READ_BYTES or len(found) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(names, kinds, strict=True)], names)
        if source is not None:
            source.close()

    # numbers of tasks are given, since narrow rows that stand for many bytes would else be merged into few
    sized = archives.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes") if "bytes" in archives.columns else F.lit(None).cast("long").alias("bytes")).first()
    many = archives.sparkSession.sparkContext.defaultParallelism
    tasks = max(many, -(-(sized["bytes"] or sized["n"] * ARCHIVE_BYTES) // TASK_BYTES))
    place = archives.select("path").repartition(max(1, min(sized["n"], 4 * many)), "path").mapInArrow(places, "path string, offset long, length long")
    # neighbouring records go to one task, an archive's runs of READ_BYTES to many
    dealt = place.repartition(tasks, "path", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(records, _FIELDS + (", payload binary" if with_payload else ""))
