"""Legacy web archives: ARC files (versions 1 and 2) converted to WARC, written and read back.

An ARC file starts with a version block whose URL record ends in a declared length; its first line
names the version, which decides the fields of every record's header line. Records are taken by their
declared lengths. Each becomes a WARC record: the 14-digit date an ISO time, the record's data an
HTTP message, identifiers derived from the record, and SHA-1 digests of block and payload computed.
Records of equal payload become revisits of the one with the largest page id.

WARC files are gzip members, one a record, written through pyarrow.fs below a shared folder; each attempt
of a task names its own files and a manifest holds those that count, so only they are read back. Reading
measures and digests the payload of every response; a revisit, which has none, is known by the standard
fields alone: its payload digest and the length that its HTTP headers declare.

convert_arc() takes existing ARC files (plain or of gzip members) to WARC files, record by record.

Defined cases: null html is an empty payload, and empty payloads revisit like others; repeated rows of the
largest page_id of a payload are all responses (revisits refer to the last of them), and every record has
an identifier of its own; null urls are `about:blank`; null page_ids are responses of their own with
page_id null; an empty table writes no record and gives no row; a very long page is one record, held in
memory; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, passing_tables, scratch, stored

_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
FILE_BYTES = 16 << 20
#: Marks, in the first half of a record's identifier, that the record has no page id.
_NO_PAGE = 1 << 63


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(records: list[tuple[str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, 14-digit date, data) records."""
    about = f"{version} 0 leafgrade\n{_TITLES[version]}\n\n".encode()
    head = {1: f"filedesc://{name} 0.0.0.0 19960923142103 text/plain {len(about)}\n", 2: f"filedesc://{name} 0.0.0.0 19960923142103 text/plain 200 - - 0 {name} {len(about)}\n"}[version]
    out = [head.encode(), about]
    at = len(out[0]) + len(out[1])
    for url, date, data in records:
        plain = url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "about:blank"
        line = f"{plain} 127.0.0.1 {date} text/html {len(data)}\n" if version == 1 else f"{plain} 127.0.0.1 {date} text/html 200 - - {at} {name} {len(data)}\n"
        out += [line.encode(), data, b"\n"]
        at += len(out[-3]) + len(data) + 1
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block; `data` holds each record's bytes."""
    end = data.index(b"\n")
    first = data[:end].split(b" ")
    if not first[0].startswith(b"filedesc://"):
        raise ValueError("not an ARC file: no version block")
    size = int(first[-1])
    about = data[end + 1 : end + 1 + size]
    version = int(about.split(b" ", 1)[0])
    if version not in _FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    names = _FIELDS[version]
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").split(" ")
        if len(line) != len(names):
            raise ValueError(f"an ARC header line has {len(line)} fields; version {version} has {len(names)}")
        row = dict(zip(names, line, strict=True))
        size = int(row["length"])
        if end + 1 + size > len(data):
            raise ValueError("an ARC record is shorter than its declared length")
        yield row | {"version": version, "data": data[end + 1 : end + 1 + size]}
        at = end + 1 + size


def record_id(row: int, page_id: int | None) -> str:
    """An identifier that holds the row (unique in a table) and the page id."""
    h = f"{row | (_NO_PAGE if page_id is None else 0):016x}{(page_id or 0) & (2**64 - 1):016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(identifier: str) -> int | None:
    v = int(identifier.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    if v >> 64 & _NO_PAGE:
        return None
    v &= 2**64 - 1
    return v - 2**64 if v >= 2**63 else v


def warc_record(row: dict, identifier: str, refers_to: str | None = None) -> bytes:
    """The WARC record equivalent to an ARC record; a revisit keeps only the HTTP headers."""
    d = row["date"]
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head, _, payload = row["data"].partition(b"\r\n\r\n")
    block = row["data"] if refers_to is None else head + b"\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {when}", f"WARC-Target-URI: {row['url']}", f"WARC-IP-Address: {row['ip']}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """What each gzip member holds; read in steps, as what lies behind a member is copied with each."""
    at = 0
    while at < len(data):
        z, out = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member ends early")
            part = data[at : at + step]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def unpacked(data: bytes) -> bytes:
    """The bytes behind gzip members, or data itself where it is none."""
    return b"".join(_members(data)) if data[:2] == b"\x1f\x8b" else data


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a WARC file of gzip members, digests verified."""
    for raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(names["Content-Length"])]
        if names["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"block digest differs in {names['WARC-Record-ID']}")
        yield names, block


def _http(html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


_START = datetime(1997, 1, 1, tzinfo=UTC)


class _Files:
    """Writes records to files of about FILE_BYTES below a folder; row() is a manifest row of what was written."""

    def __init__(self, folder: str):
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(folder)
        self.part, self.attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        self.held: list[bytes] = []
        self.size = self.number = 0

    def add(self, record: bytes) -> None:
        z = zlib.compressobj(3, wbits=31)
        self.held.append(z.compress(record) + z.flush())
        self.size += len(self.held[-1])

    def row(self) -> pa.RecordBatch:
        name = f"part-{self.part:06d}-{self.number:05d}-{self.attempt}.warc.gz"
        with self.fs.open_output_stream(f"{self.base}/{name}", compression=None) as f:
            f.write(b"".join(self.held))
        out = pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(self.held)], pa.int64()), "bytes": pa.array([self.size], pa.int64())})
        self.held, self.size, self.number = [], 0, self.number + 1
        return out


_MANIFEST = "file string, n_records long, bytes long"


def _make_folder(folder: str) -> None:
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)


def _revisits(rows: DataFrame) -> DataFrame:
    """Rows (row, to_page, to_row) of the rows (row, page_id, sha) whose payload a larger page id has too."""
    rows = rows.where("page_id IS NOT NULL")
    last = F.max(F.struct("page_id", "row"))
    groups = stored(rows.groupBy("sha").agg(last.alias("to"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("to.page_id").alias("to_page"), F.col("to.row").alias("to_row"), "n"), "archive-groups")
    # A payload of more than a thousandth of all rows meets its rows without a shuffle; there are at most a thousand.
    most = rows.count() // 1000
    common = F.broadcast(groups.where(F.col("n") > most).drop("n"))
    some = rows.join(common, "sha", "left_anti").join(groups.where(F.col("n") <= most).drop("n"), "sha")
    return rows.join(common, "sha").unionByName(some).where("page_id <> to_page").select("row", "to_page", "to_row")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """ARC records of all pages, converted to WARC files below folder; rows (file, n_records, bytes)."""
    bound_batches(pages.sparkSession)
    with passing_tables():
        source = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
        source = stored(source.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary")))), "archive-pages")
        planned = source.join(stored(_revisits(source.select("row", "page_id", "sha")), "archive-revisits"), "row", "left").select("row", "page_id", "url", "html", "to_page", "to_row")
        _make_folder(folder)

        def run(batches):
            files, version = _Files(folder), 1
            for batch in batches:
                for at in range(0, len(batch), 200):
                    rows = batch.slice(at, 200).to_pylist()
                    records = []
                    for r in rows:
                        when = _START + timedelta(seconds=(r["page_id"] or 0) % 315_360_000)
                        records.append((r["url"] or "about:blank", when.strftime("%Y%m%d%H%M%S"), _http(r["html"].encode())))
                    for r, record in zip(rows, parse_arc(arc_file(records, version)), strict=True):
                        to = None if r["to_row"] is None else record_id(r["to_row"], r["to_page"])
                        files.add(warc_record(record, record_id(r["row"], r["page_id"]), to))
                    version = 3 - version
                    if files.size >= FILE_BYTES:
                        yield files.row()
            if files.held:
                yield files.row()

        return stored(planned.mapInArrow(run, _MANIFEST), "archive-manifest", last=True)


def convert_arc(spark: SparkSession, archives: str, folder: str) -> DataFrame:
    """The records of all ARC files that Spark finds at `archives`, as WARC files below folder; rows (file, n_records, bytes).

    Identifiers are derived from the archive's path and the record's place in it, so a repeated run makes the same.
    """
    _make_folder(folder)

    def run(batches):
        files = _Files(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, record in enumerate(parse_arc(unpacked(content.as_py()))):
                    h = hashlib.sha1(f"{path} {k}".encode()).hexdigest()
                    files.add(warc_record(record, f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"))
                    if files.size >= FILE_BYTES:
                        yield files.row()
        if files.held:
            yield files.row()

    return stored(spark.read.format("binaryFile").load(archives).select("path", "content").mapInArrow(run, _MANIFEST), "archive-manifest")


def payload_of(names: dict[str, str], block: bytes) -> tuple[int, str]:
    """Length and digest of the payload: measured on a response, from the standard fields of a revisit."""
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = names["WARC-Payload-Digest"].removeprefix("sha1:")
    if names["WARC-Type"] == "revisit":
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
        return int(fields[b"Content-Length"]), stated
    found = digest(payload)
    if found != stated:
        raise ValueError(f"payload digest differs in {names['WARC-Record-ID']}")
    return len(payload), found


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, warc_date) of all records
    in the manifest's files below folder."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                cols = ([], [], [], [], [], [], [], [])
                for names, block in parse_warc(data):
                    size, sha = payload_of(names, block)
                    own, refers = names["WARC-Record-ID"], names.get("WARC-Refers-To")
                    for c, v in zip(cols, (page_of(own), size, sha, names["WARC-Type"], None if refers is None else page_of(refers), own, names["WARC-Target-URI"], names["WARC-Date"]), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], _RECORD)

    files = manifest.select("file").repartition(max(1, manifest.count()))
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string")


_RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date"]


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
