"""WARC records in ZIP packages: writing them, and reading single records by byte ranges.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (a line of JSON per record with its offset and length in the
archive), both stored without compression. The reader takes the package's tail, follows
the end record, ZIP64 where its fields say so, to the central directory, finds where the
members' bytes start, and reads records by their ranges. Nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
WRITTEN = "2024-01-01T00:00:00Z"
#: The profile of records whose payload another record holds.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records ------------------------------------------------------------------------

def _header(fields: dict[str, object]) -> bytes:
    clean = {k: str(v).replace("\r", " ").replace("\n", " ") for k, v in fields.items() if v is not None}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean.items()).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, holder: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit names the page that holds the payload and leaves the payload out."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = _header({
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{page_id}>" if page_id is not None else "<urn:page:>",
        "WARC-Target-URI": url, "WARC-Date": WRITTEN, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": SAME_PAYLOAD if revisit else None,
        "WARC-Refers-To": f"<urn:page:{holder}>" if revisit else None, "Content-Type": "application/http;msgtype=response", "Content-Length": len(block)})
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """Header fields (lower-case names), HTTP header and payload of a gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode(), "payload": payload}


# -- packages -----------------------------------------------------------------------

def _u(fmt: str, data: bytes, at: int) -> tuple:
    return struct.unpack_from("<" + fmt, data, at)


def read_directory(size: int, read: Callable[[int, int], bytes]) -> dict[str, tuple[int, int, int]]:
    """Member name -> (offset of its bytes, stored size, method), from byte ranges of a ZIP file.

    ``read(offset, length)`` gives a range. Offsets and sizes that the 32-bit fields can't
    hold are taken from the ZIP64 records.
    """
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # the end record is the one whose comment ends the file; the signature may stand inside a comment, too
    while end >= 0 and (end + 22 > len(tail) or end + 22 + _u("H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = _u("HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[max(0, end - 20) : end][:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = _u("Q", tail, end - 20 + 8)
        end64 = read(at, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = _u("QQQ", end64, 32)
    directory, at, members = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory broken")
        (method,) = _u("H", directory, at + 10)
        packed, plain = _u("II", directory, at + 20)
        n_name, n_extra, n_comment = _u("HHH", directory, at + 28)
        (offset,) = _u("I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, x = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = _u("HH", extra, x)
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = list(_u(f"{n // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            x += 4 + n
        local = read(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("local header missing")
        members[name] = (offset + 30 + sum(_u("HH", local, 26)), packed, method)
        at += 46 + n_name + n_extra + n_comment
    return members


def _stored(members: dict, name: str) -> tuple[int, int]:
    start, size, method = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed: its records can't be read by ranges")
    return start, size


# -- Spark --------------------------------------------------------------------------

def write_packages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages``, a package per partition; returns package, records, bytes.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
    page id holds the payload, the others are revisits of it. A null payload is empty.
    Null ids never hold a payload that a row with an id has; if all ids of a payload are
    null, each such row is a response. Rows repeated with id and payload are alike: each
    row of the largest id is a response. Other columns are not read.
    """
    fs, local = pafs.FileSystem.from_uri(path)
    fs.create_dir(local, recursive=True)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.concat_ws("-", F.sha1(html), F.octet_length(html)).alias("digest"))
    # written out, so that the join below can split a payload that very many pages have
    holders = cut(rows.groupBy("digest").agg(F.max("page_id").alias("holder")), "holders")
    revisit = (F.octet_length("html") >= min_bytes) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    marked = rows.join(holders, "digest").select("page_id", "url", "html", "holder", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, local = pafs.FileSystem.from_uri(path)
        name, tmp, index, n = f"part-{task.partitionId():06d}.wacz", f"{local}/_tmp-{task.taskAttemptId()}", [], 0
        with fs.open_output_stream(tmp) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as archive:
                at = 0
                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        member = record(row[0], row[1], row[2].encode(), row[3], row[4])
                        archive.write(member)
                        index.append(json.dumps({"page_id": row[0], "url": row[1], "offset": at, "length": len(member)}))
                        at, n = at + len(member), n + 1
            package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        if n:
            fs.move(tmp, f"{local}/{name}")
            yield pa.RecordBatch.from_pydict({"package": [name], "records": [n], "bytes": [at]})
        else:
            fs.delete_file(tmp)

    schema = "package string, records bigint, bytes bigint"
    written = marked.mapInArrow(write, schema).collect()  # a row per package
    return pages.sparkSession.createDataFrame(sorted(written), schema)


def read_packages(packages: DataFrame, path: str, records_per_read: int = 500, bytes_per_read: int = 8_000_000, bytes_per_task: int = 64_000_000) -> DataFrame:
    """Every record of the packages: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    ``packages`` is what ``write_packages`` returned: package and bytes. A first pass reads
    each package's directory and index and cuts the index into runs of neighbouring records,
    at most so many records and bytes (one record may be longer); the runs are spread over as
    many tasks as the bytes ask for, and each is one range read. Length and digest of a
    revisit are those its header states. Null ids and URLs come back as null, empty payloads
    as empty; repeated records are rows of their own; no packages give an empty result.
    """
    spark = packages.sparkSession
    total = packages.agg(F.sum("bytes")).first()[0] or 0
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-total // bytes_per_task))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                with fs.open_input_file(f"{local}/{name}") as f:
                    read = lambda at, n: f.read_at(n, at)
                    members = read_directory(f.size(), read)
                    (start, _), (index_at, index_size) = _stored(members, ARCHIVE), _stored(members, INDEX)
                    entries = [json.loads(x) for x in read(index_at, index_size).decode().split("\n") if x]
                for own in _runs(entries, records_per_read, bytes_per_read):
                    yield pa.RecordBatch.from_pydict({"package": [name], "offset": [start + own[0]["offset"]], "lengths": pa.array([[e["length"] for e in own]], pa.list_(pa.int64()))})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, at, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{local}/{name}") as f:
                    data = f.read_at(sum(lengths), at)
                out, where, held = [], 0, 0
                for n in lengths:
                    out.append(_row(parse_record(data[where : where + n])))
                    where, held = where + n, held + len(out[-1][-1] or b"")
                    if held > 4 * bytes_per_read:  # what the records unpack to is bounded, too
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    listed = packages.select("package").mapInArrow(runs, "package string, offset bigint, lengths array<bigint>")
    return listed.repartition(n_tasks, "package", "offset").mapInArrow(fetch, _READ)


def _runs(entries: list[dict], most_records: int, most_bytes: int) -> Iterator[list[dict]]:
    """Runs of index entries within both bounds, an entry at least."""
    own, held = [], 0
    for e in entries:
        if own and (len(own) == most_records or held + e["length"] > most_bytes):
            yield own
            own, held = [], 0
        own.append(e)
        held += e["length"]
    if own:
        yield own


_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _row(found: dict) -> tuple:
    fields, payload = found["fields"], found["payload"]
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        size = int(next(x for x in found["http"].split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
        return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), "revisit", _page(fields["warc-refers-to"]), size, stated, None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), "response", None, len(payload), digest, payload


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    return read_packages(write_packages(table(spark, sf_dir, "pages"), path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Each five hex digits of the SHA-1 are four base32 letters.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d
"""
