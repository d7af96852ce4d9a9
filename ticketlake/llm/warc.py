"""Web archives: WARC records in ZIP packages, written by one task for each partition and read back by ranges.

A package holds two stored members: ``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdx``
(one line for each record: offset, length, type, digest). A reader finds the members in the central directory and reads
each record as a range of the package; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketlake.llm.common import batches, slices
from ticketlake.session import materialize, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed layouts of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    if urlsplit(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value stays on its line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit repeats the HTTP headers, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str, level: int):
    """Each task writes one package under a name of its own attempt, and returns the name: a lost or repeated attempt
    leaves an unused file, never half a package."""
    schema = pa.schema([("package", pa.string()), ("records", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = iter(it)
        first = next(it, None)
        if first is None:
            return
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        index, count, at = [], 0, 0
        with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                while first is not None:
                    for row in first.to_pylist():
                        payload = (row["html"] or "").encode("utf-8", "replace")
                        sha = digest(payload)
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = record(row["id"], row["url"], payload, sha, row["refers_to"], row["revisit"])
                        data = packer.compress(data) + packer.flush()
                        member.write(data)
                        index.append(f"{at} {len(data)} {'revisit' if row['revisit'] else 'response'} {sha}\n")
                        at, count = at + len(data), count + 1
                    first = next(it, None)
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
                for line in index:
                    member.write(line.encode())
        yield from batches(schema, [(name, count)])

    return run, "package string, records bigint"


def _extra64(extra: bytes, size: int, packed: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset of an entry; those that do not fit 32 bits are in its ZIP64 field, in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = list(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            size = wide.pop(0) if size == 0xFFFFFFFF and wide else size
            packed = wide.pop(0) if packed == 0xFFFFFFFF and wide else packed
            offset = wide.pop(0) if offset == 0xFFFFFFFF and wide else offset
        at += 4 + length
    return size, packed, offset


def directory(source) -> dict[str, tuple[int, int, int]]:
    """Members of a ZIP package: name to (method, first byte of the data, stored bytes), from its central directory.

    ``source`` is a random-access file. The end record is looked for in the last 64 KiB (the longest comment); a ZIP64
    locator before it leads to the wide end record.
    """
    total = source.size()
    back = min(total, 65557 + 20)
    tail = source.read_at(back, total - back)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP package: no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail.rfind(LOCATOR64, 0, end)
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and locator >= 0:
        wide = source.read_at(56, struct.unpack_from("<Q", tail, locator + 8)[0])
        if wide[:4] != END64:
            raise ValueError("damaged ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    listing = source.read_at(length, start)
    found, at = {}, 0
    for _ in range(count):
        if listing[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", listing, at + 10)
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", listing, at + 20)
        offset, = struct.unpack_from("<I", listing, at + 42)
        name = listing[at + 46 : at + 46 + n_name].decode("utf-8")
        extra = listing[at + 46 + n_name : at + 46 + n_name + n_extra]
        size, packed, offset = _extra64(extra, size, packed, offset)
        head = source.read_at(30, offset)
        if head[:4] != LOCAL:
            raise ValueError(f"damaged member {name}")
        skip_name, skip_extra = struct.unpack_from("<HH", head, 26)
        found[name] = (method, offset + 30 + skip_name + skip_extra, packed)
        at += 46 + n_name + n_extra + n_comment
    return found


def _stored(members: dict, name: str) -> tuple[int, int]:
    method, start, length = members[name]
    if method != 0:
        raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
    return start, length


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:] if ": " in x)
    return fields, inner, payload


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if value in ("", "null", "None") else int(value)


def _read(folder: str, ahead: int):
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string()),
    ])

    def rows(name: str, low: int, high: int) -> Iterator[tuple]:
        fs, root = filesystem(folder)
        with fs.open_input_file(f"{root}/{name}") as source:
            members = directory(source)
            start, _ = _stored(members, DATA)
            at, length = _stored(members, INDEX)
            lines = source.read_at(length, at).decode().splitlines()[low:high]
            places = [tuple(map(int, x.split(" ", 2)[:2])) for x in lines]
            import numpy as np

            # Neighbouring records are fetched together, about ``ahead`` bytes a request.
            for a, b in slices(np.array([n for _, n in places], np.int64), ahead):
                base = places[a][0]
                chunk = source.read_at(places[b - 1][0] + places[b - 1][1] - base, start + base)
                for offset, size in places[a:b]:
                    fields, http, payload = parse(zlib.decompress(chunk[offset - base : offset - base + size], 31))
                    sha, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != sha:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    yield (
                        _page(fields["WARC-Record-ID"]), int(http["Content-Length"]), sha, fields["WARC-Type"],
                        _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"),
                        None if revisit else payload.decode("utf-8"),
                    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x in batch.to_pylist():
                yield from batches(schema, rows(x["package"], x["low"], x["high"]), 200)

    return run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload string"


def base32_sha1(payload) -> F.Column:
    """Upper-case base32 SHA-1 of a binary column: eight times five hex digits are four letters each."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, level: int = 1
) -> DataFrame:
    """Writes one package for each partition of ``pages`` into ``folder`` and returns their names and record counts.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
    revisit it. A null html is an empty payload. Rows that repeat the smallest id are all responses; a row without id
    revisits if another row has an id, else it is a response. Payloads meet as digests, counted and minimised before
    the shuffle; only the list of revisits is joined to the pages.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    binary = F.col("html").cast("binary")
    sums = materialize(rows.select("id", base32_sha1(binary).alias("sha"), F.octet_length("html").alias("n")), "warc-digests")
    firsts = sums.filter(F.col("n") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    again = materialize(
        sums.join(firsts, "sha").filter("not (id <=> first)").select("id", F.col("first").alias("refers_to"), "sha").distinct(),
        "warc-revisits",
    )
    rows = rows.withColumn("sha", base32_sha1(binary))
    marked = rows.alias("p").join(again.alias("r"), F.expr("p.id <=> r.id and p.sha = r.sha"), "left").select(
        "p.id", "p.url", "p.html", "r.refers_to", F.col("r.refers_to").isNotNull().alias("revisit")
    )
    run, schema = _write(folder, level)
    return marked.mapInArrow(run, schema)


def read_archives(packages: DataFrame, folder: str, records: int = 2000, ahead: int = 4 << 20) -> DataFrame:
    """All records of the packages (package, records): page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload (null for a revisit). A task reads ``records`` records of one package by ranges."""
    parts = packages.select(
        "package", F.explode(F.expr(f"sequence(0L, greatest(records - 1, 0), {records}L)")).alias("low")
    ).withColumn("high", F.col("low") + records)
    run, schema = _read(folder, ahead)
    # A row stands for thousands of records: one row in a partition lets all cores read.
    return parts.repartition(parts.sparkSession.sparkContext.defaultParallelism * 2, "package", "low").mapInArrow(run, schema)


def archive_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes the pages into packages in the shared folder and reads every record back."""
    folder = scratch_path(spark, "warc")
    packages = materialize(write_archives(pages, folder, **options), "warc-packages")
    return read_archives(packages, folder)
