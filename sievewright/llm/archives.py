"""Legacy ARC archives, and their conversion to WARC.

An ARC file begins with a version block: a filedesc header line, then `1 0 origin` or `2 0 origin`, then the line
that names the fields of the headers to come. Every header line ends with the declared length of its block; version
2 adds result code, checksum, location, offset and file name. The converter goes from one declared length to the
next and never looks for separators inside a block.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_spread, map_batches, scratch_path, written

#: Field names of the two header versions. Fixed values.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC files hold as many records as make about so many bytes at the mean size of a page.
FILE_BYTES = 16 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def arc_header(version: int, values: dict[str, str]) -> bytes:
    """A header line; blanks in a value would shift the fields, so they are escaped, and an empty value is a dash."""
    return (" ".join(values.get(f, "").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-" for f in FIELDS[version]) + "\n").encode()


def arc_file(version: int, date: str, records: list[tuple[dict[str, str], bytes]], name: str = "-") -> bytes:
    """An ARC file of one version block and these records."""
    body = f"{version} 0 sievewright\n{' '.join(FIELDS[version])}\n".encode()
    head = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Filename": name}
    out = [arc_header(version, head | {"Archive-length": str(len(body))}), body, b"\n"]
    for values, block in records:
        out += [arc_header(version, values | {"Archive-length": str(len(block))}), block, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record after the version block, by the fields that this file declares."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at {at} has no end")
        line = data[at:end].rstrip(b"\r").decode("utf-8")
        if not line:
            at = end + 1
            continue
        values = line.rsplit(" ", len(fields or FIELDS[1]) - 1) if fields else line.split(" ")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"ARC record at {at} declares {length} bytes and has {len(block)}")
        at = end + 1 + length
        if fields is None:
            version, _, rest = block.partition(b"\n")
            if not line.startswith("filedesc:") or int(version.split()[0]) not in FIELDS:
                raise ValueError("no ARC version block that can be read")
            fields = tuple(rest.split(b"\n", 1)[0].rstrip(b"\r").decode().split(" "))
            continue
        yield dict(zip(fields, values)), block


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a block; a block without a status line is payload only."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head + found, payload) if found else (block, b"")


def warc_date(arc_date: str) -> str:
    """The 14 digits of an ARC date as WARC writes them; missing digits count as the first of their kind."""
    d = arc_date[:14] + "00000101000000"[len(arc_date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    """The same identifier for the same record in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def warc_record(kind: str, url: str, date: str, ip: str, page: object, row: int, digest: str, head: bytes, payload: bytes, refers: tuple[object, int] | None) -> bytes:
    """A WARC record without the blank lines that end it. row: its place in the table; refers: page and row that a revisit refers to."""
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, row, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Page: {'' if page is None else page}",
    ]
    if refers:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(*refers, digest)}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record, by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin, length = end + 4, int(fields["Content-Length"])
        block = data[begin : begin + length]
        if len(block) != length or data[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at {at} is cut short")
        yield fields, block
        at = begin + length + 4


def _arc_date(page: int | None) -> str:
    """Pages have no time of capture; a minute for each page id stands in."""
    minute = (page or 0) % (366 * 24 * 60)
    return f"2008{_DAYS[minute // 1440]}{minute // 60 % 24:02d}{minute % 60:02d}00"


_DAYS = [f"{m:02d}{d:02d}" for m, n in enumerate((31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), 1) for d in range(1, n + 1)]


def _arc_record(version: int, page: int | None, url: str | None, html: bytes) -> tuple[dict[str, str], bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    values = {"URL": url or "", "IP-address": "192.0.2.1", "Archive-date": _arc_date(page), "Content-type": "text/html"}
    return values | ({"Result-code": "200", "Checksum": "", "Location": "", "Offset": "0", "Filename": f"page-{page}"} if version == 2 else {}), block


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, batch in enumerate(batches):
        rows = batch.select(["page_id", "url", "row", "first_id", "first_row"]).to_pylist()
        version = 1 + n % 2
        pages = batch.column("html").to_pylist()
        arc = arc_file(version, "20080101000000", [_arc_record(version, r["page_id"], r["url"], h) for r, h in zip(rows, pages)])
        records = []
        for r, (fields, block) in zip(rows, read_arc(arc), strict=True):
            head, payload = http_parts(block)
            digest = sha1_base32(payload)
            revisit = r["first_row"] is not None and r["first_row"] != r["row"]
            records.append(
                warc_record(
                    "revisit" if revisit else "response", fields["URL"], warc_date(fields["Archive-date"]), fields["IP-address"], r["page_id"], r["row"], digest, head, payload, (r["first_id"], r["first_row"]) if revisit else None
                ).decode("utf-8")
            )
        yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["value"])


_READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string, warc_date string, record_id string"


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
    names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for f, block in read_warc(gzip.decompress(content.as_buffer())):
                if f["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                    raise ValueError(f"block digest of {f['WARC-Record-ID']} is wrong")
                page, size, digest = f["X-Page"], None, f["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Type"] == "response":
                    payload = http_parts(block)[1]
                    size = len(payload)
                    if sha1_base32(payload) != digest:
                        raise ValueError(f"payload digest of {f['WARC-Record-ID']} is wrong")
                rows.append((int(page) if page else None, size, digest, f["WARC-Type"], f.get("WARC-Refers-To"), f["WARC-Date"], f["WARC-Record-ID"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


def write_archives(pages: DataFrame, path: str, smallest: int = 0) -> None:
    """Writes pages (page_id, url, html) as WARC files under path, by way of ARC.

    Of records with equal payloads of at least smallest bytes, that with the least page_id is a response and the
    others are revisits of it. Ties: of repeated rows of that page the first in the table is the response. Every row has a
    record id of its own, made of its page, payload and place in the table, so pages must be stored, not computed anew.
    Nulls: a null html is an empty payload, a null url an empty target; a page without an id comes after those that have one.
    Extra columns are not read. An empty table gives no records. A page must fit in a worker's memory some ten times.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("html"), F.sha1(html.cast("binary")).alias("_digest"), F.monotonically_increasing_id().alias("row"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id", "row")).alias("first")
    firsts = slim.groupBy("_digest").agg(least, F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    firsts = written(firsts.select(F.col("_digest").alias("_d"), F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row")), "firsts")
    slim = slim.join(firsts, slim["_digest"] == firsts["_d"], "left")
    mean = slim.agg(F.avg(F.length("html"))).first()[0] or 0.0
    first = F.when(F.length("html") >= smallest, F.col("first_row"))
    records = map_batches(slim.select("page_id", "url", "html", "row", "first_id", first.alias("first_row")), _to_warc, "value string")
    # A record and the two line ends that close it are one line of Spark's text writer: so files go to any store.
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1000)))).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """The records of the WARC files under path: page_id, payload_bytes, payload_digest, record_type, refers_to, warc_date, record_id.

    Size and digest are those of the payload that was read; a revisit has them from the record that it names.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = written(map_batches(files, _from_warc, _READ_SCHEMA), "records")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_date", "record_id")
    own = records.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    named = records.filter("record_type <> 'revisit'").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("page_id").alias("refers_to"))
    asked = records.filter("record_type = 'revisit'").drop("payload_bytes")
    named = written(named.join(asked.select(F.col("refers_id").alias("_asked")).distinct(), F.col("_id") == F.col("_asked"), "left_semi"), "named")
    again = joined_spread(asked, named, "refers_id", "_id", "record_id")
    again = again.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("_digest"), F.col("_digest"))).withColumnRenamed("_bytes", "payload_bytes")
    return own.unionByName(again.select(*columns))


def op10_legacy_archives(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)

