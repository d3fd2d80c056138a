"""WARC archives: writing, and reading back with segment reassembly.

``write_archives`` makes one response or revisit record for each page, as files of WARC/1.1 in a folder of any store that Spark writes to. A
response's payload is framed by chunked transfer encoding; a long record is segmented: the first part is the response record with segment
number 1, the others are continuation records that name its id as their origin and may stand in other files; the last one gives the total length.

``read_archives`` parses every file, groups continuation records by origin identifier, orders them by segment number, verifies the numbers and
the total length, and takes the payload out of the chunked framing, verifying its digest. A record without segments never leaves its task.

Defined cases: null html is the empty payload; an empty payload is one chunk of size zero; a null url gives a record without target; pages with equal payloads
(of ``least`` bytes or more) have one response, that of the greatest page_id, and revisits that name it; a row without page_id takes no part in that and is always a response; repeated rows
(same page_id and payload) are written once each: one of them is the response; rows with the same page_id and other payloads are pages of their own. Of several equal urls
or rows, which one is the response makes no difference to the result. A payload of any length is written whole, in segments; an empty table gives empty archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

#: Bytes of block in one record at most; of a transfer chunk; of an archive file, about.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 32_768, 8_192, 8_000_000
DATE, END = "2026-01-01T00:00:00Z", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, page_id long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def framed(payload: bytes) -> bytes:
    """payload in chunked transfer encoding."""
    out = []
    for a in range(0, len(payload), CHUNK_BYTES):
        part = payload[a : a + CHUNK_BYTES]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    """The payload of a body in chunked transfer encoding; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode("utf-8")


def _clean(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def record_id(number: str, segment: int = 1) -> str:
    return f"<urn:page:{number}>" if segment == 1 else f"<urn:page:{number}:{segment}>"


def response_number(page_id: int, sha: str) -> str:
    """What names the response of a page with this payload; a revisit can tell it without a look at the response."""
    return f"{page_id}-{sha}"


def records(number: str, url: str | None, payload: bytes, sha: str, refers_to: int | None, page_id: int | None) -> Iterator[bytes]:
    """The WARC records of one page, without the two line ends that close a record. number: no other page's record in the archives has it."""
    name = record_id(number)
    shared = [("WARC-Target-URI", _clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", page_id)]
    if refers_to is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response_number(refers_to, sha))), ("X-Refers-To-Page", refers_to)]
        yield header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))]) + http
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload)
    parts = [block[a : a + SEGMENT_BYTES] for a in range(0, len(block), SEGMENT_BYTES)]
    for k, part in enumerate(parts, 1):
        fields: list[tuple[str, object]] = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(number, k))]
        if k == 1:
            fields += [*shared, ("Content-Type", "application/http; msgtype=response")]
        else:
            fields += [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name)]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", k)]
            if k == len(parts):
                fields += [("WARC-Segment-Total-Length", len(block))]
        yield header([*fields, ("Content-Length", len(part))]) + part


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        stop = archive.index(END, at)
        fields = {}
        for line in archive[at:stop].decode("utf-8").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        begin, size = stop + 4, int(fields["content-length"])
        if archive[begin + size : begin + size + 4] != END:
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, archive[begin : begin + size]
        at = begin + size + 4


def _payloads(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with ``sha`` (SHA-1 in hex) and ``refers_to``: the page whose record holds the same payload, null for responses.

    Only ids and digests are shuffled by digest; a digest of very many pages is one row of the side with the greatest ids."""
    marks = pages.where("page_id is not null").select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    greatest = marks.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("greatest"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = marks.where(F.col("n") >= least).join(greatest, "sha").select("page_id", "sha", "greatest").distinct()
    out = pages.withColumn("sha", F.sha1("payload")).join(found, ["page_id", "sha"], "left")
    first = F.row_number().over(Window.partitionBy("page_id", "sha").orderBy("url")) == 1
    return out.withColumn("refers_to", F.when(F.col("greatest").isNull() | ((F.col("greatest") == F.col("page_id")) & first), None).otherwise(F.col("greatest"))).drop("greatest")


def write_archives(pages: DataFrame, path: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archives of all pages under path, as gzip files of about FILE_BYTES before compression; Spark's committer leaves out what lost tasks wrote."""
    rows = marked(_payloads(pages, key, url, html), least).withColumn("number", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex(F.monotonically_increasing_id())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, link, payload, sha, refers, number in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "sha", "refers_to", "number")), strict=True):
                # Of a page and a payload of ``least`` bytes or more there is one response at most: page and digest name it. Other records have a number of their own.
                sha32 = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
                out += records(response_number(page, sha32) if refers is None and page is not None and len(payload) >= least else number, link, payload, sha32, refers, page)
                size += len(payload)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # A record ends with two line ends: the line separator of the text writer. A file has so many records as bring it near FILE_BYTES.
    made.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_BYTES // 4096).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit record under path (RECORD), after reassembly. Raises on damage: a missing segment, a false length or digest."""
    parts = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_py()
                rows = []
                for f, block in parsed(gzip.decompress(raw) if name.endswith(".gz") else raw):
                    if "warc-segment-number" in f:
                        number = int(f["warc-segment-number"])
                        total = f.get("warc-segment-total-length")
                        rows.append((f["warc-record-id"] if number == 1 else f["warc-segment-origin-id"], number, int(total) if total else None, block, _fields(f) if number == 1 else None, None))
                    else:
                        rows.append((f["warc-record-id"], 0, None, None, _fields(f), _told(f, block)))
                yield from pa.Table.from_pylist([dict(zip(SEGMENT.names, r, strict=True)) for r in rows], schema=SEGMENT).to_batches()

    fields = "struct<record_type:string, url:string, digest:string, refers_to:long, page_id:long>"
    segments = parts.mapInArrow(run, f"origin string, number int, total long, block binary, fields {fields}, told struct<payload_bytes:long,payload_digest:string>")
    whole = segments.where("number = 0").select(F.col("told.payload_bytes").alias("payload_bytes"), F.col("told.payload_digest").alias("payload_digest"), "fields.record_type", "fields.refers_to", F.col("origin").alias("record_id"), "fields.url", "fields.page_id")
    joined = segments.where("number > 0").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.first("fields", True).alias("fields"), F.count("total").alias("lasts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, pieces, total, f, lasts in zip(*(batch.column(k).to_pylist() for k in ("origin", "parts", "total", "fields", "lasts")), strict=True):
                if f is None or lasts != 1 or [p["number"] for p in pieces] != list(range(1, len(pieces) + 1)):
                    raise ValueError(f"segments of {origin} are missing or doubled")
                block = b"".join(p["block"] for p in pieces)
                if len(block) != total:
                    raise ValueError(f"{origin} has {len(block)} bytes of {total}")
                size, sha = _told({"warc-type": f["record_type"], "warc-payload-digest": f["digest"]}, block).values()
                rows.append({"payload_bytes": size, "payload_digest": sha, "record_type": f["record_type"], "refers_to": f["refers_to"], "record_id": origin, "url": f["url"], "page_id": f["page_id"]})
            yield from pa.Table.from_pylist(rows, schema=OUT).to_batches()

    return whole.select(*OUT.names).unionAll(joined.mapInArrow(join, RECORD))


SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("fields", pa.struct([("record_type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("page_id", pa.int64())])), ("told", pa.struct([("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))])
OUT = pa.schema([("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64())])


def _fields(f: dict[str, str]) -> dict:
    number = lambda k: int(f[k]) if k in f else None
    return {"record_type": f["warc-type"], "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "refers_to": number("x-refers-to-page"), "page_id": number("x-page-id")}


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n")[1:])
    return unframed(body) if chunked else body


def _told(f: dict[str, str], block: bytes) -> dict:
    """Size and digest of the full payload: of a revisit as its record tells them, of a response as they are."""
    told = (f.get("warc-payload-digest") or "sha1:").removeprefix("sha1:")
    if f["warc-type"] == "revisit":
        lines = block.partition(b"\r\n\r\n")[0].split(b"\r\n")
        return {"payload_bytes": next(int(x[15:]) for x in lines if x.lower().startswith(b"content-length:")), "payload_digest": told}
    payload = payload_of(block)
    if digest(payload) != told:
        raise ValueError("a payload doesn't have its digest")
    return {"payload_bytes": len(payload), "payload_digest": told}


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as tables:
        path = tables.path("warc")
        write_archives(table(spark, sf_dir, "pages"), path)
        return tables.kept(read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "pages-told")


_BITS = "".join(f"{k:04b}" for k in range(16))
ORACLE = f"""
    WITH told AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda k: substr('{_BITS}', 4 * instr('0123456789abcdef', hex[k]) - 3, 4)), 'string_agg', '') AS b FROM told),
    named AS (
        SELECT page_id, payload_bytes, hex, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(b[5 * k + j + 1] AS INTEGER) * (1 << (4 - j)))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest
        FROM bits),
    greatest_ AS (SELECT hex, max(page_id) AS top FROM named GROUP BY hex),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, hex) AS r FROM named)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NULL OR (page_id = top AND r = 1) THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT (page_id IS NULL OR (page_id = top AND r = 1)) THEN top END AS refers_to
    FROM ranked JOIN greatest_ USING (hex)"""

__all__ = ["ORACLE", "digest", "framed", "marked", "op9_warc", "parsed", "read_archives", "records", "unframed", "write_archives"]
