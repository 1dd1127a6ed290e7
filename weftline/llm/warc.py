"""WARC archives: writing records, reading them back, and reassembling segmented ones.

Archives are written by Spark's own file writer into the shared folder, each record a gzip member of its own, as
WARC readers expect; one file holds at most FILE_RECORDS records, so its size is bounded. Blocks longer than SEGMENT
bytes become a first segment and continuation records. Reading parses by content length. Reassembly groups segments by the
first one's record id, orders them by segment number, checks that none is missing or repeated and that the total length is
as told, and decodes the chunked transfer framing of the payload.

Null payloads are empty; empty ones are records without payload. Very long payloads become many segments. Rows without an
id are written too, with record ids of their own, and come back with a null id. Repeated rows are records each, with record ids of their own;
among equal payloads every row of the least id is a response. Extra columns are not written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import by_bytes, shared_dir, small_batches, stage_table

#: Payloads of fewer bytes are never revisits of another.
REVISIT_BYTES = 100
SEGMENT, CHUNK = 256 << 10, 16 << 10
FILE_RECORDS = 512
#: Payloads that are handled at a time, but for a longer one, which is handled alone.
BATCH_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"


# --- one record ------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (*headers, ("Content-Length", str(len(block)))))
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) for p in (payload[i : i + size],)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def segmented(headers: list[tuple[str, str]], block: bytes, uri: str, size: int = SEGMENT) -> list[bytes]:
    """The record, or its segments where the block is longer than size."""
    if len(block) <= size:
        return [record(headers, block)]
    origin = dict(headers)["WARC-Record-ID"]
    out, last = [], (len(block) - 1) // size
    for i in range(last + 1):
        part = block[i * size : (i + 1) * size]
        if i == 0:
            out.append(record([*headers, ("WARC-Segment-Number", "1")], part))
            continue
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}/{i + 1}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(i + 1))]
        out.append(record([*own, *([("WARC-Segment-Total-Length", str(len(block)))] if i == last else [])], part))
    return out


#: Bytes of an archive that are fed to the decompressor at a time.
FEED = 1 << 16


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of concatenated gzip members. Slices of FEED bytes are read, so a member's end costs no copy of all that follows."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at == len(view):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + FEED]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("a record is cut short")
    return headers, rest[:n]


# --- tables ----------------------------------------------------------------------------------------------------


def typed(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """(id, url, payload, size, digest, type, refers_to, nth, refers_many): what kind of record each row becomes.

    nth numbers the rows of an id and digest where the id occurs more than once; refers_many says that of refers_to.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    # Written first, so that Spark knows how small it is: the other rows stay where they are.
    many = stage_table(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Only digests with a revisit are joined back: one row for each group of equal payloads.
    first = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("digest", "first")
        .join(many.select(F.col("id").alias("first"), F.lit(True).alias("refers_many")), "first", "left")
    )
    if many.isEmpty():
        rows = rows.withColumn("nth", F.lit(None).cast("int"))
    else:
        numbered = rows.join(many, "id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")))
        rows = rows.join(many, "id", "left_anti").withColumn("nth", F.lit(None).cast("int")).unionByName(numbered)
    again = F.col("first").isNotNull() & (F.octet_length("payload") >= REVISIT_BYTES) & (F.col("id") > F.col("first"))
    return rows.join(first, "digest", "left").select(
        "id", "url", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"), "digest",
        F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"),
        "nth", F.coalesce("refers_many", F.lit(False)).alias("refers_many"),
    )


def write(rows: DataFrame, folder: str, segment: int = SEGMENT) -> None:
    """Archives of typed() rows, as files of folder.

    The writer sets its line separator between rows. It is a zero byte here, and a member's last byte, the
    top byte of its length, is zero as segments are far below 16 MB; so each row is a member without that byte,
    and a file is nothing but members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in by_bytes(batch, 2, BATCH_BYTES):
                out = []
                for r in part.to_pylist():
                    # A row without an id gets a record id from what it holds and where it stands; all segments of a row are of one task.
                    count += 1
                    if r["id"] is None:
                        name = "none-" + hashlib.sha256(f"{r['url']}\n{r['digest']}".encode()).hexdigest() + f".{task}.{count}"
                    else:
                        name = str(r["id"]) if r["nth"] is None else f"{r['id']};{r['digest']}.{r['nth']}"
                    uri = "".join(r["url"].split()) or "about:blank"
                    headers = [
                        ("WARC-Type", r["type"]), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
                        ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    if r["type"] == "revisit":
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{r['refers_to']}{';' + r['digest'] + '.1' if r['refers_many'] else ''}>")]
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\n\r\n" % r["size"]
                    else:
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(r["payload"])
                    out += [gzipped(x)[:-1] for x in segmented(headers, block, uri, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    files = small_batches(rows).mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


RECORD = "record_id string, type string, uri string, digest string, refers_to string, origin string, segment int, total bigint, block binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of the archives in folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for data in members(batch.column(0)[i].as_buffer().to_pybytes()):
                    h, block = parsed(data)
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"), h.get("warc-segment-origin-id"), int(h.get("warc-segment-number", 0)), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
                    held += len(block)
                    if held >= 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    # A file is one row, and at most FILE_RECORDS segments.
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, type, uri, digest, refers_to, block) of whole records.

    Records that stand in one piece are passed on as they are. A group is the segments of one record; segments
    that don't fit (missing, twice, or not of the total length) raise an error.
    """
    whole = records.where("segment = 0").select("record_id", "type", "uri", "digest", "refers_to", "block")
    parts = records.where("segment > 0").withColumn("whole_id", F.coalesce("origin", "record_id"))
    joined = parts.groupBy("whole_id").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("type", "uri", "digest", "refers_to"))).alias("head"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    # Joined as strings, which keep any bytes: arrays of binaries have no join of their own, and repeated concat() is quadratic.
    block = F.array_join(F.transform("parts.block", lambda x: x.cast("string")), "").cast("binary")
    sound = (F.size("parts") == F.element_at("parts.segment", -1)) & (F.size(F.array_distinct("parts.segment")) == F.size("parts")) & F.col("head").isNotNull()
    length = F.aggregate("parts.block", F.lit(0).cast("long"), lambda a, b: a + F.octet_length(b))
    return whole.unionByName(
        joined.select(
            F.col("whole_id").alias("record_id"), "head.*",
            F.when(sound & (length == F.col("total")), block).otherwise(F.raise_error(F.concat(F.lit("broken segments of "), "whole_id"))).alias("block"),
        )
    )


def payloads(records: DataFrame) -> DataFrame:
    """(record_id, type, uri, digest, refers_to, size, payload) of whole records; a revisit has no payload, but its size.

    The payload's SHA-256 is checked against the record's.
    """
    schema = "record_id string, type string, uri string, digest string, refers_to string, size bigint, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 5, BATCH_BYTES):
                sizes, bodies, digests = [], [], []
                for kind, digest, block in zip(*(part.column(i).to_pylist() for i in (1, 3, 5)), strict=True):
                    head, _, body = block.partition(b"\r\n\r\n")
                    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    digest = (digest or "").removeprefix("sha256:")
                    if kind == "revisit":
                        sizes.append(int(told[b"x-payload-length"]))
                        bodies.append(None)
                    else:
                        body = dechunked(body) if told.get(b"transfer-encoding") == b"chunked" else body
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError("a payload differs from its digest")
                        sizes.append(len(body))
                        bodies.append(body)
                    digests.append(digest)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests), part.column(4), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return small_batches(records).select("record_id", "type", "uri", "digest", "refers_to", "block").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives of them."""
    folder = f"{shared_dir(pages.sparkSession)}/archives"
    write(typed(pages), folder)
    back = payloads(reassembled(read(pages.sparkSession, folder)))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)(?:;[0-9a-f]+\.\d+)?>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return back.select(
        page("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""
