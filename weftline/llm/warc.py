"""WARC archives with revisit records, written and read by Spark.

Revisit resolution works on headers only: digest and id are grouped by digest (combined before the shuffle, so a payload
that a third of all pages share is one row for each task), which gives one original for each repeated payload.  That
table is written, so the join back to the pages is a plain one: broadcast while it is small, else a sort-merge join of
which adaptive execution splits a hot digest.  The payloads themselves are never shuffled when it is broadcast.

Records are text (payloads are UTF-8), so Spark's text sink writes them with the WARC record end as line separator.
Each task packs its records, in the order they come, into rows of at most ``FILE_BYTES`` and writes a row a file, without a
shuffle or a sort; reading hands one file at a time to a parser that follows Content-Length, so payloads may hold
anything, record ends included.  Memory of a task follows the bound, or one record where that is longer.

Cases: a null payload is empty; a payload below the limit is always a response; of repeated rows with the original's
id all are responses (with equal record ids, as they are one record written twice), and revisits name the largest of
their urls; where all ids of a payload are null, all its records are responses; a record longer than the bound has a file
of its own; no pages: no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_arrow, scratch, written

FILE_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"


def resolve(pages: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its ``digest`` and ``bytes``, and for a revisit the id (``original``) and url
    (``original_url``) of the response it refers to, else nulls."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns(
        {"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")}
    )
    headers = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
    known = headers.agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
    known = known.filter("n > 1 AND top.page_id IS NOT NULL")
    known = known.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("top.page_id").alias("original"), F.col("top.url").alias("top_url"))
    originals = written(known, "warc-originals")
    joined = rows.join(originals, (rows.digest == originals.d) & (rows.bytes == originals.b), "left")
    other = ~F.col("original").eqNullSafe(F.col("page_id"))
    refers = (F.when(other, F.col("original")).alias("original"), F.when(other, F.col("top_url")).alias("original_url"))
    return joined.select("page_id", "url", "payload", "digest", "bytes", *refers)


def _id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _uri(url: str) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\x00-\x20]", "")


def records(resolved: DataFrame) -> DataFrame:
    """One text column ``record``: header block, and for responses the payload, without the record end."""
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    # one time for all records of a write, so the date of a revisit's response is its own
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _id(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), _uri("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("original"), F.col("digest")))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri("original_url"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), date)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    head = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), http)
    return resolved.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of consecutive records, joined by the record end, each of at most ``most`` bytes or one record."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for record in batch.column(0):
            text = record.as_py()
            n = record.as_buffer().size + len(END)
            if held and size + n > most:
                yield pa.RecordBatch.from_pydict({"record": pa.array([END.join(held)])})
                held, size = [], 0
            held.append(text)
            size += n
    if held:
        yield pa.RecordBatch.from_pydict({"record": pa.array([END.join(held)])})


def write_archives(resolved: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Archives below ``path``, each of at most ``file_bytes`` bytes or one record."""
    rows = records(resolved).mapInArrow(lambda batches: packed(batches, file_bytes), "record string")
    rows.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def parse(content: memoryview | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive."""
    content, at = bytes(content), 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {at}")
        at += 4
        yield headers, block


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").split(":")[0]
    return int(text) if text else None


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for content in batch.column(0):
        out: list[tuple] = []
        for headers, block in parse(content.as_buffer()):
            http, _, payload = block.partition(b"\r\n\r\n")
            bytes_ = int(http.rpartition(b"Content-Length: ")[2])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = headers["WARC-Type"]
            if kind == "response":
                whole = len(payload) == bytes_ and hashlib.sha1(payload).hexdigest() == digest
                refers = None
            else:
                whole, refers = not payload, _page(headers["WARC-Refers-To"])
            out.append((_page(headers["WARC-Record-ID"]), bytes_, digest, kind, refers, whole))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")
        yield {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record; ``whole``: a response's payload has the size and digest its headers say."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, _rows, READ)


def deduplicate(pages: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """Writes the archives into the shared folder and gives what they hold; a damaged record fails the job."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(resolve(pages, least_bytes=least_bytes), path)
    back = read_archives(pages.sparkSession, path)
    sound = F.when(~F.col("whole"), F.raise_error(F.lit("a record's payload does not have its digest"))).otherwise(F.col("page_id"))
    return back.select(sound.cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
