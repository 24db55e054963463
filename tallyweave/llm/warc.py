"""WARC archives: records written by Spark, read back, segments reassembled, chunked framing decoded."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staging, join_counted

_END = "\r\n\r\n"
_RECORD = "id string, type string, origin string, segment int, total long, digest string, refers_to string, uri string, block binary"
_CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: str, chars: int) -> str:
    """A body in chunked transfer framing, cut at character boundaries."""
    cuts = [payload[k : k + chars] for k in range(0, len(payload), chars)]
    return "".join(f"{len(c.encode()):X}\r\n{c}\r\n" for c in cuts) + "0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or ends early."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size, at = int(m[1], 16), m.end()
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2
    return None


def _records(page_id, row, url, payload, digest, first_page, first_row, segment_chars, chunk_chars) -> Iterator[str]:
    """The records of a page, each without the blank lines that end it: a response in segments as needed, or a revisit."""
    urn = lambda page, row: f"urn:page:{'' if page is None else page}:row:{row}"
    name = lambda n: f"<{urn(page_id, row)}>" if n == 1 else f"<{urn(page_id, row)}:{n}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)

    def record(kind, n, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(n)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", *more]
        return "WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}"

    payload_head = f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    if first_row != row:
        yield record("revisit", 1, "", payload_head, f"WARC-Refers-To: <{urn(first_page, first_row)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_chars)
    cuts = [block[k : k + segment_chars] for k in range(0, len(block), segment_chars)]
    if len(cuts) == 1:
        yield record("response", 1, block, payload_head)
        return
    yield record("response", 1, cuts[0], payload_head, "WARC-Segment-Number: 1")
    for n, cut in enumerate(cuts[1:], 2):
        last = [f"WARC-Segment-Total-Length: {len(block.encode())}"] if n == len(cuts) else []
        yield record("continuation", n, cut, f"WARC-Segment-Origin-ID: {name(1)}", f"WARC-Segment-Number: {n}", *last)


def write_archives(
    pages: DataFrame, path: str, staging: Staging, *, min_dedup_bytes: int = 0, segment_chars: int = 32_768, chunk_chars: int = 4_096, records_per_file: int = 1_000, compression: str = "gzip"
) -> None:
    """Write ``pages`` (page_id, url, html) as WARC 1.1 files below ``path``.

    Of pages with equal payloads (by SHA-256 and length) of at least
    ``min_dedup_bytes`` bytes the smallest page_id is a response and the
    others are revisits of it. Long responses are cut into continuation
    records of ``segment_chars`` characters. Spark's text writer puts the
    blank lines after each record, so a retried task leaves one copy of its
    file. Null url and html are empty. Every row is a record of its own, also
    where it repeats a page_id or has none (a null page_id stands last among
    equal payloads); record ids carry the row's number in the input. Payloads
    that very many pages share are not gathered: see ``join_counted``.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"), F.concat_ws(":", F.sha2(payload.cast("binary"), 256), F.octet_length(payload)).alias("same"),
    )
    size = F.octet_length("payload")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staging.save(firsts.select("same", "first.page_id", "first.row", "n").toDF("same", "first_page", "first_row", "n"), "firsts")
    own = size < min_dedup_bytes
    rows = join_counted(rows, firsts, "same", "n").select(
        "page_id", "row", "url", "payload", F.sha1(F.col("payload").cast("binary")).alias("digest"),
        F.when(own, F.col("page_id")).otherwise(F.col("first_page")).alias("first_page"), F.when(own, F.col("row")).otherwise(F.col("first_row")).alias("first_row"),
    )

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "row", "url", "payload", "digest", "first_page", "first_row")]
            out, size = [], 0
            for row in zip(*cols, strict=True):
                for r in _records(*row, segment_chars, chunk_chars):
                    out.append(r)
                    size += len(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records = rows.mapInArrow(run, "value string")
    records.write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).option("compression", compression).mode("overwrite").text(path)


def parse_records(data: bytes) -> Iterator[tuple]:
    """The records of one archive file (plain or gzip), by their Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = (line.partition(b":") for line in data[at:end].split(b"\r\n")[1:])
        head = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, cut, v in lines if cut}
        start = end + 4
        at = start + int(head.get(b"content-length", 0))
        number, total = head.get(b"warc-segment-number"), head.get(b"warc-segment-total-length")
        yield (
            head.get(b"warc-record-id"), head.get(b"warc-type"), head.get(b"warc-segment-origin-id"), number and int(number), total and int(total),
            head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, head.get(b"warc-refers-to"), head.get(b"warc-target-uri"), data[start:at],
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path``; files are bounded by the writer, one is parsed at a time."""
    schema = pa.schema([("id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("block", pa.binary())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out, size = [], 0
                for record in parse_records(batch.column(0)[k].as_py()):
                    out.append(record)
                    size += len(record[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """id, type, digest, refers_to, uri, payload, payload_bytes, valid for every logical record.

    Continuation records are grouped by their origin's id and ordered by
    segment number; the total length must agree and no segment may miss. A
    whole block's HTTP head is cut off and chunked framing decoded. ``valid``
    is false, and payload null, for a broken record. A revisit has no payload.
    Only segmented records are shuffled, so a group is one record's segments.
    """
    whole = records.where("segment is null")
    parts = records.where("segment is not null").withColumn("whole_id", F.coalesce("origin", "id"))
    joined = parts.groupBy("whole_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("origin").isNull(), F.col(c))).alias(c) for c in ("type", "digest", "refers_to", "uri")],
    )
    sizes = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    numbered = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))
    joined = joined.select(
        F.col("whole_id").alias("id"), "type", "digest", "refers_to", "uri",
        F.when((sizes == F.col("total")) & numbered & F.col("type").isNotNull(), F.transform("s", lambda x: x["block"])).alias("blocks"),
    )
    every = whole.select("id", "type", "digest", "refers_to", "uri", F.array("block").alias("blocks")).unionByName(joined)

    def run(batches):
        for batch in batches:
            payloads = []
            for kind, blocks in zip(batch.column("type").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                head, cut, body = b"".join(blocks or []).partition(b"\r\n\r\n")
                if kind != "response" or not cut:
                    payloads.append(None)
                elif re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
                    payloads.append(dechunked(body))
                else:
                    payloads.append(body)
            digests = [None if p is None else payload_digest(p) for p in payloads]
            stated = batch.column("digest").to_pylist()
            kinds = batch.column("type").to_pylist()
            valid = [k == "revisit" if p is None else d == s for p, d, s, k in zip(payloads, digests, stated, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(payloads, pa.binary()), pa.array([None if p is None else len(p) for p in payloads], pa.int64()), pa.array(valid)],
                names=[*batch.schema.names[:-1], "payload", "payload_bytes", "valid"],
            )

    return every.mapInArrow(run, "id string, type string, digest string, refers_to string, uri string, payload binary, payload_bytes long, valid boolean")


def archive_round_trip(pages: DataFrame, *, staging: Staging | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives, read them back: one row per page from what was read.

    Rows that repeat a page_id or have none get a row each.

    page_id, payload_bytes and payload_digest (of the full payload; a revisit
    takes the bytes from the response that it names), record_type and
    refers_to. A broken record has null payload columns. No pages, no rows.
    """
    spark = pages.sparkSession
    staging = staging or Staging(spark, "warc")
    write_archives(pages, staging.path("archives"), staging, **options)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*):row:\d+>$", 1), F.lit("")).cast("long")
    found = reassemble(read_archives(spark, staging.path("archives"))).select(
        "id", number("id").alias("page_id"), "payload_bytes", F.when(F.col("valid"), F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )
    found = staging.save(found, "found")
    staging.drop("archives", "firsts")
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes")
    asked = staging.save(revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n")), "asked")
    sizes = asked.join(found.where("record_type = 'response'").select(F.col("id").alias("refers_to"), "payload_bytes"), "refers_to", "left")
    sizes = staging.save(sizes, "sizes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(join_counted(revisits, sizes, "refers_to", "n").select(*columns, number("refers_to").alias("refers_to")))
