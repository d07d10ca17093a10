"""WARC: archives are written from pages, read back, and assembled into transactions.

Writing makes three records per page: a request, a response (or a revisit, if an equal payload has a response already)
and a metadata record; request and metadata name the capture in WARC-Concurrent-To. They are native expressions: the
three records of a page are one row of Spark's text writer, whose line end is the last of the empty lines that close a
record, so that part files are WARC files, compressed whole, which a retried task writes anew as they were. Only digests
that several pages share are joined to the pages, by a broadcast of checked size, so payloads stay where they are.

Reading parses files by Content-Length, whatever the payload holds, one file in memory at a time. Pages of more than
``LONG_BYTES`` are written apart, and the rows of a file are bounded for each kind by its mean and its longest page: a file
holds about ``FILE_BYTES``, ``MOST_BYTES`` at most, or one page. The payload's bytes and SHA-1 are measured from the blocks.
A response whose digest or length isn't what its headers say, and a revisit whose response is missing or has another
digest, stop the run with an error. Assembly joins the records of a capture by a grouped aggregate over narrow rows on the
capture's id, emits one nested row per capture, and resolves revisits by record id.

Of rows with equal payloads of ``MIN_BYTES`` or more, that with the smallest page_id is the response. Defined cases: null
payloads are empty; null page_ids come last; rows equal in page_id and payload are captures of their own that share
record ids, and are all responses if one is; a null URL has no target URI; control characters in URLs are escaped; an
empty table gives no captures; a page of any length is one record; other columns, whatever their names, aren't archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bitmap, maybe, shared_dir, spread, table, written

MIN_BYTES = 0
FILE_BYTES = 32 << 20
MOST_BYTES = 256 << 20
LONG_BYTES = 128 << 10
#: Bytes of the headers of a page's three records, and of its other two blocks, besides its URL.
OTHER_BYTES = 1500
DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
RECORDS = "id string, kind string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits."""
    digest = F.sha1(payload)
    out = []
    for k in range(8):
        group = F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(_BASE32), F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*out)


def record_id(page_id: Column, digest: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def described(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, bytes, the leader (page_id of the response, if several share the payload), and revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("n"))
    shared = written(shared.where("n > 1 AND leader IS NOT NULL").select("digest", "leader"))
    if shared.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(shared), "digest", "left")
    else:  # only payloads that may be shared move
        rows = maybe(rows.withColumn("h", F.xxhash64("digest")), "h", bitmap(written(shared.withColumn("h", F.xxhash64("digest"))), "h"))
        alone = rows.where("NOT maybe").withColumn("leader", F.lit(None).cast(shared.schema["leader"].dataType))
        out = alone.unionByName(spread(rows.where("maybe"), shared, "digest", F.xxhash64("page_id"), "left")).drop("h", "maybe")
    return out.withColumn("revisit", F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")))


def _record(kind: Column | str, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        head.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    return F.concat(*head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def write_archives(pages: DataFrame, out: str, min_bytes: int = MIN_BYTES) -> None:
    rows = described(pages, min_bytes)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    main, digest = record_id(F.col("page_id"), F.col("digest"), "capture"), F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    date = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]
    revisit = [
        ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("leader"), F.col("digest"), "capture"))),
    ]
    capture = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        [("WARC-Record-ID", main), *date, ("WARC-Payload-Digest", digest), *revisit, ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))),
    )
    path = F.regexp_extract(uri, r"^[^:]*://([^/?#]*)([^#]*)", 2)
    request = F.concat(F.lit("GET "), F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    asked = _record("request", [("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"), "request")), *date, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))], request)
    facts = F.coalesce(F.concat(F.lit("page: "), F.col("page_id").cast("string"), F.lit(_END)), F.lit(""))
    meta = _record("metadata", [("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"), "metadata")), *date, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))], facts)
    text = F.concat(asked, capture, meta)
    size, long_ = F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + OTHER_BYTES, F.coalesce(F.octet_length("html") > LONG_BYTES, F.lit(False))
    kinds = pages.groupBy(long_.alias("long")).agg(F.avg(size).alias("mean"), F.max(size).alias("most")).collect()  # two rows at most
    for kind in kinds or [Row(long=False, mean=1, most=1)]:
        lines = rows.where(F.col("bytes") > LONG_BYTES if kind.long else F.col("bytes") <= LONG_BYTES).select(text.alias("v")).select(F.substring("v", F.lit(1), F.length("v") - 2).alias("value"))
        per_file = max(1, int(min(FILE_BYTES / kind.mean, MOST_BYTES / kind.most)))
        lines.write.option("lineSep", _END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(f"{out}/{'long' if kind.long else 'short'}")


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record of an archive; names of headers are lower-cased."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, view[stop + 4 : stop + 4 + n]
        at = stop + 4 + n


def _measured(head: dict[str, str], block: memoryview) -> dict:
    """What a capture's block holds: the payload's bytes and digest of a response, as measured and as its headers say."""
    payload = bytes(block).partition(b"\r\n\r\n")[2]
    told = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        return {"payload_digest": told, "refers_to": head["warc-refers-to"]}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(block).partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")[1:])}
    if digest != told or int(http["content-length"]) != len(payload):
        raise ValueError(f"payload of {head['warc-record-id']} is damaged: {len(payload)} bytes of digest {digest}, not {http['content-length']} of {told}")
    return {"payload_bytes": len(payload), "payload_digest": digest}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    for batch in batches:
        for content in batch.column(0):
            out = []
            data = content.as_py()
            for head, block in parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                kind = head["warc-type"]
                row = dict.fromkeys(schema.names) | {"id": head["warc-record-id"], "kind": kind, "concurrent_to": head.get("warc-concurrent-to"), "uri": head.get("warc-target-uri")}
                if kind in ("response", "revisit"):
                    row |= _measured(head, block)
                elif kind == "metadata":
                    facts = dict(x.split(": ", 1) for x in bytes(block).decode().split("\r\n") if x)
                    row["page_id"] = int(facts["page"]) if "page" in facts else None
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_rows, RECORDS)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, capture, request and metadata."""
    whole = F.struct("id", "kind", "uri", "payload_bytes", "payload_digest", "refers_to")
    is_main = F.col("kind").isin("response", "revisit")
    out = records.groupBy(F.coalesce("concurrent_to", "id").alias("capture_id")).agg(
        F.count(F.when(is_main, 1)).alias("n"),
        F.max(F.when(is_main, whole)).alias("capture"),
        F.max(F.when(F.col("kind") == "request", F.struct("id", "uri"))).alias("request"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("id", "page_id"))).alias("metadata"),
    )
    return out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def resolved(captures: DataFrame) -> DataFrame:
    """Written captures with ``response``: for a revisit, the id, page_id, payload_bytes and payload_digest of its response."""
    is_revisit = F.col("capture.kind") == "revisit"
    responses = captures.where(~is_revisit).select(F.col("capture.id").alias("refers_to"), F.struct(F.col("capture.id").alias("id"), F.col("metadata.page_id").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest")).alias("response"))
    responses = responses.groupBy("refers_to").agg(F.max("response").alias("response"))
    revisits = captures.where(is_revisit).withColumn("refers_to", F.col("capture.refers_to"))
    told, found = F.col("capture.payload_digest"), F.col("response.payload_digest")
    right = F.when(told.eqNullSafe(found), F.col("response")).otherwise(F.raise_error(F.concat(F.lit("no response of the digest of "), F.col("capture.id"), F.lit(" at "), F.col("refers_to"))))
    revisits = spread(revisits, responses, "refers_to", F.xxhash64("capture_id"), "left").withColumn("response", right).drop("refers_to")
    return captures.where(~is_revisit).withColumn("response", F.lit(None).cast(revisits.schema["response"].dataType)).unionByName(revisits)


def op10(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    out = resolved(written(assembled(read_records(spark, path))))
    return out.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("capture.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.col("response.page_id").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[(k // 4) * 5 + 1 : (k // 4) * 5 + 5])::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1]), '') AS payload_digest FROM p),
l AS (SELECT payload_digest, min(page_id) AS leader FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN leader IS NULL OR page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN leader IS NULL OR page_id IS NOT DISTINCT FROM leader THEN NULL ELSE leader END AS refers_to
FROM d JOIN l ON d.payload_digest = l.payload_digest
"""
