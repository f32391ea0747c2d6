"""WARC archives: writing with segmentation and revisits, reading with reassembly.

Writing: a page's HTTP message (chunked transfer framing) is a response record. A message
longer than ``segment`` bytes becomes a first segment and continuation records. Of equal
payloads of at least ``least`` bytes only the one with the least id is stored; the others are
revisit records. Records are rows of Spark's text writer, which ends each with the line feed
that ends a WARC record anyway, so archives go to any file system that Spark writes.

Reading: archives are split into records by Content-Length. Unsegmented messages are decoded
where they are read; only segments are shuffled: grouped by origin, ordered by number,
joined, held against the total length of the last one, and then decoded.

A null html is an empty payload; a null url leaves its field out; rows with a null id are
written with an empty id and come back as null. Rows of equal id and payload are each a
response. Line breaks in an url are percent-encoded, as are those in an id, blanks at its ends
and percent signs, which reading an id undoes. A record of broken framing comes back with
``whole`` false and no payload.
"""

from __future__ import annotations

import gzip
import io
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove_at_exit, shared_dir
from .kit import in_batches, small_side, written

SEGMENT = 16 << 10
CHUNK = 8 << 10
LEAST = 100
RECORDS = 5000  # in an archive: a reader holds one archive at a time
DATE = "2024-01-01T00:00:00Z"  # fixed, so that equal tables give equal archives
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BATCH_BYTES = 4 << 20


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Parts of about ``size`` bytes that split no UTF-8 sequence."""
    out, a = [], 0
    while a < len(data):
        b = min(a + size, len(data))
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        out.append(data[a:b])
        a = b
    return out


def framed(payload: bytes) -> bytes:
    """The payload as an HTTP message in chunked transfer framing."""
    return HEAD + b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, CHUNK)) + b"0\r\n\r\n"


def unframed(message: bytes) -> bytes:
    """The payload of an HTTP message; raises ValueError where its framing is broken."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("message without an end of its head")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of a wrong length")
        out.append(body[at : at + size])
        at += size + 2


def _told(x) -> str:
    """An id as a header's value; ``unquote`` undoes it."""
    x = str(x)
    inner = x.strip()
    return "".join(quote(c, safe="") if c in "%\r\n\t" or not (c.isprintable() or c == " ") else c for c in inner) if x == inner else quote(x, safe="")


def payload_of(message: bytes) -> bytes | None:
    """The payload of a message, or None where its framing is broken."""
    try:
        return unframed(message)
    except ValueError:
        return None


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r"  # the writer adds the last line feed


def records(row: int, page, url, html, digest: str, refers_to, segment: int) -> list[bytes]:
    page = "" if page is None else _told(page)
    name = f"<urn:larkspur:{row}>"
    common = [("WARC-Date", DATE), ("X-Page-ID", page)]
    if url is not None:
        common.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    common.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", _told(refers_to))], b"HTTP/1.1 200 OK\r\n\r\n")]
    parts = _cuts(framed((html or "").encode()), segment)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], parts[0])]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:larkspur:{row}:{i}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i))]
        if i == len(parts):
            own.append(("WARC-Segment-Total-Length", str(sum(map(len, parts)))))
        out.append(_record(own, part))
    return out


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, least: int = LEAST) -> None:
    """Write one record for each row (and its continuations) to archives below ``path``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha2(payload, 256).alias("digest"))
    narrow = pages.select(F.col(key).alias("page"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = narrow.groupBy("digest").agg(F.min("page").alias("lead"), F.count("*").alias("copies")).where("copies > 1").select("digest", "lead")
    # Only payloads that occur again are named here, so this side is small or is not sent.
    out = rows.join(small_side(first), "digest", "left")
    out = out.withColumn("refers", F.when(F.col("page") > F.col("lead"), F.col("lead"))).drop("lead").withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            made, size = [], 0
            for r in batch.select(["row", "page", "url", "html", "digest", "refers"]).to_pylist():
                for x in records(r["row"], r["page"], r["url"], r["html"], r["digest"], r["refers"], segment):
                    made.append(x)
                    size += len(x)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])

    in_batches(out, run, "value STRING").write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


def parsed(stream) -> list[tuple[dict[str, str], bytes]]:
    """Records of an archive, as (fields in lower case, block)."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record of a wrong length")
        yield fields, block


SCHEMA = "record_id STRING, page STRING, url STRING, record_type STRING, refers_to STRING, digest STRING, segment BIGINT, total BIGINT, block BINARY, payload BINARY, whole BOOLEAN"


def _parse(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"segment": pa.int64(), "total": pa.int64(), "block": pa.binary(), "payload": pa.binary(), "whole": pa.bool_()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types.get(c, pa.string())) for i, c in enumerate(names)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_py()
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
            rows, size = [], 0
            for f, block in parsed(stream):
                segment = f.get("warc-segment-number")
                origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                alone = f["warc-type"] == "response" and segment is None
                payload = payload_of(block) if alone else None
                told = [unquote(f[k]) if f.get(k) else None for k in ("x-page-id", "x-refers-to-page")]
                rows.append((origin, told[0], f.get("warc-target-uri"), f["warc-type"], told[1], (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None, int(segment) if segment else None, int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block if segment else None, payload, not alone or payload is not None))
                size += len(block)
                if size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark, path: str) -> DataFrame:
    """Records of all archives below a path, segments joined: record_id, page, url,
    record_type, refers_to, digest (as stored), payload (null for revisits), and ``whole``:
    false where segments are missing or do not reach the stated total length, or where the payload
    has not the stored digest."""
    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, SCHEMA)
    columns = ["record_id", "page", "url", "record_type", "refers_to", "digest", "payload"]
    alone = read.where("segment IS NULL").select(*columns, "whole")
    first = lambda c: F.max(c).alias(c)  # noqa: E731  only the first segment has it
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = read.where("segment IS NOT NULL").groupBy("record_id").agg(first("page"), first("url"), first("digest"), F.max("total").alias("total"), F.max("segment").alias("last"), parts.alias("parts"))
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p["block"]))
    complete = (F.col("last") == F.size("parts")) & (length == F.coalesce("total", F.lit(-1)))
    joined = joined.select("record_id", "page", "url", "digest", complete.alias("whole"), F.transform("parts", lambda p: p["block"]).alias("blocks"))

    def decode(batches):
        for batch in batches:
            payload = [payload_of(b"".join(x)) if ok else None for x, ok in zip(batch.column("blocks").to_pylist(), batch.column("whole").to_pylist())]
            whole = pa.array([p is not None for p in payload], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("record_id", "page", "url", "digest")), pa.array(payload, pa.binary()), whole], names=["record_id", "page", "url", "digest", "payload", "whole"])

    again = joined.mapInArrow(decode, "record_id STRING, page STRING, url STRING, digest STRING, payload BINARY, whole BOOLEAN")
    again = again.select("record_id", "page", "url", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "digest", "payload", "whole")
    out = alone.unionByName(again)
    # A stored SHA-256 is held against what was read.
    kept = F.col("payload").isNull() | F.coalesce(~F.rlike("digest", F.lit("^[0-9a-fA-F]{64}$")), F.lit(True)) | (F.lower("digest") == F.sha2("payload", 256))
    return out.withColumn("whole", F.col("whole") & kept)


def round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The columns of op9, from archives written and read back. Sizes and digests are those
    of the payloads read; a revisit has those of the response it refers to."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/archives"
    write_archives(pages, path, key)
    remove_at_exit(spark, folder)
    kind = pages.schema[key].dataType
    read = read_archives(spark, path).select("page", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.when(F.col("whole") & F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"))
    read = written(read, "records")
    responses = read.where("record_type = 'response'").select("page", "payload_bytes", "payload_digest")
    # A response that others refer to has the least id of its payload; one row for an id is enough.
    origin = responses.join(read.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("page")).distinct(), "page", "left_semi").groupBy("page", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    origin = origin.groupBy("page").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("o")).select(F.col("page").alias("refers_to"), "o")
    origin = small_side(origin.select("refers_to", "o.*"))  # many revisits may refer to one page
    revisits = read.where("record_type = 'revisit'").select("page", "refers_to").join(origin, "refers_to", "left").select("page", "refers_to", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"))
    out = responses.select("page", F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type")).unionByName(revisits)
    return out.select(F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
