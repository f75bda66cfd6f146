"""WARC archives: written from page tables, read back, segments put together again.

``write`` makes one record a page. Equal payloads are stored once: the page with the
largest id keeps its response, others become revisits of it. Blocks longer than a segment
are cut: a first record, then continuation records that name its id and their number, the
last one with the length of the whole. Archives are plain WARC/1.1 text of bounded size,
written by Spark's own writer, so they lie wherever Spark can write and a lost task leaves
nothing behind.

``read`` parses each archive where it is read. Whole records are decoded there; segments
alone are shuffled, by the record they continue, sorted by number and put together one
record at a time, so a task holds one block, not a group. Lengths and numbers are verified,
then the HTTP message is taken apart: header, chunked framing or stated length, payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir

#: Bytes of records in an archive at most, before compression.
ARCHIVE_BYTES = 32 << 20
#: Bytes of records that a task hands on at once.
BATCH_BYTES = 4 << 20
#: Parts that the rows of one payload are dealt to.
SALTS = 64
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "record_id string, type string, uri string, refers_to string, declared string"


def base32_sha1(data: bytes) -> str:
    """The SHA-1 of bytes, 32 upper-case base32 digits."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing --------------------------------------------------------------------


def kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, payload) with digest (SHA-1, hexadecimal) and top: the largest page_id with the same
    payload, null where the payload is shorter than least_bytes.

    A payload that many pages share is dealt to SALTS parts, counted there first."""
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = pages.withColumn("digest", F.sha1("payload")).withColumn("salt", salt)
    parts = rows.groupBy("digest", "salt").agg(F.max("page_id").alias("m"))
    whole = parts.groupBy("digest").agg(F.max("m").alias("top"))
    tops = parts.join(whole, "digest").select("digest", "salt", "top")
    long = F.octet_length("payload") >= least_bytes
    return rows.join(tops.hint("merge"), ["digest", "salt"]).withColumn("top", F.when(long, F.col("top"))).drop("salt")


def _chunked(payload: bytes, size: int) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for its very last byte, a line feed."""
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block))) if v is not None)
    return b"WARC/1.1\r\n%s\r\n%s\r\n\r" % (head.encode(), block)


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, top: int | None, revisit: bool, date: str, segment_bytes: int, chunk_bytes: int):
    """The records of one page, each without its last byte; digest is hexadecimal."""
    digest = base64.b32encode(bytes.fromhex(digest)).decode()
    name = lambda i: f"<urn:page:{'' if i is None else i}:{digest}>"
    own = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(top))], head)
        return
    block = head + _chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *own], block)
        return
    last = (len(block) - 1) // segment_bytes + 1
    for i in range(1, last + 1):
        part = block[(i - 1) * segment_bytes : i * segment_bytes]
        if i == 1:
            yield _record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1)], part)
        else:
            total = len(block) if i == last else None
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name(page_id)[:-1]}:{i}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], part)


def write(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = 1 << 20, chunk_bytes: int = 1 << 13, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages(page_id, url, html) to gzipped archives in path,
    a new folder.

    Of rows with equal payloads (html in UTF-8; null is empty) of least_bytes or more, those
    with the largest page_id become responses and the others revisits of them; all rows with
    shorter payloads responses. A null page_id counts as less than all others. Rows that
    repeat page_id and payload become equal records. Control characters and blanks in a url
    are escaped, a null url is left out. Other columns are not read; an empty table makes an
    archive without records. Very long pages become many segments.
    """
    if segment_bytes < 1 or chunk_bytes < 1:
        raise ValueError("segments and chunks have a byte at least")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = kinds(rows, least_bytes)
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows = rows.select("page_id", "url", F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"), "digest", "top", revisit.alias("revisit"))

    def made(batches):
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                for record in records_of(*row[:2], row[2] or b"", *row[3:], date, segment_bytes, chunk_bytes):
                    out.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    text = rows.mapInArrow(made, "value binary").select(F.col("value").cast("string"))
    most = max(1, ARCHIVE_BYTES // (segment_bytes + 1024))
    text.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", most).text(path)


# --- reading --------------------------------------------------------------------


def parse(raw: io.BufferedIOBase):
    """(fields, block) of each record of an archive, names in lower case; block None where
    the archive ends within it or no length is given."""
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := raw.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit():
            yield fields, None
            return
        block = raw.read(int(size))
        yield fields, block if len(block) == int(size) else None


def opened(content: bytes) -> io.BufferedIOBase:
    """An archive's bytes, gzipped (in any number of members) or not."""
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else plain


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; extensions and trailers are passed over. None where the
    framing is broken."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 1
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) < n:
            return None
        at += n
        if body[at : at + 2] == b"\r\n":
            at += 2
        elif body[at : at + 1] == b"\n":
            at += 1
        else:
            return None
    return None


def payload_of(kind: str, block: bytes | None) -> tuple[bytes | None, str | None]:
    """A record's payload, and what is wrong with it. Revisits have none."""
    if block is None:
        return None, "truncated"
    if kind == "revisit":
        return None, None
    if kind != "response":
        return block, None
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    if not gap or not head.startswith(b"HTTP/"):
        return None, "header"
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\n")[1:])}
    if b"chunked" in named.get(b"transfer-encoding", b"").lower():
        got = unchunked(body)
        return got, None if got is not None else "framing"
    size = named.get(b"content-length", b"")
    if size.isdigit():
        return (body[: int(size)], None) if len(body) >= int(size) else (None, "length")
    return body, None


class _Out:
    """Rows on their way out, BATCH_BYTES at a time."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int):
        self.rows.append(row)
        self.size += size + 256
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self):
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.size = [], 0


_TEXTS = [pa.field(n.split()[0], pa.string()) for n in _FIELDS.split(", ")]
_SEGMENT = pa.schema([*_TEXTS, pa.field("origin", pa.string()), pa.field("number", pa.int64()), pa.field("total", pa.int64()), pa.field("block", pa.binary())])
_READ = pa.schema([*_TEXTS, pa.field("payload", pa.binary()), pa.field("size", pa.int64()), pa.field("digest", pa.string()), pa.field("problem", pa.string())])
_READS = f"{_FIELDS}, payload binary, size long, digest string, problem string"
_WANTED = ("response", "resource", "revisit")


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,18}", text) else None


def _named(fields: dict[str, str]) -> tuple:
    return tuple(fields.get(k) for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to", "warc-payload-digest"))


def _decoded(named: tuple, block: bytes | None, payloads: bool) -> tuple:
    """A row of _READ: the payload's size and digest, itself if asked for, and what is wrong."""
    payload, problem = payload_of(named[1], block)
    digest = base32_sha1(payload) if payload is not None else None
    if digest and (named[4] or "").startswith("sha1:") and named[4] != f"sha1:{digest}":
        payload, digest, problem = None, None, "digest"
    return (*named, payload if payloads else None, None if digest is None else len(payload), digest, problem)


def _segments(archives: DataFrame) -> DataFrame:
    def run(batches):
        out = _Out(_SEGMENT)
        for batch in batches:
            for i in range(batch.num_rows):
                for fields, block in parse(opened(batch.column(0)[i].as_py())):
                    number = _number(fields.get("warc-segment-number"))
                    if number is None or fields.get("warc-type") not in (*_WANTED, "continuation"):
                        continue
                    origin = fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                    yield from out.add((*_named(fields), origin, number, _number(fields.get("warc-segment-total-length")), block), len(block or b""))
        yield from out.flush()

    return archives.mapInArrow(run, f"{_FIELDS}, origin string, number long, total long, block binary")


def _whole(archives: DataFrame, payloads: bool) -> DataFrame:
    def run(batches):
        out = _Out(_READ)
        for batch in batches:
            for i in range(batch.num_rows):
                for fields, block in parse(opened(batch.column(0)[i].as_py())):
                    if "warc-segment-number" not in fields and fields.get("warc-type") in _WANTED:
                        row = _decoded(_named(fields), block, payloads)
                        yield from out.add(row, len(row[5] or b""))
        yield from out.flush()

    return archives.mapInArrow(run, _READS)


def assembled(segments: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of segments(record_id, ..., origin, number, total, block): those of an origin
    by number, which must run from 1 without a gap and add up to the stated total length;
    else the payload is null and problem says "segments".

    Segments written k times over, all of them, are k equal records; one that repeats alone
    with the same content counts once, with other content is a problem."""

    def record(first, blocks, times, total, bad):
        row = (*(first or (None,) * 5), None, None, None, "segments")
        if first is not None and not bad and total == sum(map(len, blocks)):
            row = _decoded(first, b"".join(blocks), payloads)
        return [row] * (times if row[-1] is None else 1), len(row[5] or b"")

    def run(batches):
        out = _Out(_READ)
        now, first, blocks, counts, total, bad = None, None, [], [], None, False

        def closed():
            rows, size = record(first, blocks, min(counts, default=1), total, bad)
            for row in rows:
                yield from out.add(row, size)

        for batch in batches:
            for i in range(batch.num_rows):
                *named, origin, number, length, block = (c[i].as_py() for c in batch.columns)
                if origin != now or not counts:
                    if counts:
                        yield from closed()
                    now, first, blocks, counts, total, bad = origin, None, [], [], None, False
                if number == len(counts):  # the same segment again
                    counts[-1] += 1
                    bad |= block != blocks[-1]
                else:
                    bad |= number != len(counts) + 1 or block is None
                    blocks.append(block or b"")
                    counts.append(1)
                if number == 1:
                    first = tuple(named)
                total = length if length is not None else total
        if counts:
            yield from closed()
        yield from out.flush()

    ordered = segments.repartition("origin").sortWithinPartitions("origin", "number")
    return ordered.mapInArrow(run, _READS)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, type, uri, refers_to, declared (the stated payload digest), payload, its
    size and digest, and problem of each response, resource and revisit in the archives of
    path. Without payloads that column is null; they are read and verified all the same.

    problem is null where all is well; else the payload is null and it names the first
    fault: truncated, segments, header, framing, length, or digest (the stated one is another
    SHA-1). Revisits hold no payload. An archive is one row while it is parsed: those of
    ``write`` are bounded, others may have up to 2 GB.
    """
    archives = spark.read.format("binaryFile").load(path).select("content")
    return _whole(archives, payloads).union(assembled(_segments(archives), payloads))


def _page(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) and problem
    of each record of ``read`` over archives of ``write``. What a revisit leaves out comes
    from its response, met by record id; rows that revisit one response are dealt to SALTS
    parts. A revisit without a response has the problem "missing"."""
    narrow = records.select("record_id", "type", "refers_to", "problem", "size", "digest")
    own = narrow.where("type <> 'revisit'")
    whole = own.select(_page(F.col("record_id")).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    again = narrow.where("type = 'revisit'").select("record_id", "refers_to", "problem", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).alias("salt"))
    asked = again.select("refers_to", "salt").distinct()
    known = own.where("problem is null").groupBy("record_id").agg(F.first("size").alias("size"), F.first("digest").alias("digest"))
    met = asked.join(known.hint("merge"), asked.refers_to == known.record_id).select("refers_to", "salt", "size", "digest")
    again = again.join(met.hint("merge"), ["refers_to", "salt"], "left")
    missing = F.when(F.col("digest").isNull(), "missing")
    return whole.union(again.select(_page(F.col("record_id")), "size", "digest", F.lit("revisit"), _page(F.col("refers_to")), F.coalesce("problem", missing)))


def round_trip(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = 1 << 20, chunk_bytes: int = 1 << 13) -> DataFrame:
    """``pages_of`` what ``write`` makes of pages, through archives in the shared folder."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes, segment_bytes, chunk_bytes)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return pages_of(read(spark, path, payloads=False))
