"""WARC: segmented records out, segment reassembly in.

Records follow WARC/1.1. Payloads go as HTTP messages with chunked framing. A
block longer than a segment is dealt over a record of its type with segment
number 1 and continuation records that name its id as their origin; the last
names the total length. Each archive is a file of gzip members, one a record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, shared_dir

CRLF = b"\r\n"
#: Bytes of a block before it is segmented, of a chunk, and of a packed archive.
SEGMENT, CHUNK, ARCHIVE = 16_384, 4_096, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The most rows of repeated payloads that are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000
#: The most tasks that read archives; each then reads several, one after the other.
MAX_TASKS = 20_000


def record_id(page_id: int | None, payload_digest: str) -> str:
    """A URN of page and payload: reruns give it again, and rows that share one
    are equal. Null pages are named null."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{payload_digest}>"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are allowed;
    framing that is cut short or wrong is an error."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is cut short")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str | int], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": len(block)}.items())
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF) + squeeze.flush()


def records(page_id: int | None, url: str | None, payload: bytes, head: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: a response, in segments if it is long, or a revisit of
    the page `head`, whose HTTP head tells the payload's length."""
    name = digest(payload)
    own, http = record_id(page_id, name), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    base = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{name}"}
    if url:
        base["WARC-Target-URI"] = quote(url, safe="%:/?#[]@!$&'()*+,;=~")
    if head is not None and head != page_id:
        base |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(head, name)}
        return [record(base, http + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record(base, block)]
    out = [record(base | {"WARC-Segment-Number": 1}, block[:segment])]
    for k, at in enumerate(range(segment, len(block), segment), 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}:{k}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k}
        if at + segment >= len(block):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(record(more, block[at : at + segment]))
    return out


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", segment=SEGMENT, archive=ARCHIVE) -> DataFrame:
    """Writes a record for every row of pages into archives in folder, a URI that
    driver and executors share; returns a row (path) for each archive.

    Of rows with equal payloads that with the largest id is the response, the
    others revisit it; a row with a null id revisits too if some id is known. Null
    payloads are empty. Only the payloads that occur twice or more are joined to
    the pages, by broadcast if they are few, so payloads are not shuffled. Archives
    are named by the attempt that writes them, and the paths returned are those of
    the attempts that Spark committed (a table beside the folder): what a lost or
    repeated attempt leaves is never read. No rows write nothing."""
    x = pages.select(col(pages, id_col).cast("long").alias("id"), col(pages, url_col).alias("url"), F.encode(F.coalesce(col(pages, payload_col), F.lit("")), "UTF-8").alias("payload"))
    key = F.sha1("payload").alias("key")
    repeated = cut(x.select("id", key).groupBy("key").agg(F.max("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    heads = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST else repeated
    x = x.withColumn("key", key).join(heads, "key", "left").select("id", "url", "payload", "head")

    def run(batches):
        context = TaskContext.get()
        files, root = pafs.FileSystem.from_uri(folder)
        made, held, size = [], [], 0

        def flush():
            nonlocal held, size
            if held:
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):05d}.warc.gz"
                with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for r in held:
                        out.write(r)
                made.append(f"{folder}/{name}")
                held, size = [], 0

        for b in batches:
            for row in zip(*(b.column(k) for k in range(4))):
                for r in records(*(v.as_py() for v in row), segment):
                    held.append(r)
                    size += len(r)
                    if size >= archive:
                        flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    x.mapInArrow(run, "path string").write.parquet(f"{folder}-committed")
    return pages.sparkSession.read.schema("path string").parquet(f"{folder}-committed")


def parse(file, block: int = 1 << 15):
    """(headers with lower-case names, block) of each record of an archive of gzip
    members, a file that is read `block` bytes at a time: a record is held, never the
    archive. What is cut short is an error."""
    waiting = b""
    while waiting or (waiting := file.read(block)):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            parts.append(member.decompress(waiting))
            waiting = member.unused_data
            if not member.eof and not (waiting := file.read(block)):
                raise ValueError("archive is cut short")
        raw, at = b"".join(parts), 0
        while raw.startswith(b"WARC/", at):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = int(headers["content-length"])
            if end + 4 + n > len(raw):
                raise ValueError("record is cut short")
            yield headers, raw[end + 4 : end + 4 + n]
            at = end + 8 + n


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP response, its framing decoded, and the length that
    its head declares."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    declared = int(fields[b"content-length"]) if b"content-length" in fields else None
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body, declared


PARSED = "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, verified boolean, payload binary, segment int, total long, block binary"


def _kinds():
    return [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PARSED.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _kinds())], names)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """A row (path) for each *.warc.gz of a folder that others have written."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit in the archives (a column path):
    record_id, record_type, refers_to, payload_digest, payload_bytes, verified, payload.

    Segments are grouped by their origin and put in order of number; numbers that
    are missing, a total length that differs, copies of a segment that differ, broken
    framing or another digest than declared give verified = false, and no payload. A
    revisit's digest and length are as its record declares them; it is verified if
    the response that it refers to is there, is verified and has just these. Records
    of other types are passed over. Records that share an id are copies and give a
    row each, but copies of a segment are counted before they are shuffled, and one
    of each meets in the task that joins them. An archive is read as a stream."""

    def decoded(name, kind, refers, declared, block):
        try:
            payload, length = payload_of(block)
        except ValueError:
            return name, kind, refers, declared, None, False, None, None, None, None
        if kind == "revisit":
            return name, kind, refers, declared, length, True, None, None, None, None
        found = digest(payload)
        good = declared in (None, found)
        return name, kind, refers, found, len(payload), good, payload if with_payload and good else None, None, None, None

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                files, root = pafs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
                rows, size = [], 0
                with files.open_input_stream(root, compression=None) as file:
                    for h, block in parse(file):
                        kind, number = h.get("warc-type"), h.get("warc-segment-number")
                        declared = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                        if kind in ("response", "revisit") and number is None:
                            rows.append(decoded(h["warc-record-id"], kind, h.get("warc-refers-to"), declared, block))
                        elif kind in ("response", "continuation"):
                            total = h.get("warc-segment-total-length")
                            rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), kind, None, declared, None, None, None, int(number or 0), total and int(total), block))
                            size += len(block)
                        size += len(rows[-1][6] or b"") if rows else 0
                        if size > 1 << 23 or len(rows) > 10_000:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    def join(batches):
        for b in batches:
            rows, size = [], 0
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                numbers, totals = [p["segment"] for p in r["parts"]], {p["total"] for p in r["parts"]} - {None}
                block = b"".join(p["block"] for p in sorted(r["parts"], key=lambda p: p["segment"]))
                whole = sorted(numbers) == [*range(1, len(numbers) + 1)] and totals == {len(block)} and {p["copies"] for p in r["parts"]} == {r["copies"]}
                row = decoded(r["record_id"], "response", None, r["declared"], block) if whole else (r["record_id"], "response", None, r["declared"], None, False, *[None] * 4)
                copies = max(1, r["copies"])
                for _ in range(copies):
                    rows.append(row)
                    size += len(row[6] or b"") + 500
                    if size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)

    # An archive a task, up to MAX_TASKS.
    found = cut(archives.select("path").repartition(min(MAX_TASKS, max(1, archives.count()))).mapInArrow(run, PARSED))
    plain = found.filter("segment IS NULL").drop("segment", "total", "block")
    parts = found.filter("segment IS NOT NULL").groupBy("record_id", "segment", "total", "block").agg(F.max("payload_digest").alias("declared"), F.count("*").alias("copies"))
    first = F.max(F.when(F.col("segment") == 1, F.col("copies"))).cast("int")
    by_id = parts.groupBy("record_id").agg(F.max("declared").alias("declared"), F.collect_list(F.struct("segment", "total", "block", F.col("copies").cast("int").alias("copies"))).alias("parts"), F.coalesce(first, F.lit(0)).alias("copies"))
    joined = lambda some: some.mapInArrow(join, PARSED).drop("segment", "total", "block")

    # What revisits refer to: each record once, with what a revisit must agree with.
    facts = F.struct("payload_digest", "payload_bytes", "verified")
    wanted = cut(plain.filter("refers_to IS NOT NULL").groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n")))
    heads = plain.filter("record_type = 'response'").join(wanted, "record_id", "left_semi").unionByName(joined(by_id.join(wanted, "record_id", "left_semi")))
    heads = cut(heads.groupBy("record_id").agg(F.min(facts).alias("facts")))
    heads = F.broadcast(heads) if heads.count() <= MAX_BROADCAST else heads
    rows = plain.unionByName(joined(by_id)).join(heads.withColumnRenamed("record_id", "head"), F.col("refers_to") == F.col("head"), "left")
    agrees = (F.col("facts.payload_digest").eqNullSafe(F.col("payload_digest"))) & F.col("facts.payload_bytes").eqNullSafe(F.col("payload_bytes")) & F.col("facts.verified")
    sound = F.when(F.col("record_type") == "revisit", F.col("verified") & F.coalesce(agrees, F.lit(False))).otherwise(F.col("verified"))
    return rows.select("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", sound.alias("verified"), "payload")


def reread(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Pages through archives and back: page_id, payload_bytes, payload_digest,
    record_type, refers_to (the response's page_id), verified."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    x = read_archives(write_archives(pages, folder, **how), with_payload=False)
    return x.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"), "verified")


def _page(name: str):
    return F.regexp_extract(name, "^<urn:x-page:(-?[0-9]+|null):", 1).try_cast("long")
