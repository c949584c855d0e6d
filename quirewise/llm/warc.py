"""WARC archives: written with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own, so any record can be read alone; each file begins with a warcinfo record.
Writing gives one index row a record: path, offset, length, URL and digest. Reading sorts the index rows of the selected
records by path and offset and joins neighbouring ranges into reads of up to ``MOST_READ`` bytes, over gaps of up
to ``GAP`` bytes; the bytes selected set the number of tasks.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is the
response; the others are revisits that name it and its URL. Payload keys are summed per digest before anything is joined.

A null html is an empty payload; a null URL leaves its header out; a URL with line breaks has them as %0A in the standard header and is kept whole, quoted, in
one of its own. page_ids may be integers or strings, which keep their type. Null page_ids never are the largest; if all
of a digest's ids are null, all are responses. Rows that share the largest page_id are all responses, under one record id. An empty
table gives an empty index. Other columns of ``pages`` aren't read, whatever their names. Archives go through Arrow's file systems: local and NFS paths, s3 (s3a and s3n
mean the same), gs, abfs and, with libhdfs on the executors, hdfs and viewfs. A file belongs
to one task attempt, so a retried task never writes into another's file; only finished attempts are in
the index. Texts are taken in chunks of ``CHUNK_BYTES``, so long pages don't meet in memory.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm.common import CHUNK_BYTES, HOT, checked_broadcast, materialize, scratch_path, text_chunks

LEAST_PAYLOAD = 1000
#: Bytes of an archive file before the next one begins; of a read; between two records of one read.
FILE_BYTES, MOST_READ, GAP = 128 << 20, 8 << 20, 64 << 10
#: Compressed bytes that a reading task takes; with fewer in all, tasks take less, down to the second.
TASK_BYTES, LEAST_TASK = 64 << 20, 1 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, url string, digest string, page_id {0}, record_type string"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _base32(hexdigest: str) -> str:
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _one_line(url: str) -> str:
    return re.sub(r"[\r\n]+", "%0A", url)


def _written(page_id: int | str) -> str:
    return quote(page_id, safe="") if isinstance(page_id, str) else str(page_id)


def _record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _member(head: list[str], block: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    head = ["WARC/1.1", *head, f"Content-Length: {len(block)}"]
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def warcinfo(path: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: quirewise\r\nformat: WARC File Format 1.1\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(path)}", f"WARC-Date: {DATE}", f"WARC-Filename: {path.rsplit('/', 1)[-1]}", "Content-Type: application/warc-fields"], block)


def record(row: dict, folder: str, at: str) -> bytes:
    """The WARC record of a decided row as a gzip member; ``at``: a name that no other record has.

    The response that revisits refer to is named by its page and digest, so they can tell its id.
    """
    digest, page_id, first = row["digest"], row["page_id"], row["first"]
    named = _record_id(f"{folder}#{first}#{digest}")
    head = [
        f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: {named if first is not None and not row['revisit'] else _record_id(at)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
        if _one_line(row["url"]) != row["url"]:
            head.append(f"X-Page-Url: {quote(row['url'], safe='')}")
    if page_id is not None:
        head.append(f"X-Page-Id: {_written(page_id)}")
    if row["revisit"]:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {named}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {_written(first)}"]
        if row["first_url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(row['first_url'])}")
    return _member(head, _HTTP % row["size"] + (row["payload"] or b""))


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers of a record, its payload, and the payload length that its HTTP head states."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, int(re.search(rb"Content-Length: (\d+)", http)[1])


#: Spark's names of file systems that Arrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    scheme, colon, rest = path.partition(":")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


def id_type(pages: DataFrame) -> str:
    """bigint for whole numbers, else string."""
    return "bigint" if pages.schema["page_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark itself would use for it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``folder``; gives the stored index."""
    folder = qualified(pages.sparkSession, folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    kind = id_type(pages)
    given = pages.select(F.col("page_id").cast(kind).alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    digested = given.withColumn("digest", F.sha1("payload"))
    shared = digested.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.max_by("url", F.struct("page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first", "first_url", "n"), "shared-payloads")
    # Digests that over 1/1024 of these rows share are broadcast; rows decided by them drop their payload and spread over the next join.
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > total * HOT).select(F.col("of").alias("hot_of"), F.col("first").alias("hot_first"), F.col("first_url").alias("hot_url"))
    cold = shared.where(F.col("n") <= total * HOT).drop("n")
    marked = digested.join(F.broadcast(hot), F.col("digest") == F.col("hot_of"), "left").withColumn("size", F.octet_length("payload").cast("long"))
    is_first = F.col("page_id").eqNullSafe(F.col("hot_first"))
    marked = marked.withColumn("payload", F.when(F.col("hot_of").isNull() | is_first, F.col("payload")))
    key = F.when(F.col("hot_of").isNull(), F.col("digest")).otherwise(F.concat_ws("#", F.lit(""), F.xxhash64("page_id", "url").cast("string")))
    decided = marked.withColumn("key", key).join(checked_broadcast(cold), F.col("key") == F.col("of"), "left")
    decided = decided.withColumn("first", F.coalesce("hot_first", "first")).withColumn("first_url", F.when(F.col("hot_of").isNotNull(), F.col("hot_url")).otherwise(F.col("first_url")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    decided = decided.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", "first", "first_url", revisit.alias("revisit"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, _ = _files(folder)
        out, path, at, nth = None, "", 0, 0
        try:
            for batch in text_chunks(batches, "payload"):
                index = []
                for r in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        path, at, nth = f"{stem}-{nth}.warc.gz", 0, nth + 1
                        out = files.open_output_stream(_files(path)[1], compression=None)
                        info = warcinfo(path)
                        out.write(info)
                        at = len(info)
                    member = record(r, folder, f"{path}#{at}")
                    out.write(member)
                    index.append({"path": path, "offset": at, "length": len(member), "url": r["url"], "digest": r["digest"], "page_id": r["page_id"], "record_type": "revisit" if r["revisit"] else "response"})
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_pylist(index, schema)
        finally:
            if out is not None:
                out.close()

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64() if kind == "bigint" else pa.string()), ("record_type", pa.string())])
    files, inside = _files(folder)
    files.create_dir(inside, recursive=True)
    return materialize(decided.mapInArrow(rows, INDEX.format(kind)), "warc-index")


RECORD = "page_id {0}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {0}"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows, read from their archives and checked against their digests.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` also payload (null for revisits). A
    revisit's size and digest are those that its head states of the payload it stands for.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            lo = 0
            while lo < len(rows):
                first, end, hi = rows[lo], rows[lo]["offset"] + rows[lo]["length"], lo + 1
                while hi < len(rows) and rows[hi]["path"] == first["path"] and rows[hi]["offset"] - end <= GAP and rows[hi]["offset"] + rows[hi]["length"] - first["offset"] <= MOST_READ:
                    end, hi = max(end, rows[hi]["offset"] + rows[hi]["length"]), hi + 1
                files, inside = _files(first["path"])
                with files.open_input_file(inside) as f:
                    data = f.read_at(end - first["offset"], first["offset"])
                out, held = [], 0
                for r in rows[lo:hi]:
                    at = r["offset"] - first["offset"]
                    result = _result(r, data[at : at + r["length"]], payloads, kind)
                    out.append(result)
                    held += len(result.get("payload") or b"")
                    if held > CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                lo = hi

    kind = id_type(index)
    arrow = pa.int64() if kind == "bigint" else pa.string()
    fields = [("page_id", arrow), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", arrow)]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(total / TASK_BYTES), min(2 * cores, math.ceil(total / LEAST_TASK)))
    step = min(MOST_READ, max(1, math.ceil(total / tasks / 4)))  # several ranges a task, so that they come out even
    ranges = index.select("path", "offset", "length").withColumn("range", F.floor(F.col("offset") / F.lit(step)))
    sorted_ranges = ranges.repartition(tasks, "path", "range").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return sorted_ranges.mapInArrow(rows, RECORD.format(kind) + ", payload binary" * payloads)


def _result(row: dict, member: bytes, payloads: bool, kind: str) -> dict:
    fields, payload, size = parse(member)
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"damaged record at {row['path']}#{row['offset']}")
    page = lambda name: None if name not in fields else int(fields[name]) if kind == "bigint" else unquote(fields[name])
    url = unquote(fields["X-Page-Url"]) if "X-Page-Url" in fields else fields.get("WARC-Target-URI")
    out = {"page_id": page("X-Page-Id"), "url": url, "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": page("X-Refers-To-Page")}
    return out | {"payload": None if revisit else payload} if payloads else out


def round_trip(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Archive all pages in the shared folder, then read every record back by its index row."""
    index = write_archives(pages, scratch_path(pages.sparkSession, "warc"), least)
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to, url
FROM d LEFT JOIN g USING (payload_digest)
"""
