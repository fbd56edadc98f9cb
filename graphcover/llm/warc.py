"""WARC archives: write, normalise from one gzip stream to a member per record, read by index.

``write_archives`` writes pages as ``.warc.gz`` files that are one gzip stream each,
the form that cannot be read from its middle. ``normalise`` inflates such a stream
once, front to back, rewrites every record as a gzip member of its own and writes a
sidecar index (``offset length type id`` a line); memory holds one record. With the
index, ``read_records`` seeks to each member.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the
smallest id carries the payload and the others are ``revisit`` records that refer to
it. Groups are found on digests alone: a minimum per digest, which combines on the
map side, so a payload that a third of all pages share is no hot key, and pages
travel only if the table of revisits is too large for Spark to send it to them.

Files go to the shared folder under names that hold the task attempt. Only files of
attempts that succeeded are listed, so a lost executor's leftovers are never read.

A null payload is empty; a null url is an empty target; rows with equal ids are each
written, and both are the response if theirs is the smallest id; a null id is never
the smallest; an empty table gives no archive. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcover.functions.scratch import delete_path, materialize, new_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
BATCH_BYTES = 16 << 20
DATE = "2000-01-01T00:00:00Z"
ID = "<urn:graphcover:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "path string, index string, n_records long"


def _open(path: str):
    """File system and path for a URI or a plain absolute path."""
    return pafs.FileSystem.from_uri(path)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Inflated:
    """Bytes of a gzip file of one or more members, inflated as they are read."""

    def __init__(self, stream, step: int = 1 << 20):
        self.stream, self.step, self.engine, self.held = stream, step, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        raw = self.engine.unused_data if self.engine.eof else b""
        if self.engine.eof:
            self.engine = zlib.decompressobj(31)
        raw = raw or self.stream.read(self.step)
        self.held += self.engine.decompress(raw)
        return bool(raw)

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; empty at the end of the file."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(stream):
    """``head, block`` of every record of an inflated stream."""
    inflated = Inflated(stream)
    while head := inflated.until(b"\r\n\r\n"):
        block = inflated.take(int(headers(head)["content-length"]))
        inflated.take(4)
        yield head, block


def _name(folder: str, number: int) -> str:
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc.gz"


def _files(rows) -> pa.RecordBatch:
    path, index, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(index, pa.string()), pa.array(n, pa.int64())], ["path", "index", "n_records"])


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``id, digest, refers_to`` of the records that are revisits."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    told = materialize(pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")), "digests")
    groups = told.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    groups = materialize(groups, "payloads")  # so that the join is of two plain shuffles, whose hot payloads Spark can split
    found = told.join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
    return materialize(found.select("id", "digest", F.col("first").alias("refers_to")), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One gzip stream per file; returns ``path, index, n_records`` with a null index."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    revisits = mark_revisits(pages, id_col, payload_col)
    same = rows["id"].eqNullSafe(revisits["id"]) & (rows["digest"] == revisits["digest"])
    marked = rows.join(revisits.dropDuplicates(), same, "left").select(rows["id"], "url", "payload", rows["digest"], "refers_to")

    def write(batches):
        out, engine, size, done, count = None, None, 0, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = _name(folder, len(done))
                    fs, at = _open(path)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    out, engine, size, count = fs.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                raw = record(*row)
                out.write(engine.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    done.append((path, None, count))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((path, None, count))
        yield _files(done)

    return materialize(marked.mapInArrow(write, _FILES), "archives")


def _spread(files: DataFrame) -> DataFrame:
    """A task for each archive as far as there are slots; rows are paths only."""
    slots = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(slots, min(files.count(), 4 * slots)), "path")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record; ``path, index, n_records`` of the new files."""

    def run(batches):
        number = 0
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path = _name(folder, number)
                number += 1
                fs, at = _open(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                old, old_at = _open(source)
                offset, lines = 0, []
                with old.open_input_stream(old_at, compression=None) as stream, fs.open_output_stream(at, compression=None) as out:
                    for head, block in records(stream):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(head + block + b"\r\n\r\n") + engine.flush()
                        out.write(member)
                        told = headers(head)
                        lines.append(f"{offset} {len(member)} {told['warc-type']} {told['warc-record-id']}\n")
                        offset += len(member)
                with fs.open_output_stream(f"{at}.idx", compression=None) as out:
                    out.write("".join(lines).encode())
                yield _files([(path, f"{path}.idx", len(lines))])

    return materialize(_spread(archives).mapInArrow(run, _FILES), "members")


def _page(text: str, kind):
    inner = text[len(ID) - 3 : -1]
    return None if inner == "" else kind(inner)


def read_records(archives: DataFrame, id_kind: str = "long", with_payload: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of every indexed record.

    Digest and size are of the full payload: computed from it for a response, told by the headers for a revisit.
    """
    schema = f"page_id {id_kind}, url string, record_type string, refers_to {id_kind}, payload_bytes long, payload_digest string, payload binary"
    kind, arrow = (int, pa.int64()) if id_kind == "long" else (str, pa.string())
    types = [arrow, pa.string(), pa.string(), arrow, pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def parsed(raw: bytes):
        head, _, rest = raw.partition(b"\r\n\r\n")
        told = headers(head)
        http, _, payload = rest[: int(told["content-length"])].partition(b"\r\n\r\n")
        full = int(headers(http)["content-length"])
        if told["warc-type"] == "response":
            digest = hashlib.sha256(payload).hexdigest()
            if len(payload) != full or told["warc-payload-digest"] != f"sha256:{digest}":
                raise ValueError(f"damaged record {told['warc-record-id']}")
            refers = None
        else:
            digest, refers = told["warc-payload-digest"].removeprefix("sha256:"), _page(told["warc-refers-to"], kind)
        return _page(told["warc-record-id"], kind), told["warc-target-uri"], told["warc-type"], refers, full, digest, payload if with_payload else None

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def read(batches):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                fs, at = _open(path)
                with fs.open_input_stream(_open(index)[1], compression=None) as stream:
                    lines = stream.read().decode().splitlines()
                rows, size = [], 0
                with fs.open_input_file(at) as file:
                    for line in lines:
                        offset, length = map(int, line.split(" ", 2)[:2])
                        rows.append(parsed(zlib.decompress(file.read_at(length, offset), 31)))
                        size += rows[-1][4]
                        if size >= BATCH_BYTES or len(rows) >= 10_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return _spread(archives).mapInArrow(read, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages, normalise what was written, drop the streams; the indexed archives."""
    spark = pages.sparkSession
    streams, members = new_path(spark, "warc-streams"), new_path(spark, "warc")
    done = normalise(write_archives(pages, streams, id_col, url_col, payload_col), members)
    delete_path(spark, streams)
    return done


def op8_warc(spark, sf_dir: str) -> DataFrame:
    archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f
"""
