"""WARC writing with revisit records, and a reader that salvages damaged archives.

write_warc sends every page to a record of a gzip-per-record archive in the shared folder; payloads seen before become revisit
records without the body. An archive is written under a name of the task attempt and counts only once the manifest row of that
attempt is committed, so that lost executors and repeated attempts leave no doubles. Which payloads occur often is counted first:
those with more rows than HOT_SHARE of a task's fair number are looked up in a broadcast table, so that no task gets all of their copies.

The reader checks each gzip member (CRC) and record (version line, Content-Length, closing blank lines, block digest). After a
failed check it looks for the next valid member or version line, inside the content of a member too, goes on from there and
reports the skipped bytes as a gap. Of a member that breaks off, the records before the damage whose block digests hold are kept.
Gaps are given in bytes of the archive; for damage inside a compressed member that is the whole member.

Defined results: null html is the empty payload; payloads of any length are one record; payloads below min_bytes are never
revisits; of equal payloads the rows with the smallest page_id are responses; a null page_id revisits the smallest page_id of its
group or is a response where the group has none; a null url is written as `urn:none`; repeated rows are records each; a table
without rows gives no archive and no rows; columns other than page_id, url and html, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import as_bytes, materialize, new_path, open_shared, parts, read_shared, small_batches

ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FEED = 1 << 16
#: A payload with more rows than this share of a task's fair number is looked up without a shuffle.
HOT_SHARE = 0.25


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        """The block after its HTTP head."""
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block

    def http(self, name: str) -> str | None:
        found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", self.block.partition(b"\r\n\r\n")[0])
        return found[1].decode("latin-1").strip() if found else None


@dataclass
class Salvage:
    """What a read found besides records: (start, end, reason) of quarantined bytes of the archive."""

    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _record_id(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_record_id(page_id)}>", "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or 'urn:none')}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at `at`, where it ends, and what is wrong with it (then the content is what came before the damage)."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            piece = data[pos : pos + FEED]
            if not len(piece):
                return b"".join(out), pos, "truncated member"
            out.append(d.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        return b"".join(out), pos, f"bad member: {e}"
    return b"".join(out), pos - len(d.unused_data), ""


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _plain(data: bytes, at: int, offset: int) -> tuple[Record, int]:
    """The record at `at` of uncompressed data and where it ends; ValueError if it is damaged."""
    if not _VERSION.match(data, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers do not end")
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = bytes(data[start:stop])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return Record(headers.get("warc-type", ""), headers, block, offset), stop + 4


def _inside(content: bytes, offset: int) -> tuple[list[Record], str]:
    """Records of a member's content and, if any stretch of it failed, why the first did."""
    found, at, why = [], 0, ""
    while at < len(content):
        try:
            record, at = _plain(content, at, offset)
            found.append(record)
        except ValueError as e:
            why = why or str(e)
            later = _VERSION.search(content, at + 1)
            at = later.start() if later else len(content)
    return found, why


def read_archive(data: bytes, salvage: Salvage | None = None) -> Iterator[Record]:
    """Records of an archive, compressed by record or by many, or plain, or mixed; damaged stretches go to salvage.gaps."""
    salvage = salvage if salvage is not None else Salvage()
    view, pos, bad, why = memoryview(data), 0, -1, ""
    again: set[str | None] = set()  # records of a broken member, which stored bytes of it would show once more
    while pos < len(data):
        if data[pos : pos + 2] == b"\x1f\x8b":
            content, end, broken = _member(view, pos)
            found, failed = _inside(content, pos)
            if broken:
                found = [r for r in found if r.headers.get("warc-block-digest", "").startswith("sha256:")]
                again = {r.headers.get("warc-record-id") for r in found} - {None}
            failed = broken or failed
        else:
            broken = ""
            try:
                record, end = _plain(data, pos, pos)
                if bad >= 0 and record.headers.get("warc-record-id") in again:
                    pos = end
                    continue
                found, failed = [record], ""
            except ValueError as e:
                found, failed, broken = [], str(e), str(e)
        if bad >= 0 and not (failed and not found):
            salvage.gaps.append((bad, pos, why))
            bad = -1
        yield from found
        if broken:
            if bad < 0:
                bad, why = pos, failed
            later = _START.search(data, pos + 1)
            pos = later.start() if later else len(data)
            continue
        if failed:
            if bad >= 0:  # nothing was found in it
                salvage.gaps.append((bad, end, why))
                bad = -1
            else:
                salvage.gaps.append((pos, end, failed))
        pos = end
    if bad >= 0:
        salvage.gaps.append((bad, len(data), why))


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        name, held, size, count, seq = uuid.uuid4().hex, [], 0, 0, 0

        def flush():
            nonlocal held, size, count, seq
            file = f"{name}-{seq:05d}.warc.gz"
            with open_shared(f"{folder}/{file}") as f:
                for x in held:
                    f.write(x)
            row = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])
            held, size, count, seq = [], 0, 0, seq + 1
            return row

        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                member = gzip_member(build_record(page_id, url, payload, digest, first, revisit))
                held.append(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) to archives under folder; returns the folder and the manifest (file, n_records, n_bytes)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    body = as_bytes("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    large = F.octet_length("payload") >= min_bytes
    counts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, "payloads", f"{folder}/payloads")
    n = parts(spark)
    fair = max(1, int(HOT_SHARE * (counts.agg(F.sum("n")).head()[0] or 0) / n))
    hot = counts.where(F.col("n") > fair).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))  # at most n / HOT_SHARE rows
    rare = counts.where(F.col("n") <= fair).select(F.col("digest").alias("key"), F.col("first").alias("rare_first"))
    rows = rows.join(F.broadcast(hot), large & (F.col("digest") == F.col("hot")), "left")
    # small payloads and hot ones get a key of their own, which no payload has
    own = F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("own", own).join(rare, F.col("own") == F.col("key"), "left").withColumn("first", F.coalesce("hot_first", "rare_first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit"))
    manifest = out.mapInArrow(_writer(f"{folder}/archives", archive_bytes), "file string, n_records long, n_bytes long")
    return folder, materialize(manifest, "manifest", f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """(file, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, gap_start, gap_end, gap_reason): a row a record or gap of the archives of the manifest (without one, of every archive under folder/archives).

    payload is null for revisits and gaps; of gaps only file and the gap columns are set. A task opens one archive at a time.
    """
    if manifest is not None:
        files = manifest.select("file")
    else:
        files = spark.read.format("binaryFile").load(f"{folder}/archives").select(F.element_at(F.split("path", "/"), -1).alias("file"))
    schema = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"
    return files.repartition(parts(spark), "file").mapInArrow(_reader(f"{folder}/archives"), schema)


_COLUMNS = ["file", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "gap_start", "gap_end", "gap_reason"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def _reader(folder: str):
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], _COLUMNS)

    def number(x):
        return int(x) if x is not None else None

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                salvage, rows, size = Salvage(), [], 0
                for r in read_archive(read_shared(f"{folder}/{file}"), salvage):
                    h, payload = r.headers, r.payload
                    whole = r.kind == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else h.get("warc-payload-digest", "").removeprefix("sha256:")
                    rows.append((file, number(h.get("x-page-id")), h.get("warc-target-uri"), len(payload) if whole else number(r.http("Content-Length")), digest, r.kind, number(h.get("x-refers-to-page")), payload if whole else None, None, None, None))
                    size += len(payload)
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                rows += [(file, *[None] * 7, a, b, why) for a, b, why in salvage.gaps]
                if rows:
                    yield out(rows)

    return run


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_warc(spark, folder, manifest).where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM m
"""
