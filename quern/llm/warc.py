"""WARC archives: writing, normalising of monolithic gzip files, reading by offset index.

A crawl is first written as monolithic archives: one gzip stream over all records of a file. A few rows
per record (archive, place, digest, length) go to a manifest. Of equal payloads of at least ``min_bytes``
the record with the smallest id is the response and the others are revisits; that is settled on the
manifest alone, so payloads are never shuffled. The normaliser then takes each archive in a task of its
own: it inflates the stream once, front to back, and rewrites every record as its own gzip member
(revisits without their payload), and writes a sidecar index with a line per record: offset, length of
the member, id, type. Readers seek by that index and inflate single members.

Archives are closed at ``max_bytes`` of input, so a task holds one record at a time and a file's work is
bounded. Files are written under names that no other attempt uses and count only once the manifest or
index table names them; a task that is run again on another executor leaves at most an orphan file.
Everything is in the shared folder.

Defined cases: a null payload is empty, and so are null urls. Among equal ids the earlier place wins;
null ids come last. Columns other than id, url and payload are not kept.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import text_bytes
from quern.storage import materialize, new_dir, open_fs

_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page: int | None, url: str, payload: bytes, digest: str, length: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record with an HTTP head; a revisit has the head of the full response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = "" if page is None else str(page)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{digest}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Page-ID", name),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_record(stream: io.BufferedIOBase) -> tuple[dict[str, str], bytes] | None:
    """The next record of an inflated stream: its fields, names in lower case, and its block."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:60]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    block = stream.read(size)
    if len(block) != size:
        raise ValueError("the archive ends inside a record")
    return fields, block


class Inflater(io.RawIOBase):
    """The bytes of a gzip file of one or many members, inflated once as they are read."""

    def __init__(self, raw, chunk: int = 1 << 18):
        self.raw, self.chunk, self.inflate, self.rest = raw, chunk, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            data = self.rest or self.raw.read(self.chunk)
            if not data:
                return 0
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(data, len(buffer))
            self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)


def _member(data: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_monolithic(pages: DataFrame, uri: str, id_col: str, url_col: str, payload_col: str, max_bytes: int, level: int) -> DataFrame:
    """Write every row as a response record; a row per record: archive, place, page, digest, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        fs.create_dir(root, recursive=True)
        out = pack = None
        name, rows, filled = "", [], 0

        def close():
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("place", pa.int64()), ("page", pa.int64()), ("digest", pa.string()), ("length", pa.int64())]))

        for batch in batches:
            urls = batch.column("url").to_pylist()
            for page, url, payload in zip(batch.column("page").to_pylist(), urls, text_bytes(batch.column("payload")), strict=True):
                if out is None:
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out, pack, rows, filled = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                digest = hashlib.sha256(payload).hexdigest()
                out.write(pack.compress(record("response", page, url or "", payload, digest, len(payload))))
                rows.append({"archive": name, "place": len(rows), "page": page, "digest": digest, "length": len(payload)})
                filled += len(payload) + 500
                if filled >= max_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    chosen = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"))
    return chosen.mapInArrow(run, "archive string, place long, page long, digest string, length long")


def decide(manifest: DataFrame, min_bytes: int) -> DataFrame:
    """The manifest with first: the place whose record the row's is a revisit of, or null."""
    order = F.struct(F.col("page").isNull().alias("unknown"), "page", "archive", "place")
    long = manifest.filter(F.col("length") >= min_bytes)
    groups = long.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups.select("digest", "first"), "equal-payloads")
    joined = manifest.join(groups, "digest", "left")
    own = (F.col("first.archive") == F.col("archive")) & (F.col("first.place") == F.col("place"))
    again = F.col("first").isNotNull() & ~own & (F.col("length") >= min_bytes)
    return joined.select("archive", "place", "page", "digest", "length", again.alias("again"), F.when(again, F.col("first.page")).alias("refers_to"))


def normalise(decisions: DataFrame, source: str, target: str, level: int, tasks: int) -> DataFrame:
    """Rewrite each archive with a member per record and a sidecar; a row per new archive: archive, records, bytes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        (from_fs, from_root), (fs, root) = open_fs(source), open_fs(target)
        fs.create_dir(root, recursive=True)
        old = rows["archive"].iloc[0]
        new = f"{old.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        again = dict(zip(rows["place"][rows["again"]], rows["refers_to"][rows["again"]], strict=True))
        at = place = 0
        with from_fs.open_input_stream(f"{from_root}/{old}", compression=None) as raw, fs.open_output_stream(f"{root}/{new}", compression=None) as out, fs.open_output_stream(f"{root}/{new}.idx", compression=None) as index:
            stream = io.BufferedReader(Inflater(raw), 1 << 18)
            while (found := read_record(stream)) is not None:
                fields, block = found
                kind, page = "response", fields["warc-page-id"]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                refers = again.get(place)
                if place in again:
                    kind = "revisit"
                data = _member(record(kind, int(page) if page else None, fields["warc-target-uri"], payload, fields["warc-payload-digest"].removeprefix("sha256:"), len(payload), None if refers is None or pd.isna(refers) else int(refers)), level)
                out.write(data)
                index.write(json.dumps({"offset": at, "length": len(data), "page": page, "type": kind}).encode() + b"\n")
                at, place = at + len(data), place + 1
        if place != len(rows):
            raise ValueError(f"{old} has {place} records, its manifest {len(rows)}")
        return pd.DataFrame({"archive": [new], "records": [place], "bytes": [at]})

    chosen = decisions.select("archive", "place", "again", F.col("refers_to").cast("string").alias("refers_to"))
    # the rows are slim but stand for whole archives: a fixed number of tasks, as sizes would put many archives in one
    chosen = chosen.repartition(tasks, "archive")
    return chosen.groupBy("archive").applyInPandas(run, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Every record of the archives (a column archive of names under ``uri``), sought by the sidecar indexes.

    Digest and length of a response are worked out from its payload and held against its head; those of
    a revisit are from its head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    entries = [json.loads(line) for line in f.read().splitlines()]
                rows = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for e in entries:
                        fields, block = read_record(io.BytesIO(zlib.decompress(f.read_at(e["length"], e["offset"]), 31)))
                        head, _, payload = block.partition(b"\r\n\r\n")
                        told = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != told):
                            raise ValueError(f"{name} at {e['offset']}: the payload isn't what its head says")
                        page, refers = fields["warc-page-id"], fields.get("warc-refers-to-page")
                        rows.append({"page_id": int(page) if page else None, "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": told, "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None, "archive": name, "offset": e["offset"]})
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("archive").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long")


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, max_bytes: int = 64 << 20, level: int = 6
) -> tuple[DataFrame, str]:
    """Write, settle and normalise; the table of normalised archives (archive, records, bytes) and their folder."""
    spark = pages.sparkSession
    source, target = new_dir(spark, "warc-monolithic"), new_dir(spark, "warc")
    manifest = materialize(write_monolithic(pages, source, id_col, url_col, payload_col, max_bytes, level), "warc-manifest")
    tasks = max(1, min(20_000, 2 * manifest.select("archive").distinct().count()))
    made = materialize(normalise(decide(manifest, min_bytes), source, target, level, tasks), "warc-archives")
    fs, root = open_fs(source)
    if fs.get_file_info(root).type.name == "Directory":
        fs.delete_dir(root)  # every record is in the new archives, which the table names
    return made, target


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives, uri = archive_pages(pages)
    dealt = archives.repartition(max(1, spark.sparkContext.defaultParallelism), "archive")
    return read_archives(dealt, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
"""
