"""Line dedup: a sharded minimal perfect hash over the hashes of common lines, probed by documents.

A first pass hashes each line's key (128 bits) and counts, per key, the documents that hold it and
the largest of their ids; Spark sums map-side, so a line that sits in a third of all documents costs
a row for each task. Keys found in enough documents are dealt to shards of bounded size by their hash.
Each shard becomes a minimal perfect hash and three arrays in its order: the key's other 64 bits as
fingerprint, the count, and the largest id. Shards are files in the shared folder. In the second pass
each task hashes its lines again, groups them by shard, and probes the arrays; no line is joined and
no document moves. A key counts as found only if all 128 bits agree.

Defined cases: a null or empty text is one empty line. Rows of equal id are one document, and so are those
without an id, which ranks below every other. Lines of fewer than ``min_chars`` code points always stay. Other columns pass.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACES, keeps, lean, only, pieces, text_bytes, with_columns
from quern.storage import materialize, open_fs

_NO_ID = -(1 << 63)
_ENTRY_BYTES = 21


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """A row per key held by ``min_docs`` documents at least: lo, hi, n, last (the largest id).

    Where ids repeat, a key counts once for an id; else no row is sent but map-side sums.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found, owner = [], []
                for doc, text in zip(part.column("id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    own = {k for line in text.split(b"\n") if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars)}
                    found += own
                    owner += [_NO_ID if doc is None else doc] * len(own)
                if found:
                    lo, hi = _hashes(found)
                    yield pa.RecordBatch.from_arrays([pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(owner, pa.int64())], names=["lo", "hi", "id"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(keys), "lo long, hi long, id long")
    if not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        rows = rows.distinct()
    return rows.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).filter(F.col("n") >= min_docs)


def build_index(counts: DataFrame, shard_entries: int) -> tuple[str, int]:
    """Write the shards; their folder and number. Each shard has about ``shard_entries`` keys."""
    from quern.llm.mph import PerfectHash

    counts = materialize(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_entries))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (rows[c].to_numpy().view(np.uint64) for c in ("lo", "hi"))
        mph = PerfectHash.build(lo, hi)
        order = np.empty(len(rows), np.int64)
        order[mph.lookup(lo, hi)] = np.arange(len(rows))
        blobs = (mph.sizes, mph.words, hi[order], rows["n"].to_numpy()[order].astype(np.int64), rows["last"].to_numpy()[order])
        return pd.DataFrame([[int(key[0]), *(b.tobytes() for b in blobs)]], columns=["shard", "sizes", "words", "fingerprints", "counts", "last"])

    made = (
        counts.groupBy(F.pmod("lo", F.lit(shards)).cast("int").alias("shard"))
        .applyInPandas(build, "shard int, sizes binary, words binary, fingerprints binary, counts binary, last binary")
    )
    table = materialize(made, "line-index", ("shard",))
    return table.inputFiles()[0].split("/shard=")[0] if shards and table.inputFiles() else "", shards


class _Shards:
    """Shards read from the shared folder; the least used go when they are over ``max_bytes``."""

    def __init__(self, uri: str, max_bytes: int = 128 << 20):
        self.uri, self.max_bytes, self.kept, self.size = uri, max_bytes, OrderedDict(), 0

    def get(self, shard: int):
        if shard in self.kept:
            self.kept.move_to_end(shard)
            return self.kept[shard]
        from quern.llm.mph import PerfectHash

        fs, root = open_fs(self.uri)
        infos = fs.get_file_info(_selector(f"{root}/shard={shard}"))
        files = [i.path for i in infos if i.path.endswith(".parquet")]
        found = None
        if files:
            with fs.open_input_file(files[0]) as f:
                row = pq.read_table(f).to_pylist()[0]
            arrays = {n: np.frombuffer(row[n], k) for n, k in (("sizes", np.int64), ("words", np.uint64), ("fingerprints", np.uint64), ("last", np.int64))}
            found = PerfectHash(arrays["sizes"], arrays["words"]), arrays["fingerprints"], arrays["last"]
            self.size += len(arrays["last"]) * _ENTRY_BYTES
        self.kept[shard] = found
        while self.size > self.max_bytes and len(self.kept) > 1:
            _, old = self.kept.popitem(last=False)
            self.size -= len(old[2]) * _ENTRY_BYTES if old else 0
        return found


def _selector(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path, allow_not_found=True)


_READERS: dict[str, _Shards] = keeps()


def _reader(uri: str) -> _Shards:
    """One reader in a Python worker; that of an earlier job goes."""
    if uri not in _READERS:
        only(_READERS)
        _READERS.clear()
        _READERS[uri] = _Shards(uri)
    return _READERS[uri]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, shard_entries: int = 250_000) -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` documents, except in the largest id that holds them.

    Adds n_lines (before) and n_dropped; these names win over columns of the same name.
    """
    uri, shards = build_index(line_counts(docs, id_col, text_col, min_chars, min_docs), shard_entries)

    def probe(lo: np.ndarray, hi: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line goes."""
        drop = np.zeros(len(lo), bool)
        shard = lo.view(np.int64) % shards
        for k in np.unique(shard):
            at = np.flatnonzero(shard == k)
            if (found := _reader(uri).get(int(k))) is None:
                continue
            mph, fingerprints, last = found
            index = mph.lookup(lo[at], hi[at])
            at, index = at[index >= 0], index[index >= 0]
            same = fingerprints[index] == hi[at]
            drop[at[same]] = last[index[same]] != ids[at[same]]
        return drop

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in pieces(batch, text_col):
                ids = [_NO_ID if d is None else d for d in part.column(id_col).to_pylist()]
                lines = [t.split(b"\n") for t in text_bytes(part.column(text_col))]
                keys, owner, place = [], [], []
                for d, own in enumerate(lines):
                    for i, line in enumerate(own):
                        if len(line) >= min_chars and _long_enough(k := line_key(line), min_chars):
                            keys.append(k)
                            owner.append(d)
                            place.append(i)
                gone: dict[int, set[int]] = {}
                if keys and uri:
                    for j in np.flatnonzero(probe(*_hashes(keys), np.array([ids[d] for d in owner], np.int64))):
                        gone.setdefault(owner[j], set()).add(place[j])
                texts = [b"\n".join(own if d not in gone else [x for i, x in enumerate(own) if i not in gone[d]]).decode() for d, own in enumerate(lines)]
                yield part, {text_col: texts, "n_lines": [len(x) for x in lines], "n_dropped": [len(gone.get(d, ())) for d in range(len(lines))]}

    return with_columns(docs, [(text_col, "string"), ("n_lines", "long"), ("n_dropped", "long")], lean(run, alone=False))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document without its common lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
keyed AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE last IS NOT NULL AND last <> doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id
"""
