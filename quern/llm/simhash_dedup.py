"""SimHash near-dedup by anchor-point covering.

Fingerprints. Each bit of a document's fingerprint is 1 if it is set in over half of the XXH64 hashes
(seed 42) of its word shingles, repeats counted.

Anchors. Two fingerprints that differ in at most three bits differ in at most one bit of one of their
halves. For each half the anchors are the words of a covering code: a Hamming code on 31 bits (perfect,
covering radius 1), the 32nd bit free. A fingerprint is sent to every anchor within covering radius
plus threshold, 1 + 1 = 2, of its half: 17 of 2^27 anchors, or 2 if the half is itself a code word. The
anchor nearest to one of a pair of halves one bit apart is within 2 of the other, so they meet there.
For four or five bits there are three parts, each with a Hamming code on 15 bits and the others free.

Comparison. Only distinct fingerprints are sent, so exact copies cost nothing. Anchors with more than
``cell`` fingerprints are split in chunks, and each pair of chunks is compared in a group of its own, so
no task holds an unbounded anchor and no link is lost. A group is searched breadth first and gives the
edges of a spanning forest, not its pairs. Components are found by contraction (quern.llm.graph).

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other. Texts with fewer words than a shingle are one shingle. A null id is never a component's id
unless all its ids are null. Rows of equal id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lean, pieces, text_bytes
from quern.llm.graph import components
from quern.storage import materialize

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``width`` words, lower-cased, joined by spaces."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(whole[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        ones = np.unpackbits(lanes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """A row per row of ``docs``: id, fp (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                made = np.array([simhash(shingle_hashes(t, width)) for t in text_bytes(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _code(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the Hamming code on ``bits`` bits: by syndrome the masks that lead to the code words within 2 (one bit, or two), how many hold, and the checks."""
    masks = np.zeros((bits + 1, (bits + 1) // 2), np.uint64)
    for s in range(1, bits + 1):
        pairs = [(i, j) for i, j in combinations(range(1, bits + 1), 2) if i ^ j == s]
        masks[s] = [1 << (s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)]
    checks = [sum(1 << (i - 1) for i in range(1, bits + 1) if i >> b & 1) for b in range(bits.bit_length())]
    return masks, np.array([1] + [(bits + 1) // 2] * bits), np.array(checks, np.uint64)


_CODES = {bits: _code(bits) for bits in (31, 15)}
#: By the number of parts: the bits of each.
_WIDTHS = {2: (32, 32), 3: (22, 21, 21)}


def anchors(fps: np.ndarray, parts: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Every (anchor, index into fps) of the fingerprints; an anchor also says which part it is of."""
    out, index, low = [], [], 0
    for k, width in enumerate(_WIDTHS[parts]):
        bits = 31 if width >= 31 else 15
        masks, n_masks, checks = _CODES[bits]
        x = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
        low += width
        syndrome = np.zeros(len(x), np.int64)
        for b, check in enumerate(checks):
            syndrome |= (np.bitwise_count(x & check).astype(np.int64) & 1) << b
        near = x[:, None] ^ masks[syndrome]
        valid = np.arange(masks.shape[1]) < n_masks[syndrome][:, None]
        free = np.array([1 << b for b in range(bits, width)], np.uint64)
        words = np.concatenate([near, near[:, :1] ^ free], axis=1)  # the nearest one with a free bit turned
        valid = np.concatenate([valid, np.ones((len(x), len(free)), bool)], axis=1)
        row, col = np.nonzero(valid)
        out.append(words[row, col] | np.uint64(k << 32))
        index.append(row)
    return np.concatenate(out).astype(np.int64), np.concatenate(index)


def _forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints within ``limit`` bits."""
    edges, left = [], fps
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            for k in range(0, len(front), 64):
                found |= (np.bitwise_count(front[k : k + 64, None] ^ left[None, :]) <= limit).any(0)
            front, left = left[found], left[~found]
            edges += [(seed, x) for x in front]
    return edges


def _compare(limit: int):
    """From rows sorted by group (columns k1, k2, k3, fp), the edges (a, b) within each group."""

    def edges_of(keys: np.ndarray, fps: np.ndarray) -> list[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= limit]
        found = list(zip(fps[two], fps[two + 1], strict=True))
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            found += _forest(fps[s : s + n], limit)
        if not found:
            return []
        both = np.array(found, np.uint64).view(np.int64)
        return [pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_k, kept_f = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2", "k3")], axis=1)
            keys = np.concatenate([kept_k, keys])
            fps = np.concatenate([kept_f, batch.column("fp").to_numpy().view(np.uint64)])
            last = len(keys) - 1
            other = np.flatnonzero((keys != keys[last]).any(1))
            cut = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            yield from edges_of(keys[:cut], fps[:cut])
            kept_k, kept_f = keys[cut:], fps[cut:]
        yield from edges_of(kept_k, kept_f)

    return run


def links(fps: DataFrame, limit: int = 3, cell: int = 4096) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints within ``limit`` bits.

    ``fps``: distinct fingerprints in a long column fp. ``limit`` is at most 5: the anchors' halves
    or thirds leave one bit to each.
    """
    if not 0 <= limit <= 5:
        raise ValueError("the anchors are for thresholds of 0 to 5 bits")
    parts = 2 if limit <= 3 else 3

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                anchor, index = anchors(part, parts)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index].view(np.int64))], names=["k1", "fp"])

    sent = fps.select("fp").mapInArrow(lean(send), "k1 long, fp long")
    full = materialize(sent.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell), "full-anchors")
    light = sent
    if crowded := not full.isEmpty():
        light = sent.join(full, "k1", "left_anti")
    light = light.select("k1", F.lit(0).alias("k2"), F.lit(0).alias("k3"), "fp")
    edges = _grouped(light, ("k1",), limit)
    if crowded:
        chunks = F.ceil(F.col("n") / cell).cast("int")
        heavy = sent.join(full, "k1").withColumn("own", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        heavy = heavy.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        heavy = heavy.select("k1", F.least("own", "other").alias("k2"), F.greatest("own", "other").alias("k3"), "fp")
        edges = edges.union(_grouped(heavy, ("k1", "k2", "k3"), limit))
    return edges


def _grouped(rows: DataFrame, keys: tuple[str, ...], limit: int) -> DataFrame:
    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lean(_compare(limit)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3) -> DataFrame:
    """A row per row of ``docs``: id, fp, component (the smallest id that links reach)."""
    own = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = materialize(own.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    labels = components(links(first, limit), "simhash").withColumnRenamed("node", "fp")
    linked = first.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = materialize(linked, "linked-fingerprints")
    smallest = materialize(linked.groupBy("label").agg(F.min("first").alias("component")), "component-ids")
    by_fp = materialize(linked.join(smallest, "label").select("fp", "component"), "fingerprint-components")
    return own.join(by_fp, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` with the document of the smallest id of each group of near copies; all columns stay.

    Documents whose id is null stay: nothing names them.
    """
    found = near_duplicates(docs, id_col, text_col, width, limit)
    gone = materialize(found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
