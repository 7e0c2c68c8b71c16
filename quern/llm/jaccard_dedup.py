"""Near-dedup by Jaccard similarity of word shingles: every pair at the threshold is found and verified.

Sets. A document's set is its distinct XXH64 hashes (seed 42) of runs of ``width`` words, as op9 has
them. Documents of equal sets are one node, named by the XXH64 of the sorted hashes.

Fingerprints. Each set has the SimHash of its hashes. Fingerprints up to ``limit`` bits apart meet at the anchors of
quern.llm.simhash_dedup; the pairs are verified and make the first components. At similarity 0.8 fingerprints
differ in about ten bits, more than anchors reach, so the sets that are still apart are compared by an exact way.

The exact way. Two sets of similarity t share at least t of the hashes of the larger, so under any one order
of all hashes the first n - ceil(t n) + 1 of each set share one. Hashes that are common in a sample of
the documents come last in that order; the sample decides how much is compared, never what is found.
Pairs whose sizes, or whose places in both sets, rule out the threshold are not compared.

The sets are dealt by hash once; neighbours by size under each shared hash are written, and the members of
hashes that more than two sets share. First, of each set's neighbours the one that shares most hashes
with it is verified, then the others whose sets lie in different components so far, then, up to
``turns`` times, members a few places apart in a new order: all linear in the rows, and large
groups of near copies are one component by then. At last come all pairs of the written members that still
lie in different components, so nothing is lost. Each set has a sketch, the sizes of its parts by hash;
the lesser sizes of two sets, summed, are an upper bound of what they share, so pairs that it rules out
are never written. Nor are whole sets moved for a pair before the parities of both sets' parts, about a bit for each
hash, leave it possible: parts whose sizes differ in parity are a lower bound of the hashes in one set only. Hashes shared by more than ``cell`` sets are split in chunks and each pair
of chunks compared in a group of its own. Verification takes the similarity of the whole sets, by the
low 32 bits of the hashes.

Defined cases: null and empty texts, and texts without words, are copies of one another and of nothing
else. Texts with fewer words than a shingle are one shingle. Rows of equal id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean, pieces, text_bytes
from quern.llm.graph import components
from quern.llm.simhash_dedup import links, shingle_hashes, simhash
from quern.storage import discard, materialize


_PARTS = 128
#: Texts whose sets are held at once.
_TEXT_BYTES = 4 << 20
#: How far apart in an order the sets are that a linear turn compares.
_STRIDES = (1, 2, 3, 5, 8, 13)
#: Sets under a hash whose pairs are all compared without linear turns before.
_FEW = 16


def shingle_set(text: bytes, width: int) -> tuple[int, np.ndarray]:
    """The set's name (long) and its hashes, sorted."""
    hashes = np.unique(shingle_hashes(text, width))
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64)), hashes


def sketch(hashes: np.ndarray) -> bytes:
    """Sizes of the set's parts by hash, 255 for any size from there on."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % _PARTS, minlength=_PARTS), 255).astype(np.uint8).tobytes()


def parities(hashes: np.ndarray) -> bytes:
    """Whether each part of the set by hash has an odd size; as many parts, a power of two, as the set has hashes."""
    bits = max(64, 1 << (max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """How many hashes, at least, are in one of two sets only, by their parities."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # halves are folded to the parities of fewer parts
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "little") ^ int.from_bytes(x[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def _bound(x: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches x and y of sets with n hashes together leave the threshold possible."""
    least = np.minimum(x, y)
    return (least.sum(1, dtype=np.int64) >= similarity / (1 + similarity) * n - 1e-6) | (least == 255).any(1)


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set, of which it shares one with every set at the threshold."""
    n = len(hashes)
    if not n:
        return hashes
    keep = n - math.ceil(similarity * n - 1e-9) + 1
    if not len(common):
        return hashes[:keep]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    late = common[at] == hashes
    return np.concatenate([hashes[~late], hashes[late][np.argsort(rank[at[late]], kind="stable")]])[:keep]


def _common(docs: DataFrame, width: int, sample: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in more than one document of a sample (sorted), and their ranks from the rarest on."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _TEXT_BYTES):
                made = np.concatenate([shingle_set(t, width)[1] for t in text_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64))], names=["h"])

    counts = rows.select("text").mapInArrow(lean(run), "h long").groupBy("h").count().filter("count > 1")
    found = counts.orderBy(F.desc("count"), "h").limit(size).toArrow()
    hashes = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - order


def _prepared(docs: DataFrame, width: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """A row per row of ``docs``: id, node, n, prefix, sketch, fp, odd."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _TEXT_BYTES):
                made = [shingle_set(t, width) for t in text_bytes(part.column("text"))]
                first = [prefix(h, *shared.value, similarity).view(np.int64) for _, h in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([s for s, _ in made], pa.int64()), pa.array([len(h) for _, h in made], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([sketch(h) for _, h in made], pa.binary()), pa.array(np.array([simhash(h) for _, h in made], np.uint64).view(np.int64)), pa.array([parities(h) for _, h in made], pa.binary())],
                    names=["id", "node", "n", "prefix", "sketch", "fp", "odd"],
                )

    return docs.mapInArrow(lean(run), "id long, node long, n int, prefix array<long>, sketch binary, fp long, odd binary")


def _possible(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and places of a shared hash allow the threshold, if it is the first one shared."""
    most = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
    return most >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6


def _neighbours(similarity: float):
    """From rows sorted by token, size and node: pairs of neighbours (kind 0: a, b, times) and the members of tokens
    that more than two sets share (kind 1: token, node, size and place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((3, 0), np.int64)  # the last token's rows that are not written, or its last row
        written = False  # whether that row is
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy() for c in ("token", "node", "at")])
            old, rows = kept.shape[1], np.concatenate([kept, new], axis=1)
            token, node, at = rows
            same = token[1:] == token[:-1]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(first, len(token)))
            crowded = size > 2
            crowded[0] |= written and size[0] > 1
            member = np.repeat(crowded, size)
            member[:1] &= not written
            n, pos = at >> 32, at & 0xFFFFFFFF
            i = np.flatnonzero(same)
            i = i[i + 1 >= old]  # other pairs were met before
            i = i[_possible(n, pos, i, i + 1, similarity) & (node[i] != node[i + 1])]
            pairs, times = np.unique(np.sort(np.stack([node[i], node[i + 1]], axis=1), axis=1), axis=0, return_counts=True)
            out = np.concatenate([np.stack([np.zeros(len(pairs), np.int64), *pairs.T, times]), np.stack([np.ones(int(member.sum()), np.int64), token[member], node[member], at[member]])], axis=1)
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["kind", "a", "b", "c"])
            written = bool(crowded[-1]) or (written and len(first) == 1)
            kept = rows[:, -1:] if written else rows[:, first[-1] :]

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _PARTS)


def _possible_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that their sketches (sa, sb) and sizes (na, nb) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _bound(_sketches(batch.column("sa")), _sketches(batch.column("sb")), batch.column("na").to_numpy() + batch.column("nb").to_numpy(), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", F.col("na").cast("long"), F.col("nb").cast("long"), "sa", "sb").mapInArrow(lean(run), "a long, b long")


def _every(keys: tuple[str, ...], similarity: float, adjacent: bool = False):
    """From rows sorted by keys, size and node: pairs (a, b) of all rows of a group that have different labels; or, in any order, of rows a few places apart."""

    def pairs_of(k: np.ndarray, node: np.ndarray, at: np.ndarray, label: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, pos = at >> 32, at & 0xFFFFFFFF
        if adjacent:
            for stride in _STRIDES:
                i = np.flatnonzero((k[stride:] == k[:-stride]).all(1) & (label[stride:] != label[:-stride]))
                j = i + stride
                good = _possible(n, pos, i, j, similarity)
                i, j = i[good], j[good]
                good = _bound(parts[i], parts[j], n[i] + n[j], similarity)
                pairs = np.unique(np.sort(np.stack([node[i[good]], node[j[good]]], axis=1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], names=["a", "b"])
            return
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])) if len(k) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(k)))
        for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            if (label[s : s + m] != label[s]).any():
                top = np.searchsorted(n[s : s + m], n[s : s + m] / similarity + 1e-6, "right")
                for begin in range(0, m, 256):
                    own, other = np.arange(begin, min(m, begin + 256)), np.arange(begin, m)
                    i, j = np.nonzero((other > own[:, None]) & (other < top[own][:, None]) & (label[s + other] != label[s + own][:, None]))
                    i, j = s + own[i], s + other[j]
                    good = _possible(n, pos, i, j, similarity)
                    i, j = i[good], j[good]
                    for k in range(0, len(i), 20_000):
                        good = _bound(parts[i[k : k + 20_000]], parts[j[k : k + 20_000]], n[i[k : k + 20_000]] + n[j[k : k + 20_000]], similarity)
                        a, b = node[i[k : k + 20_000][good]], node[j[k : k + 20_000][good]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1), *(batch.column(c).to_numpy() for c in ("node", "at", "label")), _sketches(batch.column("sketch"))]
            if kept is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(kept, rows, strict=True)]
            other = np.flatnonzero((rows[0] != rows[0][-1]).any(1))
            cut = len(rows[0]) if adjacent else other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            yield from pairs_of(*(x[:cut] for x in rows))
            kept = None if adjacent else [x[cut:] for x in rows]
        if kept is not None:
            yield from pairs_of(*kept)

    return run


def _further(members: DataFrame, similarity: float, cell: int, turn: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of different labels that share a hash, or only those a few places apart in an order that a turn names. ``members``: token, node, at, label, sketch."""

    def dealt(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "at", "node").mapInArrow(lean(_every(keys, similarity)), "a long, b long")

    # one label throughout a hash: nothing to compare
    groups = members.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = materialize(groups.filter("low <> high").select("token", "m"), "mixed-hashes")
    if mixed.isEmpty():
        return members.sparkSession.createDataFrame([], "a long, b long")
    rows = members.join(mixed, "token")
    if turn is not None:  # the pairs of fewer sets are few
        turned = rows.filter(F.col("m") > _FEW).repartition("token").sortWithinPartitions("token", F.xxhash64("node", F.lit(turn)))
        return turned.mapInArrow(lean(_every(("token",), similarity, True)), "a long, b long").distinct()
    light = dealt(rows.filter(F.col("m") <= cell), ("token",))
    chunks = F.ceil(F.col("m") / cell).cast("int")
    heavy = rows.filter(F.col("m") > cell).withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    heavy = heavy.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    heavy = heavy.withColumn("k2", F.least("own", "other")).withColumn("k3", F.greatest("own", "other"))
    return light.union(dealt(heavy, ("token", "k2", "k3"))).distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs whose sets have the similarity. Whole sets are moved only for pairs that sizes and parities leave possible."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-6
            least = [apart(x, y) for x, y in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(least, np.int64) <= total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _TEXT_BYTES):
                made = [shingle_set(t, width) for t in text_bytes(part.column("text"))]
                low = [np.unique(h.astype(np.uint32)).view(np.int32) for _, h in made]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int64()), pa.array(low, pa.list_(pa.int32()))], names=["node", "hashes"])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").cast("long").alias(f"n{c}"), F.col("odd").alias(f"o{c}"))
    pairs = materialize(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(near), "a long, b long"), "near-pairs")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = materialize(nodes.select("node", "first").join(involved, "node", "left_semi").select(F.col("first").alias("named")).distinct(), "candidates")
    texts = docs.join(ids, docs["id"].eqNullSafe(ids["named"]), "left_semi").mapInArrow(lean(run), "node long, hashes array<int>")
    sets = materialize(texts.join(involved, "node", "left_semi").dropDuplicates(["node"]), "candidate-sets")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = materialize(both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "links")
    discard(pairs, ids, sets)
    return found


def _fingerprint_pairs(nodes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b) of sets that the anchors of their fingerprints link: each fingerprint's sets with its first, and the first of linked fingerprints."""
    by_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "set-fingerprints")
    found = links(by_fp, limit)
    lead = lambda c: by_fp.select(F.col("fp").alias(c), F.col("lead").alias(f"l{c}"))
    between = found.join(lead("a"), "a").join(lead("b"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    within = nodes.select("fp", "node").join(by_fp, "fp").filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = materialize(between.union(within).distinct(), "fingerprint-pairs")
    discard(by_fp)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, cell: int = 4096, sample: int = 10_000, common: int = 200_000, turns: int = 2, limit: int = 5) -> DataFrame:
    """A row per row of ``docs``: id, component (the smallest id that links of the similarity reach)."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = materialize(_prepared(docs, width, similarity, _common(docs, width, sample, common)), "shingle-prefixes")
    nodes = materialize(own.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"), F.first("odd").alias("odd")), "distinct-sets")
    ids = materialize(own.select("id", "node"), "set-ids")
    discard(own)
    tokens = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = tokens.select("token", "node", (F.col("n").cast("long") * (1 << 32) + F.col("pos")).alias("at"))
    met = tokens.repartition("token").sortWithinPartitions("token", "at", "node").mapInArrow(lean(_neighbours(similarity)), "kind long, a long, b long, c long")
    met = materialize(met, "neighbours")
    slim = materialize(nodes.drop("prefix"), "slim-sets")
    discard(nodes)
    nodes = slim
    close = _fingerprint_pairs(nodes, limit)
    edges = _verified(docs, nodes, close, width, similarity)
    discard(close)

    def labelled() -> DataFrame:
        """Each set's component so far."""
        found = components(edges, "jaccard")
        return materialize(nodes.select("node", "n", "sketch").join(found, "node", "left").select("node", "n", "sketch", F.coalesce("label", "node").alias("label")), "labelled-sets")

    labels = labelled()
    pairs = materialize(met.filter("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("times")), "neighbour-pairs")
    best = lambda other: F.max(F.struct("times", F.col(other).alias("other"))).alias("best")
    own_label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    open_pairs = pairs.join(own_label("a"), "a").join(own_label("b"), "b").filter("la <> lb")
    picks = open_pairs.groupBy(F.col("a").alias("node")).agg(best("b")).union(open_pairs.groupBy(F.col("b").alias("node")).agg(best("a")))
    picks = picks.groupBy("node").agg(F.max("best").alias("best")).select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b"))
    picks = materialize(picks.distinct(), "picked-pairs")
    edges = edges.union(_verified(docs, nodes, picks, width, similarity))
    members = met.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("c").alias("at"))
    discard(labels)
    labels = labelled()
    for turn in (None, *range(turns), "every"):
        if turn is None:
            side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
            rest = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter("la <> lb")
            more = _possible_pairs(rest, similarity).join(picks, ["a", "b"], "left_anti")
        else:
            more = _further(members.join(labels.drop("n"), "node"), similarity, cell, turn if turn != "every" else None)
        more = materialize(more, "further-pairs")
        if more.isEmpty():
            continue
        fresh = _verified(docs, nodes, more, width, similarity)
        discard(more)
        if not fresh.isEmpty():
            edges = edges.union(fresh)
            discard(labels)
            labels = labelled()
    labels = labels.select("node", "label")
    linked = materialize(nodes.select("node", "first").join(labels, "node"), "linked-sets")
    smallest = linked.groupBy("label").agg(F.min("first").alias("component"))
    by_node = materialize(linked.join(smallest, "label").select("node", "component"), "set-components")
    found = materialize(ids.join(by_node, "node").select("id", "component"), "near-duplicates")
    discard(ids, nodes, met, pairs, picks, linked, by_node)
    return found


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the document of the smallest id of each group of near copies; all columns stay.

    Documents whose id is null stay: nothing names them.
    """
    found = near_duplicates(docs, id_col, text_col, width, similarity)
    gone = materialize(found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
