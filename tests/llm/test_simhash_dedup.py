import random

import numpy as np
import xxhash

from quern.llm import simhash_dedup as s


def plain_fingerprint(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, limit=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[root(i)] = root(j)
    smallest = {}
    for i, doc in enumerate(ids):
        smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return [smallest[root(i)] for i in range(len(ids))]


def test_query_against_brute_force(spark, sf):
    rows = {r[0]: r for r in s.op9_simhash_dedup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = [d.doc_id for d in docs]
    fps = [plain_fingerprint(d.text) for d in docs]
    assert len(rows) == len(docs)
    assert [rows[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i].component_id for i in ids] == plain_components(ids, fps)


def test_anchors_meet_for_every_pair_of_halves_one_bit_apart():
    rng = np.random.default_rng(1)
    for half in range(2):
        fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
        other = fps ^ (np.uint64(1) << rng.integers(32 * half, 32 * half + 32, 300, dtype=np.uint64))
        (a, ia), (b, ib) = s.anchors(fps), s.anchors(other)
        sent = set(zip(a.tolist(), ia.tolist()))
        met = {i for x, i in zip(b.tolist(), ib.tolist()) if (x, i) in sent and x >> 32 == half}
        assert met == set(range(300))


def test_clusters_with_full_anchors(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            f = c
            for _ in range(rng.randint(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    expected = plain_components(fps, fps)
    for cell in (5, 4096):
        edges = s.links(table, cell=cell)
        labels = {r.node: r.label for r in s.components(edges).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        got = [labels.get(f, f) for f in signed]
        pairs = {(g, e) for g, e in zip(got, expected)}
        assert len(pairs) == len(set(got)) == len(set(expected))


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1000), (1001, 1002)], "a long, b long")
    rows = s.components(edges).collect()
    assert len({r.label for r in rows if r.node <= 500}) == 1
    assert len({r.label for r in rows}) == 3 and len(rows) == 504


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " \n ", None), (4, "one two", "z"), (5, "ONE\ttwo", "z"), (5, "ONE\ttwo", "z"), (None, "one two", "n"), (7, "a b c d " * 40_000, "long")], "doc_id long, text string, label string")
    rows = {(r.id, r.fp, r.component) for r in s.near_duplicates(docs).collect()}
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1] == by_id[2][1] == by_id[3][1] == 0 and by_id[3][2] == 1
    assert by_id[5][2] == by_id[4][2] == by_id[None][2] == 4
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "label"]
    assert {r.doc_id for r in kept.collect()} == {1, 4, 7, None}
    assert s.near_duplicates(docs.limit(0)).count() == 0
