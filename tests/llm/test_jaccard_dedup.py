import random

import numpy as np

import corpus_pipeline
from quern.llm import jaccard_dedup as j
from quern.llm.simhash_dedup import anchors


def plain_components(rows, width=5, similarity=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) >= similarity * both - 1e-9:
                parent[root(a)] = root(b)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return [smallest[root(i)] for i in range(len(rows))]


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three four five"), (6, "one two three four five six")]
    shared = " ".join(rng.choice(words) for _ in range(12))
    for _ in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        for edits in (0, 0, 1, 2, 3, 5):
            copy = list(text)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy) + (f" {shared}" if rng.random() < 0.3 else "")))
    return rows


def test_against_brute_force(spark):
    rows = made()
    expected = dict(zip([i for i, _ in rows], plain_components(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"cell": 3}, {"common": 0}):
        assert {r.id: r.component for r in j.near_duplicates(docs, **options).collect()} == expected
    assert {r.id for r in j.near_duplicates(docs.limit(0)).collect()} == set()


def test_stage_drops_what_three_bits_miss(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in made(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {i for (i, _), c in zip(rows, plain_components(rows), strict=True) if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == kept


def test_fingerprints_link_first(spark, monkeypatch):
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    links = j.links
    monkeypatch.setattr(j, "links", lambda fps, limit: seen.append((fps.count(), limit)) or links(fps, limit))
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert seen and seen[0][0] > 100 and seen[0][1] == 5
    assert got == {i for (i, _), c in zip(rows, plain_components(rows), strict=True) if i == c}


def test_anchors_of_thirds_meet():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(6):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1 << int(b))
        (ax, ix), (ay, iy) = anchors(x, 3), anchors(y, 3)
        assert set(range(300)) == {i for _, i in set(zip(ax.tolist(), ix.tolist())) & set(zip(ay.tolist(), iy.tolist()))}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, other in ((1, 1), (60, 70), (500, 520), (3000, 4500)):
        own, rest = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, other, dtype=np.uint64)
        half = np.concatenate([own[: n // 2], rest])
        assert j.apart(j.parities(own), j.parities(own)) == 0
        for x in (rest, half):
            assert 0 < j.apart(j.parities(own), j.parities(x)) <= len(np.setxor1d(own, x))


def test_whole_sets_move_only_for_possible_pairs(spark, monkeypatch):
    rng = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(2500))
    texts = [shared + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(2500)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    moved = []
    kept = j.materialize

    def counted(df, name, *more):
        made = kept(df, name, *more)
        moved.extend([made.count()] if name == "candidate-sets" else [])
        return made

    monkeypatch.setattr(j, "materialize", counted)
    assert {r.id: r.component for r in j.near_duplicates(docs).collect()} == {i: i for i in range(12)}
    assert sum(moved) == 0
