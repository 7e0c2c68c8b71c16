import math
import random
from collections import Counter

from quern.llm import decontaminate as d


def overlaps(text, item, width=5):
    words = d.words_of(text)
    out = []
    for part in d.split_item(item):
        n = min(width, len(part))
        have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        own = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
        out.append(len(own & have) / len(own))
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in d.op2_decontaminate(spark, sf).collect()}
    whole, verified = set(), set()
    for doc in docs:
        text = " " + " ".join(d.words_of(doc.text)) + " "
        for item in items:
            if " " + " ".join(d.words_of(item.text)) + " " in text:
                whole.add((doc.doc_id, item.item_id))
            q, a = overlaps(doc.text, item.text)
            if q >= 0.8 and a >= 0.5:
                verified.add((doc.doc_id, item.item_id))
    assert whole and whole <= got <= verified


def test_search_finds_all_items_at_the_threshold():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)] + ["the", "of"] * 20
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(17, 32)))) for i in range(400)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    block = d.Benchmark(items, 400, 25.0, frequency, 5)
    (index,) = block.indexes
    for threshold in (0.3, 0.5, 0.8):
        for _ in range(60):
            terms = set(rng.sample(range(len(block.terms)), rng.randint(1, 60)))
            scores = Counter()
            for t in terms:
                p = index.postings[t]
                for i, w in zip(p.items, p.weights):
                    scores[i] += w
            expected = {i for i, s in scores.items() if s >= threshold}
            assert {i for i, _ in index.search(terms, threshold)} == expected


def test_odd_rows_and_blocks(spark):
    rng = random.Random(6)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)) for n in (5, 12, 30, 90, 400)]
    items = [(i, p) for i, p in enumerate(passages)] + [(10, None), (11, ""), (12, "too short"), (None, "Question: what is it that one sees here?\nAnswer: nothing at all")]
    filler = " ".join("".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range(30_000))
    docs = [(i, f"{filler[:700]} {p.upper()}. {filler[:50]}", None) for i, p in enumerate(passages)]
    docs += [(20, None, 1), (21, "", 1), (22, filler + " " + passages[2], 1), (23, "what is it that one sees here\n\nanswer: Nothing, at all", 2), (23, filler, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, leaks int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 1200):
        rows = d.mark_leaks(frame, tests, max_bytes=size).collect()
        got = {(r.doc_id, x.item_id) for r in rows for x in r.leaks}
        assert got == {(i, i) for i in range(5)} | {(22, 2), (23, None)}
    clean = d.decontaminate(frame, tests)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [20, 21, 23]
    assert d.mark_leaks(frame, tests.limit(0)).count() == len(docs) and d.mark_leaks(frame.limit(0), tests).count() == 0


def test_short_items_clashing_names_and_unspaced_scripts(spark):
    items = spark.createDataFrame([(1, "Yes, it is."), (2, "\u4ec0\u4e48\u662f\u4eba\u5de5\u667a\u80fd\u7684\u4e3b\u8981\u76ee\u6807\u548c\u65b9\u6cd5\u5417")], "item_id long, text string")
    docs = [(1, "well yes it is so", 0, 1), (2, "first\nYES it is!\nlast", 0, 2), (3, "\u6211\u4eec\u95ee\u4ec0\u4e48\u662f\u4eba\u5de5\u667a\u80fd\u7684\u4e3b\u8981\u76ee\u6807\u548c\u65b9\u6cd5\u5417\u5427", 0, 3), (4, None, 0, 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, leaks__0 int, leaks int")
    assert {(r.doc_id, x.item_id) for r in d.mark_leaks(frame, items).collect() for x in r.leaks} == {(2, 1), (3, 2)}
    clean = d.decontaminate(frame, items)
    assert clean.columns == frame.columns and sorted((r.doc_id, r.leaks) for r in clean.collect()) == [(1, 1), (4, 4)]


def test_query_is_all_that_retrieval_and_verification_allow(spark, sf):
    """Equal to scoring every window of every document against every item, without index or pruning."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = {i: d.words_of(t) for i, t in items}
    frequency = Counter(w for own in words.values() for w in set(own))
    mean = sum(map(len, words.values())) / len(words)
    weights = {}
    for i, own in words.items():
        raw = {w: math.log(1 + (len(words) - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, n in Counter(own).items()}
        weights[i] = {w: x / sum(raw.values()) for w, x in raw.items()}
    expected = set()
    for doc in docs:
        own = d.words_of(doc.text)
        for i, text in items:
            length = 1 << max(4, (len(words[i]) - 1).bit_length())
            step = length // 4
            scores = [sum(weights[i].get(w, 0.0) for w in set(own[k : k + length + step])) for k in range(0, max(1, len(own) - length + step), step)]
            if own and max(scores) >= 0.8 - 1e-9:
                q, a = overlaps(doc.text, text)
                if q >= 0.8 and a >= 0.5:
                    expected.add((doc.doc_id, i))
    assert expected and {(r.doc_id, r.item_id) for r in d.op2_decontaminate(spark, sf).collect()} == expected
