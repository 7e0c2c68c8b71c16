import re
from collections import Counter

from quern.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.op5_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id].text)
        assert r.kept is (not r.base_failed and not (r.n_words >= 50 and ((r.char_distance or 0) > 0.25 or (r.word_distance or 0) > 0.45 + 3 / r.n_words**0.5 or ((r.char_distance or 0) > 0.15 and (r.word_distance or 0) > 0.28))))


def test_verdicts_agree_with_labels(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op5_quality_rules(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id]]
    bad = [r.kept for r in rows if not labels[r.doc_id] and r.n_words >= 50]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [None, "", " \n\t", "a b c d e f g h " * 3, "x " * 60 + "\n" * 5 + "x", long + " " + long, "\x0bone\x0ctwo three four é\n\n é\n é", "same line\nsame line\n other"]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "xx", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    rows = q.score_quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
    kept = q.keep_quality(docs)
    assert kept.columns == docs.columns and all(r.kept == 5 for r in kept.collect())
    assert q.score_quality(docs.limit(0)).count() == 0
