import hashlib

import numpy as np

from quern.llm import line_dedup as l
from quern.llm.mph import PerfectHash

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(lower(line)) >= min_chars:
                holders.setdefault(lower(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(lower(x), ())) < min_docs or max(h) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = brute(docs)
    rows = l.op6_line_dedup(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, dropped, text = expected[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (n, dropped, hashlib.sha256(text.encode()).hexdigest())


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        lo, hi = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
        mph = PerfectHash.build(lo, hi)
        assert sorted(mph.lookup(lo, hi).tolist()) == list(range(n))


def test_odd_rows_and_many_shards(spark):
    common, other = "the same line in many documents", "\u00e9" * 20
    rows = [(i, f"{common} \n own line of document {i}, long enough\n\t{common.upper()}\r\n{other}\nshort") for i in range(6)]
    rows += [(10, None), (11, ""), (12, common), (13, (f"{other}\n" * 20_000) + "end")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, n_lines string, extra int")
    for shard_entries in (1, 250_000):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in l.dedup_lines(docs, shard_entries=shard_entries).collect()}
        assert got == brute(rows)
    assert l.dedup_lines(docs.limit(0)).count() == 0
    assert set(l.dedup_lines(docs).columns) == {"doc_id", "extra", "text", "n_lines", "n_dropped"}


def test_rows_of_equal_id_are_one_document(spark):
    line = "a line that some documents have"
    for ids, gone in (([1, 2, 2], 0), ([1, 2, 3, 3], 2), ([None, None, 1], 0), ([None, 1, 2], 2)):
        docs = spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
        assert sum(r.n_dropped for r in l.dedup_lines(docs).collect()) == gone
