import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from quern.llm import bpe
from tests.llm import test_decontaminate, test_jaccard_dedup, test_line_dedup, test_quality_rules


def test_pipeline_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    everything = {r.doc_id: r.text for r in docs.collect()}
    assert all(not test_quality_rules.brute(t)[-1] for t in first.values())
    assert len(first) >= 0.7 * len(everything) and all(everything[i] == t for i, t in first.items())
    rows = sorted(first.items())
    texts = {d: x[2] for d, x in test_line_dedup.brute(rows).items()}
    ids = list(texts)
    groups = test_jaccard_dedup.plain_components(list(texts.items()))
    texts = {i: texts[i] for i, g in zip(ids, groups) if i == g}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        return any(q >= 0.8 and a >= 0.5 for q, a in (test_decontaminate.overlaps(text, item) for item in items))

    texts = {i: t for i, t in texts.items() if not leaks(t)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].n_tokens == len(plain.encode_ordinary(t))
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
