import numpy as np

from quern.llm import cotraining as c


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_query_on_labels_not_fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    model = c.fit_quality(docs, labels.filter("doc_id % 3 <> 0"))
    assert model.handed and any(sum(h) for h in model.handed)
    rows = {r.doc_id: r for r in c.score_quality(docs, model).collect()}
    assert len(rows) == docs.count()
    held = [i for i in truth if i % 3 == 0]
    y = np.array([truth[i] for i in held])
    assert auc(np.array([rows[i].quality_score for i in held]), y) > 0.9
    assert np.mean([rows[i].keep for i in held if truth[i]]) > 0.95
    again = {r.doc_id: r for r in c.score_quality(docs, c.fit_quality(docs, labels.filter("doc_id % 3 <> 0"))).collect()}
    assert all(abs(again[i].quality_score - rows[i].quality_score) < 1e-9 for i in rows)


def test_metadata_view_learns_from_the_text_view():
    rng = np.random.default_rng(2)
    def draw(n):
        y = (rng.random(n) < 0.6).astype(float)
        rows = []
        for v in y:
            words = " ".join(rng.choice(["good", "fine", "plain"] if v else ["bad", "junk", "plain"], 12))
            rows.append((c.text_row(words.encode()), c.metadata_row([f"s{rng.integers(40) * 2 + int(v)}", int(rng.integers(1000))])))
        return rows, y
    (labelled, y), (pool, _), (test, truth) = draw(40), draw(1500), draw(500)
    alone = c.CoTrained().fit(labelled, y, [], 4, 0.1, 0.95)
    both = c.CoTrained().fit(labelled, y, pool, 4, 0.1, 0.9)
    gain = lambda m: auc(m.scores(test)[1], truth)
    assert gain(both) > gain(alone) + 0.1 and auc(both.scores(test)[2], truth) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "k"), (2, "", "en", "a", 5, "k"), (2, "x " * 100_000, "en", "a", 5, "k"), (None, "text", "de", "b", 1, "k")], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 0), (None, 1), (9, 1)], "doc_id long, quality int")
    model = c.fit_quality(docs, labels)
    assert [r.quality_score for r in c.score_quality(docs, model).collect()] == [1.0] * 4
    assert c.score_quality(docs.limit(0), c.fit_quality(docs.limit(0), labels.limit(0))).count() == 0
