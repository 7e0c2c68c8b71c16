import html
import itertools
import re

import numpy as np

from quern.llm import html_extract as x
from quern.llm.html_tree import parse


def article(page):
    """The truth of the test tables, whose pages have one article element without anything foreign in it."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [html.unescape(re.sub(r"<[^>]+>", "", p)) for p in re.split(r"</?(?:p|h1|br)\s*/?>", inner)]
    return " ".join(" ".join(p.split()) for p in parts if p.split())


def test_query_on_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = x.op10_html_extract(spark, sf).collect()
    assert len(rows) == len(pages)
    assert all(r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


def test_held_out_pages():
    held = x.labelled_pages(150, seed=77)
    got = x.default_model().texts([h for h, _, _ in held])
    exact = sum(g == t for g, (_, _, t) in zip(got, held)) / len(held)
    kept = sum(len(g) for g in got if g)
    foreign = sum(g.count("qbadq") for g in got)
    assert exact > 0.9 and kept and foreign < 60


def test_marginals_against_enumeration():
    model = x.TreeModel()
    rng = np.random.default_rng(1)
    model.weights, model.edges = rng.normal(size=x.N_FEATURES), rng.normal(size=(3, 2, 2))
    page = parse("<body><div class=content><p>a<p>b</div><ul><li>c</ul></body>")
    f = x.Forest([page])
    n = len(f.parent)
    unary = f.x @ model.weights
    total = np.zeros(n)
    norm = 0.0
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(unary[i] * v for i, v in enumerate(labels)) + sum(model.edges[f.kind[i], labels[f.parent[i]], labels[i]] for i in range(1, n))
        w = np.exp(score)
        norm += w
        total += w * np.array(labels)
    assert np.allclose(model.marginals(f), total / norm)


def test_markup_errors_and_references():
    model = x.default_model()
    cases = {
        "<article><p>a &amp; b&nbsp;&lt;c&gt; &#233; &notit;<p>x<b>y</b>z<br>w</article>": "a & b <c> é ¬it; xyz w",
        "<article><p>one<!-- no --> two</p><script>var a='</p>';</script><style>p{}</style><p>three < four > five</article": "one two three < four > five",
        "<ARTICLE><P>Up\n\n  down\t<I>in</I>line</P></ARTICLE><footer>end</footer>": "Up down inline",
        "": "",
        None: "",
        "<p": "",
    }
    assert model.texts(list(cases)) == list(cases.values())
    deep = "<div>" * 3000 + "<p>x</p>" + "</div>" * 3000
    assert len(model.texts([deep, "<" * 50_000, "<a href='" * 5000, "&" * 100_000, "<p>" * 20_000])) == 5


def test_odd_rows(spark):
    body = "<html><body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>T</h1><p>text one</p></article></body></html>"
    pages = spark.createDataFrame([(1, "u", body, 5), (1, "u", body, 5), (None, None, None, None), (3, "w", body.replace("text one", "word " * 100_000), 1)], "page_id long, url string, html string, n_chars int")
    rows = x.extract(pages).collect()
    assert sorted((str(r.page_id), r.text[:10], r.n_chars) for r in rows) == [("1", "T text one", 10), ("1", "T text one", 10), ("3", "T word wor", 500_001), ("None", "", 0)]
    assert x.extract(pages.limit(0)).count() == 0


def test_parts_with_misleading_names_stay():
    pages = {
        '<article><p>one two three</p><div class="comment-note"><p>four five</p></div></article>': "one two three four five",
        '<body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>Title</h1><p>one two three</p><section class="related-work"><h2>Related work</h2><p>Others did this before us.</p></section></article><footer>end</footer>': "Title one two three Related work Others did this before us.",
        "<article><h1>T</h1><p>Energy is <math>E</math> and <object>fallback words</object></p></article>": "T Energy is E and fallback words",
    }
    assert x.default_model().texts(list(pages)) == list(pages.values())
