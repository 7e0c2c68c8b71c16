import time

import pytest

from quern.llm.html_tree import parse


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>t</title><body><p>kept text</p></body></html>",
        "<head><meta charset=utf-8><style>p{}</style><p>kept text",
        "<head><title>t</title>kept text",
        "<head><script>x</script><noscript><link href=a></noscript><body>kept text",
        "<head><title>t</title></head><body><p>kept text</p>",
    ],
)
def test_head_without_end_tag(html):
    assert [text for _, text in parse(html).runs] == ["kept text"]


@pytest.mark.parametrize(
    "html",
    ["<a " * 300_000, "<" * 1_000_000, "<div>" * 200_000, "<a href=\"" * 100_000, "<a href='x>" * 100_000, "<b><div>" * 60_000 + "</b>" * 60_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<!--" * 250_000, "</a " * 250_000, "<a =" + "= " * 500_000, "</ " * 300_000],
    ids=range(11),
)
def test_time_in_proportion_to_the_page(html):
    part = html[: len(html) // 8]
    times = []
    for text in (part, html):
        start = time.process_time()
        parse(text)
        times.append(time.process_time() - start)
    assert times[1] < 20 * times[0] + 0.2 and times[1] < 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=\"x\"y\">z</p>", ["z"]),
        ("<p class='never closed>a</p><p>b</p>", ["a", "b"]),
        ("<p>one <b>two</p><p>three</b> four</p>", ["one two", "three four"]),
        ("<table><tr><td>a<tr><td>b</table>c", ["a", "b", "c"]),
        ("<p>a <math>E</math> <object>o</object> <video>v</video> <iframe>i</iframe></p><noscript>n</noscript>", ["a E o v i", "n"]),
        ("<p hidden>h</p><p style='display:none'>d</p>", ["h", "d"]),
        ("a<!-- x --!>b<!doctype y>c<?z?>d", ["abcd"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<select><option>x</select><textarea>y</textarea><script>z</script>a", ["a"]),
        ("<div>" * 2000 + "deep" + "</div>" * 2000 + "after", ["deep", "after"]),
    ],
)
def test_what_is_read(html, text):
    assert [t for _, t in parse(html).runs] == text
