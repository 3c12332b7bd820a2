import time

import pytest
from textlens.llm import html_extract as H

P1 = "First paragraph, long enough to count, with commas, and more."
P2 = "Second paragraph that is also long enough to be counted here."

CASES = [
    ("<p>" + P1 + "</p>", P1),
    (f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; line</h1>"
     f"<p><b>{P1}<br><p>{P2}</article><footer>&copy; x</footer>", f"Head & line\n\n{P1}\n\n{P2}"),
    (f"<body><header><h1>Site</h1></header><div id=main-content><h2>Title</h2><p>{P1}<p>{P2} <a href=x>link</a><table><tr><td>a<td>b</table><ul><li>one<li>two</ul></div>"
     f"<div class='user-comments'><p>{P2}</p></div><div class=sidebar>x</div>", f"Title\n\n{P1}\n\n{P2} link\n\na b\n\none\n\ntwo"),
    (f"<main><header><h1>Kept</h1></header><section><p>{P1}</p></section><aside>{P2}</aside><section><p>short</p></section></main>", f"Kept\n\n{P1}\n\nshort"),
    (f"<article><p>{P1}</p><form><input><p>{P2}</p></form><div hidden>{P2}</div><div style='display: none'>x</div><div role=alert>y</div><p>end</p></article>", f"{P1}\n\nend"),
    (f"<div><p>{P1}</p><p>{P2}</p></div><div class='cookie-notice'><p>{P1}</p></div><!-- <p>no</p> --><p>", f"{P1}\n\n{P2}"),
    (f"<ARTICLE><P>{P1}</P><PRE>a\n  b</PRE><blockquote>q</blockquote>x<hr>y</ARTICLE>", f"{P1}\n\na b\n\nq\n\nx\n\ny"),
    (f"<article><p>a&nbsp;&#233;&lt;b&gt; &bogus; {P1}</p></article>", f"a é<b> &bogus; {P1}"),
    (f"<article><p>{P1}</p><script>x", P1),
    ("plain text only", "plain text only"),
    ("<body><p>tiny</p></body>", "tiny"),
    ("<nav>menu</nav>", ""), ("", ""), (None, ""), ("<", "<"), ("<!-- open", ""), ("a < b", "a < b"),
    (f"<article><p>{P1}</p><p title='a>b'>{P2}</p></article>", f"{P1}\n\n{P2}"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert H.main_text(html) == text


MENU = "<a href=/1>One of the other pages</a> <a href=/2>Another of them</a>"
LOOSE = [
    (f'<article><p>{P1} <a href="/hidden-lakes" title="the hidden city">lakes</a> <a href="/p?id=comments" data-id="share-1">b</a> end</p></article>', f"{P1} lakes b end"),
    (f'<article><section id="recommendations"><h2 id="related-work">Related work</h2><p class="notice">{P1}</p></section><p id=skip-lists>Skip lists</p></article>',
     f"Related work\n\n{P1}\n\nSkip lists"),
    (f'<article><p>{P1}</p><div class="related"><p>{MENU}</p></div><div class=share>Share this</div><p>{P2}</p></article>', f"{P1}\n\n{P2}"),
    (f'<article><p>{P1}</p><section class=comments><div class=comment><p>{P2}</p></div></section></article>', P1),
    (f'<body><div><p>{P1}</p><p class="notice">{P2}</p><section id=replies><p>{P1}</p></section></div><div class=sidebar><p>{P2}</p></div>', f"{P1}\n\n{P2}\n\n{P1}"),
    (f'<article><p>{P1} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p><pre>a <span class="comment"># b</span></pre></article>', f"{P1} x=2\n\na # b"),
    (f"<article><p>{P1}</p><div class = 'a' HIDDEN><p>{P2}</p></div><div data-x='y'hidden>z</div></article>", P1),
]


@pytest.mark.parametrize("html,text", LOOSE)
def test_words_that_look_like_boilerplate(html, text):
    assert H.main_text(html) == text


def test_long_and_broken_pages_stay_linear():
    began = time.process_time()
    for page in ("<div>" * 30_000 + "x", "<p><b>" * 30_000 + P1, "<!--" * 30_000, "<a href='" * 30_000, "<" * 100_000, "<li>" * 30_000,
                 "<article>" + f"<p>{P1}</p>" * 20_000 + "</article>", "</div>" * 50_000, "<table><tr><td>" * 5_000):
        H.main_text(page)
    assert time.process_time() - began < 60
    assert H.main_text("<article>" + f"<p>{P1}</p>" * 3000 + "</article>") == "\n\n".join([P1] * 3000)


def test_query(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0], 1), (None, "n", "<p>" + P1, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = H.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        want = P1 if r["page_id"] is None else CASES[r["page_id"]][1]
        assert r["text"] == want and r["n_chars"] == len(want)
    assert H.extract(pages.limit(0)).count() == 0


GRID = "<a href=/1>Another story of the day</a><a href=/2>And one more of them</a><a href=/3>A third one to read</a>"


@pytest.mark.parametrize("html,text", [
    (f"<main><article><p>{P1}</p><p>{P2}</p></article><div class=tiles>{GRID}</div></main>", f"{P1}\n\n{P2}"),
    (f"<main><div class=tiles>{GRID}</div><p>{P1}</p><p>{P2}</p></main>", f"{P1}\n\n{P2}"),
    (f"<main><div><section><p>{P1}</p><p>{P2}</p></section><ul><li><a href=/1>One of the pages</a><li><a href=/2>Other one</a></ul></div><p>end</p></main>",
     f"{P1}\n\n{P2}\n\nend"),
    (f"<article><p>{P1}</p><p><a href=/x>A paragraph</a> <a href=/y>of two links stays</a></p><div><a href=/z>one link stays</a></div></article>",
     f"{P1}\n\nA paragraph of two links stays\n\none link stays")])
def test_parts_of_links_inside_the_widened_element_go(html, text):
    assert H.main_text(html) == text
