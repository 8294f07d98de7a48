from __future__ import annotations

import pytest

from corollary.llm import extraction

LONG = "A paragraph that is long enough to begin the main text, with quite a few words in a row."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain words", "plain words"), ("<p>a &amp; b&nbsp;&lt;c&gt;</p>", "a & b <c>"),
    ("<nav><ul><li>Menu</ul></nav><article><h1>T</h1><p>Short.</p></article><footer>f</footer>", "T\nShort."),
    ("<article><p>one\n  two<br>three</p><div class='ad'>Buy<p>now</div><p>four</article>", "one two three\nfour"),
    ("<div class=ad>open ad<article><p>text</article>", "text"),
    (f"<body><div class='top-menu'>a</div><h2>Title</h2><p>{LONG}</p><p>End.</p><div id=comments><p>{LONG}</p></div></body>", f"Title\n{LONG}\nEnd."),
    (f"<p>{LONG}</p><form><p>{LONG}</p></form><script>var a='<p>{LONG}</p>'</script><style>p{{}}</style><!-- <p>{LONG}</p> -->", LONG),
    (f"<p>{LONG}</p><p><a href=x>{LONG}</a></p>", LONG),
    (f"<header>h</header><main><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside></main>", f"T\n{LONG}"),
    (f"<p>{LONG}", LONG), (f"<p>{LONG}<p unfinished='", LONG), (f"<div hidden>{LONG}</div><p>{LONG} Two.</p>", f"{LONG} Two."),
])
def test_pages(html, text):
    assert extraction.main_text(html or "") == text


def test_surge_and_dive():
    assert extraction.stretches([], 3, 80) == []
    assert extraction.stretches([0, 0], 3, 80) == []
    assert extraction.stretches([5, 0, 0, 0, 50, 40, 2, 0, 0, 0, 9], 3, 80) == [(4, 7)]
    assert extraction.stretches([5, 0, 0, 0, 3], 3, 80) == [(0, 1)]


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t", 5), (2, None, None, None, None), (1, "u", f"<article><p>{LONG}</p></article>", "t", 5)]
    rows.append((3, "v", "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(5000)) + "</article>", "t", 5))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract_main_text(pages).toPandas()
    assert list(got.columns) == ["page_id", "url", "text", "n_chars"]
    assert sorted(got.n_chars) == [0, len(LONG), len(LONG), sum(len(f"{LONG} {i}") + 1 for i in range(5000)) - 1]
    assert extraction.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post-body comments-open", "site-content with-banner", "page-header-layout"])
def test_a_word_of_a_class_does_not_take_the_page(name):
    page = f"<body><div class='site-menu'>Home</div><div class='{name}'><h1>T</h1><p>{LONG}</p><p>End.</p><div class='top-share'>Share</div></div></body>"
    assert extraction.main_text(page) == f"T\n{LONG}\nEnd."


def test_a_page_of_marked_elements_only():
    assert extraction.main_text(f"<div class=widget><p>{LONG}</p></div>") == LONG
    assert extraction.main_text(f"<div hidden class=widget><p>{LONG}</p></div>") == ""
    unclosed = f"<ul><li class='nav-item'>Home<li class='nav-item'>News</ul><p>{LONG}</p>"
    assert extraction.main_text(unclosed) == LONG


@pytest.mark.parametrize("raw", [
    "<svg class='i'/>", "<svg><title>t</title><path d='M0'/>", "<svg><text>no</text></svg>", "<select><option>no", "<select name=a><option>no</option></select>",
    "<object data=x>", "<video src='a.mp4'>", "<noscript>", "<iframe src='x'/>", "<script src='x'/>", "<canvas></canvas>", "<math><mi>x</mi></math>",
])
def test_raw_elements_end(raw):
    page = f"<article><h1>A</h1>{raw}<p>Main text.</p>%s</article>"
    assert extraction.main_text(page % "") == "A\nMain text."
    assert extraction.main_text(page % f"{raw}<p>More.</p>") == "A\nMain text.\nMore."
