"""Blocks of main text against a plain reading of the article, odd pages, and deep ones."""

import html as h
import re
import time

import pytest
from compare import connect

from corpusmill.llm.html_text import extract

TEXT = "A long paragraph of the article with many words in it, and some more of them after a comma."


@pytest.mark.parametrize("root", ["/root/testdata/sf0.01", "/root/testdata/check_s"])
def test_blocks_equal_a_plain_reading(root):
    if root.endswith("check_s"):
        pages = connect("/root/testdata/sf0.001").execute(f"SELECT html FROM '{root}/pages.parquet/*.parquet' WHERE page_id % 13 = 0").fetchall()
    else:
        pages = connect(root).execute("SELECT html FROM pages").fetchall()
    assert len(pages) > 200
    for (page,) in pages:
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        blocks = re.split(r"</?(?:p|h1|h2|div|ul|li|blockquote|pre|table|tr|td)\b[^>]*>", re.sub(r"<br[^>]*>", " ", inner))
        blocks = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
        assert extract(page) == "\n".join(b for b in blocks if b)


def test_names_that_sound_like_something_else():
    body = f"<h1>T</h1><p>{TEXT}</p><p class='alert'>{TEXT}</p><section class='related-work'><p>{TEXT}</p></section><div class='side-by-side'><p>Short.</p></div><p>{TEXT}</p>"
    want = "\n".join(["T", TEXT, TEXT, TEXT, "Short.", TEXT])
    assert extract(f"<body><article>{body}</article></body>") == want
    assert extract(f"<body><div>{body}</div></body>".replace(" class='alert'", "")) == want


def test_boilerplate_without_names():
    menu = "".join(f"<li><a href=/{i}>Topic {i}</a>" for i in range(8))
    links = "<p><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a> <a href=/4>Four</a></p>"
    page = f"<body><div><ul>{menu}</ul></div><div><h1>Head</h1>" + f"<p>{TEXT}</p>" * 6 + "<p>Short end.</p></div><div><ul>" + menu + "</ul></div><div>&copy; us</div></body>"
    assert extract(page) == "\n".join(["Head", *[TEXT] * 6, "Short end."])
    page = "<body><article><h1>Head</h1>" + f"<p>{TEXT}</p>" * 6 + links + f"</article><div class=comments><p>{TEXT}</p></div></body>"
    assert extract(page) == "\n".join(["Head", *[TEXT] * 6])
    page = "<body><article><h1>Head</h1>" + f"<p>{TEXT}</p>" * 4 + f"<p>See <a href=/x>this</a>.</p><section id=comments><p>{TEXT}</p></section></article></body>"
    assert extract(page) == "\n".join(["Head", *[TEXT] * 4, "See this."])


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    deep = "<article>" + "<div class=has-menu>x" * 100_000
    assert extract(deep).count("x") == 100_000
    assert extract("<div class=menu>" * 50_000 + f"<p>{TEXT}") == TEXT
    assert extract("<p>" + "<b>" * 50_000 + f"{TEXT}" + "</i></div>" * 50_000) == TEXT
    assert extract(f"<p>{TEXT}" * 50_000).count("\n") == 49_999
    assert time.time() - began < 60
