"""Pages whose wrapper names its layout."""

import pytest

from corpusmill.llm.html_text import extract

TEXT = "A long paragraph of the article with many words in it."
PARTS = "<div class=sidebar>side words</div><div class=comments><p>I say</div>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "content no-sidebar", "post with-comments"])
def test_wrappers_keep_their_article(name):
    inner = f"<p>{TEXT}" * 4
    want = "\n".join([TEXT] * 4)
    assert extract(f"<body><div class='{name}'><article>{inner}</article>{PARTS}</div></body>") == want
    assert extract(f"<body><div class='{name}'>{inner}</div>{PARTS}</body>") == want
    assert extract(f"<body><div id='{name}'><div class='{name}'>{inner}</div>{PARTS}</div></body>") == want


def test_entry_header_keeps_its_title():
    page = f"<body><div class=site-header>Site</div><article><div class=entry-header><h1>Title</h1></div><p>{TEXT}</article></body>"
    assert extract(page) == f"Title\n{TEXT}"
