"""What stands in frames of all kinds goes, what articles share stays."""

from __future__ import annotations

import pytest

from spatialfactor.llm import html_extract


def text(body: str) -> list[str]:
    return html_extract.content(html_extract.blocks(f"<html><body>{body}</body></html>"))


ARTICLE = "<p>One long line of the article, which holds most of the text of this page.</p><p>Another one of its lines.</p>"
LINES = ["One long line of the article, which holds most of the text of this page.", "Another one of its lines."]


@pytest.mark.parametrize(
    ("inner", "line"),
    [
        ("Body <button>Share</button> more", "Body more"),
        ("Body<label>Name</label>, more", "Body, more"),
        ('Body <span class="ad">Buy <b>now</b></span> more', "Body more"),
        ('<span class="share-buttons">Like</span>Body more', "Body more"),
        ('Body <span class="x">in <i>one</i></span> line', "Body in one line"),
        ('Body <span class="ad">Buy<div>now</div>here</span> more', "Body"),
    ],
)
def test_inline_frames_leave_the_line_around_them(inner, line):
    got = text(f"<article>{ARTICLE}<p>{inner}</p></article>")
    assert got[:2] == LINES and got[2] == line and not any("Buy" in x or "Share" in x or "Name" in x for x in got)


@pytest.mark.parametrize("name", ["article-ad", "ad-slot", "sponsored-content", "share-buttons", "user-comments", "post-comments", "site-header", "related-posts-list", "main-menu", "comments"])
def test_names_of_frames(name):
    assert text(f"<article>{ARTICLE}<div class='{name}'>Not of the article</div></article>") == LINES
    assert text(f"<article>{ARTICLE}<div id='x' class='y {name}'>Not of the article</div></article>") == LINES


@pytest.mark.parametrize("name", ["article-header", "post-body", "ad-free-article", "has-comments", "no-sidebar", "entry-title", "content", "adapter", "shared"])
def test_names_of_the_article(name):
    assert text(f"<article><div class='{name}'>Of the article</div>{ARTICLE}</article>") == ["Of the article", *LINES]


def test_remarks_of_readers_are_no_articles():
    assert text(f"<article>{ARTICLE}</article><article class='comment'>I agree</article><article id='reply-5'>Me too</article>") == LINES
    assert text(f"<article class='post has-comments'>{ARTICLE}</article>") == LINES


def test_articles_keep_what_two_share_and_lose_what_three_do():
    page = lambda own, *more: [(own, True, False), *[(m, True, False) for m in more]]
    mine = page("a line that only this article has, and long", "shared sentence", "site line")
    near = [("/b", ["other article, long enough", "shared sentence", "site line"]), ("/c", ["third article, long enough", "site line"])]
    kept, shared = html_extract.main_lines(mine, "/a", near)
    assert kept == ["a line that only this article has, and long", "shared sentence"] and shared == 2
    assert html_extract.main_lines(mine, "/a", near[:1])[0] == [x for x, _, _ in mine]
    # outside a main part one neighbour is enough
    plain = [(x, False, False) for x, _, _ in mine]
    assert html_extract.main_lines(plain, "/a", near[:1])[0] == ["a line that only this article has, and long"]


def test_rows_of_one_id_and_url_give_the_same_text_in_any_layout(spark):
    head = "<html><body><nav>menu</nav>"
    rows = [(1, f"http://h.example.net/{i // 2:05d}", f"{head}<p>frame line</p><p>own text {i} of the page {'abc'[i % 3] * (i % 5)}</p></body></html>") for i in range(1400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    first = sorted(map(tuple, html_extract.extract_main_text(pages.repartition(3)).collect()))
    assert first == sorted(map(tuple, html_extract.extract_main_text(pages.repartition(7, "html")).collect()))
    assert len(first) == 1400 and not any("frame line" in r[2] or "menu" in r[2] for r in first)
