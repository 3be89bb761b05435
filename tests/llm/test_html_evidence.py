"""What counts as evidence that a passage is boilerplate."""

import random
import time

import pytest

from quarryline.llm import htmltext

from .brute_html import clean, zones_of

LONG = " ".join(f"w{i}" for i in range(30))


@pytest.fixture
def kept(spark):
    def by_spark(*pages):
        rows = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
        got = [x["text"].split("\n") for x in sorted(htmltext.main_text(rows).collect())]
        assert got == clean([htmltext.blocks_of(p) for p in pages])
        return got

    return by_spark


def test_mirrored_pages_keep_their_text(kept):
    page = f"<div>{LONG}</div><div>more</div>"
    assert kept(page, page, "<p>other") == [[LONG, "more"]] * 2 + [["other"]]


def test_marked_copies_do_not_remove_an_article(kept):
    assert kept(f"<article><p>{LONG}</article>", f"<div class=related>{LONG}</div><p>own") == [[LONG], ["own"]]


def test_boilerplate_still_goes(kept):
    assert kept(f"<p>{LONG}<p>a", f"<p>{LONG}<p>b", f"<div class=related>{LONG}</div><p>own") == [["a"], ["b"], ["own"]]
    assert kept(f"<article><p>{LONG}<p>x</article>", f"<p>{LONG}<p>b") == [["x"], ["b"]]


def test_teasers_and_class_names(kept):
    assert kept(f"<div><p>{LONG}</div><article>teaser</article>") == [[LONG, "teaser"]]
    assert kept("<div class='no-sidebar'><p>whole page text</p></div>") == [["whole page text"]]
    boxes = "<div class='share-price-box'>price</div><section class=related-work>work</section>"
    assert kept(f"<article><p>x</p>{boxes}<div class='related-posts'>no</div><ul id='comment-list'><li>no</ul></article>") == [["x", "price", "work"]]
    assert kept("<div class='page sidebar'><p>all there is</p></div>") == [["all there is"]]
    assert kept("<div class='siteFooter'>no</div><div class='entry-header'><h1>T</h1></div><div class='post-comments'>no</div><p>x") == [["T", "x"]]


@pytest.mark.parametrize("page", ["<b>" * 80_000 + "</i>" * 80_000, "<svg>" * 200_000, "<p><div>" + "<b>" * 80_000 + "<p></p>" * 80_000, "<div>" * 90_000 + "x" + "</span>" * 80_000, "<a '>" * 200_000, "<td><p>" * 80_000 + "x"])
def test_time_is_in_proportion(page):
    took = []
    for part in (8, 1):
        text = page[: len(page) // part]
        began = time.process_time()
        htmltext.blocks_of(text)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_a_host_whose_repeats_decide(spark):
    """No element and no class name says what is boilerplate; only the array can."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    menu, notice = (" ".join(word() for _ in range(n)) for n in (40, 60))
    own = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(30)]
    pages = [f"<html><body><div>{menu}</div><div><p>{text}</p><p>read on</p></div><div>{notice} {i}</div></body></html>" for i, text in enumerate(own)]
    rows = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = [r["text"].split("\n") for r in htmltext.main_text(rows).orderBy("page_id").collect()]
    assert got == clean([zones_of(p) for p in pages]) == [[text, str(i)] for i, text in enumerate(own)]


def test_blocks_by_another_parser():
    rng = random.Random(9)

    def node(depth):
        if depth > 4 or rng.random() < 0.35:
            return f" t{rng.randrange(99)} &amp; <b>x</b>"
        tag = rng.choice(["div", "section", "article", "nav", "ul", "aside", "h2", "blockquote", "form"])
        name = rng.choice(["", "", "", " class='ad'", " class=related", " id=\"comments\"", " class='content'"])
        return f"<{tag}{name}>" + "".join(node(depth + 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    seen = 0
    for _ in range(400):
        page = "<html><body>" + "".join(node(0) for _ in range(3)) + "</body></html>"
        want = zones_of(page)
        if any(z != 2 for z, _ in want):  # else other rules hold
            assert htmltext.blocks_of(page) == want
            seen += 1
    assert seen > 200
