import random
import re
import time
from collections import Counter

import pytest

from gazeframe.llm.html import best_run, extract_pages, learned_weights, main_text
from gazeframe.llm.html_labelled import pages as labelled_pages

ARTICLE = "<h1>A title of the page</h1><p>First words &amp; more of the long text\n  here.<br><p>Second part of the article goes on for a while.</p>"
WANT = "A title of the page\nFirst words & more of the long text here.\nSecond part of the article goes on for a while."


def test_weights_have_their_signs():
    weights = learned_weights()
    assert weights["tag p"] > 0 > weights["tag nav"] and weights["mark content"] > 0 > weights["mark sidebar"]
    assert all(w < 0 for k, w in weights.items() if k[:1] == "<")


def test_the_scan_finds_the_largest_sum():
    r = random.Random(1)
    for _ in range(2000):
        scores = [r.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randrange(0, 25))]
        spans = [(sum(scores[i:j]), i, j) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
        i, j = best_run(scores)
        assert sum(scores[i:j]) == max(s for s, _, _ in spans)


TWO = "<p>The committee met on Tuesday and discussed the new bridge.</p><p>Members agreed that the work should begin before the autumn.</p>"
TWO_WANT = "The committee met on Tuesday and discussed the new bridge.\nMembers agreed that the work should begin before the autumn."


@pytest.mark.parametrize(
    ("page", "more"),
    [
        ("<div class='content has-sidebar'>{}</div>", ""),
        ("<div class='layout-no-nav'>{}</div>", ""),
        ("<div class='social-share-enabled'>{}</div>", ""),
        ("<body class='page with-header'><nav><a href=1>Home</a></nav><section>{}</section><div class='site-footer'>Words of the footer</div></body>", ""),
        ("<article>{}<p class='notice'>A last word on the matter.</p></article>", "\nA last word on the matter."),
        ("<article>{}<h2 class='section-header'>Next steps</h2></article>", "\nNext steps"),
        ("<article>{}<p><a href='x'>Read the full report of the committee here</a></p></article>", "\nRead the full report of the committee here"),
        ("<article>{}<p title=don't>Some text that stays.</p></article>", "\nSome text that stays."),
        ("{}<div>Copyright 2024 Example</div>", ""),
        ("<nav>Menu<article>{}</article>", ""),
        ("<div class='box newsletter'><p>Sign up here for more words each week and never miss one.</p></div>{}<div class='reader-comments'><p>I think so too and say it at length.</p><p>So do I.</p></div>", ""),
    ],
)
def test_marks_are_weighed(page, more):
    assert main_text(page.format(TWO)) == TWO_WANT + more


OTHER = "<p>I think so too and say it here at some length for all.</p>"


@pytest.mark.parametrize("holder", ["<main>{}</main>", "<article>{}</article>", "<div class='content'>{}</div>"])
@pytest.mark.parametrize(
    "part",
    ["<section id='comments'>{}</section>", "<div class='comments'>{}</div>", "<ul class='comments'><li>{}</li></ul>", "<div class='sidebar'>{}</div>", "<section class='related-posts'>{}</section>", "<section class='newsletter'>{}</section>", "<div class='ad'>{}</div>", "<div class='werbung'>{}</div>", "<div id='kommentare'>{}</div>", "<aside>{}</aside>"],
)
def test_parts_within_the_article_go(holder, part):
    for inner in (OTHER, OTHER * 3):
        assert main_text(holder.format(TWO + part.format(inner))) == TWO_WANT
        assert main_text(holder.format(part.format(inner) + TWO)) == TWO_WANT
        assert main_text(holder.format(TWO) + part.format(inner)) == TWO_WANT


@pytest.mark.parametrize(
    "page",
    ["<form action=x><div id=main>{}</div></form>", "<form><article>{}</article></form>", "<form>{}", "<body><form id=whole><div class=nav><a href=x>Home</a></div><div class=content>{}</div><div class=footer>Foot words</div></form></body>", "<article>{}<form><p>Send us a word</p><input></form></article>"],
)
def test_a_form_around_the_page_is_no_form(page):
    assert main_text(page.format(TWO)) == TWO_WANT
    assert main_text("<form><label>Your name</label><input><label>Your password here</label></form>") == ""


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='content'>{}</div>", "<section class=page>{}</section>", "<table><tr><td>{}</table>"])
@pytest.mark.parametrize("tag", ["ul", "ol"])
def test_lists_of_the_article_stay(holder, tag):
    page = TWO + f"<{tag}><li>The first point of the meeting was long.</li><li>Second</li></{tag}>" + TWO
    assert main_text(holder.format(page)) == f"{TWO_WANT}\nThe first point of the meeting was long.\nSecond\n{TWO_WANT}"


def test_words_of_unseen_pages_are_told_apart():
    """Precision and recall of words over labelled pages that the fit has not seen."""
    hits = given = wanted = 0
    for page in labelled_pages(150, seed=99):
        want = Counter(w for m, is_in in page if is_in for w in re.findall(r"\w+", re.sub(r"<[^>]*>", " ", m)))
        got = Counter(re.findall(r"\w+", main_text("".join(m for m, _ in page))))
        hits, given, wanted = hits + sum((want & got).values()), given + sum(got.values()), wanted + sum(want.values())
    assert hits > 0.97 * given and hits > 0.97 * wanted


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("<html><head><title>x y z</title><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href=/>Home page</a></ul></nav><article>", "</article><footer>&copy; words of the footer</footer></body></html>"),
        ("<body><header>Site name and words</header><div class='cookie-banner'>We use many cookies here</div><main>", "</main><aside>Side words in a row</aside><div id=comments><p>Reader says nothing useful at all</p></div>"),
        ("<div><a href=1>One</a> <a href=2>Two</a></div><div class=\"ad\">Buy this thing now</div><article>", "<form><label>Your mail</label><input></form></article>"),
        ("<!-- <p>hidden words</p> --><article>", ""),
    ],
)
def test_only_the_article_stays(before, after):
    assert main_text(before + ARTICLE + after) == WANT


def test_adverts_inside_are_left_out():
    page = "<article><p>Some text before the advert stands.</p><div class='ad'>Buy now cheap things</div><p>Some text after the advert stands.</p></article>"
    assert main_text(page) == "Some text before the advert stands.\nSome text after the advert stands."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<br><p></p>", ""), ("<article><p>cut off in a t", "cut off in a t"), ("<article><p>words then a tag <a hre", "words then a tag"), ("plain text alone", "plain text alone"), ("<article><p>a &am", "a &am"), ("<p>3 < 4 and 5 > 4 hold</p>", "3 < 4 and 5 > 4 hold")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_and_nested_pages_are_linear():
    assert main_text("<article>" + "<p>word here</p>" * 50_000).count("\n") == 49_999
    assert main_text("<div>" * 30_000 + "text in the deep" + "</div>" * 30_000) == "text in the deep"
    for page in ("<div>" * 40_000 + "</p>x" * 40_000, "<nav>" + "<article>x" * 40_000 + "</nav>", "<b>x" * 40_000, "<form><p>x" * 40_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 8
    assert main_text("<nav>" * 5000 + "<article>" * 5000 + "w") is not None


def test_table(spark):
    page = "<article>" + ARTICLE
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = extract_pages(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out) == [(0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (2, "", 0)]
    assert extract_pages(df.limit(0)).count() == 0
