"""Main text of web pages as the maximum-scoring run of words and tags.

A page is one sequence of words and tags. Each word scores by where it stands: a sum of learned weights of the tags and
the marks (words of class, id and role) of the elements around it, of the size of its block and of its being a link.
Tags score negative. The weights come from labelled pages of many shapes: logistic regression for words, log odds for
tags. One linear scan finds the contiguous run with the largest sum. Words that the elements around them speak against,
and whose block doesn't outweigh that, score negative; those in the run (an advert between two paragraphs, say) are no content, as the tags are none, and are
not given out. All other words score positive, a short block or a link only less.

No mark takes anything out by itself: ``class='content has-sidebar'`` around an article adds weights of both signs.
Only elements whose content is no text (scripts, styles and the like) are skipped. Text of the run is cut into blocks
at block-level tags, character references are decoded, and white space inside a block becomes one space.

Defined cases: null and empty pages give an empty text, and so do pages without words; unclosed elements end with
the page (an unclosed menu, advert or form ends where an article or main part begins); a page cut off inside a tag
loses the broken tag only; a form that holds most of the page's paragraphs (words outside of links)
is no form but a holder of the page, any other form's words go;
a quote inside a tag counts only where a value begins; pages of any length are read whole;
repeated rows are extracted each by itself; an empty table
gives an empty result; other columns, whatever their names, are not read. A part whose name no labelled page has and
whose shape is that of the article (a class such as ``box2`` with paragraphs in it) stays.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .html_labelled import TURNS
from .html_labelled import pages as labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+(?:>|\Z)|<(?:/[A-Za-z]?[^>]*)?\Z|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
FORM, END = re.compile(r"<form\b", re.I), re.compile(r"</([A-Za-z][^\s/>]*)")
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

#: Elements whose content is no text at all; they end at their own end tag only.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold a line or a paragraph; a mark on one says less than a mark on what holds many.
LINES = frozenset("h1 h2 h3 h4 h5 h6 p a b i em strong time figure img blockquote".split())
#: Elements that hold anything, and so say nothing.
PLAIN = frozenset("html body div span section table tbody tr td center font".split())
#: The score of a word of which nothing else is known; all that is learned is added to it.
PLAIN_WORD = 1.0
#: Elements that an article may begin in, and those that a following one of their kind ends.
ARTICLES, ENDED = frozenset(("article", "main")), frozenset("p li dt dd tr td th option".split())


def page_forms(page: str) -> set[int]:
    """Where the forms begin that hold the article: most of the page's words outside of links stand in their paragraphs."""
    forms: list[list[int]] = []  # start, words in paragraphs at its start, at its end
    words = prose = links = paragraphs = 0
    raw, is_open = "", False
    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            if not raw and not links:
                n = len(token.split())
                words += n
                prose += n if paragraphs else 0
            continue
        named = NAME.match(token)
        if not named:
            continue
        name, closing = named[1].lower(), token[1] == "/"
        if raw:
            raw = "" if closing and name == raw else raw
        elif name in RAW:
            raw = "" if closing or token.endswith("/>") else name
        elif name == "a":
            links = int(not closing)
        elif name in ("p", "article", "main"):
            paragraphs = max(0, paragraphs - 1) if closing else paragraphs + 1 if name != "p" else max(1, paragraphs)
        elif name == "form":
            if is_open:
                forms[-1][2] = prose
            if not closing:
                forms.append([m.start(), prose, -1])
            is_open = not closing
    return {at for at, first, last in forms if 2 * ((prose if last < 0 else last) - first) > words}


def features(name: str, tag: str, within: bool, around: bool = False) -> tuple[str, ...]:
    """What an element says about the words in it. ``within``: it stands in an article or main part; ``around``: it holds the page."""
    out = [] if name in PLAIN else [f"tag {name}" + (" within" if within and name == "header" else " around" if around else "")]
    if "=" in tag:
        kind = "line " if name in LINES else "mark "
        for value in MARKS.findall(tag):
            for one in value.lower().split():
                words = re.findall(r"[a-z]+", one)
                if any(w in TURNS for w in words):
                    out.append("turned mark")  # has-sidebar is said of what holds the article
                else:
                    out += [kind + w for w in words]
        if name != "html" and HIDDEN.search(tag):
            out.append("hidden")
    return tuple(out)


def block_features(n: int, linked: int, holder: str) -> tuple[str, ...]:
    """What the size of a block, its share of linked words and the element that it stands in say."""
    size = next(s for s in (3, 10, 25, 10**9) if n <= s)
    share = "all" if linked == n else "most" if 2 * linked > n else "some" if linked else "no"
    return (f"size {size}", f"links {share} in {holder if holder in ('p', 'li', 'td') else 'other'}")


def walk(page: str, evidence, nothing):
    """(kind, text, evidence of the elements around, evidence of the block, place) in page order: kind is "<name" for a tag, else the block of the text.

    ``evidence`` turns features into something that can be added up (a weight, or the features themselves, to learn
    from); ``nothing`` is its zero.
    """
    out: list = []
    stack: list[tuple] = []  # name, evidence of this element and all around it, whether its own is negative, its features, the nearest block's name
    links, within, raw, block = 0, 0, "", 0
    forms = page_forms(page) if FORM.search(page) else ()
    last_end = {m[1].lower(): m.start() for m in END.finditer(page)}
    opened: Counter = Counter()  # names of the stack
    negative: list[int] = []  # places in the stack of elements that speak against their words
    around = lambda: stack[-1][1] if stack else nothing
    sizes: dict[int, list] = {}
    said: Counter = Counter()  # a feature counts once, however many elements around a word have it

    def pop() -> str:
        nonlocal links, within
        name, _, against, found, _ = stack.pop()
        if against:
            negative.pop()
        opened[name] -= 1
        said.subtract(found)
        links -= name == "a"
        within -= name in ARTICLES
        return name

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            if not raw:
                n = len(token.split())
                size = sizes.setdefault(block, [0, 0, stack[-1][4] if stack else ""])
                size[0] += n
                size[1] += n if links else 0
                out.append((block, token, around(), m.start()))
            continue
        named = NAME.match(token)
        if not named:
            continue
        name, closing = named[1].lower(), token[1] == "/"
        if raw:
            if closing and name == raw:
                raw = ""
            continue
        out.append(("<" + name, "", nothing, m.start()))
        block += name in BLOCKS
        if closing:
            if opened[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in VOID or token.endswith("/>"):
            continue
        if name in RAW:
            raw = name
            continue
        if name == "body":
            while stack:
                pop()
        if name in ARTICLES:
            # An article ends whatever unclosed part stood before it, but for a part that is closed behind it.
            while negative and last_end.get(stack[negative[0]][0], -1) < m.end():
                part = negative[0]
                while len(stack) > part:
                    pop()
        if name in ENDED and stack and stack[-1][0] == name:
            pop()
        found = features(name, token, within > 0, m.start() in forms)
        own = evidence(found)
        against = isinstance(own, float) and own < 0
        if against:
            negative.append(len(stack))
        stack.append((name, around() + evidence(tuple(f for f in found if said[f] <= 0)), against, found, name if name in BLOCKS else stack[-1][4] if stack else ""))
        opened[name] += 1
        said.update(found)
        links += name == "a"
        within += name in ARTICLES
    more = {b: evidence(block_features(n, linked, holder)) for b, (n, linked, holder) in sizes.items() if n}
    return [(kind, text, e, more.get(kind, nothing), at) for kind, text, e, at in out]


@cache
def learned_weights() -> dict[str, float]:
    """Weights of features and of tags ("<name") from the labelled pages."""
    rows, inside, words = [], [], []
    tags_in, tags_out = Counter(), Counter()
    for page in labelled_pages():
        starts = np.cumsum([0, *(len(markup) for markup, _ in page)]).tolist()
        for kind, text, around, own, at in walk("".join(markup for markup, _ in page), lambda f: f, ()):
            is_in = page[bisect.bisect_right(starts, at) - 1][1]
            if kind.__class__ is int:
                if n := len(text.split()):
                    rows.append(around + own)
                    inside.append(is_in)
                    words.append(min(n, 12))
            else:
                (tags_in if is_in else tags_out)[kind] += 1
    names = sorted({f for r in rows for f in r})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for f in r:
            x[i, place[f]] += 1.0
    y, share = np.array(inside, float), np.array(words, float)
    w, hold = np.zeros(len(names)), 0.1
    for _ in range(12):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w + PLAIN_WORD, -30, 30)))
        slope = x.T @ (share * (y - p)) - hold * w
        w = w + np.linalg.solve((x.T * (share * p * (1 - p) + 1e-9)) @ x + hold * np.eye(len(names)), slope)
    out = dict(zip(names, w.tolist(), strict=True))
    n_in, n_out = sum(tags_in.values()), sum(tags_out.values())
    for kind in {*tags_in, *tags_out}:
        out[kind] = min(-0.01, float(np.log((tags_in[kind] + 0.5) / (n_in + 1)) - np.log((tags_out[kind] + 0.5) / (n_out + 1))))
    out["<"] = float(np.quantile([v for k, v in out.items() if k[:1] == "<"], 0.75))  # of a tag that no page has
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, in one pass; empty if no sum is positive."""
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_from, best_to = total, start, i + 1
    return best_from, best_to


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The blocks of the best-scoring run, joined by line ends."""
    if not page:
        return ""
    weights = weights or learned_weights()
    of = weights.get
    known: dict[tuple, float] = {}

    def evidence(found: tuple[str, ...]) -> float:
        got = known.get(found)
        if got is None:
            got = known[found] = float(sum(of(f, 0.0) for f in found))
        return got

    run, other, bias = walk(page, evidence, 0.0), weights["<"], PLAIN_WORD
    each = []
    for kind, text, around, own, _ in run:
        if kind.__class__ is int:
            stands, all_in_all = around + max(own, 0.0) + bias, around + own + bias
            # Bounded on both sides: neither a few words in a very plain place nor a long advert outweigh a page.
            each.append(len(text.split()) * (max(0.5, min(4.0, all_in_all)) if stands > 0 else -0.1))
        else:
            each.append(of(kind, other))
    first, last = best_run(each)
    blocks, now = [], []
    for kind, text, around, own, _ in run[first:last]:
        if kind.__class__ is int:
            if around + max(own, 0.0) + bias > 0:
                now.append(text)
        elif kind[1:] in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif kind == "<br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(x for b in blocks if (x := " ".join(entities.unescape(b).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. One pass, no shuffle."""
    bounded_batches(pages.sparkSession)
    weights = learned_weights()  # some hundred numbers

    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
