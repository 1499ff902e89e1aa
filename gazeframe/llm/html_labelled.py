"""Labelled pages of many shapes, made by rule: each page is a list of (markup, whether its text belongs to the article)."""

from __future__ import annotations

import random

_WORDS = "the river ran high that spring and the people of the valley moved their boats to the upper meadow before the rain came back in April".split()

#: How pages mark what is no article: names of classes, ids and roles. Fixed values.
PART_MARKS = (
    "ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar side nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar search share sharing social related recommended comment comments respond disqus replies reply pagination pager widget copyright disclaimer complementary contentinfo"
).split()
#: The same in other languages. Fixed values.
PART_MARKS += "werbung anzeige teaser kommentar kommentare fusszeile kopfzeile seitenleiste navigationsleiste hinweis suche verwandte publicite annonce commentaire commentaires pied recherche publicidad anuncio comentario comentarios pie busqueda relacionados pubblicita commento commenti".split()
#: How pages mark what readers say and what else there is to read. Fixed values.
READER_MARKS = "comment comments commentlist discussion respond replies reply reactions reviews kommentare commentaires comentarios related sidebar newsletter teaser".split()
#: How pages mark the article and what holds it. Fixed values.
ARTICLE_MARKS = "article content post entry story main body text page prose markdown hentry single wrapper container column layout row site".split()
#: Words that turn a mark of a part into a property of what holds the article. Fixed values.
TURNS = "has with no without enabled disabled hide show is".split()
_PART_TAGS = "nav aside footer header form menu dialog button select".split()


def _prose(r: random.Random, n: int) -> str:
    at = r.randrange(len(_WORDS))
    return " ".join(_WORDS[(at + i) % len(_WORDS)] for i in range(n)).capitalize() + "."


def _links(r: random.Random, n: int) -> str:
    kind = r.randrange(3)
    links = [f'<a href="/{i}">{_prose(r, r.randrange(1, 4))}</a>' for i in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind else " ".join(links)


def _attribute(r: random.Random, words: list[str]) -> str:
    return f' {r.choice(["class", "id", "class", "role"])}="{r.choice("-_ ").join(words)}"' if words else ""


def _part(r: random.Random, inside: bool) -> str:
    """What is no article: by its tag, by its mark, or (outside of the article only) by neither."""
    inner = r.choice([_links(r, r.randrange(3, 9)), _prose(r, r.randrange(3, 16)), f"<p>{_prose(r, r.randrange(4, 40))}</p>", f"<h3>{_prose(r, 2)}</h3>{_links(r, 4)}", f"<p>{_prose(r, 20)}</p>" * r.randrange(1, 5)])
    if r.random() < 0.4:
        tag = r.choice(_PART_TAGS if not inside else [t for t in _PART_TAGS if t != "header"])
        return f"<{tag}>{inner}</{tag}>"
    if r.random() < 0.9 or inside:
        words = [r.choice(PART_MARKS)]
        words = r.choice([words, words, [r.choice(["top", "left", "box", "inner", "list", "site", "post", "reader", "user"]), *words], [*words, r.choice(["box", "inner", "list", "wrap", "bar"])]])
        tag = r.choice(["div", "div", "section", "ul" if "<ul>" not in inner else "div", "span" if "<" not in inner else "div"])
        return f"<{tag}{_attribute(r, words)}>{inner}</{tag}>"
    return f"<div>{r.choice([_links(r, 6), _prose(r, r.randrange(1, 5)), '&copy; ' + _prose(r, 4)])}</div>"


def _block(r: random.Random) -> str:
    """One block of an article; its own class may hold any word."""
    kind, own = r.random(), ""
    if r.random() < 0.15:
        own = _attribute(r, [r.choice(["entry", "post", "article", "page"]), r.choice(PART_MARKS)] if r.random() < 0.6 else [r.choice(PART_MARKS)])
    if kind < 0.09:
        return f"<h{r.randrange(1, 5)}{own}>{_prose(r, r.randrange(2, 10))}</h{1}>"
    if kind < 0.2:
        return (list_tag := r.choice(["ul", "ul", "ol"])) and f"<{list_tag}>" + "".join(f"<li>{_prose(r, r.randrange(4, 25))}</li>" for _ in range(r.randrange(2, 7))) + f"</{list_tag}>"
    if kind < 0.25:
        return f"<blockquote>{_prose(r, r.randrange(8, 40))}</blockquote>"
    if kind < 0.33:
        return f"<p{own}><a href='/x'>{_prose(r, r.randrange(2, 9))}</a></p>"
    if kind < 0.45:
        return f"<p{own}>{_prose(r, r.randrange(5, 20))} <a href='/x'>{_prose(r, 4)}</a> {_prose(r, r.randrange(1, 20))}</p>"
    if kind < 0.55:
        tag = r.choice(["div", "div", "section", "figure", "td"])
        inner = "".join(f"<p>{_prose(r, r.randrange(3, 50))}</p>" for _ in range(r.randrange(1, 4)))
        return f"<table><tr><td>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{own}>{inner}</{tag}>"
    if kind < 0.6:
        return f"<header><h1>{_prose(r, 7)}</h1></header>"
    if kind < 0.7:
        inline = r.choice("b i em strong span code small q mark u sup".split())
        return f"<p{own}><{inline}>{_prose(r, r.randrange(2, 40))}</{inline}>{r.choice(['<br>', '<img src=a.gif>', ' '])}{_prose(r, r.randrange(2, 20))}</p>"
    return f"<p{own}>{_prose(r, r.randrange(2, 90))}</p>"


def _page(r: random.Random) -> list[tuple[str, bool]]:
    bare = r.random() < 0.3
    out = [] if bare else [("<html><head><meta charset='utf-8'><title>News</title></head>", False)]
    holders = []
    for tag in [*(() if bare else ("body",)), *r.choices(["div", "div", "section", "table><tr><td"], k=r.randrange(0, 3)), r.choice(["article", "main", "div", "div", "section"])]:
        words = [] if r.random() < 0.3 else [r.choice(ARTICLE_MARKS)]
        if r.random() < 0.35:
            turned = [r.choice(TURNS), r.choice(PART_MARKS)] if r.random() < 0.6 else [r.choice(PART_MARKS), r.choice(TURNS[4:])]
            words = [r.choice("-_").join([*words, *turned])]
        holders.append(f"<{tag}{_attribute(r, words)}>")
    for i, holder in enumerate(holders):
        out.append((holder, False))
        if i + 1 < len(holders):
            out += [(_part(r, False), False) for _ in range(r.randrange(0, 4))]
    for _ in range(r.randrange(3, 14)):
        plain = r.random() < 0.08 and holders[-1].startswith("<div")
        out.append((_prose(r, r.randrange(20, 80)) + "<br><br>" if plain else _block(r), True))
        if r.random() < 0.15:
            out.append((_part(r, True), False))
    if r.random() < 0.4:  # what readers say, and what else there is to read, stands in the article's own holder
        kinds = READER_MARKS if r.random() < 0.6 else PART_MARKS
        tag, inner = r.choice(["div", "div", "section"]), "".join(f"<p>{_prose(r, r.randrange(4, 60))}</p>" for _ in range(r.randrange(1, 5)))
        mark = r.choice([[r.choice(kinds)], [r.choice(["post", "reader", "user", "site"]), r.choice(kinds)], [r.choice(kinds), r.choice(["list", "box", "wrap", "section", "area"])]])
        inner = r.choice([inner] * 6 + [f"<h3>{_prose(r, 2)}</h3>{inner}", f"<ul><li>{inner}</li></ul>"])
        out.append((f"<{tag}{_attribute(r, mark)}>{inner}</{tag}>", False))
    for i, holder in enumerate(reversed(holders)):
        tag = holder[1:].split(" ")[0].rstrip(">")
        out.append(("</td></tr></table>" if tag.startswith("table") else f"</{tag}>", False))
        if i + 1 < len(holders):
            out += [(_part(r, False), False) for _ in range(r.randrange(0, 4))]
    if r.random() < 0.08:  # some sites put the whole page into one form
        first = 0 if bare else 1
        out = [*out[:first], (f"<form{_attribute(r, r.choice([[], ['page'], ['main']]))} method=post action='/'>", False), *out[first:], ("</form>", False)]
    return out


def pages(n: int = 500, seed: int = 7) -> list[list[tuple[str, bool]]]:
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]
