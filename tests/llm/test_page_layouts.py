"""Recall and precision of the main text over labelled layouts: K marks blocks of the article, D what is not of it."""

from __future__ import annotations

import re

import pytest

from swathkit.llm import html_extract

PROSE = "words of a sentence that goes on for a while, and on, so that it is prose. " * 3


def k(n, tag="p"):
    return f"<{tag}>K{n} {PROSE}</{tag}>"


def d(n, tag="p"):
    return f"<{tag}>D{n} {PROSE}</{tag}>"


LINKS = "".join(f"<li><a href=/x{i}>D{90 + i} a linked title of some length</a></li>" for i in range(6))
SECTION = "<article>{a}<section class='{c}'>{b}</section>{e}</article>"

LAYOUTS = {
    **{c: [SECTION.format(c=c, a=k(1) + k(2), b=k(3) + k(4), e=k(5))] for c in (
        "social-history", "search-engines", "related-work", "rail-transport", "notice-board", "cookie-recipe", "menu-planning", "banner-years", "login-problem", "alert-systems", "discussion-of-results", "share-prices")},
    "reply by id": [f"<article>{k(1)}{k(2)}<section id='reply-of-the-author'>{k(3)}</section></article>"],
    "sections of a div": [f"<div class=story>{k(1)}{k(2)}<div class='social-history'>{k(3)}</div>{k(4)}</div>"],
    "plain article": [f"<nav><ul>{LINKS}</ul></nav><article><h1>K0 head</h1>{k(1)}{k(2)}</article><footer>{d(1)}</footer>"],
    "sidebar": [f"<div class='layout has-sidebar'><div class=content>{k(1)}{k(2)}{k(3)}</div><div class=sidebar>{d(1)}</div></div>"],
    "sidebar and article": [f"<div class=wrap><article>{k(1)}{k(2)}</article><div id=sidebar-right>{d(1)}{d(2)}</div></div>"],
    "share bar inside": [f"<article>{k(1)}<div class='social-share'><ul>{LINKS}</ul></div>{k(2)}</article>"],
    "related posts inside": [f"<article>{k(1)}{k(2)}<div class='related-posts'><ul>{LINKS}</ul></div></article>"],
    "newsletter form inside": [f"<article>{k(1)}<div class=newsletter>{d(1)}<input name=mail><button>go</button></div>{k(2)}{k(3)}</article>"],
    "form": [f"<article>{k(1)}{k(2)}</article><form><label>D1 your name</label><input></form>"],
    "comments below": [f"<div class=post>{k(1)}{k(2)}{k(3)}</div><div id=comments><div class=c>{d(1)}</div><div class=c>{d(2)}</div></div>"],
    "comments inside": [f"<article>{k(1)}{k(2)}{k(3)}<ol class=comment-list><li><div class=x>{d(1)}</div></li><li><div class=x>{d(2)}</div></li></ol></article>"],
    "long comments": [f"<main><article>{k(1)}{k(2)}</article><section id=comments>{''.join(f'<article>{d(i)}</article>' for i in range(7))}</section></main>"],
    "aside": [f"<article>{k(1)}<aside>{d(1)}</aside>{k(2)}</article>"],
    "hidden": [f"<article>{k(1)}<div style='display: none'>{d(1)}</div>{k(2)}</article>"],
    "whole page in a form": [f"<form id=aspnetForm><div>{k(1)}{k(2)}</div><input></form>"],
    "roles": [f"<div role=banner>{d(1)}</div><div role=main>{k(1)}{k(2)}</div><div role=contentinfo>{d(2)}</div>"],
    "tables": [f"<table><tr><td class=menu><ul>{LINKS}</ul></td><td>{k(1)}{k(2)}</td></tr></table>"],
    "definition list": [f"<article>{k(1)}<dl><dt>K2 term</dt>{k(3, 'dd')}</dl><blockquote>{k(4)}</blockquote></article>"],
    "cookie notice": [f"<div class=cookie-banner>{d(1)}</div><main>{k(1)}{k(2)}{k(3)}</main>"],
    "advert before": [f"<div class=ad>{d(1)}</div><article>{k(1)}{k(2)}</article>"],
    "entry header": [f"<article><header class=entry-header><h1>K0 head</h1></header>{k(1)}{k(2)}</article>"],
    "script and style": [f"<article><style>D1</style>{k(1)}<script>var D2 = '</p>'</script>{k(2)}</article>"],
    # pages of one host: what recurs is cut, what belongs to one article stays
    "adverts of a host": [f"<article>{k(1)}<div class=ad>{d(i)} number {i}</div>{k(2)}<p>page {i}</p></article>" for i in range(5)],
    "notice of a host": [f"<article>{k(1)}<section class='notice-to-all'><p>D1 {PROSE}</p></section>{k(2)}<p>page {i}</p></article>" for i in range(5)],
    "one marked section": [f"<article>{k(1)}<section class='{c}'>{k(3)} only {i}</section>{k(2)}<p>page {i}</p></article>" for i, c in enumerate(["x", "social-history", "y", "z", "v"])],
    "copies of a page": [f"<article>{k(1)}<section class='social-history'>{k(3)}</section>{k(2)}</article>"] * 6,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"http://h{h}.example/{i}", page, name) for h, (name, pages) in enumerate(LAYOUTS.items()) for i, page in enumerate(pages, 1000 * h)]
    texts = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, layout string")).collect()}
    return [(name, page, texts[i]) for i, _, page, name in rows]


def labels(text):
    return re.findall(r"\b[KD]\d+\b", text)


def test_recall_and_precision(found):
    assert len(LAYOUTS) >= 30
    want = got = right = 0
    lost = []
    for name, page, text in found:
        article, taken = {x for x in labels(page) if x[0] == "K"}, set(labels(text))
        want, got, right = want + len(article), got + len(taken), right + len(article & taken)
        if taken != article:
            lost.append((name, sorted(article - taken), sorted(taken - article)))
    assert right / want >= 0.98 and right / got >= 0.98, lost


@pytest.mark.parametrize("name", [c for c in LAYOUTS if "-" in c and " " not in c] + ["reply by id", "sections of a div", "one marked section", "copies of a page"])
def test_sections_of_an_article_stay(found, name):
    for own, page, text in found:
        if own == name:
            assert {x for x in labels(page) if x[0] == "K"} == set(labels(text))
