"""Main text of pages: the layouts that chose wrongly before, path ratios by hand, and the given pages another way."""

from __future__ import annotations

import os
import re
import time
from collections import defaultdict
from html import unescape

import numpy as np
import pytest

from skein.llm import html_text, queries

DATA = "/root/testdata/sf0.001"
ONE = "Long text, with commas, and more of it to read, all the way down."
TWO = "And a second, as long as that one was, in the end, it says."
BOTH = f"{ONE}\n\n{TWO}"
MENU = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"

LAYOUTS = {
    "head not closed": (f"<html><head><title>x</title><body><p>{ONE}</p><p>{TWO}</p>", BOTH),
    "sibling articles": (f"<body><article><h1>A</h1><p>{ONE}</p></article><article><p>{TWO}</p></article>", f"A\n\n{BOTH}"),
    "inline share link, related work": (f"<body><article><p>{ONE} <a class='share' href=x>Share</a></p><section id='related-work'><h2>Related work</h2><p>{TWO}</p></section><div class='search-algorithms'>BFS.</div></article>", f"{ONE}\n\nRelated work\n\n{TWO}\n\nBFS."),
    "header of the article": (f"<body><header><a href=/>Site</a></header><div class=post><header><h1>Title</h1></header><p>{ONE}</p><p>{TWO}</p></div><footer>x</footer>", f"Title\n\n{BOTH}"),
    "menu and rights beside": (f"<body>{MENU}<div><p>{ONE}</p><p>{TWO}</p></div><p>© 2020 Corp, all rights reserved.</p>", BOTH),
    "all in the body": (f"<body>{MENU}<h1>T</h1><p>{ONE}</p><ul><li>item</li></ul><p>{TWO}</p><p>© 2020 Corp, all rights reserved.</p>", f"T\n\n{ONE}\n\nitem\n\n{TWO}"),
    "title beside the text": (f"<body><div id=w><h1>Title</h1><div class=body><p>{ONE}</p><p>{TWO}</p></div></div>", f"Title\n\n{BOTH}"),
    "table and sidebar": (f"<body><div id=w><div class=header>Site</div><div class=content><h2>Head</h2><p>{ONE}</p><table><tr><td>1<td>2</table><p>{TWO}</p></div><div class=sidebar><p>{ONE}</p></div></div>", f"Head\n\n{ONE}\n\n1\n\n2\n\n{TWO}"),
    "comments longer than the article": (f"<body><main><article><h1>T</h1><p>{ONE}</p></article><section id=comments><article><p>{TWO * 8}</p></article></section></main>", f"T\n\n{ONE}"),
    "items and cells that aren't closed": (f"<article><p>{ONE}<ul><li><p>a<li>b</ul><dl><dt>c<dd>d</dl></article>", f"{ONE}\n\na\n\nb\n\nc\n\nd"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    html, text = LAYOUTS[name]
    assert html_text.main_text(html) == text


def test_other_ratios_give_another_text():
    one, two = f"<div class=one><p>{ONE}</p><p>{ONE}</p></div>", f"<div class=two><p>{TWO}</p><p>{TWO}</p></div>"
    page = f"<body>{one}{two}</body>"
    only = lambda name: lambda found: np.array([float(f"div.{name}" in str(b.element.path)) for b in found])
    assert html_text.main_text(page, only("one")) == f"{ONE}\n\n{ONE}" and html_text.main_text(page, only("two")) == f"{TWO}\n\n{TWO}"
    ad = f"<body><div class=ad>Buy.</div><article><p>{ONE}</p></article></body>"
    assert html_text.main_text(ad) == ONE and html_text.main_text(ad, only("ad")) == "Buy."


def test_path_ratios_by_hand():
    html = f"<body>{MENU}<div class=c><h2>Head</h2><p>{ONE}</p><p>{TWO} <a href=x>linked</a></p><ul><li>a, b</ul></div><p>end</p></body>"
    found = html_text.blocks(html)
    length, marks, count, every = (defaultdict(float) for _ in range(4))
    for b in found:
        path = str(b.element.path)
        length[path] += len(b.text) - b.linked
        marks[path] += sum(c in ".,;:!?" for c in b.text)
        count[path] += 1
        every[path] += len(b.text)
    expected = []
    for i, b in enumerate(found):
        sums = [0.0, 0.0, 0.0]
        for j in range(max(0, i - 2), min(len(found), i + 3)):
            p, q = str(b.element.path).split("/"), str(found[j].element.path).split("/")
            w = np.exp(-((i - j) ** 2) / 2) * len(os.path.commonprefix([p, q])) / max(len(p), len(q))
            other = str(found[j].element.path)
            sums = [sums[0] + w * length[other] / count[other], sums[1] + w * marks[other] / count[other], sums[2] + w]
        own = str(b.element.path)
        expected.append(length[own] / every[own] * np.sqrt(sums[0] / sums[2] * (1 + sums[1] / sums[2])))
    assert html_text.path_ratios(found) == pytest.approx(expected)


def test_very_long_page():
    paragraphs = [f"{ONE} {i}" for i in range(20_000)]
    text = html_text.main_text(f"<body><nav>{MENU}</nav><div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>")
    assert text == "\n\n".join(paragraphs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_given_pages_another_way(spark):
    """The given pages have one article each, of paragraphs and headings only."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = queries.queries()["op8_html_text"](spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


P1, P2, P3 = f"<p>{ONE}</p>", f"<p>{TWO}</p>", f"<p>{ONE} {TWO}</p>"
TEXT = f"{ONE}\n\n{TWO}\n\n{ONE} {TWO}"
LINKS = "".join(f"<li><a href=/{i}>Story number {i}</a></li>" for i in range(6))
#: Pages without an article and without words that mark anything: only what their paths hold tells them apart.
PLAIN_LAYOUTS = {
    "menu of divs": f"<body><div class=m1>{''.join(f'<div class=x><a href={i}>Part {i}</a></div>' for i in range(9))}</div><div class=m2>{P1}{P2}{P3}</div></body>",
    "lists on both sides": f"<body><ul class=u1>{LINKS}</ul><div>{P1}{P2}{P3}</div><ul class=u2>{LINKS}</ul></body>",
    "cells": f"<body><table><tr><td class=l><ul>{LINKS}</ul></td><td class=c>{P1}{P2}{P3}</td><td class=r><ul>{LINKS}</ul></td></tr></table></body>",
    "links in a line": f"<body><div class=top><a href=1>Home</a> <a href=2>World</a> <a href=3>Sport</a></div><div class=c>{P1}{P2}{P3}</div><div class=end><a href=4>Help</a> <a href=5>Jobs</a></div></body>",
    "short labels": f"<body><div class=a1><span>Log in</span></div><div class=a2><a href=1>Sign up</a></div><div class=c>{P1}{P2}{P3}</div></body>",
    "deep": f"<body><div><div><ul>{LINKS}</ul></div><div><div><div>{P1}{P2}{P3}</div></div></div></div></body>",
    "sections": f"<body><section class=s1><ul>{LINKS}</ul></section><section class=s2>{P1}{P2}{P3}</section><section class=s3><ul>{LINKS}</ul></section></body>",
    "list under the text": f"<body><div class=c>{P1}{P2}{P3}<ul>{LINKS}</ul></div></body>",
    "list over the text": f"<body><div class=c><ul>{LINKS}</ul>{P1}{P2}{P3}</div></body>",
    "headed list under the text": f"<body><div class=c>{P1}{P2}{P3}<h3>More stories</h3><ul>{LINKS}</ul></div></body>",
    "definition menus": f"<body><dl>{''.join(f'<dt><a href={i}>Term {i}</a><dd><a href={i}>See {i}</a>' for i in range(5))}</dl><div>{P1}{P2}{P3}</div></body>",
    "rights": f"<body><div class=c>{P1}{P2}{P3}</div><div class=z>© 2020 A company</div></body>",
}


@pytest.mark.parametrize("name", PLAIN_LAYOUTS)
def test_layouts_told_apart_by_paths_alone(name):
    assert html_text.main_text(PLAIN_LAYOUTS[name]) == TEXT


def test_ratios_decide():
    same = sum(html_text.main_text(html, lambda found: np.ones(len(found))) == TEXT for html in PLAIN_LAYOUTS.values())
    turned = sum(html_text.main_text(html, lambda found: -html_text.path_ratios(found)) == TEXT for html in PLAIN_LAYOUTS.values())
    assert same < len(PLAIN_LAYOUTS) / 2 and turned < len(PLAIN_LAYOUTS) / 2


@pytest.mark.parametrize("names", ["class='post-comments'", "class='discussion'", "id=comments", "class='reader-responses'", "class='comment-thread'", "class='article_feedback'", ""])
def test_comments_go(names):
    said = f"<h2>3 comments</h2><div><p>I disagree, strongly, with it.</p></div><div><p>{ONE} So it is!</p></div>"
    for page in (f"<body><article>{P1}{P2}{P3}<section {names}>{said}</section></article></body>", f"<body><div class=c>{P1}{P2}{P3}<section {names}>{said}</section></div></body>"):
        assert html_text.main_text(page) == TEXT
    for head in ("Comments", "Leave a comment", "Comments (12)", "12 responses", "Kommentare"):
        assert html_text.main_text(f"<body><article>{P1}{P2}{P3}<h3>{head}</h3><p>I disagree, strongly, with it.</p></article></body>") == TEXT
    assert html_text.main_text(f"<body><article>{P1}<h2>Comments on the law</h2>{P2}</article></body>") == f"{ONE}\n\nComments on the law\n\n{TWO}"


def test_quotes_in_tags():
    page = "<article><p>One two three, four.</p><p title=don't>Second isn't lost, is it?</p><p>Third para.</p></article>"
    assert html_text.main_text(page) == "One two three, four.\n\nSecond isn't lost, is it?\n\nThird para."
    assert html_text.main_text(f'<body><p title="x>Broken, that is.</p>{P1}</body>') == f"Broken, that is.\n\n{ONE}"
    assert html_text.main_text(f'<body><p title="x>Broken, that is. <a href="y">It goes on, too.</a></p>{P1}</body>') == f"Broken, that is. It goes on, too.\n\n{ONE}"
    assert html_text.main_text(f"""<body><p title="a > b" data-x='<p>'>Whole, as it was.</p>{P1}</body>""") == f"Whole, as it was.\n\n{ONE}"


@pytest.mark.parametrize("inner", ["", "text, here. ", "<p>text, here.</p>", "<div class=ad>x</div>"])
def test_time_is_linear_in_depth(inner):
    def timed(n):
        page = "<body>" + f"<div>{inner}" * n + P1 + "</div>" * n
        began = time.perf_counter()
        assert html_text.main_text(page).endswith(ONE)
        return time.perf_counter() - began

    timed(500)
    assert timed(8_000) < 3.0 * timed(4_000) + 0.3
