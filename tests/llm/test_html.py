"""The extraction of main texts against a plain version, and pages that class names, forms and missing articles make difficult."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from profusion.llm import html_extraction as H


def slow_text(html):
    """The text from the parser's lines: smoothing, threshold, shares and region by loops."""
    page = H.Lines()
    page.feed(html or "")
    page.close()
    page._end_line()

    def up(e):
        return {e} | (up(page.parent[e]) if e else set())

    ratio = [len(t) / max(1, n) for t, n, _ in page.lines]
    good = [True] * len(ratio)
    if len(ratio) >= 3:
        weigh = [[math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2) if abs(i - j) <= math.ceil(3 * H.SIGMA) else 0 for j in range(len(ratio))] for i in range(len(ratio))]
        smooth = [sum(w * r for w, r in zip(row, ratio, strict=True)) / sum(row) for row in weigh]
        low, high = min(smooth), max(smooth)
        while high - low > 1e-9 * high:
            good = [s >= (low + high) / 2 for s in smooth]
            new = np.mean([s for s, g in zip(smooth, good, strict=True) if not g]), np.mean([s for s, g in zip(smooth, good, strict=True) if g])
            if np.allclose(new, (low, high), rtol=0, atol=1e-12):
                break
            low, high = new
    lines = [(t, e, g) for (t, _, e), g in zip(page.lines, good, strict=True)]
    held = lambda e: sum(len(t) for t, at, g in lines if g and e in up(at))
    gone = {e for e in page.marked if held(e) < H.MARKED_SHARE * held(0) or not held(e)}
    lines = [x for x in lines if not up(x[1]) & gone]
    if not lines:
        return ""
    best = max([e for e in page.holders if held(e) >= H.REGION_SHARE * held(0)], default=0)
    around = [e for e in sorted(up(best)) if e in page.articles]
    best = around[-1] if around else best
    return "\n".join(t for t, at, _ in lines if best in up(at))


WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak".split()


def _page(draw, deep=0):
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    parts = []
    for _ in range(draw.randint(1, 5)):
        kind = draw.choice(["p", "p", "p", "links", "div", "section", "form", "article", "marked", "ad", "header", "list", "table"])
        if kind == "p":
            parts.append(f"<p>{prose(draw.randint(1, 40))}{draw.choice(['', '<b>' + prose(3) + '</b>', '<br>x'])}</p>")
        elif kind == "links":
            parts.append("<ul>" + "".join(f"<li><a href='#'>{prose(2)}</a></li>" for _ in range(draw.randint(2, 9))) + "</ul>")
        elif kind == "table":
            parts.append(f"<table><tr><td>{prose(3)}<td>{prose(2)}</table>")
        elif kind == "list":
            parts.append(f"<ol><li>{prose(9)}<li>{prose(8)}</ol>")
        elif deep < 3:
            name = {"marked": f" class='{draw.choice(['no-sidebar', 'has-menu', 'comment-list', 'topic-social', 'ad-slot'])}'", "ad": " class='x ad'"}.get(kind, "")
            tag = "div" if kind in ("marked", "ad") else kind
            parts.append(f"<{tag}{name}>{_page(draw, deep + 1)}</{tag}>")
    return "".join(parts)


def test_equals_the_slow_version():
    draw = random.Random(10)
    pages = [_page(draw) for _ in range(400)] + [None, "", "<p>", "text", "<div class=ad>x</div>", "<form></form>", "<article></article><p>y"]
    texts = [H.extract_text(h) for h in pages]
    assert texts == [slow_text(h) for h in pages] and len(set(texts)) > 300


@pytest.mark.parametrize("wrapper", ["<div id=page class='no-sidebar'>", "<div class='layout has-sidebar'>", "<div class='site full-width-footer'>", "<div class='topic-social'>", "<div class='chess-promotion'>", "<form action='/'>", "<div role='form'>"])
def test_a_wrapper_is_not_an_unwanted_part(wrapper):
    close = "</form>" if wrapper.startswith("<form") else "</div>"
    html = f"<body><nav>menu</nav>{wrapper}<p>{'The first paragraph of the page. ' * 4}</p><p>Short.</p><input value=x><p>{'And the last one of it here. ' * 4}</p>{close}<footer>foot</footer></body>"
    assert H.extract_text(html) == f"{('The first paragraph of the page. ' * 4).strip()}\nShort.\n{('And the last one of it here. ' * 4).strip()}"


def test_unwanted_parts_go_whatever_they_hold():
    article = "<article><p>A short text.</p></article>"
    long = "<p>" + "Many words of an advert stand here. " * 9 + "</p>"
    for part in (f"<div class='ad'>{long}</div>", f"<div id='comments'>{long}</div>", f"<aside>{long}</aside>", f"<div role='navigation'>{long}</div>", f"<div hidden>{long}</div>"):
        assert H.extract_text(f"<body>{part}{article}{part}</body>") == "A short text."
    small = "<p>Ad words.</p>"
    for part in (f"<div class='ad-slot'>{small}</div>", f"<form><p>{'Sign'} up</p><input></form>", f"<div class='comment-list'>{small}</div>"):
        assert H.extract_text(f"<body><main>{long}{part}{long}</main></body>").count("\n") == 1


def test_articles_and_what_stands_beside_them():
    one, two = ("The first article has words enough to count here.", "The second article has as many words, not fewer.")
    assert H.extract_text(f"<body><article><p>{one}</p></article><article><p>{two}</p></article><nav>m</nav></body>") == f"{one}\n{two}"
    assert H.extract_text(f"<body><div><p>{one}</p><article><p>{two}</p></article><p>{one}</p></div></body>") == f"{one}\n{two}\n{one}"


def test_the_ratio_chooses_the_region(monkeypatch):
    """Pages without articles or marks: only the ratio of text to tags parts lists of links from the text."""
    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    changed = 0
    for _ in range(40):
        links = lambda: "".join(f"<li><a href='#'>{prose(3)}</a> <a href='#'>{prose(2)}</a></li>" for _ in range(draw.randint(8, 16)))
        text = [prose(draw.randint(25, 60)) for _ in range(draw.randint(4, 8))]
        html = f"<body><div class='x1'><ul>{links()}</ul></div><div class='x2'>{''.join(f'<p>{t}</p>' for t in text)}</div><div class='x3'><ul>{links()}</ul></div></body>"
        assert H.extract_text(html) == "\n".join(text)
        with monkeypatch.context() as m:
            m.setattr(H, "content_lines", lambda ratio: np.ones(len(ratio), bool))
            changed += H.extract_text(html) != "\n".join(text)
    assert changed == 40


def test_very_long_and_deep_pages():
    deep = "<div>" * 3000 + "<p>" + "word " * 50_000 + "</p>" + "</div>" * 3000
    assert len(H.extract_text(deep)) == 5 * 50_000 - 1
    assert len(H.extract_text("<p>line of some words</p>" * 20_000).split("\n")) == 20_000
