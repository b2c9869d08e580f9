"""Siblings of many kinds are aligned as well as those of few."""

import random

from ensemblar.llm import html_dom
from ensemblar.llm.html_dom import Page, align

from test_html_trees import best, tree, weight


def test_the_number_of_kinds_changes_no_matching(monkeypatch):
    monkeypatch.setattr(html_dom, "ALL_PAIRS", 0)
    monkeypatch.setattr(html_dom, "KIND_PAIRS", 1)
    monkeypatch.setattr(html_dom, "MEMO", 1, raising=False)
    r = random.Random(2)
    for _ in range(100):
        a, b = Page(tree(r)), Page(tree(r))
        assert weight(a, b, align(a, b)) == best(a, b)


def test_two_hundred_kinds_of_siblings():
    # the second page lacks the first half: labels alone match all of it with the wrong ones
    part = lambda k: "<section>" + "".join("<div><p>q</p></div>" if k >> i & 1 else "<p>q</p>" for i in range(8)) + "</section>"
    a, b = Page("<p>x</p>" + "".join(part(k) for k in range(200)) + "<p>y</p>"), Page("<p>z</p>" + "".join(part(k) for k in range(100, 200)) + "<p>w</p>")
    pairs = align(a, b)
    assert sum(a.same[x] == b.same[y] for y, x in pairs.items() if len(b.children[y]) == 8) == 100
