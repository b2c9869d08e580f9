"""Tags, marks and alignment of pages: against exhaustive matching, on very long, deep and broken pages."""

import random
import resource
import time
from functools import cache

import pytest

from ensemblar.llm import html_dom
from ensemblar.llm.html_dom import Page, align
from ensemblar.llm.html_extract import page_text


def best(a, b):
    """The largest weight of a matching that keeps order and parents, by trying all."""

    @cache
    def node(x, y):
        if a.label[x] != b.label[y]:
            return 0
        if a.text[x] is not None:
            return 3 if a.text[x] == b.text[y] else 1
        return 1 + lists(tuple(a.children[x]), tuple(b.children[y]))

    @cache
    def lists(xs, ys):
        if not xs or not ys:
            return 0
        w = node(xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), w + lists(xs[1:], ys[1:]) if w else 0)

    return node(0, 0)


def weight(a, b, pairs):
    kept = sorted((x, y) for y, x in pairs.items())
    assert len({x for x, _ in kept}) == len(kept) and all(y1 < y2 for (_, y1), (_, y2) in zip(kept, kept[1:]))
    assert all(pairs[b.parent[y]] == a.parent[x] for x, y in kept if y)
    assert all(a.label[x] == b.label[y] for x, y in kept)
    return sum(1 if a.text[x] is None else 3 if a.text[x] == b.text[y] else 1 for x, y in kept)


def tree(r, depth=4, wide=4):
    out = []
    for _ in range(r.randint(0, wide)):
        if depth == 0 or r.random() < 0.35:
            out.append(f"<p>{r.choice('abcd')}</p>")
        else:
            tag = r.choice(["div", "section"])
            out.append(f"<{tag}>{tree(r, depth - 1, wide)}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("small", [True, False])
def test_align_is_an_exhaustive_matching(monkeypatch, small):
    if not small:
        monkeypatch.setattr(html_dom, "ALL_PAIRS", 0)
        monkeypatch.setattr(html_dom, "SHARED_PAIRS", 2)
    r = random.Random(1)
    for _ in range(400):
        a, b = Page(tree(r)), Page(tree(r))
        assert weight(a, b, align(a, b)) == best(a, b)
    for _ in range(20):  # wide lists
        a, b = Page("".join(tree(r, 1, 3) for _ in range(9))), Page("".join(tree(r, 1, 3) for _ in range(9)))
        assert weight(a, b, align(a, b)) == best(a, b)


def test_many_kinds_of_siblings_still_match_in_order(monkeypatch):
    monkeypatch.setattr(html_dom, "ALL_PAIRS", 0)
    monkeypatch.setattr(html_dom, "KIND_PAIRS", 1)
    r = random.Random(2)
    for _ in range(50):
        a, b = Page(tree(r)), Page(tree(r))
        assert weight(a, b, align(a, b)) <= best(a, b)


def test_pages_of_twenty_thousand_paragraphs():
    page = lambda k: "<body><div>" + "".join(f"<p>text {i} of {k}</p>" if i % 50 else f"<p>the same {i}</p>" for i in range(20_000)) + "</div></body>"
    a, b = Page(page(1)), Page(page(2))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.thread_time()
    pairs = align(a, b)
    assert len(pairs) == len(a.label) and all(x == y for y, x in pairs.items())
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    assert time.thread_time() - began < 30


def test_broken_tags_take_linear_time():
    began = time.thread_time()
    for source in ("<a " * 100_000, '<a "' * 100_000, "<a '\"" * 50_000 + ">", "<" * 100_000, "<!-- " * 100_000, "<a b='" * 50_000 + '"' * 50_000, "</" * 100_000):
        Page(source)
    assert time.thread_time() - began < 10


def test_trees_of_any_depth():
    a, b = Page("<div>" * 5000 + "x"), Page("<div>" * 5000 + "y")
    assert len(align(a, b)) == 5002
    a, b = (Page("<div><p>k</p>" * 2000 + z) for z in "xy")
    assert len(align(a, b)) == len(a.label)


@pytest.mark.parametrize("source, want", [
    ('<article><section id="related-work"><p>On other work.</p></section><p>End.</p></article>', "On other work. End."),
    ('<article><div class="related-posts"><p>More posts</p></div><p>Text of the article.</p></article>', "Text of the article."),
    ('<article><p title="the hidden truth">Seen.</p></article>', "Seen."),
    ("<article><p hidden>Not seen.</p><p>Seen by all readers.</p></article>", "Seen by all readers."),
    ('<body><p><a href="x">a rather long link text</a> ok</p></body>', "a rather long link text ok"),
    ('<body><div><a href="x">Home</a> <a href="y">News</a></div><p>Text of the page.</p></body>', "Text of the page."),
    ('<article><p data-x="a > b" class="lead">One</p><p class=\'search-results note\'>Two</p></article>', "One Two"),
    ("<article><p>1 < 2 and 3 <4</p><p>5 > 4</p></article>", "1 < 2 and 3 <4 5 > 4"),
])
def test_marks_and_text(source, want):
    assert page_text(source) == want
