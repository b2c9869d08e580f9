"""A small block-level view of web pages, and simple tree matching of two of them."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import numpy as np

# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label map mark picture q ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head map menu nav object select svg video".split())
CONTENT = frozenset("article main".split())
CONTAINERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Our choice: words of class, id and role that hint at what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies dialog discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices "
    "pagination paywall popup promo promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADER_WORDS = frozenset("header masthead".split())
# Elements that some sites put around the whole page, and names that alone mean what others wrote.
WRAPPING = frozenset("fieldset form".split())
OTHERS_WORDS = frozenset("ad ads comment comments promo related reply".split())
# How an element is marked: by a part of a name, by a whole name, by what it is.
FREE, HINTED, NAMED, DROP = range(4)

# Our choice: words that say nothing of their own beside a hint, so that all of a name hints.
PLAIN_WORDS = frozenset("area article articles bar block body bottom box btn button center col column container content div entry form global group head header heading icon inner item items label left link links list main module outer page panel post posts primary right row secondary section section site small sticky stories story text title top user users wrap wrapper".split())
# Elements of running text: a leaf there goes as a menu only if all of it is a link.
RUNNING = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_MARKS = frozenset("class id role itemprop aria-label hidden".split())
_WORDS = re.compile(r"[a-z]+")
_NONE: frozenset[str] = frozenset()


class Tags:
    """Where the tags of a source end, in time linear in it.

    A quote hides what is inside it; a quote that nothing closes, or no ``>`` to the end, means that there is no tag.
    What follows from a quote is found once, and so is what follows from a place outside quotes.
    """

    def __init__(self, source: str):
        self.source, self.known, self.at = source, {}, -1

    def _special(self, at: int) -> int:
        if not (self.at >= at and self.began <= at):
            m = _SPECIAL.search(self.source, at)
            self.began, self.at = at, m.start() if m else len(self.source)
        return self.at

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose inside goes on at a place, -1 if none does."""
        path = []
        now = self._special(at)
        while now < len(self.source) and self.source[now] != ">":
            if now in self.known:
                now = self.known[now]
                break
            path.append(now)
            close = self.source.find(self.source[now], now + 1)
            m = _SPECIAL.search(self.source, close + 1) if close >= 0 else None
            now = m.start() if m else len(self.source)
        for x in path:
            self.known[x] = now
        return now if now < len(self.source) else -1


class Page:
    """Nodes in page order: label, text (of leaves), children, marks; and which leaves are in an article."""

    def __init__(self, source: str):
        self.label, self.text, self.children = ["#root"], [None], [[]]
        self.content, self.mark, self.linked, self.parent = [False], [FREE], [0], [0]
        self._read(source)

    def _add(self, parent: int, label: str, text: str | None, content: bool, mark: int, linked: int = 0) -> int:
        k = len(self.label)
        for x, v in zip((self.label, self.text, self.children, self.content, self.mark, self.linked, self.parent), (label, text, [], content, mark, linked, parent), strict=True):
            x.append(v)
        self.children[parent].append(k)
        return k

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]
        buffer: list[str] = []
        link = linked = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                top = stack[-1][1]
                self._add(top, "#text", text, self.content[top], FREE, linked)
            buffer.clear()
            linked = 0

        def close(name: str, until: tuple[str, ...] = ()) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    return
                if stack[k][0] in until:
                    return

        def take(piece: str) -> None:
            nonlocal linked
            buffer.append(piece)
            if link:
                linked += len(piece)

        size, tags, last = len(source), Tags(source), source.rfind(">")
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                take(source[at:])
                break
            if begin > at:
                take(source[at:begin])
            if source.startswith(("<!", "<?"), begin):
                end = source.find("-->", begin + 4) + 3 if source.startswith("<!--", begin) else source.find(">", begin + 2) + 1
                at = end if end > begin + 2 else size
                continue
            m = _NAME.match(source, begin + 1)
            end = -1
            if m and m.end() <= last:
                end = source.find(">", m.end())
                inside = source[m.end() : end]
                # as a rule all quotes before the first > are pairs
                if "'" in inside or inside.count('"') % 2:
                    end = tags.end(m.end())
                    inside = source[m.end() : end]
            if end < 0:
                take("<")
                at = begin + 1
                continue
            at = end + 1
            name = m[2].lower()
            if m[1]:
                if name == "a":
                    link = max(0, link - 1)
                if name not in INLINE or any(x == name for x, _ in stack):
                    flush()
                    close(name)
                continue
            if name in RAW and not inside.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            marks, words, hints = {}, _NONE, _NONE
            if inside and inside != "/":
                for k, x, y, z in _ATTRIBUTE.findall(inside):
                    k = k.lower()
                    if k in _MARKS:
                        marks.setdefault(k, x or y or z)
            if marks:
                named = f"{marks.get('class', '')} {marks.get('id', '')} {marks.get('role', '')}".lower()
                words = frozenset(_WORDS.findall(named))
                hints = words & ASIDE_WORDS
            if hints and self.content[stack[-1][1]]:
                # in an article a hint has to be all that a name says: related-posts, not related-work
                hints = frozenset().union(*(w for w in (frozenset(_WORDS.findall(x)) for x in named.split()) if w & ASIDE_WORDS and w <= ASIDE_WORDS | PLAIN_WORDS))
            marked = bool(hints) or "hidden" in marks
            if name == "br" or name == "hr":
                take("\n") if name == "br" else flush()
                continue
            if name == "a":
                link += 1
            if name in VOID or (name in INLINE and not marked):
                continue
            flush()
            if stack[-1][0] == "p":
                stack.pop()
            for x in CLOSES.get(name, ()):
                close(x, CONTAINERS[name])
            if name in ("html", "body", "#root"):
                marked = False
            top = stack[-1][1]
            content = self.content[top] or name in CONTENT or "main" in words & {"main"} and marks.get("role") == "main" or marks.get("itemprop") == "articleBody"
            heading = name == "header" or bool(words & HEADER_WORDS)
            mark = FREE
            if (name in DROPPED and name not in WRAPPING) or (name == "header" and not self.content[top]):
                mark = DROP
            elif marked and OTHERS_WORDS & set(f"{marks.get('class', '')} {marks.get('id', '')}".lower().split()):
                mark = NAMED
            elif name in WRAPPING or (marked and (name not in CONTENT or words & OTHERS_WORDS)) or (heading and not self.content[top]):
                mark = HINTED
            node = self._add(top, f"{name}.{marks.get('class', '')}", None, content, mark)
            stack.append((name, node))
        flush()

    def leaves(self) -> list[int]:
        return [k for k, t in enumerate(self.text) if t is not None]

    def _sums(self, weight: list[int]) -> list[int]:
        """The weight of each node's subtree."""
        out = list(weight)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def _under(self, marked: list[bool]) -> list[bool]:
        out = list(marked)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def _hard(self) -> list[bool]:
        """Nodes under elements that are never the article, or under a whole name of what others wrote, if that leaves anything."""
        size = [0 if t is None else len(t) for t in self.text]
        shut = self._under([m >= NAMED for m in self.mark])
        if not any(w for k, w in enumerate(size) if not shut[k]):
            shut = self._under([m == DROP for m in self.mark])
            held = self._sums([0 if shut[k] else w for k, w in enumerate(size)])
            shut = self._under([m == DROP or (m == NAMED and 2 * held[k] <= held[0]) for k, m in enumerate(self.mark)])
        return shut

    def _aside(self, constant: frozenset[int]) -> list[bool]:
        """Nodes under a mark.  A hint does not count on a subtree with most of the varying text of the largest article, or of a page without one."""
        n, shut = len(self.label), self._hard()
        size = [0 if t is None or shut[k] else len(t) - min(len(t), self.linked[k]) for k, t in enumerate(self.text)]
        varying = [0 if k in constant else w for k, w in enumerate(size)]
        whole, sums = self._sums(size), self._sums(varying)
        roots = [k for k in range(1, n) if self.text[k] is None and self.content[k] and not self.content[self.parent[k]] and whole[k]]
        root = max(roots, key=lambda k: (sums[k], whole[k], -k), default=0)
        inside = self._under([k == root for k in range(n)])
        within = self._sums([w if inside[k] else 0 for k, w in enumerate(varying)])
        return self._under([shut[k] or (m == HINTED and 2 * within[k] <= sums[root]) for k, m in enumerate(self.mark)])

    def main_leaves(self, constant: frozenset[int] = frozenset()) -> list[int]:
        """Leaves of the article that are not constant; without an article, leaves of the page that are not mostly links."""
        aside = self._aside(constant)
        free = [k for k in self.leaves() if not aside[k]]
        inside = [k for k in free if self.content[k]] or [k for k in free if 2 * self.linked[k] <= len(self.text[k]) or (self.linked[k] < len(self.text[k]) and self.label[self.parent[k]].split(".")[0] in RUNNING)]
        return [k for k in inside if k not in constant]

    def own_leaves(self) -> list[int]:
        """What tells a page from a copy: its article; without one, all leaves that may be content."""
        main = self.main_leaves()
        if any(self.content[k] for k in main):
            return main
        shut = self._hard()
        return [k for k in self.leaves() if not shut[k]]


#: Pairs of siblings whose weights are all worked out; beyond, siblings of one kind share a weight.  Weights of pairs of
#: kinds, and of nodes, that are kept: further ones are worked out again.
ALL_PAIRS, KIND_PAIRS, MEMO = 400, 1 << 20, 1 << 18
#: A text shared by so many pairs of siblings counts as part of their kinds.
SHARED_PAIRS = 64


class Alignment:
    """Simple tree matching of two pages: the largest matching that keeps order and parents.

    Nodes match if their labels are equal; equal texts weigh more, so that what a template repeats is matched to
    itself.  Equal subtrees are told by hashes and match as they are; equal ends of two lists of siblings come off
    before a table is made.  A long table is made row by row in numpy, with two bits a cell for the way back: siblings
    of one kind (the same but for texts) have one weight, but for pairs that share a text, which are worked out.
    Trees of any depth are matched.
    """

    def __init__(self, a: Page, b: Page):
        self.a, self.b, self.memo = a, b, {}
        for p in (a, b):
            if not hasattr(p, "same"):
                p.same, p.full, p.size = self._subtrees(p)

    @staticmethod
    def _subtrees(p: Page) -> tuple[list[int], list[int], list[int]]:
        """Hash, weight of the match with an equal one, and nodes of each node's subtree."""
        n = len(p.label)
        same, full, size = [0] * n, [1] * n, [1] * n
        for k in range(n - 1, -1, -1):
            if p.text[k] is not None:
                full[k] = 3
            for c in p.children[k]:
                full[k] += full[c]
                size[k] += size[c]
            same[k] = hash((p.label[k], p.text[k], *(same[c] for c in p.children[k])))
        return same, full, size

    def weight(self, x: int, y: int, fixed: frozenset[str] | None = None) -> int:
        """The weight of the matching of two subtrees; fixed: the texts that count as equal if they are (None: all)."""
        a, b = self.a, self.b
        if a.label[x] != b.label[y]:
            return 0
        if a.text[x] is not None:
            return 3 if a.text[x] == b.text[y] and (fixed is None or a.text[x] in fixed) else 1
        if fixed is None and a.same[x] == b.same[y]:
            return a.full[x]
        key = (x, y) if fixed is None else (x, y, fixed)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._siblings(a.children[x], b.children[y], fixed, False)
        return 1 + known[0]

    def _siblings(self, xs: list[int], ys: list[int], fixed: frozenset[str] | None, told: bool) -> tuple[int, list[tuple[int, int]] | None]:
        """The weight of the best matching of two lists of siblings, and its pairs; those of long lists only where they are to be told."""
        a, b = self.a, self.b
        total, out = 0, []
        if fixed is None:
            i, j, m = 0, len(xs), len(ys)
            while i < j and i < m and a.same[xs[i]] == b.same[ys[i]]:
                i += 1
            while j > i and m > i and a.same[xs[j - 1]] == b.same[ys[m - 1]]:
                j -= 1
                m -= 1
            if i or j < len(xs):
                out = [*zip(xs[:i], ys[:i], strict=True), *zip(xs[j:], ys[m:], strict=True)]
                total = sum(a.full[x] for x, _ in out)
                xs, ys = xs[i:j], ys[i:m]
        if not xs or not ys:
            return total, out
        if len(xs) == len(ys) == 1:
            w = self.weight(xs[0], ys[0], fixed)
            return total + w, [*out, (xs[0], ys[0])] if w else out
        if len(xs) * len(ys) > ALL_PAIRS:
            w, pairs = self._large(xs, ys, self._rows(xs, ys, fixed), told)
            return total + w, out + pairs if told else None
        cells = [[self.weight(x, y, fixed) for y in ys] for x in xs]
        n = len(ys)
        above = [0] * (n + 1)
        table = [above]
        for here in cells:
            row, left = [0], 0
            for k in range(n):
                w = here[k]
                if w:
                    w += above[k]
                    if w > left:
                        left = w
                if above[k + 1] > left:
                    left = above[k + 1]
                row.append(left)
            table.append(row)
            above = row
        i, j = len(xs), n
        while i and j:
            w = cells[i - 1][j - 1]
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return total + above[n], out

    def _large(self, xs, ys, rows, told: bool) -> tuple[int, list[tuple[int, int]]]:
        n, ways, pairs = len(ys), [], []
        above = np.zeros(n + 1, np.int32)
        for w in rows:
            met = np.where(w > 0, above[:-1] + w, 0)
            row = np.append(np.int32(0), np.maximum.accumulate(np.maximum(above[1:], met)))
            if told:
                ways.append((np.packbits((w > 0) & (row[1:] == met)), np.packbits(row[1:] == above[1:])))
            above = row
        i, j = len(xs), n
        while told and i and j:
            taken, up = ways[i - 1]
            at, bit = (j - 1) >> 3, 7 - (j - 1) % 8
            if taken[at] >> bit & 1:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
            elif up[at] >> bit & 1:
                i -= 1
            else:
                j -= 1
        return int(above[n]), pairs

    def _rows(self, xs: list[int], ys: list[int], fixed: frozenset[str] | None) -> Iterator[np.ndarray]:
        """For each of xs its weights with all ys: by their kinds, then one by one where two share a text."""
        a, b = self.a, self.b
        holders: list[dict[str, list[int]]] = [{}, {}]
        for p, side, held in ((a, xs, holders[0]), (b, ys, holders[1])):
            for k, x in enumerate(side):
                for t in {p.text[c] for c in range(x, x + p.size[x]) if p.text[c] is not None}:
                    if fixed is None or t in fixed:
                        held.setdefault(t, []).append(k)
        shared = [t for t in holders[0] if t in holders[1]]
        often = frozenset(t for t in shared if len(holders[0][t]) * len(holders[1][t]) > SHARED_PAIRS)
        close: dict[int, set[int]] = {}
        for t in shared:
            if t not in often:
                for k in holders[0][t]:
                    close.setdefault(k, set()).update(holders[1][t])
        kinds: list[dict[int, int]] = [{}, {}]
        of = [np.array([kinds[s].setdefault(self._kind(p, x, often), len(kinds[s])) for x in side]) for s, (p, side) in enumerate(((a, xs), (b, ys)))]
        first = [{}, {}]
        for s, side in enumerate((xs, ys)):
            for k, x in zip(of[s].tolist(), side, strict=True):
                first[s].setdefault(k, x)
        known: dict[int, np.ndarray] = {}
        for k, x in enumerate(xs):
            kind = int(of[0][k])
            if kind not in known:
                if (len(known) + 1) * len(kinds[1]) > KIND_PAIRS:
                    known.clear()
                known[kind] = np.array([self.weight(first[0][kind], first[1][c], often) for c in range(len(kinds[1]))], np.int32)
            row = known[kind][of[1]]
            for j in close.get(k, ()):
                row[j] = self.weight(x, ys[j], fixed)
            yield row

    def _kind(self, p: Page, x: int, often: frozenset[str]) -> int:
        out = {}
        for k in range(x + p.size[x] - 1, x - 1, -1):
            out[k] = hash((p.label[k], p.text[k] if p.text[k] in often else p.text[k] is None, *(out[c] for c in p.children[k])))
        return out[x]

    def pairs(self) -> dict[int, int]:
        """Nodes of b matched to nodes of a."""
        a, b = self.a, self.b
        out, todo = {0: 0}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            if a.same[x] == b.same[y]:
                out.update(zip(range(y, y + b.size[y]), range(x, x + a.size[x]), strict=True))
                continue
            out[y] = x
            if a.text[x] is None:
                known = self.memo.get((x, y))
                todo += known[1] if known and known[1] is not None else self._siblings(a.children[x], b.children[y], None, True)[1]
        return out


def align(a: Page, b: Page) -> dict[int, int]:
    """Nodes of b matched to nodes of a, by simple tree matching."""
    deep = sys.getrecursionlimit()
    # a level of two trees takes four calls; calls of Python functions need no stack of the machine
    sys.setrecursionlimit(max(deep, 1000 + 6 * min(len(a.label), len(b.label))))
    try:
        return Alignment(a, b).pairs()
    finally:
        sys.setrecursionlimit(deep)
