"""Ranked search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ensemblar.llm import lexical_search
from ensemblar.llm.lexical_search import Best, Queries, Signature, best_documents, search_texts, term_pairs
from ensemblar.llm.textnum import Text, as_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def ranking(docs, queries, k=10):
    """docs: (doc_id, text); queries: texts.  The k best (doc_id, score) of each query."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for q in queries:
        scored = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(q) if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out.append([(d, -s) for s, _, _, d in sorted(scored, key=lambda x: x[:3])[:k]])
    return out


def invented(seed, n, words, vocabulary=300):
    r = random.Random(seed)
    v = [f"t{k}" for k in range(vocabulary)]
    return [" ".join(r.choice(v[: r.choice([5, 40, vocabulary])]) for _ in range(r.randint(0, words))) for _ in range(n)]


def got_of(spark, docs, queries, **options):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    q = spark.createDataFrame([(f"q{k:03}", t, 1) for k, t in enumerate(queries)], "item_id string, text string, doc_id int")
    out = {k: [] for k in range(len(queries))}
    for r in sorted(best_documents(d, q, **options).collect(), key=lambda r: (r.item_id, r["rank"])):
        out[int(r.item_id[1:])].append((r.doc_id, r.score))
        assert r["rank"] == len(out[int(r.item_id[1:])])
    return [out[k] for k in range(len(queries))]


def test_against_all_scores(spark, monkeypatch):
    docs = list(enumerate(invented(1, 250, 120) + ["t1 t2"] * 20 + ["t1 " * 900, "", None]))
    queries = invented(2, 25, 30) + ["t1", "t1 t1 T2", "nowhere", "", None, "t299 t298 t1"]
    want = ranking(docs, queries)
    assert got_of(spark, docs, queries) == want
    assert got_of(spark, docs, queries, block_chars=40) == want
    assert got_of(spark, docs, queries, k=3) == [x[:3] for x in want]


def test_odd_rows(spark):
    docs = [(None, "a b c"), (3, "a b c"), (3, "a b c"), (1, "A-b_c"), (2, None), (9, " !! "), (5, "é É ß a"), (7, "x" * 100_000), (8, "long " * 50_000 + "rare")]
    queries = ["a b", "É", "rare long", "x", None]
    assert got_of(spark, docs, queries) == ranking(docs, queries)
    assert got_of(spark, docs[:0] or [(1, None)], queries) == [[]] * 5
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert best_documents(d.filter("false"), q).collect() == []
    assert best_documents(d, q.filter("false")).collect() == []
    twice = best_documents(d, q.union(q)).groupBy("item_id", "rank").count().collect()
    assert {r["count"] for r in twice} == {2}


def test_small_groups_of_cells(monkeypatch):
    texts = invented(5, 80, 60)
    ids, null = np.arange(80), np.zeros(80, bool)
    t = Text(*as_bytes(pa.array(texts)))
    tops = []
    for cells in (1, 50, 1 << 22):
        monkeypatch.setattr(lexical_search, "CELLS", cells)
        q = Queries(list(range(10)), invented(6, 10, 20))
        _, h, _, size = term_pairs(t)
        q.weigh(np.bincount(q.place(h)[1], minlength=len(q.terms)), int((size > 0).sum()), int(size.sum()))
        best = Best(10, 10)
        search_texts(t, ids, null, q, best)
        tops.append((best.score.tolist(), best.doc.tolist()))
    assert tops[0] == tops[1] == tops[2]


def test_signatures_never_miss_a_term():
    doc, h, tf, _ = term_pairs(Text(*as_bytes(pa.array(invented(7, 60, 90)))))
    s = Signature(60, doc, h, tf, int(np.bincount(doc).max()))
    asked = np.unique(h)
    for band, least in enumerate(lexical_search.BANDS):
        held = np.unpackbits(s.holders(asked, band), axis=1, count=60).astype(bool)
        there = tf >= least
        assert held[np.searchsorted(asked, h[there]), doc[there]].all()
        assert held.sum() < there.sum() + 0.02 * held.size


def test_bounds_leave_documents_out():
    r = random.Random(8)
    texts = [" ".join(f"u{r.randrange(4000)}" for _ in range(60)) for _ in range(600)]
    t = Text(*as_bytes(pa.array(texts)))
    q = Queries(list(range(20)), [" ".join(x.split()[:8]) for x in texts[:20]])
    _, h, _, size = term_pairs(t)
    q.weigh(np.bincount(q.place(h)[1], minlength=len(q.terms)), 600, int(size.sum()))
    best = Best(20, 10)
    search_texts(t, np.arange(600), np.zeros(600, bool), q, best)
    assert best.rescored < 0.2 * best.bounded
