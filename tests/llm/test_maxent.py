"""Language-model scores: counts against brute force, probabilities that sum to 1, better held-out scores than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from ensemblar.llm import maxent
from ensemblar.llm.maxent import CLASSES, CLUSTERS, CONTEXT_WORDS, held_out, score, score_texts, tokens, train
from ensemblar.llm.queries import QUERIES
from ensemblar.llm.textnum import Text, as_bytes

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]


def text_of(*texts):
    return Text(*as_bytes(pa.array(texts, pa.string())))


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return train(docs.filter(~held_out()))


def test_base_of_the_whole_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    c = Counter(w for r in rows if not out[r.doc_id] for w in words(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op12_lm_scores"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        w, g = words(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert g.score < 0


def test_held_out_texts_score_better_than_the_base(spark):
    got = QUERIES["op12_lm_scores"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert got[2] / got[0] > got[1] / got[0] + 0.12
    assert got[3] > 0.9


def test_probabilities_sum_to_one(trained):
    """Over all known words, an unknown one of each ending, and the end, after some beginnings."""
    model = trained.model
    v = model.vocabulary
    assert np.abs(model.weight).max() > 0.1
    _, _, rows = model.features(*tokens(text_of("der die und das", "", "the of and", "zzz qqq")))
    p = np.exp(model.classes(rows).astype(np.float64))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    for c in range(CLUSTERS):
        if (v.cls == c).any():
            assert (10 ** v.within[v.cls == c]).sum() == pytest.approx(1)
    counts = trained.counts.collect()
    top = set(v.word.view(np.int64).tolist())
    for b in range(maxent.ENDINGS):
        rest = [r.n for r in counts if r.ending == b and r.word not in top]
        assert sum(rest) + len(rest) + 1 == pytest.approx(10 ** -v.rare_within[b])


def test_score_against_plain_arithmetic(spark, trained):
    """The sum of the features' weights, for each token by itself."""
    model = trained.model
    v = model.vocabulary
    counts = {r.word: r.n for r in trained.counts.collect()}
    texts = ["The of and der die", "", "unheardofword the", "la de que la de que", "x " * 50]
    got = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trained, F.lit(False)).collect()
    for g in got:
        h, ending, first = tokens(text_of(texts[g.doc_id]))
        cls, ctx = [], []
        for x, e in zip(h, ending):
            k = v.place(np.array([x]))[0]
            cls.append(int(v.cls[k]) if k >= 0 else CLUSTERS if e < 0 else CLUSTERS + 1 + int(e))
            ctx.append(int(v.rank[k]) if k >= 0 and v.rank[k] < CONTEXT_WORDS else CONTEXT_WORDS + cls[-1])
        n, total = CONTEXT_WORDS + CLASSES + 1, 0.0
        for i in range(len(h)):
            a, b, c = (ctx[i - k] if i >= k else n - 1 for k in (1, 2, 3))
            x, y, z = (cls[i - k] if i >= k else CLASSES for k in (1, 2, 3))
            size = maxent.ROWS - 3 * n
            three = (1 << 40) + (x * (CLASSES + 1) + y) * (CLASSES + 1) + z
            rows = [a, n + b, 2 * n + c, 3 * n + int(maxent._spread(np.array([a * n + b]))[0]) % size, 3 * n + int(maxent._spread(np.array([three]))[0]) % size]
            logit = v.bias.astype(float) + sum(model.weight[r].astype(float) for r in rows)
            total += (logit[cls[i]] - np.log(np.exp(logit).sum())) / np.log(10)
            if ending[i] >= 0:
                same = [k for k in range(len(v.word)) if v.cls[k] == cls[i]]
                if v.place(h[i : i + 1])[0] >= 0:
                    total += math.log10((counts[int(h[i].astype(np.int64))] + 1) / sum(v.n[k] + 1 for k in same))
                else:
                    total += v.rare_within[ending[i]] + math.log10(counts.get(int(h[i].astype(np.int64)), 0) + 1)
        assert g.score == pytest.approx(total, rel=1e-4)


def test_odd_inputs(spark):
    texts = [None, "", " \n ", "one", "One one ONE", "é É", "a " * 50_000, "b" * 200_000]
    docs = spark.createDataFrame([(k, t, 1.0, 5) for k, t in enumerate(texts)] + [(None, "one two", 1.0, 5), (3, "one", 1.0, 5)], "doc_id long, text string, score double, word int")
    t = train(docs)
    got = score(docs, t, held_out()).collect()
    c = Counter(w for x in [*texts, "one two", "one"] for w in words(x))
    assert len(got) == 10
    for r in got:
        w = words("one two" if r.doc_id is None else texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), len(w), sum(c.values()))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (sum(c.values()) + len(c) + 1)) for x in w))
        assert r.doc_id is not None or r.held_out is False
    assert score(docs.filter("false"), t, held_out()).collect() == []
    none = score(docs, train(docs.filter("false")), held_out()).collect()
    assert all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score <= 0 for r in none)


def test_rare_words_are_joined(spark, monkeypatch):
    """Fewer top words change no count."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = ["doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base")]
    want = sorted(score(docs, train(docs), held_out()).select(columns).collect())
    monkeypatch.setattr(maxent, "TOP_WORDS", 50)
    assert sorted(score(docs, train(docs), held_out()).select(columns).collect()) == want


def test_reruns_agree(spark, trained):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    again = train(docs.filter(~held_out()).repartition(5)).model
    assert np.allclose(again.weight, trained.model.weight, atol=1e-3)


def test_expected_counts_are_sums_of_probabilities():
    r = np.random.default_rng(4)
    text = " ".join(f"w{i}" for i in r.zipf(1.5, 700) % 50)
    t = Text(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    h, ending, first = maxent.tokens(t)
    word, n = np.unique(h[ending >= 0], return_counts=True)
    v = maxent.Vocabulary(word, n, 1, {}, len(h), len(word) + 1)
    v.classify(r.random((len(word), maxent.COMPANY + 1)))
    model = maxent.Model(v)
    model.weight[:] = r.normal(size=model.weight.shape)
    total = np.zeros((2, maxent.ROWS, maxent.CLASSES))
    maxent.add_gradient(model, t, total)
    rows = model.features(h, ending, first)[2]
    want = np.zeros(total[1].shape)
    for k, p in enumerate(np.exp(model.classes(rows))):
        for row in rows[:, k]:
            want[row] += p
    assert np.allclose(total[1], want, atol=1e-3) and total[0].sum() == 5 * len(h)


def some_model(r, t, size):
    """A model of a text's words with weights drawn at random, and its tokens."""
    h, ending, first = maxent.tokens(t)
    word, n = np.unique(h[ending >= 0], return_counts=True)
    v = maxent.Vocabulary(word, n, 1, {}, len(h), len(word) + 1)
    v.classify(r.random((len(word), maxent.COMPANY + 1)))
    model = maxent.Model(v)
    model.weight[:] = size * r.normal(size=model.weight.shape)
    return model, (h, ending, first)


def test_equal_contexts_are_worked_out_once(monkeypatch):
    """The softmax has a row for each three contexts that differ among the tokens held, and weighs as often as they occur."""
    r = np.random.default_rng(5)
    t = text_of(*(" ".join(f"w{i}" for i in r.zipf(1.4, 300) % 40) for _ in range(4)), "", "w1")
    model, _ = some_model(r, t, 1)
    worked, plain = [], np.exp

    def counted(x, *args, **named):
        worked.append(np.size(x) // CLASSES)
        return plain(x, *args, **named)

    monkeypatch.setattr(np, "exp", counted)
    one, many = (np.zeros((2, maxent.ROWS, maxent.CLASSES)) for _ in range(2))
    maxent.add_gradient(model, t, one)
    apart = len(np.unique(model.features(*tokens(t))[2][:3], axis=1).T)
    assert sum(worked) == apart < len(tokens(t)[0])
    worked.clear()
    maxent.add_gradients(model, [t] * 30, many)
    assert sum(worked) == apart
    assert np.array_equal(30 * one[0], many[0]) and np.allclose(30 * one[1], many[1], rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("size", [0.5, 40])
def test_sums_over_held_tokens_and_scores_against_single_tokens(monkeypatch, size):
    """Few tokens held, few contexts at once, few rows in a run, and weights beyond what exp can hold change no result."""
    r = np.random.default_rng(6)
    texts = [text_of(" ".join(f"w{i}" for i in r.zipf(1.4, k) % 60)) for k in (400, 1, 300, 2)] + [text_of("w1 " * 900, "", "zz w2")]
    model, _ = some_model(r, texts[0], size)
    monkeypatch.setattr(maxent, "HELD", 350)
    monkeypatch.setattr(maxent, "BATCH", 64)
    monkeypatch.setattr(maxent, "RUN", 3)
    total, want = np.zeros((2, maxent.ROWS, maxent.CLASSES)), np.zeros((2, maxent.ROWS, maxent.CLASSES))
    maxent.add_gradients(model, iter(texts), total)
    for t in texts:
        h, ending, first = tokens(t)
        top, cls, rows = model.features(h, ending, first)
        x = model.weight[rows].sum(axis=0, dtype=float) + model.vocabulary.bias
        x -= x.max(axis=1, keepdims=True)
        p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        for row in rows:
            np.add.at(want[0], (row, cls), 1)
            np.add.at(want[1], row, p)
        own = x[np.arange(len(x)), cls] - np.log(np.exp(x).sum(axis=1))
        within = np.where(top >= 0, np.append(model.vocabulary.within, 0)[top], np.where(ending < 0, 0, np.append(model.vocabulary.rare_within, 0)[ending]))
        got = score_texts(model, t)[3]
        assert got == pytest.approx(np.add.reduceat(own / np.log(10) + within, first[:-1]), rel=1e-4, abs=1e-3)
    assert np.array_equal(total[0], want[0]) and np.allclose(total[1], want[1], rtol=1e-3, atol=2e-3)


def test_words_whose_hashes_begin_alike_are_found():
    h = np.array([0, 1, 5, 6, 1 << 50, (1 << 50) + 1, (1 << 64) - 2, (1 << 64) - 1], np.uint64)
    v = maxent.Vocabulary(h[[6, 1, 3, 4, 2]], np.array([9, 7, 5, 3, 1]), 1, {}, 26, 6)
    assert v.place(h).tolist() == [-1, 0, 1, 2, 3, -1, 4, -1]
    assert maxent.Vocabulary(h[:0], np.zeros(0, np.int64), 0, {}, 0, 0).place(h).tolist() == [-1] * len(h)
