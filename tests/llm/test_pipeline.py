"""The pipeline's stages against plain versions over a small table, and on odd tables."""

import random
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

import public_tokenizers  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, verdict_id long, starts string, mix_copy string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def made(seed=3):
    r = random.Random(seed)
    line = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    phrase = line(13)
    rows = []
    for k in range(45):
        rows.append([k, f"{line(40)}\nThe same footer of all\n{line(30)}", "a"])
    rows.append([100, rows[0][1] + " end", "b"])
    rows.append([101, f"{line(30)} {phrase} {line(30)}", "b"])
    rows.append([102, f"{line(300)} {phrase} {line(300)}", "b"])
    rows += [[103, line(20), "b"], [104, "x y z " * 60, "b"], [105, None, "b"], [106, "", None], [107, f"{line(70)}", None]]
    return [(i, t, "en", s, len(t or ""), "x", 1, "y", "z") for i, t, s in rows], phrase


def normal(line):
    return " ".join(words("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def plain_quality(rows):
    sets = {}
    for i, t, _, s, *_ in rows:
        lines = frozenset(n for n in map(normal, (t or "").split("\n")) if n)
        for x in lines:
            sets.setdefault((s, x), set()).add(lines)
    often = {k for k, v in sets.items() if len(v) > 30}
    out = {}
    for i, t, _, s, *_ in rows:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        repeated = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lost = sum(len(x.split()) for x in {normal(x) for x in (t or "").split("\n")} if (s, x) in often)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and 100 * (len(w) - lost) >= 30 * len(w):
            out[i] = "\n".join(x for x in t.split("\n") if (s, normal(x)) not in often)
    return out


def plain_dedup(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in docs.items() for w in [words(t.lower())]}
    kept = {}
    for i in sorted(docs):
        if not any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in docs if j < i):
            kept[i] = docs[i]
    return kept


def folder(spark, tmp_path, rows, phrase):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", phrase)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_plain_versions(spark, tmp_path):
    rows, phrase = made()
    sf = folder(spark, tmp_path, rows, phrase)
    docs = pipeline.documents(spark, sf)
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}

    want = plain_quality(rows)
    docs = pipeline.as_table(pipeline.quality(spark, docs, sf), "t")
    assert texts(docs) == want and len(want) == 49
    assert "The same footer of all" not in want[1] and 103 not in want and 104 not in want

    want = plain_dedup(want)
    docs = pipeline.as_table(pipeline.near_dedup(spark, docs, sf), "t")
    assert texts(docs) == want and 100 not in want

    docs = pipeline.as_table(pipeline.decontamination(spark, docs, sf), "t")
    got = texts(docs)
    assert set(got) == set(want) - {101}
    for i, t in got.items():
        assert alnum(t) == (alnum(want[i]) if i != 102 else alnum(want[i].replace(phrase, " ")))

    mixed = pipeline.as_table(pipeline.mixing(spark, docs, sf), "t")
    size = {i: len(words(t)) for i, t in got.items()}
    of = {r.doc_id: r.source for r in docs.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= set(size) and max(times.values()) <= 2
    total = Counter()
    for i, n in times.items():
        total[of[i]] += n * size[i]
    whole = sum(size.values())
    assert abs(sum(total.values()) - 1.5 * whole) < 0.05 * whole

    told = {}
    for r in pipeline.token_output(spark, mixed, sf).collect():
        told.setdefault(r.doc_id, []).append(r.n_tokens)
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert told == {i: [len(encoder.encode(got[i], add_special_tokens=False).ids) + 1] * n for i, n in times.items()}


def test_odd_and_empty_tables(spark, tmp_path):
    rows, phrase = made()
    odd = rows + [(None, rows[3][1], None, None, None, None, None, None, None), rows[5], rows[5], (None, None, None, "a", 0, "x", 1, "y", "z")]
    sf = folder(spark, tmp_path / "odd", odd, phrase)
    out = pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in out}
    assert len(kept) > 30
    assert not kept & {100, 101, 103, 104, 105, 106}
    empty = folder(spark, tmp_path / "empty", [], phrase)
    assert pipeline.run(spark, empty).collect() == []
