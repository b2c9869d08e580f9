"""Lines that share keys: crowded keys, frequent lines, the bitmap of keys."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from ensemblar.llm import line_dedup  # noqa: E402


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(p + (x != y), d[j] + 1, d[j + 1] + 1)
    return d[-1]


@pytest.fixture
def tables(monkeypatch):
    """What the steps write, by name."""
    made, write = {}, line_dedup.as_table

    def kept(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(line_dedup, "as_table", kept)
    return made


def test_no_table_grows_with_copies_of_a_line(spark, tables):
    line, near = "a line that very many of the documents hold", "a line that very many of the document hold"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 2999, near).otherwise(line).alias("text"))
    got = {x.doc_id: (x.n_links, x.near) for x in line_dedup.line_duplicates(docs).collect()}
    assert got == {0: (1, False), 2999: (1, True)}
    assert max(x.count() for x in tables.values()) <= 1024


def test_a_crowded_key_is_dealt_to_several_tasks(spark, tables, monkeypatch):
    """Lines of one start: each pair is compared once, and in the end as brute force says, with letters of one and of two bytes."""
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    r = random.Random(4)
    ends = ["".join(r.choice("abé ") for _ in range(28)) for _ in range(5)]
    lines = {("the start of all lines " + e).strip() for e in ends}
    while len(lines) < 60:
        e = list(r.choice(ends))
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(e))
            e[k : k + r.randint(0, 1)] = [r.choice("aé")] * r.randint(0, 1)
        lines.add(("the start of all lines " + "".join(e)).strip())
    lines = sorted(lines)
    r.shuffle(lines)
    links = {(x.a_h, x.b_h) for x in line_dedup.edit_links(docs_of(spark, lines), 2, 12).collect()}
    h = [x.h for x in docs_of(spark, lines).orderBy("doc_id").select(F.xxhash64("text").alias("h")).collect()]
    want = {(h[a], h[b]) for b in range(len(lines)) for a in range(b) if distance(lines[a], lines[b]) <= 2}
    assert links == want and len(want) > 20
    assert tables["probes"].agg(F.max("parts")).first()[0] > 1


def test_codes_differ_no_more_than_counts(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(300):
        x = [r.randint(0, 40) for _ in line_dedup.COUNTED]
        y = list(x)
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(x))
            y[k] = max(0, y[k] + r.choice((-1, 1)))
        pairs.append((x, y))
    both = spark.createDataFrame(pairs, "x array<int>, y array<int>")
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(line_dedup._codes("x"), line_dedup._codes("y"), strict=True)), F.lit(0))
    for x in both.select("x", "y", apart.alias("bits")).collect():
        true = sum(abs(a - b) for a, b in zip(x.x, x.y, strict=True))
        assert x.bits <= true and (x.bits == true or max(abs(a - b) for a, b in zip(x.x, x.y, strict=True)) > 4)


def test_all_marked_keys_are_found(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"), "id")
    blocks = line_dedup._marked(keys.filter("id < 10000").select("key"))
    found = keys.join(blocks, F.expr(line_dedup.BLOCK) == F.col("block")).filter(line_dedup._is_marked("words"))
    n, inside = found.agg(F.count("id"), F.sum(F.expr("int(id < 10000)"))).first()
    assert inside == 10_000 and n < 10_100 and blocks.count() == line_dedup.BLOCKS


def test_bytes_and_characters_give_one_key(spark):
    """A segment of one-byte letters has one key, whether or not the rest of its line has longer letters."""
    texts = ["plain words at the start of it, und für Ähnliches danach", "plain words at the start of it, und fur Ahnliches danach"]
    keys = [{x.key for x in line_dedup._keyed(docs_of(spark, [t]), 2, 12).filter("own").collect()} for t in texts]
    assert len(keys[0] & keys[1]) >= 1
    assert line_dedup.edit_links(docs_of(spark, texts), 2, 12).count() == 1
