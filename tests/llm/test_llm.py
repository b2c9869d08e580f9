"""The corpus operators: against brute force, SQL or exact round trips, and on odd inputs."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")

from ensemblar.llm import decontaminate, html_dom, html_extract, language, line_dedup, minhash, mixing, quality, suffix_dedup, token_counts, token_files  # noqa: E402
from ensemblar.llm.components import components, joined, roots  # noqa: E402
from ensemblar.llm.fm_index import FMIndex, suffix_array  # noqa: E402
from ensemblar.llm.grouping import sort_suffixes  # noqa: E402
from ensemblar.llm.oracle import ORACLE  # noqa: E402
from ensemblar.llm.queries import QUERIES  # noqa: E402
from ensemblar.llm.textnum import Text, as_bytes  # noqa: E402

#: Further columns with the names that stage functions use inside.
CLASHES = "n long, component string, row_key string, verdict_id long, boilerplate string, found_id long, starts string, ends string, firsts string, contaminated string, mix_row long, mix_copy string, mix_shard string, kept_id long, kept_lines string, gone_id long, h long, line string, row string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
FURTHER = tuple(None if kind == "long" else "x" for _, kind in (x.split() for x in CLASHES.split(", ")))
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or ["a"] * len(texts))[k], len(t or ""), *FURTHER) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "one two three four", "é ß " * 30, "a " * 3000, "tie tie", "tie tie", "\n\n\n", "x" * 500]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeated rows and further columns with names that operators use."""
    d = docs_of(spark, ODD)
    null_row = spark.createDataFrame([(None, "no id here at all " * 20, None, None, None, *FURTHER)], DOCS)
    return d.unionByName(d.filter("doc_id IN (4, 6)")).unionByName(null_row)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def random_texts(seed, n=40, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(5, words))] for _ in range(n)]
    out = [" ".join(x) for x in base]
    for x in base[: n // 2]:
        y = list(x)
        for _ in range(r.randint(0, 4)):
            y[r.randrange(len(y))] = r.choice(vocabulary)
        out.append(" ".join(y))
    out += [out[0]] * 3
    r.shuffle(out)
    return out


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in sorted(names)) for r in got.collect()))) == sorted(map(repr, (tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall())))


@pytest.mark.parametrize("run", [
    minhash.near_duplicates, quality.quality_rules, suffix_dedup.suffix_dedup, mixing.mix_plan, line_dedup.line_report, minhash.keep_first, quality.keep_good,
    suffix_dedup.remove_repeats, mixing.mix, line_dedup.drop_lines,
])
def test_odd_and_empty_inputs(spark, odd, empty, run):
    assert run(empty).count() == 0
    rows = run(odd).collect()
    if run in (minhash.near_duplicates, quality.quality_rules, suffix_dedup.suffix_dedup, mixing.mix_plan, line_dedup.line_report):
        assert len(rows) == odd.count()
    else:
        assert set(odd.columns) <= set(run(odd).columns)


def test_odd_inputs_of_those_with_two_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a a a"), (2, None), (3, ""), (3, "tie tie")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit) for r in decontaminate.contamination(odd, bench).collect()}
    assert (6, 3000) in got and (7, 2) in got and (0, 0) in got
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.filter("false")).filter("contaminated").count() == 0
    assert 6 not in {r.doc_id for r in decontaminate.decontaminate(odd, bench).collect()}
    counts = token_counts.section_counts(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id for r in counts.collect()} == {*range(len(ODD)), None}


def test_near_duplicates_equal_brute_force(spark):
    texts = random_texts(1)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {k: (len(sets[k]), find(k), find(k) == k) for k in range(len(texts))}


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """One shared passage in all documents, and near pairs among them: the large buckets are split by rare shingles."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    r = random.Random(9)
    shared = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(30):
        own = [f"o{k}_{j}" for j in range(20)]
        texts.append(" ".join(shared + own))
        if k % 3 == 0:
            own[r.randrange(20)] = f"z{k}"
            texts.append(" ".join(shared + own))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert links and got == dict(enumerate(label))


def test_suffix_sorters():
    r = random.Random(3)
    for _ in range(500):
        a = [r.randint(1, r.choice([1, 2, 3, 8])) for _ in range(r.randint(1, 40))] + [0]
        want = sorted(range(len(a)), key=lambda k: a[k:])
        assert sort_suffixes(np.array(a)).tolist() == want
        assert suffix_array(np.array(a)).tolist() == want


def test_fm_index_finds_all():
    r = random.Random(4)
    for _ in range(60):
        text = [r.choice([0, 1, 1, 2, 3]) for _ in range(r.randint(1, 80))]
        index = FMIndex(np.array(text), 3)
        patterns = [[r.randint(1, 3) for _ in range(r.randint(1, 4))] for _ in range(10)]
        lengths = np.array([len(p) for p in patterns])
        low, high = index.search(np.array([p + [0] * (4 - len(p)) for p in patterns]), lengths)
        for k, p in enumerate(patterns):
            got = sorted(index.locate(np.arange(low[k], high[k])).tolist())
            assert got == [j for j in range(len(text)) if text[j : j + len(p)] == p]


@pytest.mark.parametrize("big, hot", [(4000, 20_000), (1, 3)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, big, hot):
    monkeypatch.setattr(suffix_dedup, "BIG_GROUP", big)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_ANCHORS", 1_000_000)
    shared = "".join(random.Random(6).choice("abcdefgh ") for _ in range(90))
    texts = [*random_texts(5), "ab" * 200, "é" * 150, *ODD, *[f"{k:02d}" * 6 + shared + f"{k % 4:02d}" * 6 for k in range(12)]]
    seen, want = set(), {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect()}
    assert got == want


def test_groups_without_repeats_give_no_spans(spark):
    """Windows that share an anchor and nothing else: a task may sort only such."""
    assert suffix_dedup._spans(np.zeros(0, np.int64), np.zeros(0, np.int64), 100).num_rows == 0
    r = random.Random(10)
    middle = "".join(r.choice("abcdefgh") for _ in range(40))
    texts = ["".join(r.choice("xyz") for _ in range(70)) + middle + "".join(r.choice("xyz") for _ in range(70)) for _ in range(6)]
    assert all(x.n_removed == 0 for x in suffix_dedup.suffix_dedup(docs_of(spark, texts)).collect())


def test_contamination_in_blocks_is_the_same(spark):
    texts = random_texts(6)
    items = [(k, " ".join(t.split()[3:30])) for k, t in enumerate(texts[:20])] + [(99, texts[0].split()[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda d: sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in d.collect())
    docs = docs_of(spark, texts)
    one, many = decontaminate.contamination(docs, bench), decontaminate.contamination(docs, bench, block_chars=100)
    assert key(one) == key(many) and any(x[2] for x in key(one))


def test_mixing_properties(spark):
    r = random.Random(7)
    texts = ["w " * r.randint(1, 40) for _ in range(300)]
    sources = [r.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    docs = docs_of(spark, texts, sources)
    rows = mixing.mix_plan(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_plan(docs.repartition(7)).collect()))
    size = {}
    for x in rows:
        size[x.source] = size.get(x.source, 0) + x.size
        assert x.taken == x.size * x.copies <= 2 * x.size and len(x.shards) == x.copies
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), list(names), {}
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[f] for f in free) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free = [s for s in free if s not in over]
    target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
    taken = {s: sum(x.taken for x in rows if x.source == s) for s in names}
    for x in rows:
        assert x.target == pytest.approx(target[x.source]) and x.source_size == size[x.source]
    assert all(abs(taken[s] - target[s]) <= 40 for s in names)
    assert mixing.mix(docs).count() == sum(x.copies for x in rows)


def test_line_links_equal_brute_force(spark):
    r = random.Random(8)
    lines = []
    for _ in range(60):
        x = "".join(r.choice("abcdé ") for _ in range(r.randint(10, 50))).strip() or "x"
        for _ in range(3):
            y = list(x)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(y) + 1)
                y[k : k + r.randint(0, 1)] = [r.choice("ab")] * r.randint(0, 1)
            lines.append("".join(y).strip() or "y")
    r.shuffle(lines)
    texts = ["\n".join(lines[k : k + 6]) for k in range(0, len(lines), 6)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(p + (x != y), d[j] + 1, d[j + 1] + 1)
        return d[-1]

    first = {}
    for k, t in enumerate(texts):
        for n, x in enumerate(t.split("\n")):
            first.setdefault(x.strip(" \t"), (k, n))
    want = {p: [0, False] for p in first.values()}
    items = sorted(first.items(), key=lambda z: z[1])
    for a, (x, p) in enumerate(items):
        for y, q in items[:a]:
            if min(len(x), len(y)) >= 12 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                want[p][0] += 1
                want[q][0] += 1
                want[p][1] = True
    got = {(x.doc_id, x.line_no): [x.n_links, x.near] for x in line_dedup.line_duplicates(docs_of(spark, texts)).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for high in (1, 2, 50_000, 1 << 40, 1 << 63):
        for n in (0, 1, 59, 4096, 4097, 10_000):
            ids = r.integers(0, high, n, dtype=np.uint64)
            ids[r.random(n) < 0.5] = 0
            data = token_files.to_shard(np.array([7]), np.array([n]), ids)
            assert (token_files.from_shard(data)[2] == ids).all()
            if n > 4096:
                assert (token_files.from_shard(data, 1, 2)[2] == ids[4096:8192]).all()


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    with open(WORD_BPE, "rb") as f:
        encode = token_files.Encoder(f.read())
    r = random.Random(2)
    signs = ["a", "s", "t", "'", "''", "1", "22", "-", "é", "×", "É", "—", "ß", "Σ", "日本", "<|endoftext|>", "<", "|", "'s", "'ll", " ", "\n", " ", "́", "½", "İ", "I'M", "_", "\x00"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    ids, n = encode(Text(*as_bytes(pa.array(texts))))
    at = np.cumsum(n) - n
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k] + n[k]].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    token_files.write_token_files(odd, f"{tmp_path}/t", WORD_BPE, shard_ids=50)
    got = sorted(token_files.read_token_files(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for g, w in zip(got, rows, strict=True):
        ids = [*whole.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (w.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>part<br>next&nbsp;line<p>Second {n}<p>Follow our page daily</p><div class="share">share me</div>
<form><input name=q>search</form></article><section id="comments"><article class="comment">I disagree</article></section><aside>side</aside><footer>&copy; us</footer></body>"""


def test_main_text(spark):
    rows = [(k, f"http://h.example.org/{k}", PAGE.replace("{n}", f"item {k}" + " more" * k)) for k in range(12)] + [(90, None, None), (91, "x", ""), (92, "http://u.example.org/", "<p>no article</p><p><a>links only</a></p> tail")]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title & more First boldpart next line Second item 3 more more more" or got[3].text.endswith("item 3 more more more")
    assert "disagree" not in got[3].text and "cookies" not in got[3].text and "Follow" not in got[3].text and "search" not in got[3].text
    assert (got[90].text, got[90].n_chars, got[91].text) == ("", 0, "")
    assert got[92].text == "no article tail"


@pytest.mark.parametrize("around", ['<div class="page has-sidebar">@</div>', '<div id="content" class="with-comments">@</div>', '<div class="layout search-enabled">@</div>', '<form action="/">@</form>', '<div class="ad">@</div>'])
@pytest.mark.parametrize("inside", ["<article>@</article>", "<main>@</main>", "<div>@</div>", '<article><div class="entry no-sidebar">@</div></article>'])
def test_names_around_the_article_do_not_empty_it(around, inside):
    body = "<p>First paragraph of the story</p><p>Second paragraph, longer than the first</p>"
    rest = '<div class="sidebar">Latest news</div><div id="comments"><article>I disagree</article></div><form>Search here</form>'
    page = around.replace("@", inside.replace("@", body) + rest)
    assert html_extract.page_text(f"<body>{page}</body>") == "First paragraph of the story Second paragraph, longer than the first"


def test_template_decides_before_names(spark):
    """A slot with a sidebar's name is the text of its pages where all else is constant."""
    fixed = "<p>" + "Words that all pages of this host show at their top. " * 4 + "</p>"
    rows = [(k, f"http://h.example.org/{k}", f'<body>{fixed}<div class="has-sidebar"><p>Story {k} of today</p></div></body>') for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} of today" for k in range(12)}


def test_small_hosts_and_odd_shortest_pages_have_templates(spark):
    """Two pages make a template; an error page that is the shortest hides none; versions of one text stay whole."""
    r = random.Random(11)
    own = lambda: " ".join(f"w{r.randint(0, 9999)}" for _ in range(30))
    notice = "<p>Follow our page daily</p>"
    two, many = [own() for _ in range(2)], [own() for _ in range(12)]
    rows = [(k, "http://two.example.org/", f"<article><p>{x}</p>{notice}</article>") for k, x in enumerate(two)]
    rows += [(10, "http://many.example.org/", "<p>Not found</p>")] + [(20 + k, "http://many.example.org/", f'<nav>menu</nav><article><p>{x}</p>{notice}<div class="end">End</div></article>') for k, x in enumerate(many)]
    rows += [(40 + k, "http://versions.example.org/", f"<article><p>{two[0]}</p><p>{many[0]}</p><p>Version {k}</p></article>") for k in range(2)]
    got = {x.page_id: x.text for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[0], got[1]] == two
    assert got[10] == "Not found" and [got[20 + k] for k in range(12)] == many
    assert [got[40 + k] for k in range(2)] == [f"{two[0]} {many[0]} Version {k}" for k in range(2)]


def test_alignment_keeps_order():
    a, b = html_dom.Page("<ul><li>x<li>y<li>z</ul><p>same</p>"), html_dom.Page("<ul><li>y<li>w</ul><p>new</p><p>same</p>")
    pairs = html_dom.align(a, b)
    assert {(a.text[x], b.text[y]) for y, x in pairs.items() if b.text[y]} >= {("y", "y"), ("same", "same")}


def test_tokens_are_attributed_whole(spark):
    texts = ["a\n\n\nb c", "é\nü\n", "", None, "word " * 50 + "\n\n \n" + "end"]
    counts = token_counts.section_counts(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: (r.n, r.c) for r in counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.sum("n_chars").alias("c")).collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {k: (len(whole.encode(t or "", add_special_tokens=False).ids), len(t or "")) for k, t in enumerate(texts)}
    n, over = token_counts.attribute(np.array([2, 3, 1]), np.array([0, 3, 6]))
    assert n.tolist() == [1, 2] and over.tolist() == [0, 1]
    assert token_counts.attribute(np.array([2]), np.array([0, 1, 2]))[0].tolist() == [1, 0]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.doc_id: r.lang for r in language.languages_of(held, pages, language.learn(train)).filter("doc_id IS NOT NULL").collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert np.mean([got[k] == v for k, v in want.items()]) >= 0.95


def test_copies_are_not_boilerplate(spark):
    r = random.Random(3)
    own = lambda: " ".join(f"w{r.randint(0, 9999)}" for _ in range(40))
    text = "\n".join(own() for _ in range(3))
    texts = [text] * 50 + [f"{own()}\nCookie policy and terms\n{own()}\n{own()}" for _ in range(40)] + ["Cookie policy and terms\n" * 20 + own()]
    got = {x.doc_id: x for x in quality.quality_rules(docs_of(spark, texts)).collect()}
    assert all(got[k].kept and not got[k].n_boilerplate_lines for k in range(50))
    assert all(got[k].kept and got[k].n_boilerplate_lines == 1 for k in range(50, 90))
    assert not got[90].kept
    kept = {x.doc_id: x.text for x in quality.keep_good(docs_of(spark, texts)).collect()}
    assert 90 not in kept and "Cookie" not in kept[60] and kept[0] == text


def test_blocks_of_lines_are_boilerplate(spark):
    """Every line of a fixed block counts, at the top of the text or inside it; true copies count once."""
    r = random.Random(4)
    own = lambda n: " ".join(f"w{r.randint(0, 9999)}" for _ in range(n))
    head = ["Home of the news", "All menus of the site", "Sign in to read on"]
    licence = [f"Licence clause {k} holds for all of it" for k in range(20)]
    texts = ["\n".join([*head, own(60), own(60)]) for _ in range(40)]
    texts += ["\n".join([own(20), *licence, own(20)]) for _ in range(40)]
    copied = [f"Title {k} of copied text" for k in range(3)] + [own(60)]
    texts += ["\n".join(copied)] * 39 + ["\n".join(reversed(copied))]
    docs = docs_of(spark, texts, ["a"] * 40 + ["b"] * 40 + ["c"] * 40)
    got = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    assert all(got[k].n_boilerplate_lines == 3 and got[k].n_boilerplate_words == 14 and got[k].kept for k in range(40))
    assert all(got[k].n_boilerplate_lines == 20 and got[k].n_boilerplate_words == 160 and not got[k].kept for k in range(40, 80))
    assert all(not got[k].n_boilerplate_lines and got[k].kept for k in range(80, 120))
    kept = {x.doc_id: x.text for x in quality.keep_good(docs).collect()}
    assert all(kept[k] == "\n".join(texts[k].split("\n")[3:]) for k in range(40)) and kept[80] == texts[80]


def test_stages_judge_rows_with_null_or_equal_ids(spark):
    """A clean row stays and a contaminated or poor one goes, whatever its id; each row has its own copies."""
    r = random.Random(12)
    own = lambda n: " ".join(f"w{r.randint(0, 9999)}" for _ in range(n))
    clean, poor, test = [own(80) for _ in range(4)], ["a b c " * 40, "too short"], own(20)
    of = lambda rows: spark.createDataFrame([(k, t, "en", s, len(t), *FURTHER) for k, t, s in rows], DOCS)
    rows = [(None, clean[0], "a"), (None, clean[1], "b"), (None, poor[0], "a"), (7, clean[2], "a"), (7, poor[1], "b"), (8, clean[3], "b")]
    assert sorted(x.text for x in quality.keep_good(of(rows)).collect()) == sorted(clean)
    rows = [(None, clean[0], "a"), (None, test, "a"), (7, clean[1], "a"), (7, f"{clean[2]} {test} {clean[3]}", "a")] + [(8, f"{own(500)} {test}", "a")]
    bench = spark.createDataFrame([(1, test)], "item_id long, text string")
    left = sorted(x.text for x in decontaminate.decontaminate(of(rows), bench).collect())
    assert len(left) == 3 and {clean[0], clean[1]} <= set(left) and not any(test in x for x in left)
    rows = [(None, own(n), s) for n, s in [(10, "a"), (20, "a"), (400, "b"), (30, None)]] + [(7, own(n), s) for n, s in [(15, "a"), (300, "b")]]
    want = sorted((x.source or "", x["size"]) for x in mixing.mix_plan(of(rows)).collect() for _ in range(x.copies))
    assert sorted((x.source or "", len(x.text.split())) for x in mixing.mix(of(rows)).collect()) == want


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = pipeline.documents(spark, SMALL)
    stage = docs
    ids = {r.doc_id for r in docs.collect()}
    for name, f in pipeline.STAGES[:-1]:
        out = pipeline.as_table(f(spark, stage, SMALL), name)
        assert out.columns == docs.columns
        now = {r.doc_id for r in out.collect()}
        assert now <= ids
        if name == "quality":
            assert now == {r.doc_id for r in quality.quality_rules(stage).filter("kept").collect()}
        if name == "near_dedup":
            assert now == {r.doc_id for r in minhash.near_duplicates(stage).filter("kept").collect()}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert now == {r.doc_id for r in decontaminate.contamination(stage, bench).filter("NOT contaminated").collect()}
            assert decontaminate.contamination(out, bench).filter("contaminated").count() == 0
        if name == "mixing":
            want = {r.doc_id: r.copies for r in mixing.mix_plan(stage).filter("copies > 0").collect()}
            assert want == {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
        ids, stage = now, out
    assert pipeline.STAGES[-1][1](spark, stage, SMALL).count() == stage.count()


def test_languages_without_rows_or_labels(spark, odd, empty):
    pages = spark.createDataFrame([(1, None, None), (2, "http://x.fr/", '<html lang="fr">le chat')], "page_id long, url string, html string")
    none = language.learn(empty)
    assert {(r.lang, r.text_lang, r.prob) for r in language.languages_of(odd, pages, none).collect()} == {(None, None, None)}
    assert language.languages_of(empty, pages.filter("false"), none).count() == 0
    unlabelled = language.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert not unlabelled.languages
    known = language.learn(docs_of(spark, ["the cat and the dog"] * 3))
    assert {r.lang for r in language.languages_of(odd, pages, known).collect()} == {"en"}
    assert language.languages_of(empty, pages.filter("false"), known).count() == 0


def test_the_sample_of_each_language_is_bounded(spark):
    docs = spark.createDataFrame([(k, "ab cd ef", "en" if k % 10 else "fr") for k in range(3000)], "doc_id long, text string, lang string")
    few, more = language.learn(docs, sample_docs=20), language.learn(docs, sample_docs=200)
    assert few.languages == more.languages == ["en", "fr"]
    assert np.allclose(few.logs[0], few.logs[1]) and np.allclose(more.logs[0], more.logs[1])


def test_fusion_equals_brute_force(spark):
    r = np.random.default_rng(5)
    hosts, said = ["a.fr", "b.fr", "c.de", "lone", ""], ["fr", "de", None]
    rows = [(k, [float(x) for x in r.normal(0, 2, 3)], hosts[r.integers(5)], said[r.integers(3)]) for k in range(60)]
    rows = [(k, s, h, h.rpartition(".")[2] if "." in h else "", d) for k, s, h, d in rows]
    names = ["de", "en", "fr"]
    got = {x.k: x for x in language.fuse(spark.createDataFrame(rows, "k long, scores array<double>, host string, suffix string, declared string"), names, 20, 50).collect()}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = np.array([soft(np.array(s)) for _, s, *_ in rows])
    total = lambda hit: p[[k for k, x in enumerate(rows) if hit(x)]].sum(axis=0)
    whole = (total(lambda x: True) + 1) / (len(rows) + 3)
    spoken = {d: total(lambda x, d=d: x[4] == d) for d in ("fr", "de")}
    for k, scores, host, suffix, declared in rows:
        above = whole
        if suffix:
            s = total(lambda x: x[3] == suffix)
            above = (s + 50 * whole) / (s.sum() + 50)
        prior = above if host else whole
        if host:
            s = total(lambda x: x[2] == host)
            prior = (s + 20 * above) / (s.sum() + 20)
        logs = np.array(scores) + np.log(prior)
        if declared:
            logs = logs + np.log((spoken[declared] + 0.5) / (sum(spoken.values()) + 0.5 * len(spoken)))
        post = soft(logs)
        assert (got[k].lang, got[k].text_lang) == (names[post.argmax()], names[int(np.argmax(scores))])
        assert got[k].prob == pytest.approx(post.max(), abs=2e-6)


def test_shard_quotas_are_an_exact_split(spark):
    """Quotas add up for sources and, but for one block, for shards; over seeds they follow the hypergeometric mean and variance."""
    units = {"a": 400, "b": 90, "c": 0, None: 13}
    df = spark.createDataFrame(list(units.items()), "source string, units long")
    draws = []
    for seed in range(12):
        rows = mixing.shard_quotas(df, 3, seed).collect()
        by = lambda key: {k: sum(x.quota for x in rows if getattr(x, key) == k) for k in {getattr(x, key) for x in rows}}
        assert all(x.quota >= 0 for x in rows) and by("source") == units
        assert set(by("shard").values()) <= {62, 63} and len(by("shard")) == 8
        draws += [x.quota for x in rows if x.source == "a"]
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.shard_quotas(df, 3, seed).collect()))
    n, share = 503 / 8, 400 / 503
    assert np.mean(draws) == pytest.approx(n * share) and 0.5 < np.var(draws) / (n * share * (1 - share) * (503 - n) / 502) < 1.8


def test_copies_of_a_block_are_disjoint(spark):
    """Each copy of a document goes to a shard of its own draw, and a shard takes what its quota says."""
    r = random.Random(13)
    docs = docs_of(spark, ["w " * r.randint(1, 30) for _ in range(200)], [r.choice("aab") for _ in range(200)])
    plan = mixing.mix_plan(docs, depth=2).collect()
    got = sorted((x.doc_id, s) for x in plan for s in x.shards)
    drawn = mixing.mix(docs, depth=2)
    copy, shard = drawn.columns[-2:]
    assert sorted((x.doc_id, x[shard]) for x in drawn.collect()) == got
    assert drawn.select("doc_id", copy).distinct().count() == len(got)


def test_sections_equal_brute_force(spark):
    """Each token counts for the line that holds most of its bytes, the earlier one on ties."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        encoding, _ = token_counts._encoding(f.read(), public_tokenizers.PATTERN)
    assert isinstance(encoding, tiktoken.Encoding)
    r = random.Random(14)
    texts = ["".join(r.choice(["word", " ", "\n", "\n\n", "é", "  ", "x", "日"]) for _ in range(60)) for _ in range(20)] + ["\n", "\n\n\n a"]
    got = {}
    for x in token_counts.section_counts(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect():
        got.setdefault(x.doc_id, {})[x.section] = (x.n_chars, x.n_tokens)
    for d, t in enumerate(texts):
        lines = t.splitlines(keepends=True) or [""]
        owner = [k for k, line in enumerate(lines) for _ in line.encode()]
        counts, at = [0] * len(lines), 0
        for i in encoding.encode_ordinary(t):
            own = owner[at : at + len(encoding.decode_single_token_bytes(i))]
            at += len(own)
            counts[min(set(own), key=lambda k: (-own.count(k), k))] += 1
        assert got[d] == {k: (len(line), counts[k]) for k, line in enumerate(lines)}


def test_very_long_white_space_is_counted(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        encoding, _ = token_counts._encoding(f.read(), public_tokenizers.PATTERN)
    for text in (" " * 9000 + "x", "a" + " " * 9000, "\n" * 5000 + "b" + "\t " * 3000 + " c", " " * 9000, "x \u2003" * 2 + "\u3000" * 5000 + "\n'll"):
        assert token_counts.encode(encoding, text) == encoding.encode_ordinary(text)
    got = token_counts.section_counts(docs_of(spark, [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b"]), path, public_tokenizers.PATTERN)
    assert {(x.doc_id, x.n) for x in got.groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()} == {(0, 2_000_000), (1, 2_000_002)}


def test_other_tokenizer_files_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(WORD_BPE, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    data = json.dumps(said)
    encode, whole = token_files.Encoder(data.encode()), Tokenizer.from_str(data)
    texts = ["it's 12-34 a'b", "", "plain words (here)", "x" * 50]
    ids, n = encode(Text(*as_bytes(pa.array(texts))))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encode.cuts and ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_marks_hold_at_any_depth():
    for depth in (10, 170, 2000):
        page = "<div>" * depth + "<aside>SIDEBAR</aside><p>text of the page</p>" + "</div>" * depth
        assert html_extract.page_text(page) == "text of the page"
        assert html_dom.align(html_dom.Page(page), html_dom.Page(page))


def test_repeated_ids_with_different_texts_are_stable(spark):
    """Lines of different texts with one id are all judged, and the same way in every order of the rows."""
    rows = [(7, "the first line of it\nshared line of both"), (7, "another line of text\nshared line of both"), (8, "shared line of both\nthe first line of it!"), (None, "no id")]
    of = lambda x: spark.createDataFrame([(k, t, "en", "a", 0, *FURTHER) for k, t in x], DOCS)
    one, two = (sorted((x.doc_id or 0, x.text) for x in line_dedup.drop_lines(of(x)).collect()) for x in (rows, rows[::-1]))
    assert one == two == [(0, "no id"), (7, "another line of text\nshared line of both"), (7, "the first line of it\nshared line of both"), (8, "")]


def test_components_of_trees_paths_and_later_links(spark):
    """Pointers find the roots of trees; later links between components move every node of both."""
    r = random.Random(4)
    tree = [(r.randrange(max(0, k - 3), k), k) for k in range(1, 40) if k % 9]
    path = [(100 + k, 101 + k) for k in range(20)]
    frame = lambda x, a="a", b="b": spark.createDataFrame(x, f"{a} long, {b} long")

    def smallest(links):
        label = {k: k for x in links for k in x}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    want = smallest(tree + path)
    labels = roots(frame(tree + path))
    assert {(x.node, x.component) for x in labels.collect()} == {(k, v) for k, v in want.items() if k != v}
    shuffled = [(b, a) if r.random() < 0.5 else (a, b) for a, b in tree + path]
    assert {(x.node, x.component) for x in components(frame(shuffled + shuffled[:5])).collect()} == set(want.items())
    later = [(want[39], want[110]), (want[110], 500), (want[12], want[39])]
    after = smallest(tree + path + later)
    assert {(x.node, x.component) for x in joined(labels, frame(later, "a_part", "b_part")).collect()} == {(k, v) for k, v in after.items() if k != v}
    assert roots(frame([])).count() == components(frame([])).count() == 0


@pytest.mark.parametrize("block_chars", [2 << 20, 18])
def test_repeated_item_ids_are_one_item(spark, block_chars):
    """Whatever the blocks; a null id hits but is not listed."""
    docs = docs_of(spark, ["one two three four five six", "seven eight", "nine ten one two three", "none at all"])
    items = spark.createDataFrame([("1", "one two three"), ("1", "four five six"), ("2", "one two three"), (None, "seven eight"), ("1", "one two three")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, sorted(r["items"])) for r in decontaminate.contamination(docs, items, block_chars=block_chars).collect()}
    assert got == {0: (6, ["1", "2"]), 1: (2, []), 2: (3, ["1", "2"]), 3: (0, [])}
