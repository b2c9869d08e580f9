"""Main text of web pages by wrapper induction.

Pages of a host share a template.  Two pages of each shape that a host shows twice, the
shortest and one by hash, are wrappers to start from, and so are two of its most common
shape for the others; every page's tree is aligned with those of its shape and with one of the
most common shape by simple tree matching.  A text that stays equal over the host's pages
is template, one that varies is a slot.
Slots outside the article (menus, adverts, forms, comments, by their elements and
names) are dropped too, but no name or form counts that stands on most of the slots'
text; a page without an article keeps the slots that are not mostly links.  Pages that agree with the wrapper in their whole article are copies
and say nothing about the template; those that agree in half of it or more may be
versions of one text and count only where ``MIN_PAGES`` hold the node.

Counts are summed by host, wrapper and node; a page meets its wrappers by joins, so
a large host is spread over tasks.

Defined cases: null or empty html gives an empty text; a null or odd address is
the host ''; a host of one page has no constant texts; repeated rows each give a
row; further columns are not read.  Tags that nothing closes are text; trees of any depth
and pages of any length are aligned, with memory of two bits for each pair of siblings
between the first and the last that differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_dom import Page, align
from .scratch import as_table

#: Pages in which a node must have been seen, unless one of a clearly different text holds it,
#: and the share with equal text, for it to be template.
MIN_PAGES = 8
CONSTANT_PERCENT = 60


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


@lru_cache(maxsize=256)
def _wrapper(source: str) -> Page:
    return Page(source)


def shape_of(html: str = "html") -> Column:
    """A number for the elements and classes that frame a page."""
    low = F.lower(F.col(html))
    found = F.concat(
        F.regexp_extract_all(low, F.lit(r"<(article|aside|div|footer|form|header|main|nav|section|table)\b"), F.lit(1)),
        F.regexp_extract_all(low, F.lit(r"""\sclass\s*=\s*["']?([a-z _-]+)"""), F.lit(1)),
    )
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(found)), ";"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host, wrapper and node: pages that hold it, those with equal text, and both of clearly different pages."""
    sums: dict[tuple[str, int, int], list[int]] = {}
    for batch in batches:
        hosts, pages, seeds = (batch.column(k).to_pylist() for k in range(3))
        for host, source, known in zip(hosts, pages, seeds, strict=True):
            b = None
            for seed in known or ():
                if not source or source == seed["html"]:
                    continue
                b = b or Page(source)
                a = _wrapper(seed["html"])
                pairs = align(a, b)
                main = b.own_leaves()
                size = sum(len(b.text[k]) for k in main)
                like = sum(len(b.text[k]) for k in main if k in pairs and a.text[pairs[k]] == b.text[k])
                if main and like == size:
                    continue
                far = 2 * like < size
                for y, x in pairs.items():
                    if b.text[y] is not None:
                        s = sums.setdefault((host, seed["key"], x), [0, 0, 0, 0])
                        equal = a.text[x] == b.text[y]
                        for i, v in enumerate((1, equal, far, far and equal)):
                            s[i] += v
        if len(sums) > 100_000:
            yield _rows(sums)
            sums.clear()
    yield _rows(sums)


_SUMS = ("seen", "equal", "far_seen", "far_equal")


def _rows(sums: dict[tuple[str, int, int], list[int]]) -> pa.RecordBatch:
    keys = [pa.array([k[i] for k in sums], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays(keys + [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)], ["host", "key", "node", *_SUMS])


def _met(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages, with host and shape, and the wrappers that each is aligned with."""
    listed = seeds.groupBy("s_host", "s_shape").agg(F.collect_list(F.struct("key", "html", "constant", "first")).alias("own"))
    shaped = listed.filter("s_shape IS NOT NULL")
    common = listed.filter("s_shape IS NULL").select(F.col("s_host").alias("c_host"), F.col("own").alias("common"))
    met = pages.join(shaped, (F.col("host") == F.col("s_host")) & (F.col("shape") == F.col("s_shape")), "left").join(common, F.col("host") == F.col("c_host"), "left")
    # the pages of a shape of their own have the common wrappers only
    one = F.filter("common", lambda x: x["first"] & ~F.exists("own", lambda y: y["key"] == x["key"]))
    return met.withColumn("seeds", F.when(F.col("own").isNull(), F.col("common")).otherwise(F.concat("own", one))).drop("s_host", "s_shape", "c_host", "own", "common")


def wrappers(pages: DataFrame, min_pages: int = MIN_PAGES, constant_percent: int = CONSTANT_PERCENT) -> DataFrame:
    """(s_host, s_shape, key, first, html, constant): wrapper pages and their template nodes; a null shape is for all of the host.  pages has host, html and shape."""
    some = pages.filter("html <> ''").withColumn("key", F.xxhash64("html"))
    groups = some.groupBy("host", "shape").agg(F.min(F.struct(F.length("html").alias("n"), "key"))["key"].alias("short"), F.min("key").alias("any"), F.max("key").alias("other"), F.approx_count_distinct("key").alias("n"))
    groups = as_table(groups, "shapes")
    most = groups.groupBy("host").agg(F.max_by(F.struct("short", "any"), F.struct("n", "shape")).alias("m")).select("host", F.lit(None).cast("long").alias("shape"), "m.short", "m.any")
    chosen = groups.filter("any <> other").select("host", "shape", "short", "any").unionByName(most)
    chosen = chosen.select(F.col("host").alias("s_host"), F.col("shape").alias("s_shape"), "any", F.explode(F.array_distinct(F.array("short", "any"))).alias("s_key"))
    first = F.col("s_key") == F.col("any")
    texts = some.join(chosen.select(F.col("s_host").alias("k_host"), F.col("s_key").alias("k_key")).distinct(), (F.col("host") == F.col("k_host")) & (F.col("key") == F.col("k_key")), "left_semi").select("host", "key", "html").dropDuplicates(["host", "key"])
    seeds = chosen.withColumn("first", first).join(texts, (F.col("s_host") == F.col("host")) & (F.col("s_key") == F.col("key"))).select("s_host", "s_shape", "key", "first", "html")
    seeds = as_table(seeds, "wrappers")
    met = _met(some.select("host", "html", "shape"), seeds.withColumn("constant", F.lit(None).cast("array<int>"))).select("host", "html", F.transform("seeds", lambda x: F.struct(x["key"].alias("key"), x["html"].alias("html"))).alias("seeds"))
    nodes = met.mapInArrow(_compare, "host string, key long, node int, seen long, equal long, far_seen long, far_equal long").groupBy("host", "key", "node").agg(*[F.sum(x).alias(x) for x in _SUMS])
    enough = (F.col("seen") >= min_pages) & (100 * F.col("equal") >= constant_percent * F.col("seen"))
    same = nodes.filter(enough | ((F.col("far_seen") > 0) & (100 * F.col("far_equal") >= constant_percent * F.col("far_seen"))))
    constant = same.groupBy(F.col("host").alias("n_host"), F.col("key").alias("n_key")).agg(F.collect_list("node").alias("constant"))
    return as_table(seeds.join(constant, (F.col("s_host") == F.col("n_host")) & (F.col("key") == F.col("n_key")), "left").drop("n_host", "n_key"), "templates")


def page_text(source: str | None, seeds: list[dict] | None = None) -> str:
    if not source:
        return ""
    page = Page(source)
    same: set[int] = set()
    for seed in seeds or ():
        if seed["constant"]:
            wrapper, fixed = _wrapper(seed["html"]), set(seed["constant"])
            same |= {y for y, x in align(wrapper, page).items() if x in fixed and wrapper.text[x] == page.text[y]}
    return " ".join(page.text[k] for k in page.main_leaves(frozenset(same)))


def _extract(schema_names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True)
        texts = [page_text(*r) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], schema_names)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host")).withColumn("shape", shape_of())
    known = wrappers(own.select("host", "html", "shape"), **options)
    met = _met(own, known).select("page_id", "url", "html", F.transform("seeds", lambda x: F.struct(x["html"].alias("html"), x["constant"].alias("constant"))).alias("seeds"))
    return met.mapInArrow(partial(_extract, ["page_id", "url", "text", "n_chars"]), "page_id long, url string, text string, n_chars long")
