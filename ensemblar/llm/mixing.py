"""Mixing sources to target weights through a splitting tree.

Every source is cut into blocks by a hash of the document ids, and the blocks are
permuted by another hash.  A source's target in words becomes whole passes over
its blocks and a first part of one more pass, whose last block is cut at the
document nearest to the target.  The numbers of blocks of all sources are then
split over a binary tree of output shards by multivariate hypergeometric draws,
so that each shard gets the share that a random deal of all blocks would give it;
each leaf takes its own range of each source's permuted blocks, and a shard is
shuffled by a hash of document and copy.  All draws come from hashes: reruns agree.

The driver holds plans only.  Block tables have at most ``BLOCKS`` rows a source.

Defined cases: a null or blank text has size 0 and taken 0; a null source is a
source, ordered last; a null id is an id; repeated rows are documents of their own
in the same block; an empty table gives an empty mix; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import as_table, content_key, durable, unused

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_TIMES = 2
#: Blocks of a source, at most.
BLOCKS = 4096
#: Output shards: two to this power.
DEPTH = 6
SEED = 20240229

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_times: int = MAX_TIMES) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target), by water-filling.

    In the order of limit / weight, a source stands at its limit if filling all the later
    ones to its level would not use up what is left; the rest share that by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, limit = Window.partitionBy(), F.col("source_size").cast("decimal(38,0)") * max_times
    return (
        ranked.withColumn("used", F.sum(limit).over(fill) - limit)
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("to_share", F.sum("source_size").over(whole).cast("decimal(38,0)") * share_percent)
        .withColumn("full", 100 * (limit * F.col("open") + F.col("weight") * F.col("used")) <= F.col("weight") * F.col("to_share"))
        .withColumn("left", F.min(F.when(~F.col("full"), F.struct("used", (-F.col("open")).alias("open")))).over(whole))
        .select(
            "source", "source_size", "weight",
            F.when(F.col("full"), F.col("source_size").cast("double") * max_times)
            .otherwise(F.col("weight") * ((F.col("to_share").cast("double") - 100 * F.col("left.used").cast("double")) / 100.0) / -F.col("left.open")).alias("target"),
        )
    )


def _split(node: str, quotas: str, seed: int) -> str:
    """SQL for the left child's quotas: one hypergeometric draw for each source, given those before it.

    A draw inverts the distribution function by the ratio of neighbouring terms, over 45
    standard deviations on both sides of the mean: what lies outside is below the smallest double.
    """
    total = f"aggregate({quotas}, 0L, (t, q) -> t + q)"
    mean = "(p.n * p.k / p.m)"
    reach = f"(45 * sqrt({mean} * (1 - p.k / p.m) * (p.m - p.n) / greatest(p.m - 1, 1)) + 45)"
    low = f"cast(greatest(0, p.n - (p.m - p.k), floor({mean} - {reach})) as bigint)"
    high = f"cast(least(p.n, p.k, ceil({mean} + {reach})) as bigint)"
    ratio = "((p.k - x) * (p.n - x) / ((x + 1) * (p.m - p.k - p.n + x + 1D)))"
    terms = f"aggregate(sequence({low}, {high}), named_struct('w', 1e-300D, 't', 0D), (s, x) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w), s -> s.t)"
    found = f"aggregate(sequence({low}, {high}), named_struct('w', 1e-300D, 't', 0D, 'x', cast(null as bigint)), (s, x) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w, 'x', coalesce(s.x, if(s.t + s.w >= p.u * p.t, x, null))), s -> coalesce(s.x, {high}))"
    u = f"((xxhash64({node}, a.i, {seed}) & 9007199254740991L) / 9007199254740992D)"
    first = f"named_struct('m', a.m, 'n', a.n, 'k', q, 'u', {u}, 't', 0D)"
    weighed = f"transform(array({first}), p -> named_struct('m', p.m, 'n', p.n, 'k', p.k, 'u', p.u, 't', {terms}))"
    draw = f"if(a.m = 0, 0L, transform({weighed}, p -> {found})[0])"
    step = f"transform(array({draw}), d -> named_struct('i', a.i + 1L, 'm', a.m - q, 'n', a.n - d, 'out', concat(a.out, array(d))))[0]"
    start = f"named_struct('i', 0L, 'm', {total}, 'n', ({total} + 1L) div 2, 'out', cast(array() as array<bigint>))"
    return f"aggregate({quotas}, {start}, (a, q) -> {step}, a -> a.out)"


def shard_quotas(units: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(source, units) to (source, shard, quota): exact numbers of blocks for each of 2**depth shards."""
    root = units.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "units"))).alias("x"))
    nodes = root.select(F.lit(1).cast("long").alias("node"), F.transform("x", lambda s: s["source"]).alias("sources"), F.transform("x", lambda s: s["units"].cast("long")).alias("q"))
    for _ in range(depth):
        split = nodes.withColumn("l", F.expr(_split("node", "q", seed)))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(q, l, (x, y) -> x - y)").alias("q")))
        nodes = split.select("sources", F.explode(sides).alias("s")).select(F.col("s.node").alias("node"), "sources", F.col("s.q").alias("q"))
    leaf = nodes.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.explode(F.arrays_zip("sources", "q")).alias("x"))
    return leaf.select(F.col("x.sources").alias("source"), "shard", F.col("x.q").alias("quota"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, and the block that a hash of the id gives; and row_col, if given, as row."""
    key = F.xxhash64(F.col(id_col).cast("long"), F.lit(seed))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.shiftright(key, 16).alias("place"), *([F.col(row_col).alias("row")] if row_col else []))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_times: int = MAX_TIMES, blocks: int = BLOCKS, depth: int = DEPTH, seed: int = SEED, **columns: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and the shard of each copy."""
    sizes = as_table(sized(docs, blocks=blocks, seed=seed, **columns), "sizes")
    block = durable(sizes.groupBy("source", "block").agg(F.sum("size").alias("words")))
    want = targets(block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share_percent, max_times)
    want = want.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    want = durable(want.withColumnRenamed("source", "w_source"))

    order = F.xxhash64("source", "block", F.lit(seed + 1))
    before = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = block.withColumn("before", F.sum("words").over(before) - F.col("words")).join(want, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    laid = laid.withColumn("last", F.when(F.col("before") + F.col("words") <= F.col("rest"), "whole").when(F.col("before") < F.col("rest"), "part").otherwise("none"))
    laid = laid.withColumn("n_units", F.when(F.col("words") == 0, 0).otherwise(F.col("passes") + (F.col("last") != "none").cast("int")))
    laid = durable(laid)

    # units (block, pass) in permuted order meet the shards' ranges
    unit = laid.filter("n_units > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("n_units"))).alias("copy"))
    ranked = unit.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 2)), "block", "copy")).cast("long"))
    quota = shard_quotas(laid.groupBy("source").agg(F.sum("n_units").cast("long").alias("units")), depth, seed).filter("quota > 0")
    ends = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    slots = quota.withColumn("end", ends).select(F.col("source").alias("s_source"), "shard", F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("s_rank"))
    dealt = ranked.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("rank") == F.col("s_rank")))
    shards = dealt.groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("unit_shards"))
    plan = laid.join(shards, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left").drop("d_source", "d_block")
    plan = plan.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "source_size", "target", "passes", "last", (F.col("rest") - F.col("before")).alias("room"), F.coalesce("unit_shards", F.array().cast("array<int>")).alias("unit_shards"))

    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    # only a source's last block is cut: its documents are taken in hash order, up to the one nearest to the target
    cut = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = joined.filter("last = 'part'").withColumn("sum", F.sum("size").over(cut)).withColumn("more", (F.col("sum") - F.col("size") / 2 <= F.col("room")).cast("int")).drop("sum")
    rest = joined.filter("last <> 'part'").withColumn("more", (F.col("last") == "whole").cast("int"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + F.col("more"))
    return (
        rest.unionByName(part)
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.slice("unit_shards", F.lit(1), F.col("copies")).alias("shards"), *(["row"] if "row_col" in columns else []))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mixed documents: a row for each copy, with all columns, its shard and copy number, shuffled inside the shards."""
    key, m_key, drawn, nth, copy, shard = unused(docs, "content_key", "mix_key", "mix_drawn", "mix_nth", "mix_copy", "mix_shard")
    rows = docs.withColumn(key, content_key(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string")))
    plan = mix_plan(rows, id_col=id_col, text_col=text_col, source_col=source_col, row_col=key, seed=seed, **options)
    own = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # rows that are equal in all three have a list of draws, and each takes one of them
    lists = plan.groupBy(F.col("row").alias(m_key)).agg(F.sort_array(F.collect_list("shards")).alias(drawn)).filter(F.exists(drawn, lambda x: F.size(x) > 0))
    met = rows.join(lists, F.col(key) == F.col(m_key)).withColumn(nth, F.row_number().over(Window.partitionBy(m_key).orderBy(F.xxhash64(*docs.columns))) - 1)
    out = met.select(*docs.columns, F.posexplode(F.get(drawn, F.col(nth))).alias(copy, shard))
    return out.repartition(shard, F.pmod(F.xxhash64(id_col), F.lit(16))).sortWithinPartitions(shard, F.xxhash64(F.col(id_col), F.col(copy), F.lit(seed + 3)))
