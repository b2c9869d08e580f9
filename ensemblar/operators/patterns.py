"""Transition matrices, sequences and repeated patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELL, dealt, grown, names, over, ratio
from ..functions.shared import checkpointed
from .bitmaps import OCCURRENCES, TRANSACTIONS, by_size, gathered, mined, stable
from .events import surrogate_dither
from .stats import top_k_by


#: Frames of the blocks in which spikes meet: at least so many, and four windows.
BLOCK = 16


def _block(frame: Column, size: int) -> Column:
    return F.floor(frame / size).cast("int")


def _followers(onsets: DataFrame, start: int, window: int) -> DataFrame:
    """Rows (session_id, src, dst, frame, frame2): dst fires start to start + window - 1 frames after src.

    Spikes meet by blocks of frames, so pairs of a block are counted where they are made.
    """
    size, first = max(BLOCK, 4 * window), F.col("frame") + start
    last = first + window - 1
    a = onsets.select("session_id", F.col("cell").alias("src"), "frame", F.explode(F.sequence(_block(first, size), _block(last, size))).alias("_k"))
    b = onsets.select("session_id", F.col("cell").alias("dst"), F.col("frame").alias("frame2"), _block(F.col("frame"), size).alias("_k"))
    met = dealt(a, "session_id", "_k").join(grown(dealt(b, "session_id", "_k")), ["session_id", "_k"])
    return met.filter(F.col("frame2").between(first, last)).select("session_id", "src", "dst", "frame", "frame2")


def _normalised(counts: DataFrame, by: Sequence[str] = ("session_id", "src")) -> DataFrame:
    return counts.withColumn("p", ratio(F.col("w"), F.sum("w").over(over(by)))).filter("w > 0").drop("w")


def transition_matrix(onsets: DataFrame, start: int = 1, window: int = 5, rates: DataFrame | None = None, subtract: float = 0.0) -> DataFrame:
    """(session_id, src, dst, p): how dst follows src, by row.

    rates (session_id, cell, rate): each follower weighs 1 - rate.  subtract: share of the reverse
    count that is taken off (0.2 for a fifth); what is negative then counts as 0.
    """
    f = _followers(onsets, start, window).filter("src <> dst")
    n = f.groupBy("session_id", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if rates is not None:
        # one product a pair, after the count: the order of the rows changes nothing
        n = n.join(rates.select("session_id", F.col("cell").alias("dst"), "rate"), ["session_id", "dst"]).select("session_id", "src", "dst", (F.col("w") * (1 - F.col("rate"))).alias("w"))
    if subtract:
        back = n.select("session_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("_b"))
        n = n.join(back, ["session_id", "src", "dst"], "left").withColumn("w", F.greatest(F.lit(0.0), F.col("w") - subtract * F.coalesce("_b", F.lit(0.0)))).drop("_b")
    return _normalised(n)


def transition_matrix_adaptive(onsets: DataFrame, sessions: DataFrame, start: int = 1, window: int = 5, busy_share: float = 0.0128, prior: float = 1.0) -> DataFrame:
    """A uniform prior plus followers outside busy windows, each by one over its cell's number of spikes; by row."""
    c = sessions.select("session_id", "n_cells")
    starts = onsets.withColumn("frame", F.explode(F.sequence(F.col("frame") - start - window + 1, F.col("frame") - start)))
    load = starts.groupBy("session_id", "frame").agg(F.count("cell").alias("n")).join(c, "session_id")
    busy = load.filter(F.col("n") > busy_share * F.col("n_cells") * window).select("session_id", "frame")
    spikes = onsets.groupBy("session_id", F.col("cell").alias("dst")).agg(F.count("frame").alias("n"))
    f = _followers(onsets, start, window).filter("src <> dst").join(busy, ["session_id", "frame"], "left_anti").join(spikes, ["session_id", "dst"]).groupBy("session_id", "src", "dst").agg(F.sum(1 / F.col("n")).alias("x"))
    cells = onsets.select(*CELL).distinct()
    all_ = cells.select("session_id", F.col("cell").alias("src")).join(cells.select("session_id", F.col("cell").alias("dst")), "session_id").filter("src <> dst").join(c, "session_id")
    return _normalised(all_.join(f, ["session_id", "src", "dst"], "left").select("session_id", "src", "dst", (prior / F.col("n_cells") + F.coalesce("x", F.lit(0.0))).alias("w")))


def transition_matrix_order2(onsets: DataFrame, rates: DataFrame, start: int = 1, window: int = 3) -> DataFrame:
    """(session_id, a, b, c, p): triples with both steps in the window, weighed by the rates of b and c, by a."""
    one = _followers(onsets, start, window).filter("src <> dst").select("session_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("frame2").alias("frame"))
    two = _followers(onsets, start, window).filter("src <> dst").select("session_id", F.col("src").alias("b"), F.col("dst").alias("c"), "frame")
    r = lambda x: rates.select("session_id", F.col("cell").alias(x), F.col("rate").alias(f"r{x}"))
    d = one.join(two, ["session_id", "b", "frame"]).filter("a <> c").join(r("b"), ["session_id", "b"]).join(r("c"), ["session_id", "c"])
    return _normalised(d.groupBy("session_id", "a", "b", "c").agg(F.sum(F.col("rb") + F.col("rc")).alias("w")), ("session_id", "a"))


def next_candidates(matrix: DataFrame, n_cells: DataFrame, factor: float = 1.0, k: int = 3) -> DataFrame:
    """The k likeliest successors above factor / (n - 1); n_cells: (session_id, n)."""
    d = matrix.join(n_cells, "session_id").filter(F.col("p") > factor / (F.col("n") - 1)).drop("n")
    return top_k_by(d, ("session_id", "src"), [F.col("p").desc(), F.col("dst")], k)


def likely_sequences(matrix: DataFrame, n_cells: DataFrame, depth: int, branches: int = 10, factor: float = 1.0, k: int = 3) -> DataFrame:
    """Beam search from every cell: at most ``branches`` paths of each, no cell twice, ``depth`` cells at most.

    Paths that cannot go on stay as they are.
    """
    step = checkpointed(next_candidates(matrix, n_cells, factor, k).select("session_id", F.col("src").alias("_last"), "dst", F.col("p").alias("_p")))
    start = matrix.select("session_id", F.col("src").alias("start")).distinct()
    front = start.select("session_id", "start", F.array(F.col("start")).alias("cells"), F.lit(1.0).alias("p"))
    done = None
    for _ in range(depth - 1):
        wide = front.withColumn("_last", F.element_at("cells", -1)).join(step, ["session_id", "_last"], "left")
        ok = F.col("dst").isNotNull() & ~F.array_contains("cells", F.coalesce("dst", F.lit(-1)))
        grown = wide.filter(ok).select("session_id", "start", F.concat("cells", F.array("dst")).alias("cells"), (F.col("p") * F.col("_p")).alias("p"))
        ended = front.join(wide.filter(ok).select("session_id", "cells").distinct(), ["session_id", "cells"], "left_anti").select(*front.columns)
        done = ended if done is None else done.unionByName(ended)
        front = checkpointed(top_k_by(grown, ("session_id", "start"), [F.col("p").desc(), F.col("cells")], branches))
    return top_k_by(done.unionByName(front) if done is not None else front, ("session_id", "start"), [F.size("cells").desc(), F.col("p").desc(), F.col("cells")], branches)


def sequence_occurrences(onsets: DataFrame, sequences: DataFrame, start: int = 1, window: int = 5, repetitions: int = 2) -> DataFrame:
    """Times at which the cells of each sequence (session_id, cells) fire in its order, each within the window of the one before.

    Steps are equi-joins on the next cell and frame; the earliest next spike is taken.
    """
    longest = sequences.agg(F.max(F.size("cells"))).first()[0] or 0
    o = onsets.select("session_id", F.col("cell").alias("_c"), F.col("frame").alias("_f"))
    first = sequences.select("session_id", "cells", F.element_at("cells", 1).alias("_c")).join(o, ["session_id", "_c"])
    now = first.select("session_id", "cells", F.array("_f").alias("times"))
    whole = None
    for k in range(2, longest + 1):
        ended = now.filter(F.size("cells") < k)
        whole = ended if whole is None else whole.unionByName(ended)
        last = F.element_at("times", -1)
        wide = now.filter(F.size("cells") >= k).select("session_id", "cells", "times", F.get("cells", F.lit(k - 1)).alias("_c"), F.explode(F.sequence(last + start, last + start + window - 1)).alias("_f"))
        now = wide.join(o, ["session_id", "_c", "_f"]).groupBy("session_id", "cells", "times").agg(F.min("_f").alias("_f")).select("session_id", "cells", F.concat("times", F.array("_f")).alias("times"))
    whole = now if whole is None else whole.unionByName(now)
    n = F.count(F.lit(1)).over(over(["session_id", "cells"]))
    return whole.withColumn("_n", n).filter(F.col("_n") >= repetitions).drop("_n")


def group_by_time_profile(occurrences: DataFrame, tolerance: int = 0) -> DataFrame:
    """Occurrences with equal gaps between spikes (rounded to 2 x tolerance + 1 frames) as groups."""
    gaps = F.zip_with(F.slice("times", F.lit(2), F.size("times") - 1), F.slice("times", F.lit(1), F.size("times") - 1), lambda a, b: F.floor((a - b) / (2 * tolerance + 1)).cast("int"))
    return occurrences.groupBy("session_id", "cells", gaps.alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("times")[0]).alias("first_time"))


def prune_prefixes(occurrences: DataFrame, repetitions: int = 2) -> DataFrame:
    """(session_id, cells, starts) without rare sequences and prefixes that start just where a longer one does."""
    s = occurrences.groupBy("session_id", "cells").agg(F.sort_array(F.collect_set(F.col("times")[0])).alias("starts")).filter(F.size("starts") >= repetitions)
    longer = s.filter(F.size("cells") > 1).select("session_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("cells") - 1), lambda k: F.slice("cells", F.lit(1), k))).alias("cells"), "starts")
    return s.join(longer.distinct(), ["session_id", "cells", "starts"], "left_anti")


def order_score(onsets: DataFrame, order: DataFrame, reach: int = 3, window: int = 5) -> DataFrame:
    """Loss of an order (session_id, [candidate,] cell, rank) from 0 to 1.

    For pairs of cells at most ``reach`` ranks apart, each spike of the earlier one looks for the
    later one in the window to both sides; a delay below 0 counts its size, none the whole window.
    """
    by = ["session_id", *[c for c in order.columns if c not in ("session_id", "cell", "rank")]]
    a = order.withColumnRenamed("cell", "src").withColumnRenamed("rank", "_r1")
    b = order.withColumnRenamed("cell", "dst").withColumnRenamed("rank", "_r2")
    pairs = a.join(b, by).filter((F.col("_r2") > F.col("_r1")) & (F.col("_r2") - F.col("_r1") <= reach)).select(*by, "src", "dst")
    # a pair's delays are the same in every order that has it: they are summed once, and orders add up sums
    spikes = onsets.select(*CELL, "frame").distinct().groupBy("session_id", F.col("cell").alias("src")).agg(F.count(F.lit(1)).alias("_n"))
    each = pairs.join(_delays(onsets, window), ["session_id", "src", "dst"], "left").join(spikes, ["session_id", "src"])
    missed = (F.col("_n") - F.coalesce("_found", F.lit(0))) * window
    return each.groupBy(*by).agg((F.sum(F.coalesce("_late", F.lit(0)) + missed) / (F.sum("_n") * window)).alias("loss"))


def _delays(onsets: DataFrame, window: int) -> DataFrame:
    """(session_id, src, dst, _found, _late): spikes of src with one of dst at most ``window`` frames off, and by how much the nearest ones are early.

    Spikes meet by blocks of frames; only those near a border are copied to the block beside.
    """
    size = max(BLOCK, 4 * window)
    a = onsets.select("session_id", _block(F.col("frame"), size).alias("_k"), F.col("cell").alias("src"), "frame")
    f2 = F.col("frame")
    b = onsets.select("session_id", F.col("cell").alias("dst"), f2.alias("_f2"), F.explode(F.sequence(_block(f2 - window, size), _block(f2 + window, size))).alias("_k"))
    met = dealt(a, "session_id", "_k").join(grown(dealt(b, "session_id", "_k")), ["session_id", "_k"]).filter(F.abs(F.col("_f2") - F.col("frame")) <= window)
    # the nearest partner, the later one on ties: twice the distance, and one for the earlier
    d = F.col("_f2") - F.col("frame")
    near = met.groupBy("session_id", "_k", "src", "dst", "frame").agg(F.min(2 * F.abs(d) + F.when(d < 0, 1).otherwise(0)).alias("_d"))
    late = F.when(F.col("_d") % 2 == 1, F.floor(F.col("_d") / 2)).otherwise(0)
    return near.groupBy("session_id", "src", "dst").agg(F.count(F.lit(1)).alias("_found"), F.sum(late).alias("_late"))


def order_cells(onsets: DataFrame, candidates: DataFrame, reach: int = 3, window: int = 5) -> DataFrame:
    """The candidate order (session_id, candidate, cells) with the lowest loss; cells outside it follow by number."""
    cells = onsets.select(*CELL).distinct()
    listed = candidates.select("session_id", "candidate", F.posexplode("cells").alias("_k", "cell"))
    all_ = candidates.select("session_id", "candidate").join(cells, "session_id").join(listed, ["session_id", "candidate", "cell"], "left")
    rank = F.row_number().over(over(["session_id", "candidate"], F.col("_k").asc_nulls_last(), "cell"))
    order = all_.select("session_id", "candidate", "cell", rank.alias("rank"))
    score = order_score(onsets, order, reach, window)
    return score.groupBy("session_id").agg(F.min_by(F.struct("candidate", "loss"), F.struct("loss", "candidate")).alias("b")).select("session_id", "b.candidate", "b.loss")


# -- repeated patterns ------------------------------------------------------------------------------------


#: Bins whose windows are made in one place.
BINS = 64


def spike_windows(onsets: DataFrame, bin_frames: int, length: int, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Transactions (session_id, window, items): every window of bins with a spike in its first bin; item = cell x length + bin.

    Bins are dealt by blocks of windows, the first ones of a block to the block before as well; the cells of a bin are a
    row, and a window is put together from the rows of its bins.
    """
    by = names(by)
    b = onsets.dropna(subset=by).select(*by, "cell", F.floor(F.col("frame") / bin_frames).cast("int").alias("bin"))
    blocks = F.sequence(_block(F.col("bin") - length + 1, BINS), _block(F.col("bin"), BINS))
    rows = dealt(b.select("*", F.explode(blocks).alias("_k")), *by, "_k").groupBy(*by, "_k", "bin").agg(F.collect_set("cell").alias("cells"))
    near = F.collect_list(F.struct("bin", "cells")).over(over([*by, "_k"], "bin").rangeBetween(0, length - 1))
    heads = rows.withColumn("_x", near).filter(_block(F.col("bin"), BINS) == F.col("_k"))
    items = F.flatten(F.transform("_x", lambda r: F.transform(r["cells"], lambda c: c * length + r["bin"] - F.col("bin"))))
    return heads.select(*by, F.col("bin").alias("window"), F.array_sort(items).alias("items"))


def spike_sizes(onsets: DataFrame, bin_frames: int, length: int) -> DataFrame:
    """(session_id, short): sessions whose windows are few enough for one task, from the spikes alone."""
    bin_ = F.floor(F.col("frame") / bin_frames)
    n = onsets.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), (F.max(bin_) - F.min(bin_) + 1).alias("w"))
    return n.select("session_id", ((F.least("n", "w") <= TRANSACTIONS) & (F.col("n") * length <= OCCURRENCES)).alias("short"))


#: Parts into which the transactions of one session are dealt before they are numbered.
PARTS = 64


def vertical(transactions: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """(by, items of one, block, bits): in which of 64 transactions each item is.

    Blocks are filled from one session's part after another's, so most of them belong to one session.
    """
    by = names(by)
    dealt = transactions.repartition(*by, F.pmod(F.xxhash64("items", *(["window"] if "window" in transactions.columns else [])), F.lit(PARTS))).sortWithinPartitions(*by)
    numbered = dealt.withColumn("_t", F.monotonically_increasing_id())
    one = numbered.select(*by, F.explode(F.array_distinct("items")).alias("item"), F.expr("_t div 64").alias("block"), F.expr("shiftleft(1L, cast(_t % 64 as int))").alias("bit"))
    # numbers hold for one run only: they are kept
    return checkpointed(one.groupBy(*by, F.array("item").alias("items"), "block").agg(F.bit_or("bit").alias("bits")))


def _frequent(level: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    return level.groupBy(*by, "items").agg(F.sum(F.bit_count("bits")).cast("long").alias("cnt")).filter(F.col("cnt") >= least)


def frequent_patterns(transactions: DataFrame, least: int, min_size: int = 2, max_size: int = 10, length: int | None = None, min_cells: int = 1, closed: bool = True, by: Sequence[str] = ("session_id",), sizes: DataFrame | None = None) -> DataFrame:
    """(session_id, items, size, cnt) of item sets found at least ``least`` times in a session.

    Short sessions are mined in stacks, each whole in its task; the transactions of longer ones are dealt to blocks.
    sizes: (keys of ``by``, short) where known without the transactions.

    closed: without sets of which a superset of one more item has the same count.  length: bins of a window; then
    patterns must use the first bin and ``min_cells`` cells.
    """
    out = _mined(transactions, least, min_size, max_size, closed, names(by), sizes)
    if length:
        first = F.exists("items", lambda i: i % length == 0)
        cells = F.size(F.array_distinct(F.transform("items", lambda i: F.floor(i / length))))
        out = out.filter(first & (cells >= min_cells))
    return out


def _mined(transactions: DataFrame, least: int, min_size: int, max_size: int, closed: bool, by: list[str], sizes: DataFrame | None = None, told: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Sets of short and long sessions; told: what is kept of them, for each session apart."""
    short, long = by_size(transactions.dropna(subset=by), by, sizes)
    out = []
    if short is not None:
        out.append(checkpointed(told(mined(gathered(short, by), by, least, min_size, max_size, closed))))
    if long is not None or not out:
        out.append(told(_mined_by_blocks(transactions.dropna(subset=by) if long is None else long, least, min_size, max_size, closed, by)))
    return reduce(DataFrame.unionByName, out)


def _mined_by_blocks(transactions: DataFrame, least: int, min_size: int, max_size: int, closed: bool, by: list[str]) -> DataFrame:
    """Vertical mining, one size after another: a set is the rows of the blocks of 64 transactions that hold it, as bits.

    Two sets that differ in their last item only meet by (session, common items, block), and their bits
    together are those of the set of both; a set's count is the sum over its blocks.  So a step is an equi-join of
    bounded rows, whatever a session's length, and sets of one beginning go on together.  For closed sets, sizes go
    one beyond ``max_size``.
    """
    level, found = vertical(transactions, by), []
    counts = checkpointed(_frequent(level, by, least))
    for size in range(1, max_size + 1 + closed):
        if counts.isEmpty():
            break
        found.append((size, counts))
        if size == max_size + closed:
            break
        level = level.join(counts.drop("cnt"), [*by, "items"], "left_semi")
        level = level.select(*by, F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"), "block", "bits") if size > 1 else level.select(*by, F.col("items")[0].alias("last"), "block", "bits")
        head = ["head"] if size > 1 else []
        other = level.select(*by, *head, F.col("last").alias("last2"), "block", F.col("bits").alias("bits2"))
        met = level.join(other, [*by, *head, "block"]).filter("last < last2 AND (bits & bits2) <> 0")
        items = F.concat(*head, F.array("last", "last2")) if head else F.array("last", "last2")
        level = checkpointed(met.select(*by, items.alias("items"), "block", F.expr("bits & bits2").alias("bits")))
        counts = checkpointed(_frequent(level, by, least))
    out = None
    for k, (size, c) in enumerate(found):
        if size > max_size or size < min_size:
            continue
        if closed and k + 1 < len(found):
            drop = F.explode(F.transform("items", lambda x: F.array_remove("items", x)))
            c = c.join(found[k + 1][1].select(*by, drop.alias("items"), "cnt").distinct(), [*by, "items", "cnt"], "left_anti")
        c = c.select(*by, "items", F.lit(size).alias("size"), "cnt")
        out = c if out is None else out.unionByName(c)
    if out is None:
        out = counts.select(*by, "items", F.lit(0).alias("size"), "cnt").filter("false")
    return out


def pattern_spectrum(patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return patterns.groupBy("session_id", *names(by), "size", "cnt").agg(F.count(F.lit(1)).alias("n"))


def pvalue_spectrum(surrogate_patterns: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Share of n surrogates with a pattern of at least each (size, cnt); surrogate_patterns has k, sizes (session_id, size, cnt) the signatures asked for."""
    top = surrogate_patterns.groupBy("session_id", "k", "size").agg(F.max("cnt").alias("m"))
    asked = sizes.select("session_id", "size", "cnt").distinct()
    met = asked.join(top.withColumnRenamed("size", "_z"), "session_id").filter((F.col("_z") >= F.col("size")) & (F.col("m") >= F.col("cnt")))
    hit = met.groupBy("session_id", "size", "cnt").agg((F.count_distinct("k") / n).alias("p"))
    return asked.join(hit, ["session_id", "size", "cnt"], "left").select("session_id", "size", "cnt", F.coalesce("p", F.lit(0.0)).alias("p"))


def surrogate_spectrum(onsets: DataFrame, sessions: DataFrame, patterns: DataFrame, n: int, width: int, bin_frames: int, length: int, seed: int = 0) -> DataFrame:
    """(session_id, size, cnt, p): p-values of the patterns' signatures from n dithered copies of the spikes.

    All copies are one job: the copy's number is a key beside the session.  They are mined for the sizes and
    counts of the patterns only, so most of a copy's sets end after a step or two.
    """
    asked = patterns.agg(F.min("cnt"), F.min("size"), F.max("size")).first()
    if asked[0] is None:
        return patterns.select("session_id", "size", "cnt", F.lit(0.0).alias("p")).filter("false")
    least, smallest, largest = asked
    copies = onsets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # frames may meet: windows hold each item once; a copy has no more spikes than its session, and no further ones
    dithered = surrogate_dither(copies, sessions, width, F.col("k"), seed, by=("k",), once=False)
    key = ["session_id", "k"]
    tops = _mined(spike_windows(dithered, bin_frames, length, key), least, smallest, largest, False, key, spike_sizes(onsets, bin_frames, length), lambda d: d.groupBy(*key, "size").agg(F.max("cnt").alias("cnt")))
    return pvalue_spectrum(tops, patterns, n)


def correct_pvalues(df: DataFrame, alpha: float = 0.05, method: str = "fdr", by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Adds significant: none, bonferroni, fdr (step up) or holm (step down)."""
    by = names(by)
    w, all_ = over(by, "p", *[c for c in df.columns if c not in (*by, "p")]), over(by)
    m, rank = F.count(F.lit(1)).over(all_), F.row_number().over(w)
    if method == "none":
        return df.withColumn("significant", F.col("p") <= alpha)
    if method == "bonferroni":
        return df.withColumn("significant", F.col("p") <= alpha / m)
    d = df.withColumn("_r", rank).withColumn("_m", m)
    if method == "fdr":
        last = F.max(F.when(F.col("p") <= alpha * F.col("_r") / F.col("_m"), F.col("_r"))).over(all_)
        return d.withColumn("significant", F.col("_r") <= F.coalesce(last, F.lit(0))).drop("_r", "_m")
    if method == "holm":
        fail = F.min(F.when(F.col("p") > alpha / (F.col("_m") - F.col("_r") + 1), F.col("_r"))).over(all_)
        return d.withColumn("significant", fail.isNull() | (F.col("_r") < fail)).drop("_r", "_m")
    raise ValueError(f"no correction named {method}")


def filter_patterns(patterns: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Patterns whose signature (size, cnt) is significant."""
    return patterns.join(spectrum.filter("NOT significant").select("session_id", "size", "cnt"), ["session_id", "size", "cnt"], "left_anti").select(*patterns.columns)


def _occurrences(patterns: DataFrame, transactions: DataFrame) -> DataFrame:
    """(session_id, items, size, window, t_items) of the windows that hold each pattern, met by its rarest item."""
    one = transactions.select("session_id", "window", F.col("items").alias("t_items"), F.explode("items").alias("item"))
    often = one.groupBy("session_id", "item").agg(F.count(F.lit(1)).alias("_n"))
    rare = patterns.select("session_id", "items", "size", F.explode("items").alias("item")).join(often, ["session_id", "item"]).groupBy("session_id", "items", "size").agg(F.min_by("item", F.struct("_n", "item")).alias("item"))
    met = rare.join(one, ["session_id", "item"])
    return met.filter(F.size(F.array_intersect("items", "t_items")) == F.col("size")).select("session_id", "items", "size", "window", "t_items")


def _items_hash() -> Column:
    return F.aggregate("items", F.lit(0).cast("long"), lambda a, i: F.pmod(a * 31 + i, F.lit(65521)))


def _subset_draw(h, window, k, seed: int):
    """A number for each pattern, window and subset that reruns agree on; none is below 0."""
    return (((h * 7919 + window * 40503 + k * 104729 + seed) % 999983 + 999983) % 999983 * 48271) % 65521


#: Patterns of a short session that meet its transactions in one row.
PATTERNS = 4096


def pattern_stability(patterns: DataFrame, transactions: DataFrame, n_subsets: int = 20, seed: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Share of random subsets of a pattern's windows whose common items are just the pattern.

    Subsets of short sessions are bitmaps in their task, windows of longer ones are met by joins.
    sizes: (session_id, short) where known without the transactions.
    """
    by = ["session_id"]
    short, long = by_size(transactions.dropna(subset=by), by, sizes)
    hits = []
    if short is not None:
        found = patterns.select(*by, "items").filter(F.size("items") > 0)
        n = found.groupBy(*by).agg(F.ceil(F.count("items") / PATTERNS).alias("n"))
        parts = found.join(n, by).groupBy(*by, F.pmod(F.xxhash64("items"), F.col("n")).alias("_part")).agg(F.collect_list(F.struct("items", _items_hash().alias("h"))).alias("p"))
        rows = gathered(short, by, F.col("window").cast("long").alias("window")).join(parts, by).select(*by, "x", "p")
        hits.append(stable(rows, by, n_subsets, lambda h, window, k: _subset_draw(h, window, k, seed) % 2 == 0))
    if long is not None or not hits:
        hits.append(_stable_by_joins(patterns, transactions if long is None else long, n_subsets, seed))
    hit = reduce(DataFrame.unionByName, hits).select(*by, "items", (F.col("hits") / n_subsets).alias("stability"))
    return patterns.join(hit, ["session_id", "items"], "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))


def _stable_by_joins(patterns: DataFrame, transactions: DataFrame, n_subsets: int, seed: int) -> DataFrame:
    """(session_id, items, hits) from a row for each pattern, window, subset and item."""
    occ = checkpointed(_occurrences(patterns, transactions)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    kept = occ.filter(_subset_draw(_items_hash(), F.col("window").cast("long"), F.col("k").cast("long"), seed) % 2 == 0)
    size = kept.groupBy("session_id", "items", "size", "k").agg(F.count("window").alias("_m"))
    item = kept.select("session_id", "items", "k", F.explode("t_items").alias("item")).groupBy("session_id", "items", "k", "item").agg(F.count(F.lit(1)).alias("_c"))
    common = item.join(size, ["session_id", "items", "k"]).filter("_c = _m").groupBy("session_id", "items", "size", "k").agg(F.count("item").alias("_common"))
    return common.groupBy("session_id", "items").agg(F.sum(F.when(F.col("_common") == F.col("size"), 1).otherwise(0)).alias("hits"))


def reduce_patterns(patterns: DataFrame, not_significant: DataFrame, h: int = 0, k: int = 0, l: int = 2) -> DataFrame:
    """Drops one of a pattern A and its subset B where one explains the other.

    B falls if (z_B, c_B - c_A + h) is not significant, A if (z_A - z_B + k, c_A) is not; if both
    would, the one that covers fewer spikes, (z - l) c, falls.
    """
    key = ["session_id", "items"]
    a = patterns.select("session_id", F.col("items").alias("a"), F.col("size").alias("za"), F.col("cnt").alias("ca"))
    b = patterns.select("session_id", F.col("items").alias("b"), F.col("size").alias("zb"), F.col("cnt").alias("cb"))
    # subsets meet their supersets on one item, the least of the subset
    met = a.select("*", F.explode("a").alias("_i")).join(b.withColumn("_i", F.array_min("b")), ["session_id", "_i"]).filter((F.col("zb") < F.col("za")) & (F.size(F.array_except("b", "a")) == 0))
    ns = not_significant.select("session_id", "size", "cnt").distinct()
    t1 = ns.select("session_id", F.col("size").alias("zb"), F.col("cnt").alias("_x"), F.lit(True).alias("b_out"))
    t2 = ns.select("session_id", F.col("size").alias("_y"), F.col("cnt").alias("ca"), F.lit(True).alias("a_out"))
    d = met.withColumn("_x", F.col("cb") - F.col("ca") + h).withColumn("_y", F.col("za") - F.col("zb") + k).join(t1, ["session_id", "zb", "_x"], "left").join(t2, ["session_id", "_y", "ca"], "left")
    both = F.coalesce("b_out", F.lit(False)) & F.coalesce("a_out", F.lit(False))
    more = (F.col("za") - l) * F.col("ca") >= (F.col("zb") - l) * F.col("cb")
    loser = F.when(both, F.when(more, F.col("b")).otherwise(F.col("a"))).when(F.col("b_out"), F.col("b")).when(F.col("a_out"), F.col("a"))
    gone = d.select("session_id", loser.alias("items")).filter("items IS NOT NULL").distinct()
    return patterns.join(gone, key, "left_anti")


def pattern_occurrences(patterns: DataFrame, transactions: DataFrame, length: int, spectrum: DataFrame | None = None) -> DataFrame:
    """Cells, lags after the first, and window times of each pattern, with its signature's p-value."""
    t = _occurrences(patterns, transactions).groupBy("session_id", "items").agg(F.sort_array(F.collect_list("window")).alias("times"))
    lags = F.transform("items", lambda i: i % length)
    out = patterns.join(t, ["session_id", "items"]).select("session_id", "items", F.transform("items", lambda i: F.floor(i / length).cast("int")).alias("cells"), F.transform(lags, lambda x: x - F.array_min(lags)).alias("lags"), "times", "size", "cnt")
    return out.join(spectrum.select("session_id", "size", "cnt", "p"), ["session_id", "size", "cnt"], "left") if spectrum is not None else out
