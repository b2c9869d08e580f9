"""Line deduplication by a segment-partition edit join.

Lines are compared without white space at their ends.  Equal lines are one text,
held by its first place.  A text is split into limit + 1 segments; if two texts
are within the limit, one has a segment that the other holds at nearly the same
place, so substrings at the places that can match (by length and the segment's
number) probe an index of segments.  Keys that different texts hold are marked in
a bitmap of one size; only lines that hold a marked key are kept with their text.
Texts that meet under a key are dropped at once if their lengths or the counts of
their letters differ too much; a crowded key is dealt to several tasks.  Of the rest, common ends are taken off, what is left between them must show a piece that
no edit touches, and then the edit distance is computed in a band, the columns of
which are bit vectors.

A line is dropped if an equal line, or one within the limit, comes earlier in the
order of document and line.  All of it is DataFrame and SQL work.

Defined cases: blank lines are kept and not counted; texts shorter than
``min_chars`` are compared for equality only; a null text has no lines; a null id
is left out of the comparison and keeps all its lines; rows that repeat a whole
document count once; different texts with one id are lines of one document, and of
two lines at one place the one with the smaller hash is the earlier; further
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import as_table, unused

MAX_EDITS = 2
MIN_CHARS = 12
#: Lengths that share a bucket of the index.
LENGTHS = 16
BLANKS = " \t\r\f\v"
#: The bitmap of keys: blocks, of as many longs each (8 MB); a fuller one lets more lines pass, which meet nothing.
BLOCKS = WORDS = 1024
#: Lines of the index that one task compares with a key's probes.
CROWD = 512


def _trimmed(line: Column) -> Column:
    """A line without white space at its ends; most have none, and are told by their first and last byte."""
    blank = F.lit(False)
    for x in BLANKS:
        blank = blank | F.startswith(line, F.lit(x)) | F.endswith(line, F.lit(x))
    return F.when(blank, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def _keys(max_edits: int, min_chars: int) -> Column:
    """(key, own) of a line in a bucket of lengths: its segments, and the substrings that probe for those of others.

    Lengths LENGTHS x bucket and on, and max_edits beyond the bucket, have segments of one size.  The
    first half of the segments is placed from the left end, the others from the right end.  If two
    lines are within the limit, some segment i has at most i edits on its left, max_edits - i on its
    right and none inside: its place differs by no more than the smaller of these from the nearer end.
    No such place lies outside a line of at least max_edits + 1 segments.  Where each character
    is a byte, the substrings are cut from the bytes, which have the same hash.
    """
    out = []
    size = f"cast(greatest({min_chars}, bucket * {LENGTHS}) div {max_edits + 1} as int)"
    for i in range(max_edits + 1):
        near = min(i, max_edits - i)
        for shift in range(-near, near + 1):
            at = f"({i} * {size} + {shift} + 1)" if i <= max_edits - i else f"(size - {max_edits + 1 - i} * {size} + {shift} + 1)"
            hashed = [f"xxhash64({i}, bucket, substring({x}, {at}, {size}))" for x in ("bytes", "line")]
            out.append(f"named_struct('key', if(octet_length(bytes) = size, {hashed[0]}, {hashed[1]}), 'own', {str(shift == 0).lower()})")
    return F.expr(f"array({', '.join(out)})")


#: Characters that are counted.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _counts(line: str) -> Column:
    """How often a line holds each letter, digit and blank; an edit changes two counts at most, each by one."""
    low = f"lower({line})"
    return F.expr(f"array({', '.join(f"octet_length({low}) - octet_length(replace({low}, '{c}', ''))" for c in COUNTED)})")


def _codes(counts: str) -> list[Column]:
    """The counts as four bits each in longs, coded so that one more turns one bit: codes differ in no more bits than counts in all."""
    bits = [f"if({n} & 4 = 0, shiftleft(1L, {n} & 3) - 1, shiftleft(15L, {n} & 3) & 15)" for n in (f"get({counts}, {k})" for k in range(len(COUNTED)))]
    return [F.expr(" | ".join(f"shiftleft({x}, {4 * k})" for k, x in enumerate(bits[start : start + 16]))) for start in range(0, len(bits), 16)]


def _common_start(a: str, b: str, steps: int = 24) -> str:
    """SQL for the length of the longest common start of two strings, by halving steps."""
    sizes = f"transform(sequence({steps - 1}, 0), k -> shiftleft(1, k))"
    return f"aggregate({sizes}, 0, (n, s) -> if(n + s <= length({a}) AND n + s <= length({b}) AND substring({a}, n + 1, s) = substring({b}, n + 1, s), n + s, n))"


def _middles(both: DataFrame) -> DataFrame:
    """What is left of columns a and b without their common start and their common end."""
    steps = 6
    for x in ("", "r"):  # from the left, then from the right, on reversed texts
        long = F.greatest(F.length("a"), F.length("b")) >= 1 << steps
        both = both.withColumn("n", F.when(long, F.expr(_common_start("a", "b"))).otherwise(F.expr(_common_start("a", "b", steps))))
        for c in "ab":
            both = both.withColumn(c, F.reverse(F.expr(f"substring({c}, n + 1)")))
    return both.drop("n")


def _characters(text: str, max_edits: int) -> Column:
    """The characters of a text, after as many equal ones as the band is wide: a common start changes no distance."""
    return F.concat(F.array_repeat(F.lit(""), max_edits), F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, "")))


def _hopeful(max_edits: int) -> Column:
    """Whether what is left of a and b, which differ at both ends, can be within the limit.

    The first and the last step of any alignment are edits.  If they are not the same one, a
    without its first and last character loses to b at most one of max_edits - 1 pieces by each of
    the max_edits - 2 edits left; the others stand no further than max_edits - 1 from their places.
    """
    if max_edits < 2:
        return F.expr(f"greatest(length(a), length(b)) <= {max_edits}")
    n = max_edits - 1
    checks = []
    for i in range(n):
        low, high = f"cast({i} * (length(a) - 2) div {n} as int)", f"cast({i + 1} * (length(a) - 2) div {n} as int)"
        checks += [f"({low} + 2 + {s} > 0 AND substring(b, {low} + 2 + {s}, {high} - {low}) = substring(a, {low} + 2, {high} - {low}))" for s in range(-n, n + 1)]
    return F.expr(f"least(length(a), length(b)) <= {2 * max_edits} OR {' OR '.join(checks)}")


def banded_distance(a: str, b: str, max_edits: int) -> Column:
    """Edit distance of two arrays of characters of about equal length; right where it is at most max_edits.

    A column of the band is held as its vertical steps up and down in two bit vectors; the
    highest bit is the row max_edits below the diagonal.  The distance is followed along that
    row and, once the row is the last one, along the last row.  The row's distance never falls
    before that, and is at most 2 * max_edits above that of any diagonal in the band: beyond
    3 * max_edits the columns left cannot bring it back and are passed over.
    """
    k, spare = max_edits, 3
    top = 2 * k + spare
    ones = (1 << (top + 1)) - 1
    equal = " + ".join(f"if(get({a}, cast(j - 1 + {k - (top - bit)} as int)) = get({b}, cast(j - 1 as int)), {1 << bit}L, 0L)" for bit in range(top - 2 * k, top + 1))
    start = f"named_struct('up', {ones & ~((1 << (top - k)) - 1)}L, 'down', 0L, 'd', {k}L)"
    step = f"""
      transform(transform(transform(array(named_struct('up', s.up, 'down', s.down, 'd', s.d, 'e', {equal})),
        s1 -> named_struct('up', s1.up, 'down', s1.down, 'd', s1.d, 'z', ((((s1.e & s1.up) + s1.up) ^ s1.up) | s1.e | s1.down) & {ones}L)),
        s2 -> named_struct('z', s2.z, 'd', s2.d, 'hp', s2.down | (~(s2.z | s2.up) & {ones}L), 'hn', s2.z & s2.up)),
        s3 -> named_struct(
          'up', s3.hn | (~(shiftright(s3.z, 1) | s3.hp) & {ones}L),
          'down', shiftright(s3.z, 1) & s3.hp,
          'd', if(j <= size({a}) - {k},
                  s3.d + if(s3.z & {1 << top}L = 0, 1L, 0L),
                  s3.d + if(s3.hp & shiftleft(1L, cast({top} - (j - (size({a}) - {k})) as int)) <> 0, 1L, 0L)
                       - if(s3.hn & shiftleft(1L, cast({top} - (j - (size({a}) - {k})) as int)) <> 0, 1L, 0L))))[0]
    """
    return F.expr(f"if(size({b}) = 0, cast(size({a}) as bigint), aggregate(sequence(1, greatest(1, size({b}))), {start}, (s, j) -> if(s.d > {3 * k}, s, {step}), s -> s.d))")


def _lines(docs: DataFrame) -> DataFrame:
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.withColumn("line", _trimmed(F.col("line"))).filter("line <> ''")


def _keyed(docs: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """A row for each key of each line that has min_chars."""
    lines = _lines(docs).withColumn("size", F.length("line")).filter(F.col("size") >= min_chars)
    group = F.expr(f"size div {LENGTHS}")
    buckets = F.when((F.col("size") % LENGTHS < max_edits) & (group > 0), F.array(group - 1, group)).otherwise(F.array(group))
    dealt = lines.select("doc_id", "line_no", "line", "size", F.xxhash64("line").alias("h"), F.col("line").cast("binary").alias("bytes"), F.explode(buckets).alias("bucket"))
    return dealt.select("doc_id", "line_no", "line", "h", F.explode(_keys(max_edits, min_chars)).alias("x")).select("doc_id", "line_no", "line", "h", "x.key", "x.own")


#: A key's block, and its two bits there.
BLOCK = f"key & {BLOCKS - 1}L"
SPOTS = [f"(shiftrightunsigned(key, {start}) & {64 * WORDS - 1}L)" for start in (20, 42)]


def _marked(keys: DataFrame) -> DataFrame:
    """A bitmap of keys: a row for each block, with its words."""
    spots = keys.select(F.expr(BLOCK).alias("block"), F.explode(F.array(*map(F.expr, SPOTS))).alias("spot"))
    bits = spots.select("block", F.expr("shiftright(spot, 6)").alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bits"))
    none = keys.sparkSession.range(BLOCKS * WORDS).select(F.expr(f"id div {WORDS}"), F.expr(f"id % {WORDS}"), F.lit(0).cast("long"))
    words = bits.union(none).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select("block", F.col("w.bits").alias("words"))


def _is_marked(words: str) -> Column:
    return F.expr(" AND ".join(f"(shiftright(get({words}, cast(shiftright({x}, 6) as int)), cast({x} & 63 as int)) & 1L) = 1L" for x in SPOTS))


def _candidates(docs: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """Different lines that share a key with another one, once each: h, first place, line, size, counts, keys (key, own); and a few others."""
    keyed = _keyed(docs, max_edits, min_chars)
    # keys that two different lines hold, one of them as a segment; equal lines, however many, are one sum
    shared = keyed.groupBy("key").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.max("own").alias("own")).filter("h0 < h1 AND own").select("key")
    # one plan at every size: the keys grow with the data, their bitmap does not
    blocks = as_table(_marked(shared), "keys")
    found = keyed.join(F.broadcast(blocks), F.expr(BLOCK) == F.col("block")).filter(_is_marked("words"))
    # equal lines are one sum again, in the task that finds them
    lines = found.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("place"), F.min("line").alias("line"), F.collect_set(F.struct("key", "own")).alias("keys"))
    return as_table(lines.select("h", "place.*", "line", F.length("line").alias("size"), _counts("line").alias("counts"), "keys"), "candidates")


def _dealt(told: DataFrame) -> DataFrame:
    """The rows with parts, the number of tasks that the lines of their key in the index are dealt to."""
    crowded = told.filter("own").groupBy(F.col("key").alias("c_key")).agg(F.count("h").alias("n")).filter(F.col("n") > CROWD)
    return told.join(crowded, F.col("key") == F.col("c_key"), "left").withColumn("parts", F.expr(f"cast(coalesce((n - 1) div {CROWD} + 1, 1) as int)")).drop("c_key", "n")


def edit_links(docs: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """Pairs (a_h, b_h) of hashes of different lines within the limit, a's first place before b's."""
    texts = _candidates(docs, max_edits, min_chars)
    told = texts.select("h", "doc_id", "line_no", "size", F.array(*_codes("counts")).alias("c"), F.explode("keys").alias("x"))
    codes = [f"c{k}" for k in range(len(_codes("counts")))]
    told = told.select("h", "doc_id", "line_no", "size", *[F.get("c", k).alias(c) for k, c in enumerate(codes)], "x.key", "x.own")
    told = as_table(_dealt(told), "probes")
    index = told.filter("own").withColumn("part", F.expr("cast(pmod(h, parts) as int)"))
    index = index.select(*[F.col(c).alias(f"i_{c}") for c in ("key", "part", "h", "size", *codes, "doc_id", "line_no")])
    probes = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # numbers only: where copies of a long text differ, nearly all pairs of a key fail here
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"i_{c}"))) for c in codes), F.lit(0))
    like = (F.abs(F.col("size") - F.col("i_size")) <= max_edits) & (apart <= 2 * max_edits)
    met = probes.join(index.hint("merge"), (F.col("key") == F.col("i_key")) & (F.col("part") == F.col("i_part")) & (F.col("h") != F.col("i_h")) & like)
    earlier = F.struct("doc_id", "line_no", "h") < F.struct("i_doc_id", "i_line_no", "i_h")
    pairs = as_table(met.select(F.when(earlier, F.col("h")).otherwise(F.col("i_h")).alias("a_h"), F.when(earlier, F.col("i_h")).otherwise(F.col("h")).alias("b_h")).distinct(), "pairs")
    left, right = (texts.select(F.col("h").alias(f"{x}_t"), F.col("line").alias(x)) for x in "ab")
    both = pairs.join(left, F.col("a_h") == F.col("a_t")).join(right, F.col("b_h") == F.col("b_t")).select("a_h", "b_h", "a", "b")
    # a table, so that the filter is not pushed below the steps that it is computed from
    cut = as_table(_middles(both), "middles").filter(_hopeful(max_edits)).select("a_h", "b_h", _characters("a", max_edits).alias("x"), _characters("b", max_edits).alias("y"))
    return cut.filter(banded_distance("x", "y", max_edits) <= max_edits).select("a_h", "b_h")


def line_duplicates(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first place of each different line: doc_id, line_no, h (its hash), size, n_links (texts within the limit) and near (one of them is earlier)."""
    if min_chars <= max_edits:
        raise ValueError("min_chars must be larger than max_edits: each segment needs a character")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    seen = _lines(texts).select("doc_id", "line_no", F.length("line").alias("size"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"))
    first = seen.groupBy("h", "h2", "size").agg(F.min(F.struct("doc_id", "line_no")).alias("x")).select("x.doc_id", "x.line_no", "h", "size")
    first = as_table(first, "lines")
    links = as_table(edit_links(texts, max_edits, min_chars), "links")
    ends = links.select(F.col("a_h").alias("e_h"), F.lit(0).alias("later")).union(links.select("b_h", F.lit(1)))
    linked = ends.groupBy("e_h").agg(F.count("later").alias("n_links"), F.max("later").alias("later"))
    out = first.join(linked, F.col("h") == F.col("e_h"), "left")
    return out.select("doc_id", "line_no", "h", "size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("later") == 1, F.lit(False)).alias("near"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: lines, first places, near ones among them, kept lines and characters, links."""
    found = line_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    by_doc = found.groupBy(F.col("doc_id").alias("f_id")).agg(
        F.count("line_no").alias("n_first"), F.sum(F.col("near").cast("long")).alias("n_near"), F.sum("n_links").alias("n_links"),
        F.sum(F.when(~F.col("near"), F.col("size")).otherwise(0)).alias("kept_chars"),
    )
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), _trimmed), lambda x: x != "")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), lines.alias("l")).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))
    lone, zero = F.col("doc_id").isNull(), F.lit(0).cast("long")
    joined = own.join(by_doc, F.col("doc_id") == F.col("f_id"), "left")
    first, near = F.when(lone, F.col("n_lines")).otherwise(F.coalesce("n_first", zero)), F.coalesce("n_near", zero)
    return joined.select("doc_id", "n_lines", first.alias("n_first"), near.alias("n_near"), (first - near).alias("n_kept"), F.coalesce("n_links", zero).alias("n_links"), F.when(lone, F.col("chars")).otherwise(F.coalesce("kept_chars", zero)).cast("long").alias("kept_chars"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all columns, without the dropped lines; blank lines stay."""
    k_id, k_lines = unused(docs, "kept_id", "kept_lines")
    kept = line_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("NOT near").groupBy(F.col("doc_id").alias(k_id)).agg(F.collect_set(F.struct("line_no", "h")).alias(k_lines))
    joined = docs.join(kept, F.col(id_col).cast("long") == F.col(k_id), "left")
    none = F.array().cast("array<struct<line_no:int,h:bigint>>")
    stay = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x, i: (_trimmed(x) == "") | F.array_contains(F.coalesce(F.col(k_lines), none), F.struct(i.alias("line_no"), F.xxhash64(_trimmed(x)).alias("h"))))
    text = F.when(F.col(id_col).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    return joined.withColumn(text_col, text).select(docs.columns)
