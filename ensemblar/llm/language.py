"""Language of documents and pages by Bayesian fusion of evidence.

Text: log-likelihoods of hashed byte trigrams under each language, learnt from a
bounded sample of labelled documents.  Markup: the declared language, with the
chance of each declaration given the language, counted over all rows.  Address:
priors of hosts, smoothed towards those of their address suffix, and these
towards all rows, from grouped sums.  The posterior adds the logarithms.

Text evidence of long texts is damped: trigrams of a text are not independent.

Defined cases: a null or empty text has no text evidence and is decided by the
rest; a null, empty or unknown host, suffix or declaration gives no evidence beyond the
prior of the step above it; without any labelled document no language is known, and all
rows get null as language and probability; ties go to the first language by name;
repeated rows each give a row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html_extract import host_of
from .scratch import as_table, bound_batches
from .textnum import LOWER, Text, texts_of

#: Labelled documents that are learnt from, for each language.
SAMPLE_DOCS = 2000
BUCKETS = 1 << 15
#: Trigrams beyond which more text adds little.
DAMPING = 200
#: Weights of the wider prior, in rows.
HOST_ROWS, SUFFIX_ROWS = 20, 50

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[:0x80] = np.where(np.isin(np.arange(0x80), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)), np.arange(0x80), 0x20)


def trigrams(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram with a letter in it, and where each text's begin."""
    d = _SPACE[LOWER[t.data]].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(t.n + 1, np.int64)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    at = np.flatnonzero(code != 0x202020)
    edge = np.zeros(len(d) + 1, bool)
    edge[t.offsets] = True
    at = at[~(edge[at + 1] | edge[at + 2])]
    return ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64) % BUCKETS, np.searchsorted(at, t.offsets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for i, j, t in texts_of(batch, "text"):
            bucket, at = trigrams(t)
            for d in range(j - i):
                sums.setdefault(langs[i + d], np.zeros(BUCKETS, np.int64))
                sums[langs[i + d]] += np.bincount(bucket[at[d] : at[d + 1]], minlength=BUCKETS)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])], ["lang", "bucket", "n"])


class Model:
    """Log-probabilities of the buckets under each language."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs.astype(np.float32)

    def scores(self, t: Text) -> np.ndarray:
        bucket, at = trigrams(t)
        n = np.diff(at)
        out = np.empty((t.n, len(self.languages)))
        for k, logs in enumerate(self.logs):
            c = np.append(0.0, np.cumsum(logs[bucket], dtype=np.float64))
            out[:, k] = c[at[1:]] - c[at[:-1]]
        return out * (DAMPING / (DAMPING + n))[:, None]


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most sample_docs labelled documents (chosen by a hash) of each language."""
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    ids = known.select(F.col(id_col).cast("long").alias("s_id"), F.col(lang_col).alias("s_lang"))
    ids = ids.distinct().withColumn("place", F.xxhash64("s_id").bitwiseAND((1 << 53) - 1) / float(1 << 53))
    # of a frequent language, only the part below a bound of the hash (twice the sample, on average) is ranked
    often = ids.groupBy(F.col("s_lang").alias("c_lang")).agg(F.count("s_id").alias("n"))
    near = ids.join(often, (F.col("s_lang") == F.col("c_lang")) & (F.col("place") * F.col("n") <= 2 * sample_docs + 100))
    order = Window.partitionBy("s_lang").orderBy("place", "s_id")
    chosen = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs).select("s_id").distinct()
    # sample_docs ids of each language: small whatever the corpus
    texts = known.join(F.broadcast(chosen), F.col(id_col) == F.col("s_id")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(lambda b: (x for x in _count(pa.RecordBatch.from_arrays([y.column(0), y.column(1), y.column(2)], ["doc_id", "lang", "text"]) for y in b)), "lang string, bucket long, n long")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # at most languages x buckets
    languages = sorted({r.lang for r in rows})
    n = np.full((len(languages), BUCKETS), 0.5)
    for r in rows:
        n[languages.index(r.lang), r.bucket] += r.n
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)))


def text_scores(texts: DataFrame, model: Model) -> DataFrame:
    """texts has a column text; scores (one number for each language) take its place."""
    bound_batches(texts.sparkSession)
    kept = [c for c in texts.columns if c != "text"]
    told = texts.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text"] + ["scores array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in texts_of(batch, "text"):
                s = told.value.scores(t)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * s.shape[1]), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept], lists], [*kept, "scores"])

    return texts.mapInArrow(run, schema)


def _shares(rows: DataFrame, by: list[str], languages: list[str]) -> DataFrame:
    """Sums of each language's probability by some columns, as an array."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[k]) for k in range(len(languages))]).alias("sums"))


#: Hosts whose priors are sent to all tasks.
SENT_HOSTS = 100_000


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def fuse(rows: DataFrame, languages: list[str], host_rows: float = HOST_ROWS, suffix_rows: float = SUFFIX_ROWS) -> DataFrame:
    """rows: any columns, with scores, host, suffix and declared; adds lang, text_lang and prob."""
    n = len(languages)
    if not n:
        nothing = F.lit(None).cast("string")
        return rows.drop("scores").withColumn("lang", nothing).withColumn("text_lang", nothing).withColumn("prob", F.lit(None).cast("double"))
    names = F.array(*[F.lit(x) for x in languages])
    rows = rows.withColumn("p", _softmax(F.col("scores")))
    whole = _shares(rows, [], languages).select(F.transform("sums", lambda s: (s + 1) / (F.aggregate("sums", F.lit(0.0), lambda t, y: t + y) + n)).alias("all_prior"))

    def smoothed(sums: str, prior: str, weight: float) -> Column:
        total = F.aggregate(F.col(sums), F.lit(0.0), lambda t, y: t + y)
        return F.zip_with(F.col(sums), F.col(prior), lambda s, q: (s + weight * q) / (total + weight))

    suffix = _shares(rows.filter("suffix <> ''"), ["suffix"], languages).crossJoin(whole).select("suffix", smoothed("sums", "all_prior", suffix_rows).alias("suffix_prior"))
    host = _shares(rows.filter("host <> ''"), ["host", "suffix"], languages).crossJoin(whole).join(suffix.withColumnRenamed("suffix", "x_suffix"), F.col("suffix") == F.col("x_suffix"), "left")
    host = host.withColumn("above", F.coalesce("suffix_prior", "all_prior")).select(F.col("host").alias("h_host"), F.col("suffix").alias("h_suffix"), smoothed("sums", "above", host_rows).alias("prior"))
    # a few hosts may have most of the rows: their priors go to the rows where they are few, not the rows to them
    host = as_table(host, "priors")
    host = F.broadcast(host) if host.count() <= SENT_HOSTS else host
    # chances of each declaration given the language; an unseen one says nothing
    said = _shares(rows.filter("declared IS NOT NULL"), ["declared"], languages)
    total = said.agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(n)]).alias("all_said"), F.count("declared").alias("kinds"))
    said = said.crossJoin(total).select(F.col("declared").alias("d_declared"), F.zip_with("sums", "all_said", lambda s, a: F.log((s + 0.5) / (a + 0.5 * F.col("kinds")))).alias("declared_logs"))

    # a row without a host has the prior of all rows; one row crosses over
    joined = rows.join(host, (F.col("host") == F.col("h_host")) & (F.col("suffix") == F.col("h_suffix")), "left").crossJoin(whole).withColumn("prior", F.coalesce("prior", "all_prior")).join(said, F.col("declared") == F.col("d_declared"), "left")
    logs = F.zip_with(F.zip_with("scores", "prior", lambda s, q: s + F.log(q)), F.coalesce("declared_logs", F.array_repeat(F.lit(0.0), n)), lambda x, y: x + y)
    told = joined.withColumn("post", _softmax(logs))
    first = lambda x: names[(F.array_position(F.col(x), F.array_max(x)) - 1).cast("int")]
    return told.withColumn("lang", first("post")).withColumn("text_lang", first("p")).withColumn("prob", F.round(F.array_max("post"), 6)).drop("p", "post", "prior", "all_prior", "declared_logs", "d_declared", "h_host", "h_suffix", "scores")


def declared_language(html: str = "html") -> Column:
    """The primary part of the language that the root element declares, or null."""
    return F.nullif(F.lower(F.regexp_extract(F.col(html), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1)), F.lit(""))


def plain_text(html: str = "html") -> Column:
    return F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")


def languages_of(docs: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """One row per document and page: doc_id or page_id, host, declared, lang, text_lang, prob."""
    none = F.lit(None)
    of_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.cast("long").alias("page_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.lit("").alias("suffix"), none.cast("string").alias("declared"), F.col("text").cast("string").alias("text"))
    own = pages.select("page_id", F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    of_pages = own.select(none.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "host", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), declared_language().alias("declared"), plain_text().alias("text"))
    scored = as_table(text_scores(of_docs.unionByName(of_pages), model), "scores")
    return fuse(scored, model.languages).select("doc_id", "page_id", "host", "declared", "text_lang", "lang", "prob")
