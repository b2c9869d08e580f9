"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .html_extract import main_text
from .language import languages_of, learn
from .lexical_search import best_documents
from .line_dedup import line_report
from .maxent import held_out, score, train
from .minhash import near_duplicates
from .mixing import mix_plan
from .periods import periodic_runs, with_loops
from .quality import quality_rules
from .scratch import new_path
from .suffix_dedup import suffix_dedup
from .tables import documents, table
from .token_counts import section_counts
from .token_files import read_token_files, write_token_files


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.array_join("shards", ",").alias("shards"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("firsts", "ends")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("boilerplate")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages_of(docs, table(spark, sf_dir, "pages"), learn(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")

    # length / period in exact order, by products
    def before(x, y):
        more, less = x.length * y.period, y.length * x.period
        return F.when(more != less, F.when(more > less, -1).otherwise(1)).when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1)).otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0))

    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", before), F.lit(0)).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length DIV best.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs.filter(~held_out())), held_out())


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op12_lm_scores": op12_lm_scores,
    "op13_ranked_search": op13_ranked_search,
    "op11_periodic_runs": op11_periodic_runs,
    "op5_main_text": op5_main_text,
    "op6_section_tokens": op6_section_tokens,
    "op9_language_id": op9_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op3_mixing": op3_mixing,
    "op2_decontamination": op2_decontamination,
    "op8_token_files": op8_token_files,
    "op1_near_duplicates": op1_near_duplicates,
    "op7_quality_rules": op7_quality_rules,
}
