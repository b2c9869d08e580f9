"""Cleaning and summaries of tabular records."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import names, over

#: Accented letters and what replaces them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def clean_text(x: Column | str, case: str | None = "lower") -> Column:
    """Trimmed, blanks as _, accents removed, in one case."""
    c = F.translate(F.regexp_replace(F.trim(x), r"\s+", "_"), ACCENTED, PLAIN)
    return {"lower": F.lower, "upper": F.upper}.get(case, lambda y: y)(c)


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names as clean_text makes them; names that become equal get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        plain = "".join(x for x in unicodedata.normalize("NFD", c.strip()) if not unicodedata.combining(x))
        name = re.sub(r"\s+", "_", plain).lower()
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)


def fix_two_digit_year(date: Column | str, today: Column) -> Column:
    """A date in the future is a century late."""
    d = F.col(date) if isinstance(date, str) else date
    return F.when(d > today, F.add_months(d, -1200)).otherwise(d)


def age_at(birth: Column | str, day: Column | str) -> Column:
    """Whole years at a day."""
    return F.floor(F.months_between(day, birth) / 12).cast("int")


def code_column(df: DataFrame, column: str, codes: Mapping[str, int], synonyms: Mapping[str, str] | None = None, keep: bool = False) -> DataFrame:
    """Text to codes after cleaning; -1 for null and what is in no map."""
    table = dict(codes) | {k: codes[v] for k, v in (synonyms or {}).items()}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    out = df.withColumn(f"{column}_text", F.col(column)) if keep else df
    return out.withColumn(column, F.coalesce(F.try_element_at(pairs, clean_text(column)), F.lit(-1)))


def code_column_regex(df: DataFrame, column: str, patterns: Sequence[tuple[int, str]]) -> DataFrame:
    """The first pattern that matches gives the code; other values get new codes in their order, null -1."""
    c = F.lit(None).cast("int")
    for code, pattern in reversed(patterns):
        c = F.when(F.col(column).rlike(pattern), F.lit(code)).otherwise(c)
    d = df.withColumn("_code", c)
    rest = d.filter(F.col("_code").isNull() & F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    top = max([code for code, _ in patterns], default=-1)
    # one row for each different value that no pattern knows
    new = rest.withColumn("_new", F.dense_rank().over(over([], "_v")) + top)
    return d.join(new, F.col(column) == F.col("_v"), "left").withColumn(f"{column}_code", F.coalesce("_code", "_new", F.lit(-1))).drop("_code", "_v", "_new")


def label_columns(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """A 0/1 column for each label whose pattern the text matches."""
    return df.withColumns({k: F.coalesce(F.col(column).rlike(p).cast("int"), F.lit(0)) for k, p in patterns.items()})


def numbers_only(df: DataFrame, columns: Sequence[str], default: float | None = -1) -> DataFrame:
    """Cells as numbers, what is none as the default."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(default).cast("double")) for c in names(columns)})


def default_to_null(df: DataFrame, columns: Sequence[str], default: float = -1) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(default)) for c in names(columns)})


def pseudonymise(df: DataFrame, identity: Sequence[str], salt: str, id_col: str = "person_id") -> DataFrame:
    """One salted digest for equal cleaned names and birth dates; the identifying columns go."""
    key = F.concat_ws("|", F.lit(salt), *[F.coalesce(clean_text(F.col(c).cast("string")), F.lit("")) for c in identity])
    return df.withColumn(id_col, F.sha2(key, 256)).drop(*identity)


def record_stats(df: DataFrame, category: str, sub: str) -> DataFrame:
    """Counts by category and sub-category, with subtotals (null) and the whole."""
    return df.rollup(category, sub).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")).orderBy(F.col("n").desc())


def records_per_person(df: DataFrame, person: str) -> DataFrame:
    """Persons by their number of records."""
    return df.groupBy(person).agg(F.count(F.lit(1)).alias("records")).groupBy("records").agg(F.count(F.lit(1)).alias("persons"))


def gap_between_visits(df: DataFrame, person: str, date: str, i: int, j: int) -> DataFrame:
    """Days from the i-th to the j-th record of each person that has both."""
    d = df.withColumn("_k", F.row_number().over(over(person, date)))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(date)))
    return d.filter(F.col("_k").isin(i, j)).groupBy(person).agg(F.datediff(at(j), at(i)).alias("days")).filter("days IS NOT NULL")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of every pair of columns over the rows that have both, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.a", "x.b", "x.r")
