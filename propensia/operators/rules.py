"""Row-wise cleaning rules. Every rule applies only where its column exists.

All rules of one kind go into a single projection, so a hundred columns cost one
analysed plan node and one generated stage.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensia.functions.dates import age_years, fr_date

NUMERIC_TYPES = ("int", "bigint", "double", "float")

# Age range of a person, and name patterns of indicator columns.
AGE_RANGE = (16, 100)
EXTREME_SUFFIX = "_etait_extreme"
NEVER_PREFIX = "jamais_"


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    existing = set(df.columns)
    return [c for c in columns if c in existing]


def quoted(name: str) -> Column:
    """Column by exact name, also when the name holds dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_column(df: DataFrame, candidates: Sequence[str], alias: str) -> DataFrame:
    """One column ``alias`` from all alternative names that exist, earlier ones first.

    Files of one table may name a column differently; their union holds both, each NULL
    for the other file's rows.
    """
    found = present(df, candidates)
    if not found:
        raise ValueError(f"none of {list(candidates)} among {df.columns}")
    united = F.coalesce(*[quoted(c) for c in found])
    return df.withColumn("__united", united).drop(*found).withColumnRenamed("__united", alias)


def drop_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*present(df, columns))


def repair_categories(df: DataFrame, column: str, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Map known spellings to one code each; any other spelling becomes NULL."""
    if column not in df.columns:
        return df
    out = None
    for code, spellings in mapping.items():
        hit = F.col(column).isin(list(spellings))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return df.withColumn(column, out)


def drop_null_keys(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    subset = present(df, columns)
    return df.na.drop(subset=subset) if subset else df


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL -> constant per column; the constant takes the column's type."""
    types = dict(df.dtypes)
    exprs = {
        c: F.coalesce(F.col(c), F.lit(v).cast(types[c]))
        for c, v in values.items() if c in types
    }
    return df.withColumns(exprs) if exprs else df


def fill_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NULL -> 0 for counters and totals, text columns included."""
    return fill_constants(df, {c: 0 for c in columns})


def missing_flags(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """``{flag: column}``: flag is 1 where the column was never observed."""
    exprs = {f: F.col(c).isNull().cast("int") for f, c in flags.items() if c in df.columns}
    return df.withColumns(exprs) if exprs else df


def clip_negative(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Negative counts and amounts become 0, NULL stays NULL."""
    types = dict(df.dtypes)
    exprs = {
        c: F.when(F.col(c) < 0, F.lit(0).cast(types[c])).otherwise(F.col(c))
        for c in present(df, columns)
    }
    return df.withColumns(exprs) if exprs else df


def cap_and_flag(df: DataFrame, maxima: Mapping[str, float]) -> DataFrame:
    """Values above a business maximum are cut to it and flagged."""
    types = dict(df.dtypes)
    exprs: dict[str, Column] = {}
    for c in present(df, maxima):
        over = F.col(c) > F.lit(maxima[c])
        exprs[c + EXTREME_SUFFIX] = F.when(over, 1).otherwise(0)
        exprs[c] = F.when(over, F.lit(maxima[c]).cast(types[c])).otherwise(F.col(c))
    return df.withColumns(exprs) if exprs else df


def keep_plausible_age(
    df: DataFrame, birth: str, reference: dt.date, is_train: bool, age_range: tuple[int, int] = AGE_RANGE
) -> DataFrame:
    """Training rows outside the age range (or without a readable birth date) go;
    rows to be scored all stay."""
    if birth not in df.columns or not is_train:
        return df
    return df.filter(age_years(fr_date(birth), reference).between(*age_range))


def count_implausible_age(
    df: DataFrame, birth: str, reference: dt.date, age_range: tuple[int, int] = AGE_RANGE
) -> DataFrame:
    age = age_years(fr_date(birth), reference)
    outside = (age < age_range[0]) | (age > age_range[1])
    return df.agg(F.count("*").alias("n_rows"), F.count_if(outside).alias("n_implausible"))


def presence_label(df: DataFrame, column: str, label: str) -> DataFrame:
    """Binary target: 1 where ``column`` is known, 0 otherwise."""
    return df.withColumn(label, F.col(column).isNotNull().cast("int"))


def split_population(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(everyone, positives only)."""
    return df, df.filter(F.col(label) == 1)


def numeric_features(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are quantities: no labels, no numeric codes."""
    skip = set(exclude)
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in skip]


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(EXTREME_SUFFIX) or c.startswith(NEVER_PREFIX)]


def safe_ratio(df: DataFrame, numerator: str, denominator: str, out: str) -> DataFrame:
    """Ratio, NULL when the denominator is 0 or NULL."""
    return df.withColumn(out, F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double")))


def relative_volatility(
    df: DataFrame, high: str, low: str, mean: str, out: str, undefined_flag: str
) -> DataFrame:
    """(high - low) / mean where the mean is positive, else NULL with a flag.

    A NULL mean is "never observed", not "undefined", so its flag stays 0.
    """
    ratio = F.when(F.col(mean) > 0, (F.col(high) - F.col(low)) / F.col(mean))
    undefined = F.when(F.col(mean) <= 0, 1).otherwise(0)
    return df.withColumns({undefined_flag: undefined, out: ratio})
