"""Statistics learned on the training table and reapplied unchanged for scoring.

``fit_*`` returns a parameter DataFrame (one row per column, flag or class);
``apply_*`` reads those few rows and turns them into literals of one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensia.operators.aggregates import per_column, zero_shares
from propensia.operators.quantiles import approx_quantiles, exact_quantiles
from propensia.operators.rules import EXTREME_SUFFIX, present
from propensia.sources.store import params_frame

# Thresholds of the cleaning rules.
IQR_K = 1.5
ZERO_INFLATED_SHARE = 0.5
MIN_ROWS_FOR_BOUNDS = 10
MIN_FLAG_RATE = 0.03
MIN_FLAG_LIFT = 1.5

MEDIAN_SCHEMA = "colonne string, mediane double"
BOUNDS_SCHEMA = "colonne string, borne_min double, borne_max double"
COLUMN_LIST_SCHEMA = "colonne string"


def _quantiles(df: DataFrame, columns, probabilities, exact: bool) -> DataFrame:
    return (exact_quantiles if exact else approx_quantiles)(df, columns, probabilities)


# ---- medians -------------------------------------------------------------------

def fit_medians(df: DataFrame, columns: Iterable[str], exact: bool = True) -> DataFrame:
    columns = present(df, columns)
    if not columns:
        return params_frame(df.sparkSession, [], MEDIAN_SCHEMA)
    found = _quantiles(df, columns, {"mediane": 0.5}, exact)
    return found.select(F.col("column").alias("colonne"), "mediane")


def apply_medians(df: DataFrame, medians: DataFrame, suffix: str = "_imp") -> DataFrame:
    """``<c>_imp`` holds the value or the learned median; the raw column goes."""
    types = dict(df.dtypes)
    learned = {r["colonne"]: r["mediane"] for r in medians.collect() if r["colonne"] in types}
    filled = {c + suffix: F.coalesce(F.col(c), F.lit(m).cast(types[c])) for c, m in learned.items()}
    return df.withColumns(filled).drop(*learned) if filled else df


# ---- outlier bounds ------------------------------------------------------------

def detect_zero_inflated(df: DataFrame, columns: Sequence[str], share: float = ZERO_INFLATED_SHARE) -> DataFrame:
    return zero_shares(df, present(df, columns)).filter(F.col("zero_share") >= share)


def fit_iqr_bounds(
    df: DataFrame,
    columns: Iterable[str],
    k: float = IQR_K,
    share: float = ZERO_INFLATED_SHARE,
    min_rows: int = MIN_ROWS_FOR_BOUNDS,
    exact: bool = True,
) -> DataFrame:
    """Tukey fences per column: (colonne, borne_min, borne_max).

    A column that is mostly zeros is judged on its positive values alone, and its
    lower fence never exceeds 0. Too few rows or no spread: no entry, column untouched.
    """
    columns = present(df, columns)
    if not columns:
        return params_frame(df.sparkSession, [], BOUNDS_SCHEMA)
    counts = per_column(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns, {
        "n_rows": lambda c: F.count("*"), "n_zero": lambda c: F.count_if(c == 0), "n_positive": lambda c: F.count_if(c > 0),
    }).collect()  # one row per column
    inflated = {r["column"] for r in counts if r["n_rows"] and r["n_zero"] / r["n_rows"] >= share}
    bounded = [
        (r["column"], r["column"] in inflated) for r in counts
        if (r["n_positive"] if r["column"] in inflated else r["n_rows"]) >= min_rows
    ]
    columns = [c for c, _ in bounded]
    if not columns:
        return params_frame(df.sparkSession, [], BOUNDS_SCHEMA)
    values = df.select(*[
        (F.when(F.col(c) > 0, F.col(c)) if c in inflated else F.col(c)).cast("double").alias(c) for c in columns
    ])
    quartiles = _quantiles(values, columns, {"q1": 0.25, "q3": 0.75}, exact)
    is_inflated = F.col("column").isin([c for c, z in bounded if z])
    spread = F.col("q3") - F.col("q1")
    low = F.col("q1") - spread * k
    return quartiles.filter(spread != 0).select(
        F.col("column").alias("colonne"),
        F.when(is_inflated, F.least(low, F.lit(0.0))).otherwise(low).alias("borne_min"),
        (F.col("q3") + spread * k).alias("borne_max"),
    )


def apply_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cut every bounded column to its fences and flag the rows that were outside."""
    types = dict(df.dtypes)
    exprs: dict[str, Column] = {}
    for r in bounds.collect():
        c, low, high = r["colonne"], r["borne_min"], r["borne_max"]
        if c not in types:
            continue
        v = F.col(c)
        exprs[c + EXTREME_SUFFIX] = F.when((v < low) | (v > high), 1).otherwise(0)
        exprs[c] = F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
    return df.withColumns(exprs) if exprs else df


# ---- rare flags ----------------------------------------------------------------

def flag_lift(df: DataFrame, flags: Sequence[str], label: str | None) -> DataFrame:
    """(flag, n_active, rate, rate_if_active, lift) of all flags in one aggregate.

    ``lift`` is NULL for a flag that is never on, or when there is no label.
    """
    def share(a: Column, b: Column) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double"))

    has_label = label is not None and label in df.columns
    positive = (F.col(label) == 1) if has_label else F.lit(False)
    totals = [F.count("*").alias("__n"), F.count_if(positive).alias("__n_pos")]
    for i, f in enumerate(flags):
        totals.append(F.count_if(F.col(f) == 1).alias(f"{i}_on"))
        totals.append(F.count_if((F.col(f) == 1) & positive).alias(f"{i}_on_pos"))
    rows = []
    for i, f in enumerate(flags):
        on, on_pos = F.col(f"{i}_on"), F.col(f"{i}_on_pos")
        rate_if_active = share(on_pos, on) if has_label else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(f).alias("flag"),
            on.alias("n_active"),
            share(on, F.col("__n")).alias("rate"),
            rate_if_active.alias("rate_if_active"),
            F.try_divide(rate_if_active, share(F.col("__n_pos"), F.col("__n"))).alias("lift"),
        ))
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def fit_flags_to_drop(
    df: DataFrame,
    flags: Sequence[str],
    label: str | None = None,
    min_rate: float = MIN_FLAG_RATE,
    min_lift: float = MIN_FLAG_LIFT,
) -> DataFrame:
    """Flags that are rare and, when the label is known, unrelated to it.

    Rare alone is not useless: the label itself is rare. Without a label every rare
    flag goes.
    """
    if not flags:
        return params_frame(df.sparkSession, [], COLUMN_LIST_SCHEMA)
    related = F.coalesce((F.col("lift") >= min_lift) | (F.col("lift") <= 1.0 / min_lift), F.lit(False))
    return (
        flag_lift(df, sorted(flags), label)
        .filter((F.col("rate") < min_rate) & ~related)
        .select(F.col("flag").alias("colonne"))
    )


def detect_constant_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns with at most one distinct value, NULL counting as a value.

    Minimum, maximum and NULL count decide it; nothing is deduplicated or shuffled.
    """
    columns = present(df, columns)
    if not columns:
        return params_frame(df.sparkSession, [], COLUMN_LIST_SCHEMA)
    stats = per_column(df, columns, {
        "n_null": lambda c: F.count_if(c.isNull()),
        "n_rows": lambda c: F.count("*"),
        "same": lambda c: F.min(c) == F.max(c),
    })
    all_null = F.col("n_null") == F.col("n_rows")
    one_value = (F.col("n_null") == 0) & F.coalesce("same", F.lit(False))
    return stats.filter(all_null | one_value).select(F.col("column").alias("colonne"))


def drop_listed(df: DataFrame, listed: DataFrame) -> DataFrame:
    return df.drop(*present(df, [r["colonne"] for r in listed.collect()]))


# ---- class weights -------------------------------------------------------------

def class_weights(df: DataFrame, label: str, softened: bool = True) -> DataFrame:
    """(label, poids_classe): total / (classes x class size), optionally its square root."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    share_per_class = counts.agg(F.sum("n").cast("double") / F.count("*").cast("double")).scalar()
    weight = share_per_class / F.col("n").cast("double")
    return counts.select(label, (F.sqrt(weight) if softened else weight).alias("poids_classe"))


# ---- saved thresholds ----------------------------------------------------------

THRESHOLD_SCHEMA = "modele string, seuil_decision double"


def as_bounds(bounds: DataFrame) -> Mapping[str, tuple[float, float]]:
    return {r["colonne"]: (r["borne_min"], r["borne_max"]) for r in bounds.collect()}
