"""Keyed aggregates and one-pass column statistics.

Counting column by column would be one job each; here all columns of a table share one
aggregate, turned to long form at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensia.functions.amounts import exact_mean, exact_sum
from propensia.functions.dates import recency_days
from propensia.operators.quantiles import exact_quantiles, long_values
from propensia.operators.windows import null_safe_join
from propensia.session import materialise

FENCES_BROADCAST = 50_000
"""Most (class, column) fences that are broadcast; seven numbers each."""


# ---- per key -------------------------------------------------------------------
# The output column names of the feature tables below.

def balance_summary(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Mean, minimum, maximum and number of observations per key."""
    return df.groupBy(key).agg(
        exact_mean(amount).alias("solde_moyen"),
        F.min(amount).alias("solde_min"),
        F.max(amount).alias("solde_max"),
        F.count("*").alias("nb_mois_observes_solde"),
    )


def deposit_mean(df: DataFrame, key: str, amount: str) -> DataFrame:
    return df.groupBy(key).agg(exact_mean(amount).alias("depot_moyen"))


def flow_summary(df: DataFrame, key: str, amount: str) -> DataFrame:
    """A NULL month is a month without movement: it counts as 0 in mean and total."""
    filled = F.coalesce(F.col(amount), F.lit(0.0))
    return df.groupBy(key).agg(
        exact_mean(filled).alias("flux_cred_moyen"),
        exact_sum(filled).alias("flux_cred_total"),
        F.count_if(filled > 0).alias("nb_mois_avec_flux"),
    )


def operations_summary(df: DataFrame, key: str, amount: str, when: str, reference) -> DataFrame:
    """Frequency, amount and recency of a key's operations."""
    return df.groupBy(key).agg(
        F.count("*").alias("nb_operations_gab"),
        exact_sum(amount).alias("montant_total_gab"),
        exact_mean(amount).alias("montant_moyen_gab"),
        F.max(when).alias("derniere_operation_gab"),
    ).withColumn("recence_gab_jours", recency_days("derniere_operation_gab", reference))


def channel_summary(df: DataFrame, key: str, amount: str, count_as: str, total_as: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(count_as), exact_sum(amount).alias(total_as))


# ---- whole table ---------------------------------------------------------------

def rows_and_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def category_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def class_share(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """Rows per class and share of all rows (the total is a scalar subquery)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, digits))


def per_column(df: DataFrame, columns: Sequence[str], statistics: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Evaluate ``{name: column -> aggregate}`` for every column in one aggregate.

    Result: one row per column, (column, <name>...), types taken from the first column.
    """
    aggregates = [
        fn(F.col(c)).alias(f"{i}_{name}")
        for i, c in enumerate(columns) for name, fn in statistics.items()
    ]
    wide = df.agg(*aggregates)
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in statistics])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return per_column(df, list(columns or df.columns), {
        "n_null": lambda c: F.count_if(c.isNull()),
        "n_rows": lambda c: F.count("*"),
    })


def _number(c: Column) -> Column:
    """The value as a double; NaN is no value."""
    return F.nullif(c.cast("double"), F.lit(float("nan")))


def min_max_mean(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return per_column(df, columns, {
        "min": lambda c: F.min(_number(c)),
        "max": lambda c: F.max(_number(c)),
        "mean": lambda c: F.round(F.avg(_number(c)), digits),
    })


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values (NULL left out) per column.

    Values are deduplicated in map tasks and shuffled once, by (column, value).
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    found = df.select(F.inline(F.array(*cells))).distinct()
    return found.groupBy("column").agg(F.count("value").alias("n_distinct"))


def distinct_counts_approx(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    return per_column(df, columns, {"n_distinct": lambda c: F.approx_count_distinct(c, rsd)})


def outlier_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Negative and out-of-bounds rows per column, all columns in one pass."""
    aggregates, rows = [], []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        v = F.col(c)
        aggregates.append(F.count_if(v < 0).alias(f"{i}_neg"))
        aggregates.append(F.count_if((v < F.lit(low)) | (v > F.lit(high))).alias(f"{i}_out"))
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"{i}_neg").alias("n_negative"), F.col(f"{i}_out").alias("n_outside")))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def zero_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows equal to 0; rows with NULL stay in the denominator."""
    return per_column(df, columns, {
        "zero_share": lambda c: F.try_divide(F.count_if(c == 0).cast("double"), F.count("*").cast("double")),
    })


def group_means(df: DataFrame, label: str, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """(label, column, mean) for every numeric column."""
    wide = df.groupBy(label).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])
    return wide.unpivot([label], list(columns), "column", "mean")


def flag_rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., flag, pct): share of rows where a 0/1 flag is on, in percent."""
    def rate(f: str) -> Column:
        return F.try_divide(F.sum(f).cast("double") * 100.0, F.count(f).cast("double"))

    wide = df.groupBy(*by).agg(*[rate(f).alias(f) for f in flags])
    return wide.unpivot(list(by), list(flags), "flag", "pct")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts, one output column per value of ``columns``; empty cells are 0."""
    return df.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)


def crosstab_with_margins(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Long cross-table with row, column and grand totals (marked 'All')."""
    # Counted cells are few; only they are multiplied by the totals.
    counted = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    cells = counted.cube(rows, columns).agg(
        F.sum("n").alias("n"), F.grouping(rows).alias("row_total"), F.grouping(columns).alias("column_total")
    )
    return cells.select(
        F.when(F.col("row_total") == 1, "All").otherwise(F.col(rows).cast("string")).alias(rows),
        F.when(F.col("column_total") == 1, "All").otherwise(F.col(columns).cast("string")).alias(columns),
        "n",
    )


def crosstab_row_share(df: DataFrame, rows: str, columns: str, digits: int = 4) -> DataFrame:
    """Percent of each row category; the window runs over counted cells only."""
    cells = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(rows))
    return cells.withColumn("pct", F.round(share, digits))


# Bands of |skewness|.
SKEW_BANDS = ((0.5, "symmetric"), (1.0, "moderately asymmetric"))
SKEW_REST = "strongly asymmetric"


def skewness_bands(df: DataFrame, columns: Sequence[str], digits: int = 5) -> DataFrame:
    """Bias-corrected skewness (G1) and its band; needs at least 3 values."""
    raw = per_column(df, columns, {"g1": lambda c: F.skewness(c), "n": lambda c: F.count(c)})
    n = F.col("n").cast("double")
    corrected = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    band = F.when(F.abs("skewness") <= SKEW_BANDS[0][0], SKEW_BANDS[0][1])
    for limit, name in SKEW_BANDS[1:]:
        band = band.when(F.abs("skewness") <= limit, name)
    return raw.select("column", corrected.alias("skewness")).select(
        "column",
        F.round("skewness", digits).alias("skewness"),
        F.when(F.col("skewness").isNotNull(), band.otherwise(SKEW_REST)).alias("band"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column, in long form."""
    moments = per_column(df, columns, {
        "n": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "min": lambda c: F.min(c.cast("double")),
        "max": lambda c: F.max(c.cast("double")),
    })
    quartiles = exact_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, interpolate=True)
    joined = moments.join(quartiles.drop("n"), "column", "left")
    return joined.select(
        "column", "n", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")]
    )


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, unique, top value and its frequency per text column.

    Values are counted first, so the most frequent one is picked from counts; equal
    counts go to the alphabetically first value.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    counted = (
        df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    return counted.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_unique"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "value")).alias("top"),
        F.max("n").alias("freq"),
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.sum("__n").alias("n_rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates")
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width bins from minimum to maximum per column (last bin closed)."""
    values = long_values(df, columns)
    edges = per_column(df, columns, {
        "low": lambda c: F.min(_number(c)), "high": lambda c: F.max(_number(c)),
    })
    # One row per column of the schema: the broadcast is bounded.
    placed = values.join(F.broadcast(edges), "column")
    position = F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * bins)
    index = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    return placed.withColumn("bin", index).groupBy("column", "bin").agg(F.count("*").alias("n"))


def boxplot_stats(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: float = 1.5, digits: int = 4
) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and outlier count."""
    quartiles = exact_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=by, interpolate=True)
    reach = (F.col("q3") - F.col("q1")) * k
    fenced = quartiles.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})
    values = long_values(df, columns, by)
    if not by:
        fenced = F.broadcast(fenced)  # one row per column of the schema
    else:
        # Few classes: their fences are broadcast after counting, and no value is shuffled on a handful of keys.
        fenced = materialise(fenced, "fences")
        if fenced.limit(FENCES_BROADCAST + 1).count() <= FENCES_BROADCAST:
            fenced = F.broadcast(fenced)
    placed = null_safe_join(values, fenced, [*by, "column"])
    inside = F.col("value").between(F.col("fence_low"), F.col("fence_high"))
    return placed.groupBy(*by, "column").agg(
        F.count("*").alias("n"),
        *[F.round(F.first(c), digits).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def rate_by_category(df: DataFrame, category: str, label: str, min_rows: int = 0, digits: int = 6) -> DataFrame:
    """Target rate and support per category, rare categories left out."""
    rate = F.sum(label).cast("double") / F.count(label).cast("double")
    return (
        df.groupBy(category)
        .agg(F.round(rate, digits).alias("rate"), F.count(label).alias("n"))
        .filter(F.col("n") >= min_rows)
    )


def rate_spread(rates: DataFrame) -> DataFrame:
    return rates.agg(F.count("*").alias("n_categories"), F.round(F.max("rate") - F.min("rate"), 6).alias("spread"))


# ---- top k ---------------------------------------------------------------------

def top_categories(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values; NULL is no category and takes no place."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def top_crosstab(df: DataFrame, column: str, other: str, k: int = 20) -> DataFrame:
    """Row-normalised cross-table restricted to the k most frequent categories."""
    top = top_categories(df, column, k).select(column)
    return crosstab_row_share(df.join(F.broadcast(top), column, "left_semi"), column, other)


def best_and_worst(df: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    best = df.orderBy(F.desc(value), F.asc(name)).limit(k).withColumn("side", F.lit("top"))
    worst = df.orderBy(F.asc(value), F.asc(name)).limit(k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def strongest(df: DataFrame, value: str, tie_break: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(F.abs(value)), *tie_break).limit(n)
