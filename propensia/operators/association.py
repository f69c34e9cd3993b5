"""Correlation and association between features and with the target."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensia.functions.dates import age_years, fr_date
from propensia.operators.aggregates import distinct_counts, per_column
from propensia.operators.learned import IQR_K, flag_lift
from propensia.operators.quantiles import exact_quantiles
from propensia.operators.rules import flag_columns, numeric_features
from propensia.operators.sets import union_tagged


# ---- correlation ---------------------------------------------------------------

def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are known; NULL when one never varies.

    ``F.corr`` raises a division by zero on a constant column in ANSI mode.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], digits: int = 6, pairwise: bool = True
) -> DataFrame:
    """(variable_1, variable_2, correlation) of the upper triangle.

    ``pairwise`` uses for each pair the rows where both are known; otherwise only
    rows complete in all columns count. NaN counts as unknown. A constant column has
    no correlation (NULL).

    Each task multiplies its rows, centred on the column means, with themselves and with
    the pattern of known cells: five k x k sums hold everything that all pairs need, so the
    cost per row is that of one matrix product and k may be in the hundreds.
    """
    columns = list(columns)
    number = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    data = df.select(*[e.alias(c) for c, e in number.items()])
    if not pairwise:
        data = data.na.drop()
    k = len(columns)
    means = data.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m if m is not None else 0.0 for m in means])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, k, k))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - centre
                known = ~np.isnan(x)
                x, m = np.where(known, x, 0.0), known.astype(float)
                # Rows where both are known: their number, sums of x, of y, of x*y, of x*x.
                total += np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    summed = data.mapInArrow(moments, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # 5 k*k numbers
    n, sx, sy, sxy, sxx = np.array([r["v"] for r in sorted(summed, key=lambda r: r["at"])] or [0.0] * (5 * k * k)).reshape(5, k, k)
    rows = []
    for i, j in combinations(range(k), 2):
        size = n[i, j]
        r = None
        if size:
            vx, vy = sxx[i, j] / size - (sx[i, j] / size) ** 2, sxx[j, i] / size - (sy[i, j] / size) ** 2
            # What remains of a constant after rounding is no spread.
            if vx > 1e-14 * sxx[i, j] / size and vy > 1e-14 * sxx[j, i] / size:
                r = round(float((sxy[i, j] / size - sx[i, j] * sy[i, j] / size**2) / np.sqrt(vx * vy)), digits)
        rows.append((columns[i], columns[j], r))
    return df.sparkSession.createDataFrame(rows, "variable_1 string, variable_2 string, correlation double")


def correlation_matrix_pairs(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """The same over complete rows through MLlib's distributed matrix.

    The better form for many columns: cost of one Gram matrix instead of one
    aggregate per pair. The k x k result is unpacked on the driver.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    )
    matrix = Correlation.corr(vectors.select("v"), "v").head()[0].toArray()
    index = {c: i for i, c in enumerate(columns)}
    rows = [
        (a, b, None if matrix[index[a], index[b]] != matrix[index[a], index[b]]
         else round(float(matrix[index[a], index[b]]), digits))
        for a, b in combinations(columns, 2)
    ]
    return df.sparkSession.createDataFrame(rows, "variable_1 string, variable_2 string, correlation double")


def strong_pairs(pairs: DataFrame, threshold: float, inclusive: bool = True) -> DataFrame:
    size = F.abs("correlation")
    return pairs.filter(size >= threshold if inclusive else size > threshold)


def ranked_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    return (
        pairs.filter(F.col("correlation").isNotNull())
        .withColumn("abs_corr", F.abs("correlation"))
        .orderBy(F.desc("abs_corr"), "variable_1", "variable_2").limit(n)
    )


# ---- features against the target -----------------------------------------------

def point_biserial(df: DataFrame, columns: Sequence[str], label: str, min_rows: int = 30, digits: int = 6) -> DataFrame:
    """Correlation of each numeric column with a 0/1 target: (feature, r, t, n).

    Constant columns and columns with too few known rows are left out. t follows
    from r and n; its tail is read from a t table with n - 2 degrees of freedom.
    """
    y = F.col(label).cast("double")
    stats = per_column(df.withColumn("__y", y), columns, {
        "r": lambda c: safe_corr(c.cast("double"), F.col("__y")),
        "n": lambda c: F.count(F.when(F.col("__y").isNotNull(), c)),
        "varies": lambda c: F.min(c.cast("double")) < F.max(c.cast("double")),
    })
    n = F.col("n").cast("double")
    t = F.try_divide(F.col("r") * F.sqrt(n - 2), F.sqrt(1 - F.col("r") * F.col("r")))
    return stats.filter((F.col("n") >= min_rows) & F.col("varies") & F.col("r").isNotNull()).select(
        F.col("column").alias("feature"),
        F.round("r", digits).alias("r"),
        F.round(t, digits - 2).alias("t"),
        "n",
    )


def contingency(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Counted cells (feature, value, label, n) of all categorical columns, NULLs left out."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).cast("string").alias("label"), F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value", "label").agg(F.count("*").alias("n"))
    )


def cramers_v(df: DataFrame, columns: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """Bias-corrected Cramer's V per categorical column: (feature, cramers_v, n_modalites, n).

    chi2 = n (sum O^2 / (R C) - 1), so empty cells need no row of their own. A 2 x 2
    table gets the continuity correction, whose deviation is the same in all cells.
    """
    cells = contingency(df, columns, label)
    rows = cells.groupBy("feature", "value").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy("feature", "label").agg(F.sum("n").alias("col_n"))
    sizes = rows.groupBy("feature").agg(
        F.sum("row_n").alias("n"), F.count("*").alias("r"), F.min("row_n").alias("row_min")
    )
    classes = cols.groupBy("feature").agg(F.count("*").alias("k"), F.min("col_n").alias("col_min"))
    joined = cells.join(rows, ["feature", "value"]).join(cols, ["feature", "label"])
    observed = F.col("n").cast("double")
    summed = joined.groupBy("feature").agg(
        F.sum(observed * observed / (F.col("row_n").cast("double") * F.col("col_n").cast("double"))).alias("s"),
        F.max(F.struct("row_n", "col_n", "n")).alias("cell"),
    )
    n, r, k = F.col("n").cast("double"), F.col("r").cast("double"), F.col("k").cast("double")
    row_min, col_min = F.col("row_min").cast("double"), F.col("col_min").cast("double")
    plain = n * (F.col("s") - 1)
    # 2 x 2: |O - E| is one number; chi2 = (|O - E| - 0.5)^2 * sum(1 / E).
    expected = F.col("cell.row_n").cast("double") * F.col("cell.col_n").cast("double") / n
    deviation = F.abs(F.col("cell.n").cast("double") - expected)
    deviation = deviation - F.least(F.lit(0.5), deviation)
    inverse_expected = n * n * n / (row_min * (n - row_min) * col_min * (n - col_min))
    chi2 = F.when((F.col("r") == 2) & (F.col("k") == 2), deviation * deviation * inverse_expected).otherwise(plain)
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    r_corrected = r - (r - 1) * (r - 1) / (n - 1)
    k_corrected = k - (k - 1) * (k - 1) / (n - 1)
    room = F.least(r_corrected - 1, k_corrected - 1)
    return (
        sizes.join(classes, "feature").join(summed, "feature")
        .filter((F.col("r") >= 2) & (F.col("n") > 1))
        .select(
            "feature",
            F.when(room > 0, F.round(F.sqrt(phi2 / room), digits)).alias("cramers_v"),
            F.col("r").alias("n_modalites"),
            "n",
        )
    )


def flag_association(df: DataFrame, flags: Sequence[str], label: str, digits: int = 6) -> DataFrame:
    """Lift of each active flag and |ln lift|; flags that are never on are left out."""
    strength = F.when(F.col("lift") > 0, F.abs(F.ln("lift"))).otherwise(0.0)
    return flag_lift(df, flags, label).filter("n_active > 0").select(
        F.col("flag").alias("feature"),
        F.round("rate", digits).alias("taux_activation"),
        F.round("rate_if_active", digits).alias("taux_eligible_si_actif"),
        F.round("lift", digits).alias("lift"),
        F.round(strength, digits).alias("abs_log_lift"),
    )


def association_ranking(numeric: DataFrame, categorical: DataFrame, flags: DataFrame) -> DataFrame:
    """The three families in one table, ranked inside each (their scales differ).

    One row per feature, so the ranking window is bounded by the schema.
    """
    families = union_tagged({
        "numerique": numeric.select("feature", F.abs("r").alias("force_association")),
        "categoriel": categorical.select("feature", F.col("cramers_v").alias("force_association")),
        "flag_binaire": flags.select("feature", F.col("abs_log_lift").alias("force_association")),
    })
    order = Window.partitionBy("type").orderBy(F.desc("force_association"))
    ties = Window.partitionBy("type", "force_association")
    rank = F.rank().over(order) + (F.count("*").over(ties) - 1) / 2
    return families.withColumn(
        "rang_dans_sa_famille", F.when(F.col("force_association").isNotNull(), rank)
    )


def rates_against_global(df: DataFrame, category: str, label: str, digits: int = 6) -> DataFrame:
    """Target rate per category next to the overall rate, from one grouped pass."""
    counts = df.groupBy(category).agg(F.sum(label).alias("pos"), F.count(label).alias("n"))
    overall = counts.agg(F.sum("pos").cast("double") / F.sum("n").cast("double")).scalar()
    return counts.select(
        category,
        "n",
        F.round(F.try_divide(F.col("pos").cast("double"), F.col("n").cast("double")), digits).alias("rate"),
        F.round(overall, digits).alias("global_rate"),
    )


# ---- diagnostics ---------------------------------------------------------------

def outlier_profile(df: DataFrame, columns: Sequence[str], k: float = IQR_K, digits: int = 4) -> DataFrame:
    """Range, mean, quantiles, fences, negative and outside counts per column."""
    quantiles = exact_quantiles(
        df, columns, {"p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    ).drop("n")
    spread = F.col("q3") - F.col("q1")
    fenced = quantiles.withColumns({"fence_low": F.col("q1") - spread * k, "fence_high": F.col("q3") + spread * k})
    rows = fenced.collect()  # one row per profiled column
    fenced = df.sparkSession.createDataFrame(rows, fenced.schema)
    low = {r["column"]: F.lit(r["fence_low"]) for r in rows}
    high = {r["column"]: F.lit(r["fence_high"]) for r in rows}
    known = [c for c in columns if c in low]
    counts, cells = [], []
    for i, c in enumerate(known):
        v = F.col(c).cast("double")
        stats = {"min": F.min(v), "max": F.max(v), "mean": F.round(F.avg(v), digits), "n_negative": F.count_if(v < 0),
                 "n_outside": F.count_if((v < low[c]) | (v > high[c]))}
        counts += [e.alias(f"{i}_{name}") for name, e in stats.items()]
        cells.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{name}").alias(name) for name in stats]))
    basics = df.agg(*counts).select(F.inline(F.array(*cells)))
    return basics.join(F.broadcast(fenced), "column").select(
        "column", "min", "max", "mean", "median", "p1", "p99",
        F.round("fence_low", digits).alias("fence_low"), F.round("fence_high", digits).alias("fence_high"),
        "n_negative", "n_outside",
    )


def birthdate_profile(df: DataFrame, birth: str, reference: dt.date, age_range: tuple[int, int] = (16, 100)) -> DataFrame:
    aged = df.select(age_years(fr_date(birth), reference).alias("age"))
    return aged.agg(
        F.min("age").alias("age_min"),
        F.max("age").alias("age_max"),
        F.count_if(F.col("age") < 0).alias("n_future"),
        F.count_if((F.col("age") >= 0) & (F.col("age") < age_range[0])).alias("n_too_young"),
        F.count_if(F.col("age") > age_range[1]).alias("n_too_old"),
    )


def cardinality_profile(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Distinct values (NULL counting as one) and their ratio to the rows."""
    nulls = per_column(df, columns, {"n_null": lambda c: F.count_if(c.isNull()), "n_rows": lambda c: F.count("*")})
    values = F.col("n_distinct") + (F.col("n_null") > 0).cast("int")
    return distinct_counts(df, columns).join(nulls, "column").select(
        "column",
        values.alias("n_modalites"),
        "n_rows",
        F.round(F.try_divide(values.cast("double"), F.col("n_rows").cast("double")), digits).alias("ratio"),
    )


def pair_sample(df: DataFrame, columns: Sequence[str], label: str, rows: int = 1000, key: str | None = None) -> DataFrame:
    """At most ``rows`` rows for a pair plot, chosen by hash so reruns agree."""
    seeded = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ([key] if key else [*columns, label])]))
    return df.select(*columns, label, seeded.alias("__h")).orderBy("__h").limit(rows).drop("__h")


def column_roles(df: DataFrame, targets: Iterable[str] = (), codes: Iterable[str] = ()) -> DataFrame:
    """(column, role): continuous, flag, target or categorical."""
    targets, flags = set(targets), set(flag_columns(df))
    numeric = set(numeric_features(df, codes))

    def role(c: str) -> str:
        if c in targets:
            return "target"
        if c in flags:
            return "flag"
        return "continuous" if c in numeric else "categorical"

    return df.sparkSession.createDataFrame([(c, role(c)) for c in df.columns], "column string, role string")
