"""Exact and approximate quantiles of many columns at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensia.operators.windows import bucketize, running_totals, value_splits, with_value_buckets


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), buckets: Mapping[str, str] | None = None) -> DataFrame:
    """(by..., column, value[, bucket]) with NULL and NaN values left out."""
    cells = []
    for c in columns:
        fields = [F.lit(c).alias("column"), F.col(c).cast("double").alias("value")]
        if buckets:
            fields.append(F.col(buckets[c]).alias("bucket"))
        cells.append(F.struct(*fields))
    return df.select(*by, F.inline(F.array(*cells))).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_ladder(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its count and its cumulative count.

    Columns: by..., column, value, n, n_upto, n_total. Repeated values collapse in
    the map-side aggregate before anything is ordered.
    """
    buckets = {c: f"__bucket_{i}" for i, c in enumerate(columns)}
    bucketed = with_value_buckets(df.select(*by, *[c for c in columns if c not in by]), buckets)
    counted = (
        long_values(bucketed, columns, by, buckets)
        .groupBy(*by, "column", "bucket", "value")
        .agg(F.count("*").alias("n"))
    )
    return running_totals(counted, [*by, "column"], "bucket", "value", ["n"], bounded=not by)


def _ranks(p: float, interpolate: bool) -> list[Column]:
    """1-based ranks (of ``n_total`` values) that decide the quantile p."""
    n = F.col("n_total")
    if interpolate:
        place = (n - 1) * F.lit(float(p))
        return [F.floor(place) + 1, F.ceil(place) + 1]
    return [F.greatest(F.ceil(n * F.lit(float(p))), F.lit(1))]


def _ladder_near(df: DataFrame, columns: Sequence[str], ranks: Sequence[Column]) -> DataFrame:
    """The part of ``value_ladder`` around the wanted ranks.

    Counting rows per value range tells which few ranges hold those ranks. Only
    their rows are then ordered, so hardly any value is shuffled.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    splits = value_splits(data, columns)
    buckets = {c: f"__bucket_{i}" for i, c in enumerate(columns)}
    before = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        long_values(bucketize(data, buckets, splits), columns, (), buckets)
        .groupBy("column", "bucket").agg(F.count("*").alias("n"))
        .withColumns({
            "offset": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "n_total": F.sum("n").over(Window.partitionBy("column")),
        })
    )
    holds = [(F.col("offset") < r) & (r <= F.col("offset") + F.col("n")) for r in ranks]
    wanted = ranges.filter(reduce(Column.__or__, holds)).collect()  # a few ranges per column
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, value double, n bigint, n_upto bigint, n_total bigint")
    cells = []
    for c, points in zip(columns, splits):
        place = F.lit(None).cast("int")
        for w in (w for w in wanted if w["column"] == c):
            low, high = points[int(w["bucket"])], points[int(w["bucket"]) + 1]
            below = F.col(c) <= F.lit(high) if high == float("inf") else F.col(c) < F.lit(high)
            place = F.when((F.col(c) >= F.lit(low)) & below, int(w["bucket"])).otherwise(place)
        cells.append(F.struct(F.lit(c).alias("column"), place.alias("bucket"), F.col(c).alias("value")))
    near = data.select(F.inline(F.array(*cells))).filter(F.col("bucket").isNotNull())
    counted = near.groupBy("column", "bucket", "value").agg(F.count("*").alias("n"))
    known = df.sparkSession.createDataFrame(
        [(w["column"], int(w["bucket"]), w["offset"], w["n_total"]) for w in wanted],
        "column string, bucket int, offset bigint, n_total bigint",
    )
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.join(F.broadcast(known), ["column", "bucket"]).select(
        "column", "value", "n", (F.sum("n").over(inside) + F.col("offset")).alias("n_upto"), "n_total"
    )


def _at_rank(rank: Column) -> Column:
    covers = (F.col("n_upto") - F.col("n") < rank) & (rank <= F.col("n_upto"))
    return F.max(F.when(covers, F.col("value")))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    interpolate: bool = False,
) -> DataFrame:
    """Exact quantiles: (by..., column, n, <name of each probability>...).

    Without interpolation the result is a value of the column (the smallest one
    whose share of rows reaches p), with it the usual linear interpolation. Spark's
    own exact percentile keeps a whole group's values in one buffer; here the values
    stay spread over the cluster. NULLs do not count.

    ``df`` is read three times (placing ranges, counting them, picking values):
    materialise it first when it is more than a scan.
    """
    ranks = {name: _ranks(p, interpolate) for name, p in probabilities.items()}
    if by:
        ladder = value_ladder(df, columns, by)
    else:
        ladder = _ladder_near(df, columns, [r for pair in ranks.values() for r in pair])
    picked = [_at_rank(r).alias(f"__{i}_{name}") for name, pair in ranks.items() for i, r in enumerate(pair)]
    found = ladder.groupBy(*by, "column").agg(F.max("n_total").alias("n"), *picked)
    exprs = []
    for name, p in probabilities.items():
        low = F.col(f"__0_{name}")
        if interpolate:
            place = (F.col("n") - 1) * F.lit(float(p))
            low = low + (F.col(f"__1_{name}") - low) * (place - F.floor(place))
        exprs.append(low.alias(name))
    return found.select(*by, "column", "n", *exprs)


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    relative_error: float = 0.01,
) -> DataFrame:
    """Sketch-based quantiles in one pass; same columns as ``exact_quantiles``."""
    names, ps = list(probabilities), [float(p) for p in probabilities.values()]
    accuracy = F.lit(int(round(1.0 / relative_error)))
    sketched = long_values(df, columns, by).groupBy(*by, "column").agg(
        F.count("*").alias("n"), F.percentile_approx("value", ps, accuracy).alias("q")
    )
    return sketched.select(*by, "column", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
