"""One-row-per-key selection and order statistics that never need one big task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    Columns not named in ``order`` break ties, so reruns agree. Filtering on rank 1
    lets Spark keep one row per key in each map task before the shuffle
    (WindowGroupLimit), which is what makes a hot key harmless.
    """
    rank = "__rank"
    tie_break = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*order, *tie_break)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def latest_per_key(df: DataFrame, keys: Sequence[str], when: Column) -> DataFrame:
    """The newest snapshot of every key, by a parsed date."""
    return first_per_key(df, keys, [when.desc()])


def active_first_per_key(df: DataFrame, keys: Sequence[str], start: Column, end: str) -> DataFrame:
    """A row without an end wins; among equals the newest start."""
    return first_per_key(df, keys, [F.col(end).isNull().desc(), start.desc()])


SPLIT_SHARE = 0.1


def bucket_count(df: DataFrame) -> int:
    """Enough value ranges to give every shuffle task a few, within a sketch's reach."""
    return min(max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 8192)


def value_splits(df: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Split points (from -inf to inf) of about equally full value ranges per column.

    They only balance the work, so a tenth of the rows is enough to place them; every
    row is bucketed and results never depend on where the splits fall. Their number
    follows the shuffle width, not the data.
    """
    n = bucket_count(df)
    probabilities = [i / n for i in range(1, n)]
    sketched = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).sample(fraction=SPLIT_SHARE, seed=7)
    found = sketched.approxQuantile(list(columns), probabilities, 0.5 / n)
    infinity = float("inf")
    # Bucketizer wants three split points; where there are none, 0 is as good as any.
    return [[-infinity, *(sorted(set(points)) or [0.0]), infinity] for points in found]


def bucketize(df: DataFrame, columns: Mapping[str, str], splits: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``{column: bucket column}`` by the given splits; NULLs get their own bucket."""
    return Bucketizer(
        splitsArray=[list(s) for s in splits], inputCols=list(columns), outputCols=list(columns.values()), handleInvalid="keep"
    ).transform(df)


def with_value_buckets(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return bucketize(df, columns, value_splits(df, list(columns)))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys meet; keeps the left columns and the right's others."""
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), condition, how).select("l.*", *extra)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: str,
    measures: Sequence[str],
    descending: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Cumulative and overall totals along ``order`` inside each ``by`` group.

    ``df`` holds one row per (by, order) value, already bucketed by value range.
    Range totals are accumulated over the few buckets, rows only inside their own
    bucket, so no task ever sorts a whole group. Adds ``<m>_upto`` (inclusive) and
    ``<m>_total``.

    ``bounded`` says that the groups are limited by the schema (none, or one per
    column): the range totals are then at most 8192 rows per column and broadcast.
    Otherwise the join shuffles on the key the window needs anyway.
    """
    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    # A struct is never NULL and compares its NULL fields as equal, so one plain
    # equality serves join, aggregate and window with the same partitioning.
    group, grouped = list(by), df
    if by and not bounded:
        group, grouped = ["__group"], df.withColumn("__group", F.struct(*by))
    before = Window.partitionBy(*group).orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = (
        grouped.groupBy(*group, bucket)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *group,
            bucket,
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_offset") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    )
    inside = Window.partitionBy(*group, bucket).orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = grouped.join(F.broadcast(offsets) if bounded else offsets, [*group, bucket])
    return joined.select(
        *df.columns,
        *[(F.sum(m).over(inside) + F.col(f"{m}_offset")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def average_rank(df: DataFrame, family: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rank inside a family, largest first, ties sharing the mean of their ranks.

    Equal to (rows strictly above) + (ties + 1) / 2; NULL values get no rank.
    """
    bucketed = with_value_buckets(df, {value: "__bucket"})
    levels = (
        bucketed.filter(F.col(value).isNotNull())
        .groupBy(*family, "__bucket", value)
        .agg(F.count("*").alias("__n"))
    )
    ranked = running_totals(levels, family, "__bucket", value, ["__n"], descending=True).select(
        *family, value, (F.col("__n_upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out)
    )
    return null_safe_join(df, ranked, [*family, value], "left")


def row_numbers(df: DataFrame, order: str, out: str = "row_index") -> DataFrame:
    """0-based consecutive numbers along a unique numeric column, without one big sort task."""
    bucketed = with_value_buckets(df.select(order), {order: "__bucket"}).withColumn("__n", F.lit(1).cast("bigint"))
    numbered = running_totals(bucketed, [], "__bucket", order, ["__n"], bounded=True).select(
        order, (F.col("__n_upto") - 1).alias(out)
    )
    return df.join(numbered, order)
