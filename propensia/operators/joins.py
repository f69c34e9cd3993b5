"""Equi-joins on one key. The physical strategy is Spark's, sized by its statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_chain(base: DataFrame, features: Sequence[DataFrame], key: str) -> DataFrame:
    """Base with every one-row-per-key feature table attached; base rows all stay.

    All joins share the key the features were grouped by, so Spark reuses the one
    hash partitioning for the whole chain.
    """
    out = base
    for feature in features:
        out = out.join(feature, on=key, how="left")
    return out


def missing_from(targets: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Target rows whose key the base does not hold."""
    return targets.join(base.select(key).distinct(), key, "left_anti")


def found_in(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table holds."""
    return rows.join(other.select(key).distinct(), key, "left_semi")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the keys that occur more than once."""
    keys = list(keys)
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    return df.join(repeated, keys, "left_semi")


def join_target(features: DataFrame, target: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return features.join(target, on=key, how=how)


def join_small(df: DataFrame, small: DataFrame, key: str, max_rows: int = 10_000) -> DataFrame:
    """Attach a per-class table without shuffling ``df``.

    The hint is given only after counting: a table over ``max_rows`` is joined the
    ordinary way.
    """
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return df.join(small, on=key)


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the three regions of two key sets, in one full outer join."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(1))
    b = right.select(key).distinct().withColumn("in_right", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("n_both"),
        F.count_if(F.col("in_right").isNull()).alias("n_left_only"),
        F.count_if(F.col("in_left").isNull()).alias("n_right_only"),
    )
