"""Data-quality gates: each returns a small report; the ``require_`` forms raise."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.operators.aggregates import null_profile
from propensia.operators.learned import detect_constant_columns
from propensia.sources.delimited import schema_diff


class QualityError(ValueError):
    """A blocking data-quality rule does not hold."""


def unique_keys(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(table, n_rows, n_keys, n_extra) of several tables in one job."""
    reports = [
        df.groupBy(key).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
        .select(F.lit(name).alias("table"), "n_rows", "n_keys", (F.col("n_rows") - F.col("n_keys")).alias("n_extra"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, reports)


def require_unique_keys(tables: Mapping[str, DataFrame], key: str) -> None:
    broken = [r["table"] for r in unique_keys(tables, key).filter("n_extra > 0").collect()]
    if broken:
        raise QualityError(f"tables with more than one row per {key}: {broken}")


def row_conservation(base: DataFrame, result: DataFrame) -> DataFrame:
    counts = base.agg(F.count("*").alias("n")).withColumn("side", F.lit("base")).unionByName(
        result.agg(F.count("*").alias("n")).withColumn("side", F.lit("result"))
    )
    summary = counts.agg(
        F.max(F.when(F.col("side") == "base", F.col("n"))).alias("n_base"),
        F.max(F.when(F.col("side") == "result", F.col("n"))).alias("n_result"),
    )
    return summary.withColumn("conserved", (F.col("n_base") == F.col("n_result")).cast("int"))


def require_row_conservation(base: DataFrame, result: DataFrame) -> None:
    row = row_conservation(base, result).first()
    if not row["conserved"]:
        raise QualityError(f"{row['n_result']} rows after the joins, {row['n_base']} before")


def unexpected_codes(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Codes outside the confirmed list, with their row counts."""
    return (
        df.filter(F.col(column).isNull() | ~F.col(column).isin(list(allowed)))
        .groupBy(column).agg(F.count("*").alias("n"))
    )


def exclusivity(df: DataFrame, key: str, code: str) -> DataFrame:
    """Keys with several rows, and those that really hold several codes."""
    pairs = df.groupBy(key, code).agg(F.count("*").alias("n"))
    per_key = pairs.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(code).alias("n_codes"))
    return per_key.filter("n_rows > 1").agg(
        F.count("*").alias("n_keys_with_repeats"), F.count_if(F.col("n_codes") > 1).alias("n_keys_with_several_codes")
    )


def residual_problems(df: DataFrame) -> DataFrame:
    """Columns that still hold NULLs or never vary, after cleaning."""
    constants = detect_constant_columns(df, df.columns).withColumnRenamed("colonne", "column")
    report = null_profile(df).join(F.broadcast(constants.withColumn("constant", F.lit(1))), "column", "left")
    return report.select(
        "column", "n_null", F.coalesce("constant", F.lit(0)).alias("is_constant")
    ).filter("n_null > 0 OR is_constant = 1")


def schema_parity(train: DataFrame, score: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Feature columns on one side only or of different type (empty = scorable)."""
    return schema_diff(train.drop(*ignore), score.drop(*ignore))


def freshness(df: DataFrame, when: str, deadline: dt.datetime, max_age_hours: float) -> DataFrame:
    """Newest record, its age at the deadline and whether the batch is ready."""
    age = (F.unix_micros(F.lit(deadline)) - F.unix_micros("latest")) / 3_600_000_000.0
    return df.agg(F.max(when).cast("timestamp").alias("latest")).select(
        F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"),
        F.round(age, 4).alias("age_hours"),
        F.coalesce((age <= max_age_hours).cast("int"), F.lit(0)).alias("ready"),
    )
