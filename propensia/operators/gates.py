"""Data-quality gates counted while a table is written, without a job of their own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from propensia.operators.quality import QualityError

GATES = "`table` string, n_rows bigint, n_keys bigint, n_extra bigint"
_PLACE = "__place"


def observe_keys(df: DataFrame, key: str, name: str, buckets: int) -> tuple[DataFrame, Observation]:
    """``df`` dealt to ``buckets`` tasks by key, and what its next write will report: rows and rows beyond the first of a key.

    Equal keys meet in one task, where a row's place among them tells the surplus. The counters sit in the stage that
    writes, after the last shuffle, and Spark takes each task of such a stage into account once, however often
    it is retried. NULL counts as one key. Meant for tables that should hold one row per key.
    """
    seen = Observation(name)
    place = F.row_number().over(Window.partitionBy(key).orderBy(key))
    placed = df.repartition(buckets, key).withColumn(_PLACE, place)
    observed = placed.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(_PLACE) > 1).alias("n_extra"))
    return observed.drop(_PLACE), seen


def observe_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and the row count its next write will report."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def key_report(spark: SparkSession, seen: Mapping[str, Observation]) -> DataFrame:
    """(table, n_rows, n_keys, n_extra) of tables already written."""
    rows = [(t, o.get["n_rows"], o.get["n_rows"] - o.get["n_extra"], o.get["n_extra"]) for t, o in seen.items()]
    return spark.createDataFrame(rows, GATES)


def require_unique(seen: Mapping[str, Observation], key: str) -> None:
    broken = [t for t, o in seen.items() if o.get["n_extra"] > 0]
    if broken:
        raise QualityError(f"tables with more than one row per {key}: {broken}")


def require_conserved(base: Observation, result: Observation) -> None:
    before, after = base.get["n_rows"], result.get["n_rows"]
    if before != after:
        raise QualityError(f"{after} rows after the joins, {before} before")
