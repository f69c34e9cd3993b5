"""Sinks: Parquet tables, learned parameters as JSON, CSV samples, catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int | None = None
) -> DataFrame:
    """Overwrite a Parquet folder and read it back.

    ``files`` merges partitions without a shuffle before writing (small-file control).
    """
    out = df.coalesce(files) if files else df
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def params_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """Learned values (one row per column, class or model) as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def save_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The schema is fixed by the caller, so an empty parameter list still loads."""
    return spark.read.schema(schema).json(path)


def export_csv_sample(df: DataFrame, path: str, fraction: float = 0.05, seed: int = 42, sep: str = ",") -> DataFrame:
    """A seeded sample of the rows as headered CSV, read back as strings."""
    df.sample(fraction=fraction, seed=seed).write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
    return (
        df.sparkSession.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
        .option("header", "true").option("sep", sep).csv(path)
    )


def save_table(df: DataFrame, name: str, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Curated table registered in the session catalog, data kept at ``path``."""
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def bucket_number(rows: int, rows_per_bucket: int = 2_000_000, at_least: int = 8) -> int:
    """A power of two, so that tables of one generation can share the number and a later one can double it."""
    number = at_least
    while number * rows_per_bucket < rows:
        number *= 2
    return number


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Curated table cut into ``buckets`` files by key, each sorted by it: later joins and groupings by the key need no shuffle.

    Meant for tables with one row per key, where no bucket can be hot. The rows are dealt by the same
    hash that the table is cut by, so every task writes one file.
    """
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return df.sparkSession.table(name)
