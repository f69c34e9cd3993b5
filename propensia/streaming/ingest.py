"""Incremental ingestion of landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from propensia.sources.delimited import ENCODING, SEPARATOR, string_schema


def ingest_landed_files(
    spark: SparkSession,
    landing: str,
    table_path: str,
    checkpoint: str,
    columns: Sequence[str],
    sep: str = SEPARATOR,
    encoding: str = ENCODING,
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """Append every file not seen before to a Parquet table, then stop.

    The checkpoint remembers which files were taken, so a restart or a later run
    processes each landed file exactly once. A file whose header is not ``columns`` in
    this order stops the run instead of putting values under wrong names.
    """
    reader = (
        spark.readStream.schema(string_schema(columns))
        .option("header", "true").option("sep", sep).option("encoding", encoding)
        .option("enforceSchema", "false")
    )
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_batch))
    query = (
        reader.csv(landing)
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(string_schema(columns)).parquet(table_path)
