"""Incremental ingestion with a ledger: which file went where, and which files were set aside and why."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.sources.delimited import ENCODING, SEPARATOR, headers, literal_path, read_delimited, string_schema

LEDGER = "path string, status string, reason string, n_rows bigint, batch string"
LISTING = "path string, modificationTime timestamp, length bigint, content binary"
SOURCE = "source_file"
TAKEN, ASIDE = "taken", "aside"


def misfit(header: str, columns: Sequence[str], sep: str = SEPARATOR) -> str | None:
    """Why a file with this first line cannot give ``columns``; None if it can, in whatever order and among whatever others."""
    names = [c.strip().strip('"') for c in header.split(sep)] if header else []
    if not names:
        return "no header"
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        return "column more than once: " + ", ".join(twice)
    missing = [c for c in columns if c not in names]
    return "columns missing: " + ", ".join(missing) if missing else None


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per file seen: path, status, reason (of a file set aside), n_rows (of a taken one), batch."""
    return _existing(spark, ledger, LEDGER)


def read_ingested(spark: SparkSession, table_path: str, ledger: str, columns: Sequence[str]) -> DataFrame:
    """The ingested rows with the file they came from; what a failed batch left behind is not in the ledger and not read."""
    rows = _existing(spark, table_path, ", ".join(f"`{c}` string" for c in (*columns, SOURCE, "batch")))
    known = read_ledger(spark, ledger).filter(F.col("status") == TAKEN).select("batch").distinct()
    return rows.join(known, "batch", "left_semi").select(*columns, SOURCE)


def _existing(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def take_files(
    spark: SparkSession, files: Sequence[str], table_path: str, ledger: str, columns: Sequence[str], sep: str = SEPARATOR, encoding: str = ENCODING
) -> None:
    """Ingest one batch of files; doing it again, wholly or after a failure, changes nothing.

    Files of the ledger are left out. The others' rows go to a folder named after the set of files, so a repeated
    batch overwrites what its first try wrote; the ledger entry comes last and makes the folder count.
    """
    seen = {r[0] for r in read_ledger(spark, ledger).filter(F.col("path").isin(list(files))).select("path").collect()}  # at most the files of the batch
    new = sorted(set(files) - seen)
    if not new:
        return
    batch = hashlib.sha256("\n".join(new).encode()).hexdigest()[:24]
    reasons = {f: misfit(line, columns, sep) for f, line in headers(spark, new, encoding).items()}
    fitting = [f for f in new if reasons[f] is None]
    entries = spark.createDataFrame([(f, ASIDE if reasons[f] else TAKEN, reasons[f], f.rsplit("/", 1)[-1]) for f in new], "path string, status string, reason string, name string")
    counts = spark.createDataFrame([], "path string, n bigint")
    if fitting:
        rows = read_delimited(spark, [literal_path(f) for f in fitting], columns, sep, encoding, tags={SOURCE: F.input_file_name()})
        folder = f"{table_path.rstrip('/')}/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(string_schema([*columns, SOURCE])).parquet(folder)
        # The names are compared decoded: Spark reports them percent-encoded in one place and plain in the other.
        counts = written.groupBy(F.url_decode(F.regexp_extract(F.replace(SOURCE, F.lit("+"), F.lit("%2B")), "[^/]+$", 0)).alias("name")).agg(F.count("*").alias("n"))
        counts = entries.select("path", F.url_decode(F.replace("name", F.lit("+"), F.lit("%2B"))).alias("name")).join(counts, "name").select("path", "n")
    done = entries.join(counts, "path", "left").select(
        "path", "status", "reason", F.when(F.col("status") == TAKEN, F.coalesce("n", F.lit(0))).cast("bigint").alias("n_rows"), F.lit(batch).alias("batch"))
    done.coalesce(1).write.mode("append").parquet(ledger)  # one row per file of the batch


def ingest_with_ledger(
    spark: SparkSession, landing: str, table_path: str, ledger: str, checkpoint: str, columns: Sequence[str],
    sep: str = SEPARATOR, encoding: str = ENCODING, max_files_per_batch: int = 1000,
) -> DataFrame:
    """Take every landed file not seen before, then stop; returns all ingested rows.

    Unlike ``ingest_landed_files`` columns are bound by the names in each file's header, and a file that cannot give
    them is set aside with a reason instead of stopping the stream. A restart repeats the batch that failed; even with
    a new checkpoint the ledger keeps files from being taken twice. A file without a single byte is never listed by
    Spark, so it has no entry. The driver holds the names of one batch at a time.
    """
    listed = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", str(max_files_per_batch)).load(landing).select("path")
    query = (
        listed.writeStream
        .foreachBatch(lambda batch, _: take_files(batch.sparkSession, [r[0] for r in batch.collect()], table_path, ledger, columns, sep, encoding))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_ingested(spark, table_path, ledger, columns)
