"""Raw ``;``-separated text files: reading, discovery and structural checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensia.functions.dates import year_from_name
from propensia.sources.first_lines import can_open, first_lines

# Dialect of the raw files.
SEPARATOR = ";"
ENCODING = "iso-8859-1"
CANDIDATE_SEPARATORS = (";", "|", "\t", ",")


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _read_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Files behind a path, folder, glob or list of them; names only."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return sorted(r[0] for r in listed.collect())  # one name per file


def headers(spark: SparkSession, files: Sequence[str], encoding: str = ENCODING) -> dict[str, str]:
    """First line of each file, decoded: one job for all files, which reads their first bytes only."""
    readable = [f for f in files if can_open(f)]
    found = dict(first_lines(spark, readable, encoding).select("path", "line").collect()) if readable else {}  # one line per file
    return {f: found[f] if f in found else _spark_first_line(spark, f, encoding) for f in files}


def _spark_first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The same through Spark's reader, for stores that only it knows; a job of its own."""
    reader = spark.read.option("header", "true").option("encoding", encoding).option("sep", "\u0001").option("quote", "")
    columns = reader.csv(literal_path(path)).columns
    return columns[0] if columns else ""


def literal_path(path: str) -> str:
    """A path that is not taken for a glob."""
    return "".join(f"\\{c}" if c in "*?[]{}" else c for c in path)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    sep: str = SEPARATOR,
    encoding: str = ENCODING,
    tags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Headered raw file(s), every column a string, bound by the names in each file's header.

    Files with equal headers are read together; different ones are united by name, a column
    that a file lacks being NULL there. ``columns`` picks and orders columns; one that no file
    has is NULL throughout. ``tags`` are further columns made from the file's ``_metadata``.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in headers(spark, _read_files(spark, path), encoding).items():
        names = tuple(c.strip().strip('"') for c in line.split(sep)) if line else ()
        groups.setdefault(names, []).append(file)
    reader = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("enforceSchema", "false")
    parts = [reader.schema(string_schema(names)).csv([literal_path(f) for f in files]) for names, files in groups.items() if names]
    tags = dict(tags or {})
    if not parts:
        empty = spark.createDataFrame([], string_schema(columns or []))
        return empty.withColumns({t: F.lit(None) for t in tags})
    # A union has no file metadata any more: every part is tagged before.
    if columns is None:
        tagged = [p.withColumns(tags) if tags else p for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    own = [c.alias(t) for t, c in tags.items()]
    picked = [p.select(*[F.col(f"`{c}`") if c in p.columns else F.lit(None).cast("string").alias(c) for c in columns], *own) for p in parts]
    return reduce(DataFrame.unionAll, picked)


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    code_columns: Sequence[str] = (),
    sep: str = ",",
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """Typed CSV; ``code_columns`` are identifiers and end up as strings.

    Without a schema the types are inferred from all rows; a smaller ``sampling_ratio`` is
    cheaper, but a value that its rows did not show becomes NULL. A given schema must name the
    columns as the header does.
    """
    reader = spark.read.option("header", "true").option("sep", sep)
    if schema is None:
        reader = reader.option("inferSchema", "true").option("samplingRatio", str(sampling_ratio))
    else:
        reader = reader.schema(schema).option("enforceSchema", "false")
    df = reader.csv(path)
    present = {c: F.col(c).cast("string") for c in code_columns if c in df.columns}
    return df.withColumns(present) if present else df


def load_dataset(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """``*.csv`` through ``read_typed_csv``, anything else as a Parquet folder."""
    if path.endswith(".csv"):
        return read_typed_csv(spark, path, **csv_options)
    return spark.read.parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of a folder's files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length", "modificationTime")
    )


def file_inventory(
    spark: SparkSession, folder: str, pattern: str = "*", preview: int = 3, sep: str = SEPARATOR, encoding: str = ENCODING
) -> DataFrame:
    """Per file: column names, data-row count and the first ``preview`` data lines.

    One pass for all files: lines are read as text, headers recognised by being
    the line at the start of their file.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .option("wholetext", "false")
        .text(folder)
        .select(
            # Lines arrive as the file's bytes, whatever they mean.
            F.decode(F.col("value").cast("binary"), encoding).alias("value"),
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("position"),
        )
        .filter(F.length("value") > 0)
    )
    # Positions grow inside a split; splits of one file are ordered by their start.
    place = F.struct("block", "position")
    header = lines.groupBy("file").agg(F.min_by("value", place).alias("header"), F.count("*").alias("n"))
    ranked = _first_lines(lines, preview)
    return header.join(ranked, "file").select(
        "file",
        F.split("header", F.lit("\\Q" + sep + "\\E")).alias("columns"),
        (F.col("n") - 1).alias("n_rows"),
        "preview",
    )


def _first_lines(lines: DataFrame, preview: int) -> DataFrame:
    w = Window.partitionBy("file").orderBy("block", "position")
    return (
        lines.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= preview + 1)
        .groupBy("file")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "value")))),
                lambda s: s["value"],
            ).alias("preview")
        )
    )


def header_lines(spark: SparkSession, folder: str, pattern: str = "*", encoding: str = ENCODING) -> DataFrame:
    """(file, header) from the first line of every file; nothing behind it is read."""
    files = [r[0] for r in list_files(spark, folder, pattern).filter("length > 0").select("path").collect()]  # one name per file
    rows = [(unquote(f.rsplit("/", 1)[-1]), line) for f, line in headers(spark, files, encoding).items()]
    return spark.createDataFrame(rows, "file string, header string")


def search_columns(
    spark: SparkSession, folder: str, needle: str, pattern: str = "*", sep: str = SEPARATOR
) -> DataFrame:
    """(file, column) for every column whose name contains ``needle``, ignoring case."""
    return (
        header_lines(spark, folder, pattern)
        .select("file", F.explode(F.split("header", F.lit("\\Q" + sep + "\\E"))).alias("column"))
        .filter(F.upper("column").contains(needle.upper()))
    )


def sniff_separator(
    spark: SparkSession, folder: str, pattern: str = "*", candidates: Sequence[str] = CANDIDATE_SEPARATORS
) -> DataFrame:
    """Per file the candidate that splits the header into most columns.

    Ties go to the earlier candidate; a file that no candidate splits reports one column.
    """
    counts = F.array(*[
        F.struct(
            F.size(F.split("header", F.lit("\\Q" + s + "\\E"))).alias("n_columns"),
            F.lit(-i).alias("order"),
            F.lit(s).alias("separator"),
        )
        for i, s in enumerate(candidates)
    ])
    return (
        header_lines(spark, folder, pattern)
        .withColumn("best", F.array_max(counts))
        .select("file", "best.separator", "best.n_columns")
    )


def granularity(df: DataFrame, key: str, state_ratio: float = 1.05) -> DataFrame:
    """Rows against distinct keys: a "state" table has about one row per key."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    ratio = F.try_divide(F.sum("n").cast("double"), F.count(key).cast("double"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(key).alias("n_keys"),
        F.when(ratio <= state_ratio, "state").otherwise("movement").alias("granularity"),
    )


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that are missing on one side or differ in type."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    rows = [
        (c, a.get(c), b.get(c))
        for c in sorted(set(a) | set(b))
        if a.get(c) != b.get(c)
    ]
    schema = "column string, left_type string, right_type string"
    return left.sparkSession.createDataFrame(rows, schema)


def read_with_file_year(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, sep: str = SEPARATOR, encoding: str = ENCODING, folder: bool = False
) -> DataFrame:
    """Raw rows tagged with the year in the name of their file (or of its folder); headers may differ from year to year."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2) if folder else F.col("_metadata.file_name")
    return read_delimited(spark, path, columns, sep, encoding, tags={"file_year": year_from_name(name)})
