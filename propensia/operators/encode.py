"""Categorical encoding and feature assembly for MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_stage(column: str, out: str | None = None, invalid: str = "keep") -> StringIndexer:
    """Most frequent value first, equal counts alphabetical; unseen values get an index of their own."""
    return StringIndexer(inputCol=column, outputCol=out or f"{column}_idx", handleInvalid=invalid)


def encoding_stages(low_cardinality: Sequence[str], high_cardinality: Sequence[str] = ()) -> list:
    """Index + one-hot for short category lists, index alone for long ones.

    One indexer counts the values of all columns in a single pass over the data.
    """
    columns = [*low_cardinality, *high_cardinality]
    if not columns:
        return []
    indexer = StringIndexer(inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep")
    if not low_cardinality:
        return [indexer]
    one_hot = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in low_cardinality], outputCols=[f"{c}_ohe" for c in low_cardinality]
    )
    return [indexer, one_hot]


# ---- long category lists as quantities -------------------------------------------

ENCODING_BROADCAST = 100_000
"""Most category values (a number each) that are broadcast to be looked up; counted before."""


def fit_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, encoded): share of the training rows that have the value; NULL is no value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.select("value", (F.col("n") / total).alias("encoded"))


def fit_target_rate(df: DataFrame, column: str, label: str, prior_rows: float = 20.0) -> DataFrame:
    """(value, encoded): rate of a 0/1 label per value, drawn towards the overall rate.

    ``prior_rows`` rows of the overall rate are added to each value, so a rare value says little.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(label).alias("n"), F.sum(F.col(label).cast("double")).alias("positive"))
    overall = counts.agg(F.sum("positive") / F.sum("n").cast("double")).scalar()
    rate = (F.col("positive") + F.lit(prior_rows) * overall) / (F.col("n") + F.lit(prior_rows))
    return counts.select("value", rate.alias("encoded"))


def apply_encoding(df: DataFrame, column: str, learned: DataFrame, out: str, default: float) -> DataFrame:
    """Learned numbers beside each row; a value not seen in training (or NULL) gets ``default``."""
    named = learned.select(F.col("value").alias("__value"), F.col("encoded").alias("__encoded"))
    if named.limit(ENCODING_BROADCAST + 1).count() <= ENCODING_BROADCAST:
        named = F.broadcast(named)
    joined = df.join(named, df[column] == named["__value"], "left")
    return joined.withColumn(out, F.coalesce("__encoded", F.lit(default))).drop("__value", "__encoded")


def feature_columns(numeric: Sequence[str], low_cardinality: Sequence[str], high_cardinality: Sequence[str] = ()) -> list[str]:
    return [*numeric, *[f"{c}_ohe" for c in low_cardinality], *[f"{c}_idx" for c in high_cardinality]]


def assembler_stage(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    """Rows with a NULL feature are left out of training; scoring gives them a row without a probability."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip")


def label_stage(label: str, out: str = "label_idx") -> StringIndexer:
    """Classes in alphabetical order, so that index 1 is class 1 whatever its frequency."""
    return StringIndexer(inputCol=label, outputCol=out, handleInvalid="error", stringOrderType="alphabetAsc")


def encoder(
    label: str, numeric: Sequence[str], low_cardinality: Sequence[str], high_cardinality: Sequence[str] = ()
) -> Pipeline:
    """Encode and assemble, without a classifier: fitted once, shared by all models."""
    columns = feature_columns(numeric, low_cardinality, high_cardinality)
    return Pipeline(stages=[
        *encoding_stages(low_cardinality, high_cardinality), label_stage(label), assembler_stage(columns),
    ])


def index_to_label(df: DataFrame, index: str, out: str, indexer: StringIndexerModel) -> DataFrame:
    return IndexToString(inputCol=index, outputCol=out, labels=indexer.labels).transform(df)


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Names of the vector's slots, from the metadata the assembler leaves."""
    groups = df.schema[column].metadata["ml_attr"]["attrs"].values()
    slots = sorted((a["idx"], a["name"]) for group in groups for a in group)
    return [name for _, name in slots]


def unpack_vector(df: DataFrame, column: str, out: str = "values") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(column)))


def tree_bins(df: DataFrame, columns: Sequence[str], floor: int = 32) -> int:
    """maxBins that holds the longest indexed category list plus the unseen slot."""
    if not columns:
        return floor
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return max(floor, *[counts[c] + 2 for c in columns])
