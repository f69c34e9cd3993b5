"""Per-key aggregates in mergeable form: parts of two row sets add up to the parts of both, bit for bit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensia.functions.amounts import partial_sums, total_of_parts
from propensia.functions.dates import recency_days

# How each part of two row sets becomes that of both.
MERGE = {
    "n_rows": F.sum, "n_amounts": F.sum, "units": F.sum, "rest": F.sum, "n_positive": F.sum,
    "low": F.min, "high": F.max, "latest": F.max,
}


def movement_parts(df: DataFrame, keys: Sequence[str], amount: str, when: str | None = None) -> DataFrame:
    """Counts, exact sums in whole numbers, extremes and the last moment of each key's movements."""
    moment = F.max(when) if when else F.max(F.lit(None).cast("timestamp"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[e.alias(n) for n, e in partial_sums(amount).items()],
        F.count_if(F.col(amount) > 0).alias("n_positive"), F.min(amount).alias("low"), F.max(amount).alias("high"), moment.alias("latest"),
    )


def merge_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[fn(c).alias(c) for c, fn in MERGE.items()])


def _total() -> Column:
    return total_of_parts("units", "rest")


def _mean() -> Column:
    return F.try_divide(_total(), F.col("n_amounts").cast("double"))


# The output column names of the feature tables below.

def balance_of_parts(parts: DataFrame, key: str) -> DataFrame:
    return parts.select(key, _mean().alias("solde_moyen"), F.col("low").alias("solde_min"), F.col("high").alias("solde_max"),
                        F.col("n_rows").alias("nb_mois_observes_solde"))


def deposit_of_parts(parts: DataFrame, key: str) -> DataFrame:
    return parts.select(key, _mean().alias("depot_moyen"))


def flow_of_parts(parts: DataFrame, key: str) -> DataFrame:
    """The movements' NULL amounts were counted as 0 when the parts were made."""
    return parts.select(key, _mean().alias("flux_cred_moyen"), _total().alias("flux_cred_total"), F.col("n_positive").alias("nb_mois_avec_flux"))


def operations_of_parts(parts: DataFrame, key: str, reference) -> DataFrame:
    return parts.select(
        key, F.col("n_rows").alias("nb_operations_gab"), _total().alias("montant_total_gab"), _mean().alias("montant_moyen_gab"),
        F.col("latest").alias("derniere_operation_gab"), recency_days("latest", reference).alias("recence_gab_jours"))


def channel_of_parts(parts: DataFrame, key: str, count_as: str, total_as: str) -> DataFrame:
    return parts.select(key, F.col("n_rows").alias(count_as), _total().alias(total_as))
