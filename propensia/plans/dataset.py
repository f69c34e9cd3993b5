"""Raw customer files to one row per client."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.functions import age_years, fr_date, fr_decimal, fr_timestamp, recency_days
from propensia.operators.aggregates import (
    balance_summary,
    channel_summary,
    deposit_mean,
    flow_summary,
    operations_summary,
)
from propensia.operators.joins import left_join_chain
from propensia.operators.quality import require_row_conservation, require_unique_keys
from propensia.operators.rules import fill_zero, presence_label, resolve_column
from propensia.operators.sets import union_by_name
from propensia.operators.windows import active_first_per_key, first_per_key, latest_per_key
from propensia.session import materialise
from propensia.sources.delimited import read_delimited

KEY = "RADICAL"
LABEL = "label_eligibilite"

# Reference date, product codes in scope and raw file patterns.
REFERENCE_DATE = dt.date(2025, 12, 31)
SAVINGS_CODES = ("53", "09", "18")
RAW_PATTERNS: dict[str, tuple[str, ...]] = {
    "perimetre": ("ATT_PROD_EPARGNE_PERIMETRE*.txt",),
    "assi": ("ATT_PROD_EPARGNE_ASSI*.txt",),
    "opk": ("ATT_HISSAB_OPK2023*.txt", "ATT_PROD_EPARGNE_OPK2024*.txt", "ATT_HISSAB_OPK2025*.txt"),
    "digitaux": ("ATT_HISSAB_PRODUIT_DIGITAUX*.txt",),
    "solde": ("ATT_PROD_EPARGNE_SOLDE_2025*.txt", "ATT_PROD_EPARGNE_SOLDE_COMPLEMENT*.txt"),
    "depot": ("ATT_PROD_EPARGNE_DEPOT_BILANCEIL_2023*.txt", "ATT_PROD_EPARGNE_DEPONT_BILANCIEL_COMPLEMENT*.txt"),
    "flux": ("ATT_PROD_EPARGNE_FLUX_2023*.txt", "ATT_PROD_EPARGNE_FLUX_2025*.txt"),
    "gab": ("ATT_PROD_EPARGNE_OPERATION_GAB2023*.txt", "ATT_PROD_EPARGNE_OPER_GAB_COMPLEMENT*.txt"),
    "retrait": ("ATT_HISSAB_OPE_RETRAIT2023*.txt", "ATT_PROD_EPARGNE_OPER_RETRAIT_COMPLEMENT*.txt"),
    "payfac": ("ATT_PROD_EPARGNE_DIGI_PAYFAC_COMPLEMENT*.txt", "ATT_PROD_EPARGNE_DIGI_PAYFAC_2024*.txt",
               "ATT_HISSAB_DIGI_PAYFAC2023*.txt"),
    "vignette": ("ATT_PROD_EPARGNE_VIGNETTE.txt", "ATT_PROD_EPARGNE_VIGNETTE_COMPLEMENT*.txt"),
}
# Counters and totals where "no movement" means 0.
ZERO_WHEN_ABSENT = (
    "nb_operations_gab", "montant_total_gab", "nb_retraits", "montant_total_retraits",
    "nb_paiements_digitaux", "montant_total_payfac", "nb_vignettes_payees", "montant_total_vignette",
    "nb_mois_observes_solde", "nb_mois_avec_flux", "flux_cred_total", "digital_toujours_abonne",
)

RawTables = Mapping[str, DataFrame]


def load_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every logical table, its yearly and complement files united by column name."""
    root = folder.rstrip("/")
    return {
        name: union_by_name([read_delimited(spark, f"{root}/{p}") for p in patterns])
        for name, patterns in RAW_PATTERNS.items()
    }


def land_as_parquet(raw: RawTables, folder: str) -> dict[str, DataFrame]:
    """Write the text tables once in columnar form; later passes prune and push down."""
    landed = {}
    for name, df in raw.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        landed[name] = df.sparkSession.read.parquet(path)
    return landed


# ---- one function per raw table ------------------------------------------------

def client_base(perimetre: DataFrame, reference: dt.date) -> DataFrame:
    aged = perimetre.withColumn("age_client", age_years(fr_date("DATE_OF_BIRTH"), reference))
    return first_per_key(aged, [KEY], [F.col("BANQUE"), F.col("AGENCE")])


def savings_target(assi: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The product of each client's newest snapshot among the savings products."""
    savings = assi.filter(F.col("CODE_PRODUIT").isin(list(codes)))
    latest = latest_per_key(savings, [KEY], fr_date("DATE_CHARG"))
    return latest.select(KEY, F.col("CODE_PRODUIT").alias("label_code"), F.col("LIBELLE_PRODUIT").alias("label_nom"))


def current_pack(opk: DataFrame) -> DataFrame:
    latest = latest_per_key(opk, [KEY], fr_date("DATE_CHARG"))
    return latest.select(KEY, F.col("CODE_PACK").alias("pack_actuel"), F.col("ETATC").alias("pack_etat"))


def digital_subscription(digitaux: DataFrame, reference: dt.date) -> DataFrame:
    best = active_first_per_key(digitaux, [KEY], fr_date("DATE_VAL_ABON"), "DATE_RES_ABON")
    return best.select(
        KEY,
        F.col("DATE_VAL_ABON").alias("digital_date_activation"),
        F.col("DATE_RES_ABON").isNull().cast("int").alias("digital_toujours_abonne"),
        recency_days(fr_date("DATE_VAL_ABON"), reference).alias("anciennete_digitale_jours"),
    )


def feature_tables(raw: RawTables, reference: dt.date, codes: Sequence[str]) -> dict[str, DataFrame]:
    """Every 1:N table reduced to one row per client."""
    def amounts(name: str, column: str, **more) -> DataFrame:
        return raw[name].select(KEY, fr_decimal(column).alias("amount"), *[e.alias(a) for a, e in more.items()])

    vignette = resolve_column(raw["vignette"], ["TOTAL_TTC", "TOTAL_TTC/100"], "TOTAL_TTC")
    return {
        "cible": savings_target(raw["assi"], codes),
        "pack": current_pack(raw["opk"]),
        "digital": digital_subscription(raw["digitaux"], reference),
        "solde": balance_summary(amounts("solde", "SOLDEVERIF"), KEY, "amount"),
        "depot": deposit_mean(amounts("depot", "MONTANT_DEPOT"), KEY, "amount"),
        "flux": flow_summary(amounts("flux", "FLUX_CRED"), KEY, "amount"),
        "gab": operations_summary(
            amounts("gab", "MONTANT", moment=fr_timestamp("DATE_OP")), KEY, "amount", "moment", reference
        ),
        "retrait": channel_summary(amounts("retrait", "MONTANT"), KEY, "amount", "nb_retraits", "montant_total_retraits"),
        "payfac": channel_summary(
            amounts("payfac", "MONTANT_TOTAL"), KEY, "amount", "nb_paiements_digitaux", "montant_total_payfac"
        ),
        "vignette": channel_summary(
            vignette.select(KEY, fr_decimal("TOTAL_TTC").alias("amount")),
            KEY, "amount", "nb_vignettes_payees", "montant_total_vignette",
        ),
    }


def build_dataset(
    raw: RawTables, reference: dt.date = REFERENCE_DATE, codes: Sequence[str] = SAVINGS_CODES, check: bool = False
) -> DataFrame:
    """One row per client of the base, features attached, label set.

    ``check`` runs the blocking gates (extra jobs): feature keys unique before the
    joins, no base row lost or doubled after them.
    """
    base = client_base(raw["perimetre"], reference)
    features = feature_tables(raw, reference, codes)
    if check:
        # Gates look at written tables, so nothing is computed once for the gate and once for the result.
        base = materialise(base, "base")
        features = {name: materialise(df, name) for name, df in features.items()}
        require_unique_keys(features, KEY)
    joined = left_join_chain(base, list(features.values()), KEY)
    result = presence_label(fill_zero(joined, ZERO_WHEN_ABSENT), "label_nom", LABEL)
    if check:
        result = materialise(result, "dataset")
        require_row_conservation(base, result)
    return result


def write_populations(dataset: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Everyone for the binary model, holders only for the product model.

    The second set is read back from the first, so the feature joins run once.
    """
    spark, root = dataset.sparkSession, folder.rstrip("/")
    dataset.write.mode("overwrite").parquet(f"{root}/dataset_eligibilite")
    everyone = spark.read.parquet(f"{root}/dataset_eligibilite")
    everyone.filter(F.col(LABEL) == 1).write.mode("overwrite").parquet(f"{root}/dataset_produit")
    return everyone, spark.read.parquet(f"{root}/dataset_produit")
