"""Cleaning of the client table: learned on training rows, replayed for scoring."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.functions import age_years, fr_date
from propensia.operators.learned import (
    BOUNDS_SCHEMA,
    COLUMN_LIST_SCHEMA,
    MEDIAN_SCHEMA,
    apply_bounds,
    apply_medians,
    detect_constant_columns,
    drop_listed,
    fit_flags_to_drop,
    fit_iqr_bounds,
    fit_medians,
)
from propensia.operators.rules import (
    EXTREME_SUFFIX,
    cap_and_flag,
    clip_negative,
    drop_null_keys,
    drop_present,
    fill_constants,
    keep_plausible_age,
    missing_flags,
    relative_volatility,
    repair_categories,
)
from propensia.operators.sets import drop_duplicate_rows
from propensia.plans.dataset import LABEL, REFERENCE_DATE
from propensia.session import materialise
from propensia.sources.store import load_params, save_params

# Column roles and constants of the cleaning rules.
GENDER_SPELLINGS = {"F": ("FÃ©minin", "Féminin"), "M": ("Masculin",)}
REQUIRED = ("BPR", "GENDER")
NULL_MEANS = {
    "NOMBRE_ENFANT": 0, "TAILLE_ENTREPRI": "PARTICULIER", "pack_actuel": "SANS_PACK", "pack_etat": "SANS_ETAT",
    "MARITAL_STATUS": "NON_RENSEIGNE", "CUSTOMER_RATING": "NON_RENSEIGNE", "depot_moyen": 0.0, "montant_moyen_gab": 0.0,
}
NEVER_FLAGS = {"jamais_active_digital": "digital_date_activation", "jamais_utilise_gab": "derniere_operation_gab"}
MEDIAN_COLUMNS = ("anciennete_digitale_jours", "recence_gab_jours")
COUNTS = (
    "nb_mois_observes_solde", "nb_mois_avec_flux", "nb_operations_gab", "nb_retraits", "nb_paiements_digitaux",
    "nb_vignettes_payees", "NOMBRE_ENFANT",
)
AMOUNTS = (
    "depot_moyen", "flux_cred_moyen", "flux_cred_total", "montant_total_gab", "montant_moyen_gab",
    "montant_total_retraits", "montant_total_payfac", "montant_total_vignette",
)
BALANCES = ("solde_moyen", "solde_min", "solde_max")
MAXIMA = {"nb_mois_observes_solde": 36, "NOMBRE_ENFANT": 12}
LOW_CARDINALITY = (
    "GENDER", "TAILLE_ENTREPRI", "pack_actuel", "pack_etat", "CUSTOMER_RATING", "MARITAL_STATUS", "BPR",
)
HIGH_CARDINALITY = ("CODE_VILLE",)
TECHNICAL = ("BANQUE", "AGENCE", "GENERIC", "PLURAL", "CCLE")
REDUNDANT = ("digital_toujours_abonne", "flux_cred_moyen", "solde_max")


@dataclass
class LearnedCleaning:
    """Everything learned on the training rows: five small parameter tables."""

    medians: DataFrame
    bounds: DataFrame
    dropped_flags: DataFrame
    constants: DataFrame
    volatility: DataFrame

    SCHEMAS = {
        "medians": MEDIAN_SCHEMA, "bounds": BOUNDS_SCHEMA, "dropped_flags": COLUMN_LIST_SCHEMA,
        "constants": COLUMN_LIST_SCHEMA, "volatility": MEDIAN_SCHEMA,
    }

    def save(self, folder: str) -> None:
        for name in self.SCHEMAS:
            save_params(getattr(self, name), f"{folder.rstrip('/')}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> LearnedCleaning:
        return cls(**{n: load_params(spark, f"{folder.rstrip('/')}/{n}", s) for n, s in cls.SCHEMAS.items()})


def resolve_nulls(df: DataFrame) -> DataFrame:
    """Each NULL gets the meaning its column gives it."""
    df = repair_categories(df, "GENDER", GENDER_SPELLINGS)
    df = drop_null_keys(drop_present(df, ["LIBELLE_VILLE"]), REQUIRED)
    if "NOMBRE_ENFANT" in df.columns:
        df = df.withColumn("NOMBRE_ENFANT", F.col("NOMBRE_ENFANT").try_cast("int"))
    df = missing_flags(fill_constants(df, NULL_MEANS), NEVER_FLAGS)
    return drop_present(df, NEVER_FLAGS.values())


def fix_impossible(df: DataFrame, is_train: bool, reference: dt.date) -> DataFrame:
    df = cap_and_flag(clip_negative(df, [*COUNTS, *AMOUNTS]), MAXIMA)
    return keep_plausible_age(df, "DATE_OF_BIRTH", reference, is_train)


def reduce_and_derive(df: DataFrame, reference: dt.date) -> DataFrame:
    """Drop technical and redundant columns, derive volatility and age.

    The client key stays: scoring needs it as an id. It is no feature.
    """
    if all(c in df.columns for c in BALANCES):
        df = relative_volatility(
            df, "solde_max", "solde_min", "solde_moyen", "solde_volatilite_relative", "solde_volatilite_indefinie"
        )
    if "DATE_OF_BIRTH" in df.columns:
        df = df.withColumn("age_client", age_years(fr_date("DATE_OF_BIRTH"), reference))
    return drop_present(df, [*TECHNICAL, *REDUNDANT, "DATE_OF_BIRTH"])


def clean_train(
    df: DataFrame, reference: dt.date = REFERENCE_DATE, label: str = LABEL, exact: bool = True
) -> tuple[DataFrame, LearnedCleaning]:
    """Clean the training rows and learn what scoring will reuse.

    Deduplicated rows are written once; the passes that learn medians, fences, flags
    and constants then read only the columns they need. ``exact=False`` learns the
    quantiles from sketches instead.
    """
    df = materialise(drop_duplicate_rows(df), "clean")
    df = resolve_nulls(df)
    medians = pin(fit_medians(df, MEDIAN_COLUMNS, exact))
    df = fix_impossible(apply_medians(df, medians), True, reference)
    bounds = pin(fit_iqr_bounds(df, [*BALANCES, *AMOUNTS], exact=exact))
    df = apply_bounds(df, bounds)
    flags = [c for c in df.columns if c.endswith(EXTREME_SUFFIX)]
    dropped = pin(fit_flags_to_drop(df, flags, label))
    constants = pin(detect_constant_columns(df, LOW_CARDINALITY))
    df = reduce_and_derive(drop_listed(drop_listed(df, dropped), constants), reference)
    volatility = pin(fit_medians(df, ["solde_volatilite_relative"], exact))
    return apply_medians(df, volatility), LearnedCleaning(medians, bounds, dropped, constants, volatility)


def clean_score(df: DataFrame, learned: LearnedCleaning, reference: dt.date = REFERENCE_DATE) -> DataFrame:
    """The same steps with the learned values; no client is lost to the age rule."""
    df = resolve_nulls(drop_duplicate_rows(df))
    df = fix_impossible(apply_medians(df, learned.medians), False, reference)
    df = apply_bounds(df, learned.bounds)
    df = reduce_and_derive(drop_listed(drop_listed(df, learned.dropped_flags), learned.constants), reference)
    return apply_medians(df, learned.volatility)


def pin(params: DataFrame) -> DataFrame:
    """Learned rows held as values (one per column), so they are computed once."""
    return params.sparkSession.createDataFrame(params.collect(), params.schema)
