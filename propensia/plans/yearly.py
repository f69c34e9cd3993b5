"""The feature table kept up to date file by file instead of rebuilt from all years.

Every raw table has a state with one row per client: the parts of its aggregates, or the row that wins so far.
A new file is reduced, merged into the buckets of its own clients, and never read again. The result equals a full
build over all files: sums are whole numbers, extremes and winners do not depend on the order of arrival. Ties between
snapshots are broken by the remaining columns in the order they were first seen, as in a full build over the files in that order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.functions import age_years, fr_date, fr_decimal, fr_timestamp
from propensia.operators import partials
from propensia.operators.joins import left_join_chain
from propensia.operators.rules import fill_zero, presence_label, resolve_column
from propensia.operators.windows import first_per_key
from propensia.plans.dataset import KEY, LABEL, REFERENCE_DATE, SAVINGS_CODES, ZERO_WHEN_ABSENT
from propensia.plans.dataset import current_pack, digital_subscription, savings_target
from propensia.sources.versioned import BucketedState


@dataclass(frozen=True)
class Movements:
    """A table of movements: the amount, its moment, and the features finished from the parts."""
    amount: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame, dt.date], DataFrame]

    def reduce(self, raw: DataFrame) -> DataFrame:
        rows = self.amount(raw)
        return partials.movement_parts(rows, [KEY], "amount", "moment" if "moment" in rows.columns else None)

    combine = staticmethod(partials.merge_parts)


@dataclass(frozen=True)
class Snapshots:
    """A table of which one row per client counts: the rows that may win, the order, and the features of the winner."""
    keep: Callable[[DataFrame, Sequence[str]], DataFrame]
    order: Callable[[], list[Column]]
    finish: Callable[[DataFrame, dt.date, Sequence[str]], DataFrame]

    def combine(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return first_per_key(rows, keys, self.order())


def _amounts(column: str, moment: str | None = None, none_is_zero: bool = False) -> Callable[[DataFrame], DataFrame]:
    def amounts(raw: DataFrame) -> DataFrame:
        value = fr_decimal(column)
        value = F.coalesce(value, F.lit(0.0)) if none_is_zero else value
        return raw.select(KEY, value.alias("amount"), *([fr_timestamp(moment).alias("moment")] if moment else []))

    return amounts


def _vignette_amounts(raw: DataFrame) -> DataFrame:
    return _amounts("TOTAL_TTC")(resolve_column(raw, ["TOTAL_TTC", "TOTAL_TTC/100"], "TOTAL_TTC"))


def _everything(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    return rows


# Raw column names and feature names.
MOVEMENTS: dict[str, Movements] = {
    "solde": Movements(_amounts("SOLDEVERIF"), lambda p, ref: partials.balance_of_parts(p, KEY)),
    "depot": Movements(_amounts("MONTANT_DEPOT"), lambda p, ref: partials.deposit_of_parts(p, KEY)),
    "flux": Movements(_amounts("FLUX_CRED", none_is_zero=True), lambda p, ref: partials.flow_of_parts(p, KEY)),
    "gab": Movements(_amounts("MONTANT", "DATE_OP"), lambda p, ref: partials.operations_of_parts(p, KEY, ref)),
    "retrait": Movements(_amounts("MONTANT"), lambda p, ref: partials.channel_of_parts(p, KEY, "nb_retraits", "montant_total_retraits")),
    "payfac": Movements(_amounts("MONTANT_TOTAL"), lambda p, ref: partials.channel_of_parts(p, KEY, "nb_paiements_digitaux", "montant_total_payfac")),
    "vignette": Movements(_vignette_amounts, lambda p, ref: partials.channel_of_parts(p, KEY, "nb_vignettes_payees", "montant_total_vignette")),
}
SNAPSHOTS: dict[str, Snapshots] = {
    "perimetre": Snapshots(
        _everything, lambda: [F.col("BANQUE"), F.col("AGENCE")],
        lambda rows, ref, codes: rows.withColumn("age_client", age_years(fr_date("DATE_OF_BIRTH"), ref))),
    # The products in scope are chosen before the newest snapshot is; other products need not be kept.
    "assi": Snapshots(
        lambda rows, codes: rows.filter(F.col("CODE_PRODUIT").isin(list(codes))), lambda: [fr_date("DATE_CHARG").desc()],
        lambda rows, ref, codes: savings_target(rows, codes)),
    "opk": Snapshots(_everything, lambda: [fr_date("DATE_CHARG").desc()], lambda rows, ref, codes: current_pack(rows)),
    "digitaux": Snapshots(
        _everything, lambda: [F.col("DATE_RES_ABON").isNull().desc(), fr_date("DATE_VAL_ABON").desc()],
        lambda rows, ref, codes: digital_subscription(rows, ref)),
}
FEATURE_ORDER = ("assi", "opk", "digitaux", "solde", "depot", "flux", "gab", "retrait", "payfac", "vignette")


class YearlyDataset:
    """States of all raw tables below ``root``; ``codes`` must stay the same for the life of a root."""

    def __init__(self, spark: SparkSession, root: str, reference: dt.date = REFERENCE_DATE, codes: Sequence[str] = SAVINGS_CODES, buckets: int = 64):
        self.spark, self.reference, self.codes = spark, reference, tuple(codes)
        rules = {**MOVEMENTS, **SNAPSHOTS}
        self.states = {t: BucketedState(spark, f"{root.rstrip('/')}/{t}", KEY, rule.combine, buckets) for t, rule in rules.items()}

    def take(self, table: str, source: str, raw: DataFrame) -> int:
        """Merge one raw file (named ``source``) into its table's state; returns how many buckets of clients it touched."""
        state = self.states[table]
        if source in state.sources:
            return 0
        if table in MOVEMENTS:
            return state.take(source, MOVEMENTS[table].reduce(raw))
        return state.take(source, SNAPSHOTS[table].keep(raw, self.codes))

    def take_all(self, files: Mapping[str, Sequence[tuple[str, DataFrame]]]) -> int:
        """Several (source, raw) files per table, in their order; the tables' jobs run side by side. Returns the buckets touched."""
        def table(name: str) -> int:
            return sum(self.take(name, source, raw) for source, raw in files[name])

        with ThreadPoolExecutor(max_workers=4) as side_by_side:
            return sum(side_by_side.map(inheritable_thread_target(self.spark)(table), files))

    def feature_table(self, table: str) -> DataFrame:
        rows = self.states[table].read()
        if rows is None:
            raise ValueError(f"no file of {table} was taken yet")
        if table in MOVEMENTS:
            return MOVEMENTS[table].finish(rows, self.reference)
        return SNAPSHOTS[table].finish(rows, self.reference, self.codes)

    def dataset(self) -> DataFrame:
        """One row per client, as a full build over all files taken; reads the states only."""
        joined = left_join_chain(self.feature_table("perimetre"), [self.feature_table(t) for t in FEATURE_ORDER], KEY)
        return presence_label(fill_zero(joined, ZERO_WHEN_ABSENT), "label_nom", LABEL)
