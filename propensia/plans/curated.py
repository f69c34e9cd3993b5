"""The feature table through curated tables: written once in buckets of clients, gated meanwhile, joined without a shuffle."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation

from propensia.operators.gates import observe_keys, observe_rows, require_conserved, require_unique
from propensia.operators.joins import left_join_chain
from propensia.operators.rules import fill_zero, presence_label
from propensia.plans.dataset import (
    KEY, LABEL, REFERENCE_DATE, SAVINGS_CODES, ZERO_WHEN_ABSENT, RawTables, client_base, feature_tables,
)


@dataclass
class Curated:
    base: DataFrame
    features: dict[str, DataFrame]
    gates: dict[str, Observation]


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, label: str) -> tuple[DataFrame, Observation]:
    """One curated table with its gate: the shuffle that deals the rows serves the gate, the buckets and every later join."""
    observed, seen = observe_keys(df, key, label, buckets)
    (observed.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return df.sparkSession.table(table), seen


def curate(
    raw: RawTables, folder: str, buckets: int, reference: dt.date = REFERENCE_DATE, codes: Sequence[str] = SAVINGS_CODES, prefix: str | None = None
) -> Curated:
    """Base and feature tables in ``buckets`` files each below ``folder``; stops if a key occurs twice in any of them.

    Raw movements are reduced to one row per client before they are dealt, so a client with a third of all
    movements is one row in its bucket.
    """
    prefix, root = prefix or f"curated_{uuid.uuid4().hex}", folder.rstrip("/")
    tables = {"base": client_base(raw["perimetre"], reference), **feature_tables(raw, reference, codes)}
    written, gates = {}, {}
    for name, df in tables.items():
        written[name], gates[name] = write_bucketed(df, f"{prefix}_{name}", f"{root}/{name}", KEY, buckets, name)
    require_unique(gates, KEY)
    base = written.pop("base")
    return Curated(base, written, gates)


def join_curated(curated: Curated) -> DataFrame:
    """One row per client. Both sides of every join are cut by the same hash, so nothing of the base moves."""
    joined = left_join_chain(curated.base, list(curated.features.values()), KEY)
    return presence_label(fill_zero(joined, ZERO_WHEN_ABSENT), "label_nom", LABEL)


def write_dataset(curated: Curated, path: str) -> DataFrame:
    """The joined table as Parquet; stops if the joins lost or doubled a client."""
    observed, seen = observe_rows(join_curated(curated), "dataset")
    observed.write.mode("overwrite").parquet(path)
    require_conserved(curated.gates["base"], seen)
    return curated.base.sparkSession.read.schema(observed.schema).parquet(path)
