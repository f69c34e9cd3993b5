"""Unions, deduplication, sampling and splitting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Files of one logical table; a column a file lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "type") -> DataFrame:
    """Result families of equal shape, each row tagged with its family."""
    return union_by_name([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def sample_about(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """A seeded sample of about ``rows`` rows (everything when there are fewer)."""
    total = df.count()
    return df.sample(fraction=min(1.0, rows / total) if total else 1.0, seed=seed)


def random_split(df: DataFrame, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    fit, val = df.randomSplit([train_share, 1.0 - train_share], seed=seed)
    return fit, val


def hash_split(df: DataFrame, key: str, train_share: float = 0.8, out: str = "split") -> DataFrame:
    """Train/validation tag from the key alone.

    Unlike a random split, a row keeps its side when the data is re-read, repartitioned
    or grows, and no task has to be replayed in the same order after a loss.
    """
    limit = f"{min(int(train_share * 65536), 65535):04x}"
    head = F.substring(F.md5(F.col(key).cast("string")), 1, 4)
    return df.withColumn(out, F.when(head < limit, "fit").otherwise("val"))


def stratified_sample(df: DataFrame, label: str, fractions: Mapping, seed: int = 42) -> DataFrame:
    """Seeded sample with one fraction per class (majority under-sampling)."""
    return df.sampleBy(label, fractions=dict(fractions), seed=seed)


def exact_sample(df: DataFrame, label: str, sizes: Mapping | int, key: str, salt: str = "") -> DataFrame:
    """Exactly ``sizes`` rows of every class (all where a class has fewer): those whose salted key hashes lowest.

    A number for ``sizes`` holds for every class, a mapping for those it names; other classes have no row. Each map
    task keeps only the lowest of what it reads, so a large class sends that many rows per task. A row keeps
    its place when the data are re-read or grow; rows with equal keys follow their further columns.
    """
    order = [F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt))), *[F.xxhash64(*df.columns)]]
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    most = sizes if isinstance(sizes, int) else max(sizes.values(), default=0)
    ranked = ranked.filter(F.col("__place") <= most)  # a constant bound is what Spark applies before the shuffle
    if not isinstance(sizes, int):
        own = F.lit(0)
        for value, n in sizes.items():
            own = F.when(F.col(label) == F.lit(value), F.lit(n)).otherwise(own)
        ranked = ranked.filter(F.col("__place") <= own)
    return ranked.drop("__place")


def balanced_sample(df: DataFrame, label: str, key: str, salt: str = "") -> DataFrame:
    """Every class cut down to exactly the size of the smallest."""
    smallest = df.filter(F.col(label).isNotNull()).groupBy(label).count().agg(F.min("count")).first()[0]
    return exact_sample(df.filter(F.col(label).isNotNull()), label, int(smallest or 0), key, salt)


def balance_fractions(df: DataFrame, label: str) -> dict:
    """Fractions that bring every class down to about the size of the smallest.

    One count per class comes to the driver.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    smallest = min(counts.values())
    return {c: smallest / n for c, n in counts.items()}
