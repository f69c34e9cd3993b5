"""Resampling for imbalanced classes: Tomek links and SMOTE with categories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensia.operators.neighbours import closest, nearest_neighbours, nearest_positions
from propensia.operators.windows import row_numbers
from propensia.session import materialise


def numeric_vector(df: DataFrame, columns: Sequence[str], out: str = "vec") -> DataFrame:
    """Numeric columns as one array; rows with a NULL among them cannot be placed and go."""
    complete = df.na.drop(subset=list(columns))
    return complete.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def tomek_links(df: DataFrame, id_col: str, label: str, vec: str) -> DataFrame:
    """(id_a, id_b, distance): mutual nearest neighbours of different classes, id_a < id_b.

    Identical vectors are one position: its two lowest ids stand for it, since among
    copies every point's nearest neighbour is the lowest other id. Groups of copies
    of any size therefore never reach the distance search.
    """
    return _links(df, id_col, label, vec, nearest_positions)


def tomek_links_lsh(
    df: DataFrame, id_col: str, label: str, vec: str, bucket_length: float, tables: int = 4, radius: float | None = None, seed: int = 42, crowd: int = 2048
) -> DataFrame:
    """Approximate links: neighbours are searched among points sharing an LSH bucket (``hashed_neighbours``)."""
    return _links(df, id_col, label, vec, lambda points: hashed_neighbours(points, bucket_length, tables, radius, seed, crowd))


def _links(df: DataFrame, id_col: str, label: str, vec: str, nearest) -> DataFrame:
    """Links by a search for the nearest neighbours of distinct vectors."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"),
                     F.col(vec).cast("array<double>").alias("vec"))
    first = F.min(F.struct("id", "label"))
    spots = materialise(rows.groupBy("vec").agg(first.alias("a"), F.count("*").alias("n")), "positions")
    # Second lowest id of each position with copies: lowest id that is not the lowest.
    lowest = spots.filter("n > 1").select("vec", F.col("a.id").alias("low"))
    second = (
        rows.join(lowest, "vec").filter(F.col("id") > F.col("low"))
        .groupBy("vec").agg(first.alias("b"))
    )
    copies = spots.filter("n > 1").join(second, "vec")
    between_copies = copies.filter(F.col("a.label") != F.col("b.label")).select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.lit(0.0).alias("distance")
    )
    # A position with copies has its nearest neighbour at distance 0 already, so a
    # link across positions joins two single points.
    near = nearest(spots.select(F.col("a.id").alias("id"), "vec"))
    single = spots.filter("n = 1").select(F.col("a.id").alias("id"), F.col("a.label").alias("label"))
    linked = near.join(single, "id").select("id", "neighbour", "distance", "label")
    back = linked.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("id"), F.col("label").alias("other"))
    across = (
        linked.join(back, ["id", "neighbour"])
        .filter((F.col("label") != F.col("other")) & (F.col("id") < F.col("neighbour")))
        .select(F.col("id").alias("id_a"), F.col("neighbour").alias("id_b"), "distance")
    )
    return across.unionByName(between_copies)


def hashed_neighbours(points: DataFrame, bucket_length: float, tables: int = 4, radius: float | None = None, seed: int = 42, crowd: int = 2048) -> DataFrame:
    """(id, neighbour, distance): for distinct vectors (id, vec) the nearest other one that shares a bucket, within ``radius``.

    A table's first hash is a random projection in steps of ``bucket_length``. A bucket of more than ``crowd`` points is cut
    by a second one into strips of about ``crowd`` points; a point is sought in its own strip and the ones beside it. A
    strip that is still four times too full (points alike in both projections) is cut by id. So no task holds more than
    a few ``crowd`` points, work grows in proportion, and only the best of each point and table leaves a task.
    """
    first = points.select("vec").first()
    schema = "id bigint, neighbour bigint, distance double"
    if first is None:
        return points.sparkSession.createDataFrame([], schema)
    rng, reach = np.random.default_rng(seed), bucket_length if radius is None else radius
    directions = rng.standard_normal((2 * tables, len(first["vec"])))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "spot": pdf["spot"], "blob": [np.asarray(v, dtype="<f8").tobytes() for v in pdf["vec"]]})

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = np.stack(pdf["vec"].to_numpy()).astype("float64") @ directions.T
                for t in range(tables):
                    yield pd.DataFrame({"id": pdf["id"], "spot": pdf["spot"], "tab": t, "bucket": np.floor(at[:, t] / bucket_length).astype("int64"), "second": at[:, tables + t]})

    # Places are settled without the vectors; a vector moves once to its places, and from there to the strips it is in or beside.
    spots = points.select("id", "vec", F.xxhash64("vec").alias("spot"))
    placed = materialise(spots.mapInPandas(project, "id bigint, spot bigint, tab int, bucket bigint, second double"), "hashed")
    sizes = placed.groupBy("tab", "bucket").agg(F.count("*").alias("n"), F.min("second").alias("low"), F.max("second").alias("high"))
    cut = sizes.select("tab", "bucket", "low", F.ceil(F.col("n") / crowd).alias("strips"), (F.col("high") - F.col("low")).alias("span"))
    strip = F.when(F.col("span") > 0, F.least(F.floor((F.col("second") - F.col("low")) / F.col("span") * F.col("strips")), F.col("strips") - 1)).otherwise(F.lit(0))
    placed = placed.join(cut, ["tab", "bucket"]).withColumn("strip", strip.cast("bigint"))
    crowds = placed.groupBy("tab", "bucket", "strip").agg(F.count("*").alias("m")).select("tab", "bucket", "strip", F.ceil(F.col("m") / (4 * crowd)).alias("parts"))
    # As a candidate a point is in the strips on both sides too; a part of a crowded strip sees the same part beside it.
    seen = placed.withColumn("to", F.explode(F.when(F.col("strips") > 1, F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)).otherwise(F.array("strip"))))
    seen = seen.join(crowds.withColumnRenamed("strip", "to"), ["tab", "bucket", "to"])
    seen = seen.select("tab", "bucket", "to", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "spot", (F.col("to") == F.col("strip")).alias("asks"))
    packed = spots.mapInPandas(blobs, "id bigint, spot bigint, blob binary")
    places = seen.groupBy("id", "spot").agg(F.collect_list(F.struct("tab", "bucket", "to", "part", "asks")).alias("p"))  # at most three a table
    seen = packed.join(places, ["id", "spot"]).select("id", "blob", F.explode("p").alias("p")).select("id", "blob", "p.*")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["blob"]), "<f8").reshape(len(pdf), -1)
        ids, asks = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        out = []
        for a in range(0, int(asks.sum()), 512):  # rows of distances in bounded pieces
            these = np.flatnonzero(asks)[a : a + 512]
            rows, near, distance = closest(x[these], ids[these], x, ids, 1)
            out.append(pd.DataFrame({"id": ids[these][rows], "neighbour": near, "distance": distance}))
        found = pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        return found[found["distance"] <= reach]

    found = seen.groupBy("tab", "bucket", "to", "part").applyInPandas(best, schema)
    nearest = found.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("m"))
    return nearest.select("id", "m.neighbour", "m.distance")


def smallest_class(df: DataFrame, label: str):
    """The minority label (lowest label on equal counts); one row to the driver."""
    return df.groupBy(label).count().orderBy("count", label).first()[label]


def tomek_clean(df: DataFrame, links: DataFrame, id_col: str, label: str) -> DataFrame:
    """Remove every linked row that is not of the minority class; all columns stay."""
    minority = smallest_class(df, label)
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias(id_col)).distinct()
    linked = df.filter(F.col(label) != F.lit(minority)).select(id_col).join(ends, id_col, "left_semi")
    return df.join(linked, id_col, "left_anti")


def _field(name: str):
    return lambda entry: entry[name]


def _most_frequent(values: Column) -> Column:
    """Most frequent element of a short array, lowest value on ties."""
    def vote(value: Column) -> Column:
        return F.struct((-F.size(F.filter(values, lambda other: other == value))).alias("n"), value.alias("v"))

    return F.array_min(F.transform(F.array_distinct(values), vote))["v"]


def smotenc(
    df: DataFrame,
    id_col: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Synthetic rows until every class has the size of the largest.

    A new row lies between a row and one of its k neighbours of the same class; its
    categories are the most frequent ones among all k. A class of one row is copied.
    Categories take part in the distance: each differing one adds half the squared median
    deviation of the numeric columns, whatever the number of categories.
    Returns (label, numeric..., categorical...) of the new rows only.
    """
    counts = {r[label]: r["count"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    largest = max(counts.values(), default=0)
    parts = [
        _synthetic(df, id_col, label, value, largest - counts[value], list(numeric), list(categorical), k, seed)
        for value in sorted(counts) if counts[value] < largest
    ]
    if not parts:
        return df.select(label, *[F.col(c).cast("double").alias(c) for c in numeric], *categorical).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _synthetic(
    df: DataFrame, id_col: str, label: str, value, wanted: int, numeric: list[str], categorical: list[str], k: int, seed: int
) -> DataFrame:
    """``wanted`` new rows of one class."""
    rows = df.filter(F.col(label) == F.lit(value)).na.drop(subset=[*numeric, *categorical])
    rows = materialise(rows.select(F.col(id_col).cast("bigint").alias("id"), *numeric, *categorical), "minority")
    n_min = rows.count()
    if not n_min:
        raise ValueError(f"class {value!r} has no row without NULL to start from")
    deviations = rows.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in numeric]).first()
    spread = sorted(float(deviations[c] or 0.0) for c in numeric)
    middle = len(spread) // 2
    median = spread[middle] if len(spread) % 2 else (spread[middle - 1] + spread[middle]) / 2
    # A category is one more coordinate that is only equal or not: differing ones add median^2 / 2.
    codes = [F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 52)).cast("double") for c in categorical]
    vector = F.array(*[F.col(c).cast("double") for c in numeric], *codes)
    near = nearest_neighbours(rows.select("id", vector.alias("vec")), "id", "vec", k=k, n_codes=len(codes), code_gap=median**2 / 2)

    numbered = row_numbers(rows.select("id"), "id")
    share = F.floor(F.lit(wanted) / F.lit(n_min)) + (F.col("row_index") < wanted % n_min).cast("int")
    slots = numbered.withColumn("slot", F.explode(F.sequence(F.lit(1), F.greatest(share, F.lit(1)).cast("int")))).filter(
        F.col("slot") <= share
    ).select("id", "slot")

    # One row per minority row: its neighbours' values, at most k entries; a row without any is its own.
    around = near.join(rows.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *numeric, *categorical))).alias("around")
    )
    itself = F.array(F.struct(F.lit(1).alias("rank"), *[F.col(c) for c in (*numeric, *categorical)]))

    def unit(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + salt), "id", "slot"), F.lit(1_000_003)) / 1_000_003.0

    base = slots.join(rows, "id").join(around, "id", "left").withColumn("around", F.coalesce("around", itself))
    chosen = F.element_at("around", (F.floor(unit(1) * F.size("around")) + 1).cast("int"))
    gap = unit(2)
    synthetic = base.withColumns({"__other": chosen, "__gap": gap})
    moved = [
        (F.col(c).cast("double") + F.col("__gap") * (F.col(f"__other.{c}").cast("double") - F.col(c).cast("double"))).alias(c)
        for c in numeric
    ]
    modes = [_most_frequent(F.transform("around", _field(c))).alias(c) for c in categorical]
    return synthetic.select(F.lit(value).alias(label), *moved, *modes)
