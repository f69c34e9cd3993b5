"""Evaluation of a (label, prediction, score) table, without leaving Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensia.operators.aggregates import crosstab_with_margins
from propensia.operators.windows import running_totals, with_value_buckets

# The two threshold grids, as (first, step, number of points).
FINE_GRID = (0.05, 0.01, 91)
COARSE_GRID = (0.05, 0.025, 37)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (the convention of the usual metric libraries)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n); all metrics below start from these few rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_with_margins(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return crosstab_with_margins(
        df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction")), "label", "prediction"
    )


def _per_class(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    # Each cell counts once for its true class and once for its predicted class.
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("s")).select("s.*")
    summed = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    return summed.select(
        "class",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "tp",
    )


def classification_report(df: DataFrame, label: str, prediction: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted rows."""
    classes = _per_class(confusion(df, label, prediction))
    metrics = ("precision", "recall", "f1")
    each = classes.select(F.col("class").cast("string").alias("class"), *metrics, "support")
    macro = classes.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support"))
    weighted = classes.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in metrics],
        F.sum("support").alias("support"),
    )
    everything = each.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        weighted.withColumn("class", F.lit("weighted avg"))
    )
    return everything.select("class", *[F.round(m, digits).alias(m) for m in metrics], "support")


def weighted_metrics(df: DataFrame, label: str, prediction: str, digits: int = 6, focus=1) -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1, macro F1 and the F1 of
    the class in focus (``f1_classe1``)."""
    classes = _per_class(confusion(df, label, prediction))

    def weighted(m: str) -> Column:
        return F.round(_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")), digits)

    return classes.agg(
        F.round(_ratio(F.sum("tp"), F.sum("support")), digits).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        F.round(F.avg("f1"), digits).alias("macro_f1"),
        F.round(F.coalesce(F.max(F.when(F.col("class") == F.lit(focus), F.col("f1"))), F.lit(0.0)), digits).alias("f1_classe1"),
    )


def f1_by_class(df: DataFrame, label: str, prediction: str, digits: int = 6) -> DataFrame:
    return _per_class(confusion(df, label, prediction)).select("class", F.round("f1", digits).alias("f1"))


# ---- score curves --------------------------------------------------------------

def cumulative_confusion(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg, tp, fp, n_pos, n_neg): counts with score >= each level.

    Rows with the same score collapse to one level first, so ties become one point
    and a heavily repeated score costs nothing.
    """
    bucketed = with_value_buckets(df.select(*by, F.col(label).alias("__y"), F.col(score).alias("score")), {"score": "__bucket"})
    levels = bucketed.filter(F.col("score").isNotNull()).groupBy(*by, "__bucket", "score").agg(
        F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") != 1).alias("neg")
    )
    ladder = running_totals(levels, list(by), "__bucket", "score", ["pos", "neg"], descending=True, bounded=not by)
    return ladder.select(
        *by, "score", "pos", "neg",
        F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"),
        F.col("pos_total").alias("n_pos"), F.col("neg_total").alias("n_neg"),
    )


def one_vs_rest(df: DataFrame, label: str, probabilities: str, classes: Sequence) -> DataFrame:
    """(class, is_class, score): one row per class and record of a multiclass result.

    ``probabilities`` is an array or ML vector column in the order of ``classes``.
    """
    if df.schema[probabilities].dataType.typeName() == "array":
        probs = F.col(probabilities)
    else:
        probs = vector_to_array(F.col(probabilities))
    rows = [
        F.struct(
            F.lit(c).cast("string").alias("class"),
            (F.col(label) == F.lit(c)).cast("int").alias("is_class"),
            probs[i].alias("score"),
        )
        for i, c in enumerate(classes)
    ]
    return df.select(F.inline(F.array(*rows)))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(by..., threshold, fpr, tpr), one point per distinct score, plus the origin."""
    ladder = cumulative_confusion(df, label, score, by)
    points = ladder.select(
        *by,
        F.col("score").alias("threshold"),
        F.round(_ratio(F.col("fp"), F.col("n_neg")), digits).alias("fpr"),
        F.round(_ratio(F.col("tp"), F.col("n_pos")), digits).alias("tpr"),
    )
    # The origin has a threshold above every score, written as NULL.
    origin = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    origin = origin.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Trapezoid area: each level's negatives times the mean of the true positives
    before and after it. No neighbour lookup, so it is one aggregate over the ladder."""
    ladder = cumulative_confusion(df, label, score, by)
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2).cast("double"))
    whole = F.max("n_pos").cast("double") * F.max("n_neg").cast("double")
    return ladder.groupBy(*by).agg(F.round(F.try_divide(area, whole), digits).alias("auc"))


def _f1_at(tp: str, fp: str, n_pos: str) -> Column:
    return _ratio(F.col(tp) * 2, F.col(tp) + F.col(fp) + F.col(n_pos))


def best_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(threshold, f1): the observed score with the best F1, lowest score on ties."""
    curve = cumulative_confusion(df, label, score, by).withColumn("f1", _f1_at("tp", "fp", "n_pos"))
    best = F.min(F.struct((-F.col("f1")).alias("loss"), F.col("score").alias("threshold")))
    return curve.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.threshold").alias("threshold"), F.round(-F.col("b.loss"), digits).alias("f1")
    )


def threshold_grid(
    df: DataFrame, label: str, score: str, grid: tuple[float, float, int] = FINE_GRID, digits: int = 6
) -> DataFrame:
    """Confusion and F1 at every threshold of a fixed grid.

    Rows are counted by the number of thresholds they pass; the cumulation runs over
    those at most ``points + 1`` counts, never over the rows times the grid.
    """
    start, step, points = grid
    thresholds = [start + i * step for i in range(points)]
    # Estimate the position, then settle it by comparing with the neighbours.
    ladder = F.array(*[F.lit(t) for t in [float("-inf"), *thresholds, float("inf")]])
    guess = F.least(F.greatest(F.floor((F.col(score) - start) / step).cast("int") + 1, F.lit(0)), F.lit(points))
    passed = (
        F.when(F.col(score) < F.element_at(ladder, guess + 1), guess - 1)
        .when(F.col(score) >= F.element_at(ladder, guess + 2), guess + 1)
        .otherwise(guess)
    )
    counts = (
        df.filter(F.col(score).isNotNull())
        .select(passed.alias("passed"), (F.col(label) == 1).cast("bigint").alias("is_pos"))
        .groupBy("passed").agg(F.sum("is_pos").alias("pos"), F.sum(1 - F.col("is_pos")).alias("neg"))
    )
    empty = df.sparkSession.range(points + 1).select(
        F.col("id").cast("int").alias("passed"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")
    )
    full = counts.unionByName(empty).groupBy("passed").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cumulated = full.select(
        "passed",
        F.sum("pos").over(down).alias("tp"),
        F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"),
    ).filter("passed > 0")
    return cumulated.select(
        F.col("passed").alias("grid_index"),
        F.round(F.element_at(ladder, F.col("passed") + 1), 6).alias("threshold"),
        "tp",
        "fp",
        (F.col("n_pos") - F.col("tp")).alias("fn"),
        F.round(_f1_at("tp", "fp", "n_pos"), digits).alias("f1"),
    )


def best_of_grid(grid: DataFrame) -> DataFrame:
    """First maximum: the lowest threshold among equal F1."""
    best = F.min(F.struct((-F.col("f1")).alias("loss"), F.col("grid_index"), F.col("threshold")))
    return grid.agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), (-F.col("b.loss")).alias("f1"))


def apply_threshold(df: DataFrame, score: str, threshold: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))
