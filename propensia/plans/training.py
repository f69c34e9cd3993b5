"""Train several classifiers, keep the best, refit it on everything and score with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from propensia.operators import models
from propensia.operators.encode import tree_bins
from propensia.operators.sets import hash_split
from propensia.session import materialise


def train_select_save(
    df: DataFrame, spec: models.FeatureSpec, key: str, path: str, params: Mapping[str, Mapping] = models.FROZEN
) -> DataFrame:
    """Fit every algorithm in ``params`` on four fifths of the rows, rank them on the
    rest by class-1 F1 at their tuned thresholds, refit the best on all rows and save it with its threshold.

    The threshold is learned on the validation rows, before the refit. Returns the
    ranking.
    """
    rows = materialise(hash_split(df, key), "labelled")
    fit, valid = rows.filter("split = 'fit'").drop("split"), rows.filter("split = 'val'").drop("split")
    bins = tree_bins(rows, spec.high_cardinality)
    fitted = models.fit_all(fit, spec, {name: models.ALGORITHMS[name](bins, **chosen) for name, chosen in params.items()})
    # Each model is judged at the threshold it would be used with.
    thresholds = {name: models.learn_threshold(model, valid) for name, model in fitted.items()}
    board = models.leaderboard(fitted, valid, thresholds)
    best = models.winner(board)
    threshold = thresholds[best]
    final = models.refit_on_everything(rows.drop("split"), spec, best, **params[best])
    models.save_model(final, threshold, path, name=best)
    return board


def score_table(spark: SparkSession, df: DataFrame, path: str, spec: models.FeatureSpec, out: str) -> DataFrame:
    """Score with the saved model and threshold, write (ids, label, probability) as Parquet."""
    model, threshold = models.load_model(spark, path)
    models.batch_score(df, model, threshold, spec).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
