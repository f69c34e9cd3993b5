"""Model search on fold tables: encoders learned once per fold, boosted fits read off at every length.

A fold table is the training rows encoded with what the other folds know, written once; every candidate is fitted on and
judged by the same tables. Boosted trees are grown one after the other from seeds that depend on their position only, so
the first 200 trees of a fit of 600 rounds are the fit of 200 rounds: candidates that differ in their number of rounds
share one fit, and the margins of all lengths come from one pass in which every tree is evaluated once.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import prod

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.session import discard, materialise

Candidate = Mapping[str, object]

LENGTH = "maxIter"
"""The parameter of boosted trees that prefixes answer."""


@dataclass
class Search:
    """What a search found: mean class-1 F1 per candidate, in the order given, and the best one refitted on all rows."""

    candidates: list[Candidate]
    scores: list[float]
    drawn: list[bool]
    best: PipelineModel
    encoder_fits: int = 0
    classifier_fits: int = 0
    folds: int = 0
    fold_scores: list[list[float]] = field(default_factory=list)

    @property
    def winner(self) -> Candidate:
        return self.candidates[max(range(len(self.scores)), key=lambda i: (self.scores[i], -i))]


def every_candidate(grid: Mapping[str, Sequence]) -> list[Candidate]:
    """All combinations of a grid, the last parameter changing fastest."""
    return [_nth(grid, i) for i in range(prod(map(len, grid.values())))]


def draw_candidates(grid: Mapping[str, Sequence], n: int, seed: int) -> list[Candidate]:
    """``n`` different combinations of a grid, drawn by position: the grid is never listed."""
    total = prod(map(len, grid.values()))
    return [_nth(grid, i) for i in random.Random(seed).sample(range(total), min(n, total))]


def _nth(grid: Mapping[str, Sequence], i: int) -> Candidate:
    chosen = {}
    for name, values in reversed(grid.items()):
        i, k = divmod(i, len(values))
        chosen[name] = values[k]
    return dict(reversed(chosen.items()))


def fold_tables(rows: DataFrame, encoder, folds: int, seed: int, keep: Sequence[str]) -> list[DataFrame]:
    """A written table per fold: label_idx, features, the ``keep`` columns and ``held_out``.

    Folds are drawn like MLlib's (a uniform number per row); the encoder of a fold never sees its held-out rows.
    """
    dealt = materialise(rows.withColumn("__fold", F.floor(F.rand(seed) * folds)), "folds")
    tables = []
    for k in range(folds):
        fitted = encoder.fit(dealt.filter(F.col("__fold") != k))
        encoded = fitted.transform(dealt).select("label_idx", "features", *keep, (F.col("__fold") == k).alias("held_out"))
        tables.append(materialise(encoded, f"fold-{k}"))
    discard(dealt)
    return tables


def segment(model: GBTClassificationModel, start: int, stop: int) -> GBTClassificationModel:
    """The model made of trees ``start`` to ``stop`` (exclusive) of a boosted model."""
    gateway = SparkContext._active_spark_context._gateway
    ml, grown, scale = gateway.jvm.org.apache.spark.ml, model._java_obj.trees(), model.treeWeights
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, stop - start)
    weights = gateway.new_array(gateway.jvm.double, stop - start)
    for i in range(start, stop):  # references to trees that stay in the JVM
        trees[i - start], weights[i - start] = grown[i], float(scale[i])
    part = GBTClassificationModel(ml.classification.GBTClassificationModel(f"{model.uid}_{start}_{stop}", trees, weights))
    return part.setFeaturesCol(model.getFeaturesCol())


def prefix(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model that a fit of ``rounds`` rounds would have given."""
    if not 0 < rounds <= model.getNumTrees:
        raise ValueError(f"a model of {model.getNumTrees} trees has no prefix of {rounds}")
    return segment(model, 0, rounds)


def prefix_margins(model: GBTClassificationModel, df: DataFrame, lengths: Sequence[int], out: str = "margins") -> DataFrame:
    """``df`` with an array of the margins of the prefixes of the given (ascending) lengths; class 1 where positive."""
    columns, total, sums = df.columns, F.lit(0.0), []
    for a, b in zip([0, *lengths[:-1]], lengths, strict=True):
        part = segment(model, a, b).setRawPredictionCol(f"__raw{b}").setPredictionCol(f"__class{b}").setProbabilityCol("")
        df = part.transform(df)
        total = total + vector_to_array(F.col(f"__raw{b}"))[1]
        sums.append(total)
    return df.select(*columns, F.array(*sums).alias(out))


def prefix_f1(model: GBTClassificationModel, df: DataFrame, lengths: Sequence[int], label: str = "label_idx") -> dict[int, float]:
    """Class-1 F1 of every prefix, from one pass over the rows."""
    scored = prefix_margins(model, df, lengths).select(label, "margins")
    sums = []
    for k, n in enumerate(lengths):
        hit = F.col("margins")[k] > 0
        sums += [F.sum((hit & (F.col(label) == 1)).cast("long")).alias(f"tp{n}"), F.sum(hit.cast("long") + (F.col(label) == 1).cast("long")).alias(f"both{n}")]
    row = scored.agg(*sums).first()
    return {n: 2.0 * row[f"tp{n}"] / row[f"both{n}"] if row[f"both{n}"] else 0.0 for n in lengths}


def class_one_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label_idx", predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0)


def without_summary(model):
    """The same model (or pipeline of models) without the summaries of its training.

    The summary of a binary classifier refers to the session and travels with the model to the tasks; a session
    in which a query was observed (``Observation``) cannot travel, so every use of such a model would fail.
    """
    for stage in getattr(model, "stages", [model]):
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def _set(classifier, candidate: Candidate):
    return classifier.copy({classifier.getParam(name): value for name, value in candidate.items()})


def _groups(classifier, candidates: Sequence[Candidate]) -> list[tuple[Candidate, list[int]]]:
    """(what is fitted, candidates that it answers): boosted candidates that differ in length only share a fit."""
    if not isinstance(classifier, GBTClassifier):
        return [(c, [i]) for i, c in enumerate(candidates)]
    found: dict[tuple, list[int]] = {}
    for i, c in enumerate(candidates):
        found.setdefault(tuple((k, v) for k, v in c.items() if k != LENGTH), []).append(i)
    default = classifier.getMaxIter()
    return [({**dict(rest), LENGTH: max(candidates[i].get(LENGTH, default) for i in which)}, which) for rest, which in found.items()]


def search(
    rows: DataFrame, encoder, classifier, candidates: Sequence[Candidate], *, folds: int = 3, seed: int = 42, parallelism: int = 4,
    keep: Sequence[str] = (), lengths: Sequence[int] = (),
) -> Search:
    """Mean class-1 F1 of every candidate over the folds, and the best one refitted on all rows.

    ``keep`` names the weight columns that candidates may use. With ``lengths`` each boosted fit also answers the shorter
    of them, at no further fit; such candidates follow the given ones and are not marked as drawn.
    """
    candidates, n_drawn = [dict(c) for c in candidates], len(candidates)
    if lengths and isinstance(classifier, GBTClassifier):
        known = {tuple(sorted((k, str(v)) for k, v in c.items())) for c in candidates}
        for c in list(candidates):
            for n in sorted(lengths):
                other = {**c, LENGTH: n}
                name = tuple(sorted((k, str(v)) for k, v in other.items()))
                if n < c.get(LENGTH, classifier.getMaxIter()) and name not in known:
                    known.add(name)
                    candidates.append(other)
    groups = _groups(classifier, candidates)
    tables = fold_tables(rows, encoder, folds, seed, keep)
    scores = [[0.0] * folds for _ in candidates]

    def judge(job):
        k, (chosen, which) = job
        fit, held = tables[k].filter("NOT held_out"), tables[k].filter("held_out")
        model = without_summary(_set(classifier, chosen).fit(fit))
        if isinstance(classifier, GBTClassifier):
            rounds = [candidates[i].get(LENGTH, classifier.getMaxIter()) for i in which]
            f1 = prefix_f1(model, held, sorted(set(rounds)))
            for i, n in zip(which, rounds, strict=True):
                scores[i][k] = f1[n]
        else:
            scores[which[0]][k] = class_one_f1().evaluate(model.transform(held))

    jobs = [(k, g) for k in range(folds) for g in sorted(groups, key=lambda g: -int(g[0].get(LENGTH, 0)))]
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(rows.sparkSession)(judge), jobs))
    means = [sum(s) / folds for s in scores]
    chosen = candidates[max(range(len(means)), key=lambda i: (means[i], -i))]
    shared = encoder.fit(rows)
    whole = materialise(shared.transform(rows).select("label_idx", "features", *keep), "encoded")
    best = without_summary(PipelineModel(stages=[*shared.stages, _set(classifier, chosen).fit(whole)]))
    for table in (*tables, whole):
        discard(table)
    drawn = [i < n_drawn for i in range(len(candidates))]
    return Search(candidates, means, drawn, best, folds + 1, len(groups) * folds + 1, folds, scores)
