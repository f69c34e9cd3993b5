"""Training, selecting, saving and applying MLlib classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.operators.encode import encoder, feature_names, tree_bins
from propensia.operators.evaluate import best_threshold, weighted_metrics
from propensia.operators.learned import THRESHOLD_SCHEMA, class_weights
from propensia.operators.resample import smotenc
from propensia.operators.search import Search, class_one_f1, draw_candidates, every_candidate, search, without_summary
from propensia.operators.sets import balance_fractions, stratified_sample
from propensia.session import materialise
from propensia.sources.store import load_params, params_frame, save_params

SEED = 42
WEIGHT = "poids_classe"
COMMON = {"labelCol": "label_idx", "featuresCol": "features", "weightCol": WEIGHT}


@dataclass
class FeatureSpec:
    """Which columns play which part."""

    label: str
    numeric: Sequence[str]
    low_cardinality: Sequence[str] = ()
    high_cardinality: Sequence[str] = ()
    ids: Sequence[str] = field(default_factory=tuple)

    def encoder(self) -> Pipeline:
        return encoder(self.label, self.numeric, self.low_cardinality, self.high_cardinality)


# ---- classifiers (fixed default parameters) ------------------------------------

def random_forest(max_bins: int = 32, trees: int = 30, depth: int = 5, **kw) -> RandomForestClassifier:
    return RandomForestClassifier(**COMMON, numTrees=trees, maxDepth=depth, maxBins=max_bins, seed=SEED, **kw)


def logistic(max_bins: int = 32, **kw) -> LogisticRegression:
    return LogisticRegression(**COMMON, family="multinomial", **kw)


def decision_tree(max_bins: int = 32, **kw) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(**COMMON, maxBins=max_bins, seed=SEED, **kw)


def gaussian_bayes(max_bins: int = 32, **kw) -> NaiveBayes:
    return NaiveBayes(**COMMON, modelType="gaussian", **kw)


def boosted_trees(max_bins: int = 32, rounds: int = 20, depth: int = 5, step: float = 0.1, **kw) -> GBTClassifier:
    return GBTClassifier(**COMMON, maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=max_bins, seed=SEED, **kw)


ALGORITHMS: dict[str, Callable] = {
    "RandomForest": random_forest,
    "LogisticRegression": logistic,
    "DecisionTree": decision_tree,
    "NaiveBayes_Gaussian": gaussian_bayes,
    "BoostedTrees": boosted_trees,
}

# The search grids, by algorithm.
GRIDS: dict[str, dict[str, list]] = {
    "RandomForest": {"numTrees": [50, 100], "maxDepth": [5, 8]},
    "LogisticRegression": {"regParam": [0.01, 0.1, 0.5], "elasticNetParam": [0.0, 0.5, 1.0]},
    "DecisionTree": {"maxDepth": [5, 8, 12], "minInstancesPerNode": [1, 5, 10]},
    "NaiveBayes_Gaussian": {},
    "BoostedTrees": {"maxIter": [200, 300, 400, 600], "maxDepth": [3, 4, 5, 6, 8],
                     "stepSize": [0.02, 0.05, 0.1], "subsamplingRate": [0.7, 0.8, 1.0],
                     "minInstancesPerNode": [1, 3, 5], "featureSubsetStrategy": ["0.6", "0.8", "all"]},
}

# Shares of the raw imbalance that a search may give the positives as weight (None: equal weights).
WEIGHT_SHARES: tuple[float | None, ...] = (None, 0.25, 0.5, 1.0)


# Parameters kept from earlier searches, to fit without searching again.
FROZEN: dict[str, dict] = {
    "RandomForest": {"trees": 100, "depth": 8},
    "LogisticRegression": {"regParam": 0.1, "elasticNetParam": 0.0},
    "DecisionTree": {"maxDepth": 5, "minInstancesPerNode": 5},
    "NaiveBayes_Gaussian": {"smoothing": 1.0},
    "BoostedTrees": {"rounds": 200, "depth": 8, "step": 0.03, "subsamplingRate": 0.8},
}


# ---- fitting -------------------------------------------------------------------

def with_class_weights(df: DataFrame, label: str, softened: bool = True) -> DataFrame:
    """Weights as literals: one count per class reaches the driver, the rows are read once more at most."""
    weights = {r[label]: r["poids_classe"] for r in class_weights(df, label, softened).collect()}
    weight = F.lit(None).cast("double")
    for value, w in weights.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(w)).otherwise(weight)
    return df.filter(F.col(label).isNotNull()).withColumn(WEIGHT, weight)


def fit_model(train: DataFrame, spec: FeatureSpec, classifier, softened: bool = True) -> PipelineModel:
    """Encoders, assembler and weighted classifier in one fitted pipeline."""
    weighted = with_class_weights(train, spec.label, softened)
    return without_summary(Pipeline(stages=[*spec.encoder().getStages(), classifier]).fit(weighted))


def fit_all(train: DataFrame, spec: FeatureSpec, classifiers: Mapping[str, object], softened: bool = True) -> dict[str, PipelineModel]:
    """Every classifier on the same encoded rows: encoders are learned once and the encoding is written once."""
    weighted = with_class_weights(train, spec.label, softened)
    shared = spec.encoder().fit(weighted)
    encoded = materialise(shared.transform(weighted).select("label_idx", "features", WEIGHT), "encoded")
    return {name: without_summary(PipelineModel(stages=[*shared.stages, classifier.fit(encoded)])) for name, classifier in classifiers.items()}


def fit_oversampled(train: DataFrame, spec: FeatureSpec, classifier, key: str, k: int = 5) -> PipelineModel:
    """Fit on the training rows plus synthetic minority rows, without class weights.

    Oversampling and weighting correct the same imbalance, so only one is used.
    Categories are interpolated by vote before encoding; validation rows never take part.
    """
    categories = [*spec.low_cardinality, *spec.high_cardinality]
    synthetic = smotenc(train, key, spec.label, list(spec.numeric), categories, k=k, seed=SEED)
    columns = [spec.label, *spec.numeric, *categories]
    balanced = train.select(*columns).unionByName(synthetic.select(*columns)).withColumn(WEIGHT, F.lit(1.0))
    return without_summary(Pipeline(stages=[*spec.encoder().getStages(), classifier]).fit(materialise(balanced, "balanced")))


def encoder_of(model: PipelineModel) -> PipelineModel:
    """The fitted encoding stages of a model, without its classifier."""
    return PipelineModel(stages=model.stages[:-1])


def cross_validate(
    train: DataFrame, spec: FeatureSpec, classifier, grid: Mapping[str, Sequence], folds: int = 3, parallelism: int = 2
) -> Search:
    """Grid search on class-1 F1."""
    weighted = with_class_weights(train, spec.label)
    return search(weighted, spec.encoder(), classifier, every_candidate(grid), folds=folds, seed=SEED, parallelism=parallelism, keep=[WEIGHT])


def random_search(
    train: DataFrame, spec: FeatureSpec, classifier, grid: Mapping[str, Sequence],
    iterations: int = 25, folds: int = 3, parallelism: int = 2, seed: int = SEED, shares: Sequence[float | None] = (),
    lengths: Sequence[int] = (),
) -> Search:
    """Cross-validation over a seeded choice of the grid's combinations.

    With ``shares`` the weight of the positives is searched too: each share of the raw imbalance
    is a weight column of its own, and which column a candidate uses is one more parameter.
    ``lengths`` also reads every boosted fit off at those shorter numbers of rounds.
    """
    weighted, keep = with_class_weights(train, spec.label), [WEIGHT]
    if shares:
        weighted = with_positive_weights(weighted, spec.label, shares)
        keep += [weight_column(s) for s in shares]
        grid = {**grid, "weightCol": keep[1:]}
    drawn = draw_candidates(grid, iterations, seed)
    return search(weighted, spec.encoder(), classifier, drawn, folds=folds, seed=SEED, parallelism=parallelism, keep=keep, lengths=lengths)


def weight_column(share: float | None) -> str:
    return "poids_egal" if share is None else f"poids_{int(round(share * 100))}"


def with_positive_weights(df: DataFrame, label: str, shares: Sequence[float | None]) -> DataFrame:
    """A weight column per share: positives weigh share x (negatives / positives), negatives 1."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    ratio = sizes.get(0, 0) / max(sizes.get(1, 0), 1)
    return df.withColumns({
        weight_column(s): F.when(F.col(label) == 1, F.lit(1.0 if s is None else ratio * s)).otherwise(F.lit(1.0)) for s in shares
    })


def fit_undersampled(train: DataFrame, spec: FeatureSpec, classifier, seed: int = SEED) -> PipelineModel:
    """Fit on a sample in which every class is about as large as the smallest, without class weights."""
    fractions = balance_fractions(train, spec.label)
    sampled = materialise(stratified_sample(train, spec.label, fractions, seed).withColumn(WEIGHT, F.lit(1.0)), "undersampled")
    return without_summary(Pipeline(stages=[*spec.encoder().getStages(), classifier]).fit(sampled))


def search_imbalance_weight(
    train: DataFrame, valid: DataFrame, spec: FeatureSpec, classifier, shares: Sequence[float] = (0.25, 0.5, 1.0)
) -> DataFrame:
    """Class-1 F1 on ``valid`` with the positive weight at 1 and at shares of the raw imbalance."""
    sizes = {r[spec.label]: r["count"] for r in train.groupBy(spec.label).count().collect()}
    ratio = sizes.get(0, 0) / max(sizes.get(1, 0), 1)
    rows = []
    for weight in [1.0, *[ratio * s for s in shares]]:
        weighted = train.withColumn(WEIGHT, F.when(F.col(spec.label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))
        model = without_summary(Pipeline(stages=[*spec.encoder().getStages(), classifier]).fit(weighted))
        rows.append((weight, class_one_f1().evaluate(model.transform(valid))))
    return train.sparkSession.createDataFrame(rows, "positive_weight double, f1_classe1 double")


# ---- reports -------------------------------------------------------------------

def importances(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """(feature, importance), strongest first."""
    names = feature_names(scored)
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values, strict=True)]
    frame = scored.sparkSession.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature")


REPORTED_PARAMS = ("numTrees", "maxDepth", "regParam", "elasticNetParam", "minInstancesPerNode", "smoothing",
                   "maxIter", "stepSize", "subsamplingRate", "maxBins")


def params_report(spark: SparkSession, models: Mapping[str, PipelineModel]) -> DataFrame:
    rows = [
        (name, p.name, str(v))
        for name, model in models.items()
        for p, v in model.stages[-1].extractParamMap().items() if p.name in REPORTED_PARAMS
    ]
    return spark.createDataFrame(rows, "algo string, parameter string, value string")


def evaluate_model(model: PipelineModel, valid: DataFrame) -> DataFrame:
    """One row of metrics, from one pass over the scored rows."""
    scored = model.transform(valid).select("label_idx", "prediction")
    return weighted_metrics(scored, "label_idx", "prediction")


def leaderboard(models: Mapping[str, PipelineModel], valid: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Metrics of every model on the same validation rows, best class-1 F1 first.

    With ``thresholds`` a model listed there is judged at its own decision threshold instead of 0.5.
    """
    rows = None
    for name, model in models.items():
        if thresholds and name in thresholds:
            scored = class_one_probability(model.transform(valid)).select(
                "label_idx", (F.col("probability_classe1") >= thresholds[name]).cast("double").alias("prediction"))
            row = weighted_metrics(scored, "label_idx", "prediction")
        else:
            row = evaluate_model(model, valid)
        row = row.select(F.lit(name).alias("algo"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows.orderBy(F.desc("f1_classe1"), "algo")


def winner(board: DataFrame) -> str:
    return board.orderBy(F.desc("f1_classe1"), "algo").first()["algo"]


# ---- persistence and scoring ---------------------------------------------------

def class_one_probability(scored: DataFrame, out: str = "probability_classe1") -> DataFrame:
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


def learn_threshold(model: PipelineModel, valid: DataFrame) -> float:
    scored = class_one_probability(model.transform(valid))
    return best_threshold(scored, "label_idx", "probability_classe1").first()["threshold"]


def save_model(model: PipelineModel, threshold: float, path: str, name: str = "model") -> None:
    """The threshold belongs to the model and is stored beside it."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/pipeline")
    save_params(params_frame(spark, [(name, float(threshold))], THRESHOLD_SCHEMA), f"{path}/threshold")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    threshold = load_params(spark, f"{path}/threshold", THRESHOLD_SCHEMA).first()["seuil_decision"]
    return PipelineModel.load(f"{path}/pipeline"), threshold


def refit_on_everything(full: DataFrame, spec: FeatureSpec, algorithm: str, **params) -> PipelineModel:
    """The chosen algorithm on all labelled rows, weights recomputed on them."""
    bins = tree_bins(full, spec.high_cardinality)
    return fit_model(full, spec, ALGORITHMS[algorithm](bins, **params))


def _without_label(model: PipelineModel) -> tuple[PipelineModel, list[str]]:
    """The model for rows that carry no label, and the class names of its label indexer."""
    def is_label(stage) -> bool:
        return stage.hasParam("outputCol") and stage.isSet("outputCol") and stage.getOutputCol() == "label_idx"

    labels = next(s for s in model.stages if is_label(s)).labels
    return PipelineModel(stages=[s for s in model.stages if not is_label(s)]), list(labels)


def batch_score(df: DataFrame, model: PipelineModel, threshold: float, spec: FeatureSpec) -> DataFrame:
    """(ids..., label_predit, probability_classe1) at the stored threshold.

    Every row gets its row: one with a NULL or NaN feature has neither label nor probability.
    """
    stages, labels = _without_label(model)
    scored = class_one_probability(stages.transform(_scorable(df, spec)), "__p")
    probability = F.when(F.col("__complete"), F.col("__p"))
    picked = F.when(probability >= threshold, labels[1]).when(probability < threshold, labels[0])
    return scored.select(*spec.ids, picked.alias("label_predit"), probability.alias("probability_classe1"))


def _scorable(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows that the assembler accepts; ``__complete`` tells which really have all features."""
    complete = F.lit(True)
    for c in spec.numeric:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    filled = {c: F.when(complete, F.col(c).cast("double")).otherwise(F.lit(0.0)) for c in spec.numeric}
    return df.withColumn("__complete", complete).withColumns(filled)


def batch_score_classes(df: DataFrame, model: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """(ids..., label_predit, probability) of a multiclass model: most probable class by name.

    Every row gets its row, as in ``batch_score``.
    """
    stages, labels = _without_label(model)
    names = F.array(*[F.lit(x) for x in labels])
    return stages.transform(_scorable(df, spec)).select(
        *spec.ids,
        F.when(F.col("__complete"), F.element_at(names, F.col("prediction").cast("int") + 1)).alias("label_predit"),
        F.when(F.col("__complete"), vector_to_array(F.col("probability"))).alias("probability"),
    )
