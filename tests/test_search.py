"""Fold tables and prefix evaluation beside MLlib's own cross-validation and separate fits."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Observation
from pyspark.sql import functions as F

from propensia.catalog import model_queries as mq
from propensia.catalog.registry import ORACLES
from propensia.operators import models, search
from propensia.session import shared_folder
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """Label 1 where exactly one of two features is large: no single split finds it."""
    rng = random.Random(11)
    rows = [(i, rng.random(), rng.random(), rng.choice("abc")) for i in range(400)]
    return spark.createDataFrame([(i, x, y, c, int((x > 0.5) != (y > 0.5))) for i, x, y, c in rows], "id long, x double, y double, c string, label int").coalesce(2)


SPEC = models.FeatureSpec(label="label", numeric=("x", "y"), low_cardinality=("c",), ids=("id",))


def encoded(df):
    weighted = models.with_class_weights(df, "label")
    return SPEC.encoder().fit(weighted).transform(weighted).select("id", "label_idx", "features", models.WEIGHT)


def test_prefixes_are_the_shorter_fits(spark, planted):
    rows = encoded(planted).cache()
    make = {"subsamplingRate": 0.7, "featureSubsetStrategy": "0.6", "minInstancesPerNode": 3}
    long = models.boosted_trees(rounds=9, depth=3, **make).fit(rows)
    lengths = [2, 5, 9]
    f1 = search.prefix_f1(long, rows, lengths)
    margins = {r["id"]: r["margins"] for r in search.prefix_margins(long, rows, lengths).collect()}
    for k, n in enumerate(lengths):
        short = models.boosted_trees(rounds=n, depth=3, **make).fit(rows)
        assert short.toDebugString.split("\n", 1)[1] == search.prefix(long, n).toDebugString.split("\n", 1)[1]
        scored = short.transform(rows)
        for r in scored.select("id", "rawPrediction").collect():
            assert abs(r["rawPrediction"][1] - margins[r["id"]][k]) < 1e-12
        assert abs(search.class_one_f1().evaluate(scored) - f1[n]) < 1e-12
    with pytest.raises(ValueError):
        search.prefix(long, 10)


def test_fold_tables_give_the_averages_of_cross_validator(spark, planted):
    """Same folds, same averages, one encoder fit per fold."""
    grid = {"maxDepth": [1, 2, 4], "minInstancesPerNode": [1, 20]}
    found = models.cross_validate(planted, SPEC, models.decision_tree(), grid, folds=3)
    weighted = models.with_class_weights(planted, "label")
    tree = models.decision_tree()
    maps = ParamGridBuilder().addGrid(tree.maxDepth, grid["maxDepth"]).addGrid(tree.minInstancesPerNode, grid["minInstancesPerNode"]).build()
    plain = CrossValidator(estimator=Pipeline(stages=[*SPEC.encoder().getStages(), tree]), estimatorParamMaps=maps, evaluator=search.class_one_f1(), numFolds=3, seed=models.SEED).fit(weighted)
    want = {(m[tree.maxDepth], m[tree.minInstancesPerNode]): a for m, a in zip(maps, plain.avgMetrics, strict=True)}
    got = {(c["maxDepth"], c["minInstancesPerNode"]): s for c, s in zip(found.candidates, found.scores, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert found.encoder_fits == 3 + 1 and found.classifier_fits == 3 * 6 + 1
    assert found.winner["maxDepth"] > 1 and found.best.transform(planted).filter("prediction = label_idx").count() > 380


def test_boosted_search_finds_the_planted_candidate_with_shared_fits(spark, planted):
    grid = {"maxIter": [1, 3, 8], "maxDepth": [1, 3]}
    found = search.search(models.with_class_weights(planted, "label"), SPEC.encoder(), models.boosted_trees(), search.every_candidate(grid), folds=2, keep=[models.WEIGHT])
    assert found.classifier_fits == 2 * 2 + 1  # two depths, two folds, the refit
    best = dict(zip(map(str, found.candidates), found.scores, strict=True))
    assert found.winner["maxDepth"] == 3 and max(s for c, s in best.items() if "'maxDepth': 1" in c) < 0.75 < max(found.scores)
    one = search.search(models.with_class_weights(planted, "label"), SPEC.encoder(), models.boosted_trees(), [{"maxIter": 8, "maxDepth": 3}], folds=2, keep=[models.WEIGHT], lengths=[1, 3, 8])
    assert [c["maxIter"] for c in one.candidates] == [8, 1, 3] and one.drawn == [True, False, False] and one.classifier_fits == 3
    assert all(abs(s - best[str({"maxIter": c["maxIter"], "maxDepth": 3})]) < 1e-12 for c, s in zip(one.candidates, one.scores, strict=True))


def test_draws_are_different_and_repeatable():
    grid = models.GRIDS["BoostedTrees"]
    drawn = search.draw_candidates(grid, 25, 42)
    assert len({str(sorted(c.items(), key=str)) for c in drawn}) == 25 and drawn == search.draw_candidates(grid, 25, 42) != search.draw_candidates(grid, 25, 43)
    assert all(c[k] in grid[k] for c in drawn for k in grid) and list(drawn[0]) == list(grid)
    small = {"a": [1, 2], "b": ["x", "y", "z"]}
    assert search.every_candidate(small) == [{"a": a, "b": b} for a in (1, 2) for b in "xyz"]
    assert sorted(map(str, search.draw_candidates(small, 99, 1))) == sorted(map(str, search.every_candidate(small)))


def test_search_discards_its_tables(spark, planted):
    import os

    root = shared_folder(spark).split(":", 1)[-1] + "/propensia"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    models.cross_validate(planted, SPEC, models.decision_tree(), {"maxDepth": [2]}, folds=2)
    assert not [f for f in set(os.listdir(root)) - before if f.startswith(("fold", "encoded"))]


def test_a_model_of_a_shuffled_label_turns_the_row_red(spark, monkeypatch):
    con = connect(SF)
    assert compare(mq.ml_rule_recovered(spark, SF), con, ORACLES["ml_rule_recovered"]) == []
    honest = mq.ruled_rows

    def shuffled(spark, sf):
        rows = honest(spark, sf)
        fitted = F.when(F.col("split") == "fit", (F.crc32(F.col("c_custkey").cast("string").cast("binary")) % 4 == 0).cast("int")).otherwise(F.col("label"))
        return rows.withColumn("label", fitted)

    monkeypatch.setattr(mq, "ruled_rows", shuffled)
    assert compare(mq.ml_rule_recovered(spark, SF), con, ORACLES["ml_rule_recovered"])
    monkeypatch.setattr(mq, "ruled_rows", lambda s, sf: honest(s, sf).withColumn("label", F.when(F.col("split") == "fit", F.col("c_custkey").isin(1, 2, 4, 5).cast("int")).otherwise(F.col("label"))))
    assert compare(mq.ml_bayes_closed_form(spark, SF), con, ORACLES["ml_bayes_closed_form"])


def test_models_serve_in_a_session_that_has_observed_a_query(spark, planted):
    """A training summary names the session, which cannot travel once an observation was made in it."""
    seen = Observation("rows")
    planted.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 400
    for classifier in (models.logistic(), models.random_forest(trees=3)):
        fitted = models.fit_all(planted, SPEC, {"one": classifier})["one"]
        for model in (models.fit_model(planted, SPEC, classifier), fitted):
            assert not model.stages[-1].hasSummary
            assert model.transform(planted).select("prediction").count() == 400
            assert len(model.transform(planted).select("prediction").collect()) == 400
    found = models.cross_validate(planted, SPEC, models.logistic(), {"regParam": [0.01, 0.1]}, folds=2)
    assert len(found.best.transform(planted).select("prediction").collect()) == 400
