"""End-to-end plans on files laid out like the raw data, and MLlib cross-checks."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propensia.catalog import roles
from propensia.catalog.model_queries import SPEC, training_rows
from propensia.operators import evaluate as ev
from propensia.operators import models
from propensia.plans.cleaning import LearnedCleaning, clean_score, clean_train
from propensia.plans.dataset import KEY, RAW_PATTERNS, build_dataset, land_as_parquet, load_raw, write_populations
from propensia.sources import delimited
from propensia.streaming.ingest import ingest_landed_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw_folder(spark, tmp_path_factory):
    """The given tables written as raw text files under the expected file names."""
    folder = tmp_path_factory.mktemp("raw")
    files = {
        "perimetre": [roles.perimetre(spark, SF)], "assi": [roles.assi(spark, SF)], "opk": roles.opk_files(spark, SF),
        "digitaux": [roles.digitaux(spark, SF)], "solde": roles.solde_files(spark, SF), "depot": roles.depot_files(spark, SF),
        "flux": roles.flux_files(spark, SF), "gab": roles.gab_files(spark, SF), "retrait": roles.retrait_files(spark, SF),
        "payfac": roles.payfac_files(spark, SF), "vignette": roles.vignette_files(spark, SF),
    }
    for name, parts in files.items():
        for pattern, part in zip(RAW_PATTERNS[name], parts + [parts[-1].limit(0)] * 3):
            path = folder / pattern.replace("*", "_1")
            (part.write.option("header", "true").option("sep", ";").option("encoding", "iso-8859-1").csv(str(path)))
    return str(folder)


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    built = build_dataset(roles.raw_tables(spark, SF), codes=roles.CODES)
    path = str(tmp_path_factory.mktemp("dataset"))
    built.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_dataset_from_files_equals_dataset_from_tables(spark, raw_folder, dataset):
    raw = load_raw(spark, raw_folder)
    built = build_dataset(raw, codes=roles.CODES, check=True)
    assert set(built.columns) == set(dataset.columns)
    columns = [c for c in dataset.columns if c not in ("BPR", "NOMBRE_ENFANT")]
    left, right = built.select(columns), dataset.select(columns)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_landing_as_parquet_changes_nothing(spark, raw_folder, tmp_path):
    raw = load_raw(spark, raw_folder)
    landed = land_as_parquet(raw, str(tmp_path))
    assert landed["gab"].exceptAll(raw["gab"]).count() == 0 and landed["gab"].count() == raw["gab"].count()


def test_rows_are_conserved_and_flags_are_binary(dataset, spark):
    assert dataset.count() == roles.perimetre(spark, SF).select(KEY).distinct().count()
    assert {r[0] for r in dataset.select("label_eligibilite").distinct().collect()} <= {0, 1}


def test_populations(spark, dataset, tmp_path):
    everyone, holders = write_populations(dataset, str(tmp_path))
    assert everyone.count() == dataset.count()
    assert holders.count() == dataset.filter("label_eligibilite = 1").count()


def test_cleaning_learns_once_and_replays(spark, dataset, tmp_path):
    cleaned, learnt = clean_train(dataset)
    learnt.save(str(tmp_path))
    loaded = LearnedCleaning.load(spark, str(tmp_path))
    for name in LearnedCleaning.SCHEMAS:
        assert sorted(map(str, getattr(loaded, name).collect())) == sorted(map(str, getattr(learnt, name).collect()))
    scored = clean_score(dataset, loaded)
    assert scored.columns == cleaned.columns
    # The same client gets the same features on either path.
    common = cleaned.select(KEY).join(scored, KEY)
    assert common.select(cleaned.columns).exceptAll(cleaned).count() == 0
    assert scored.count() >= cleaned.count()
    numeric = [c for c, t in cleaned.dtypes if t in ("int", "bigint", "double") and c not in ("age_client", "solde_moyen", "solde_min")]
    assert cleaned.select([F.count_if(F.col(c).isNull()).alias(c) for c in numeric if c.endswith("_imp")]).first() == tuple(
        0 for c in numeric if c.endswith("_imp"))


def test_empty_parameter_lists_survive_a_save(spark, dataset, tmp_path):
    _, learnt = clean_train(dataset)
    empty = LearnedCleaning(**{n: getattr(learnt, n).limit(0) for n in LearnedCleaning.SCHEMAS})
    empty.save(str(tmp_path))
    assert LearnedCleaning.load(spark, str(tmp_path)).bounds.count() == 0


def test_metrics_agree_with_mllib(spark):
    scored = roles.scored_clients(spark, SF).select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), "score")
    ours = ev.weighted_metrics(scored, "label", "prediction").first()
    for metric, name in (("accuracy", "accuracy"), ("f1", "weighted_f1"), ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall")):
        theirs = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName=metric).evaluate(scored)
        assert ours[name] == pytest.approx(theirs, abs=1e-6)
    vectors = scored.withColumn("rawPrediction", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    auc = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0).evaluate(vectors)
    assert ev.roc_auc(scored, "label", "score").first()["auc"] == pytest.approx(auc, abs=1e-6)


def test_saved_model_scores_unlabelled_rows(spark, tmp_path):
    rows = training_rows(spark, SF)
    fit, val = rows.filter("split = 'fit'"), rows.filter("split = 'val'")
    model = models.fit_model(fit, SPEC, models.decision_tree(64))
    threshold = models.learn_threshold(model, val)
    models.save_model(model, threshold, str(tmp_path))
    loaded, again = models.load_model(spark, str(tmp_path))
    assert again == threshold
    scored = models.batch_score(val.drop("label"), loaded, again, SPEC)
    assert scored.columns == ["c_custkey", "label_predit", "probability_classe1"]
    assert scored.count() == val.count()
    wrong = scored.filter((F.col("probability_classe1") >= again) != (F.col("label_predit") == "1"))
    assert wrong.count() == 0


def test_label_index_follows_the_class(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(0,)] * 2, "y int")
    from propensia.operators.encode import label_stage

    assert label_stage("y").fit(df).labels == ["0", "1"]
    assert StringIndexer(inputCol="y", outputCol="i").fit(df).labels == ["1", "0"]


def test_stream_takes_each_file_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    columns = ["RADICAL", "MONTANT"]

    def land(rows):
        spark.createDataFrame(rows, "RADICAL string, MONTANT string").coalesce(1).write.mode("append").option("header", "true").option("sep", ";").csv(landing)

    land([("1", "5,5"), ("2", "é")])
    assert ingest_landed_files(spark, landing, out, state, columns).count() == 2
    land([("3", "7")])
    assert ingest_landed_files(spark, landing, out, state, columns).count() == 3
    assert ingest_landed_files(spark, landing, out, state, columns).count() == 3


def test_inferred_csv_keeps_codes_as_text(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    # Types come from a tenth of the rows, so there must be enough of them.
    spark.range(2000).selectExpr("cast(id as int) id", "lpad(cast(id % 90 as string), 2, '0') CODE_VILLE").write.option("header", "true").csv(path)
    df = delimited.load_dataset(spark, path, code_columns=["CODE_VILLE"])
    assert dict(df.dtypes) == {"id": "int", "CODE_VILLE": "string"}


def test_sniffer_and_search(spark, tmp_path):
    (tmp_path / "a.txt").write_text("RADICAL|DATE_CREATED|X\n1|2|3\n")
    (tmp_path / "b.txt").write_text("RADICAL;CREATE_DAY\n1;2\n4;5\n")
    folder = str(tmp_path)
    found = {r["file"]: (r["separator"], r["n_columns"]) for r in delimited.sniff_separator(spark, folder).collect()}
    assert found == {"a.txt": ("|", 3), "b.txt": (";", 2)}
    assert [tuple(r) for r in delimited.search_columns(spark, folder, "create", "b.txt").collect()] == [("b.txt", "CREATE_DAY")]
    inventory = delimited.file_inventory(spark, folder, "b.txt").first()
    assert (inventory["n_rows"], inventory["preview"]) == (2, ["1;2", "4;5"])
