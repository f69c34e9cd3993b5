"""The small scheduled training job: a few ratios, boosted trees, one AUC."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensia.functions import months_since
from propensia.operators.evaluate import roc_auc
from propensia.operators.models import class_one_probability
from propensia.operators.rules import safe_ratio
from propensia.operators.sets import hash_split

FEATURES = ("anciennete_mois", "ratio_epargne_revenu", "nb_produits_detenus", "score_risque")


def job_features(clients: DataFrame, reference: dt.date, key: str | None = None) -> DataFrame:
    """Seniority in months and savings ratio; rows with any NULL go."""
    df = clients.withColumn("anciennete_mois", months_since("date_ouverture_compte", reference))
    df = safe_ratio(df, "solde_moyen", "revenu_mensuel", "ratio_epargne_revenu")
    return df.select(*([key] if key else []), *FEATURES, "eligible").na.drop()


def train_small(
    clients: DataFrame, reference: dt.date, key: str, rounds: int = 300, depth: int = 5, step: float = 0.05
) -> DataFrame:
    """Fit on four fifths of the clients, report the AUC on the rest."""
    df = hash_split(job_features(clients, reference, key), key)
    fit, held_out = df.filter("split = 'fit'"), df.filter("split = 'val'")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        GBTClassifier(labelCol="eligible", maxIter=rounds, maxDepth=depth, stepSize=step, seed=42),
    ]).fit(fit)
    scored = class_one_probability(model.transform(held_out), "score")
    return roc_auc(scored, "eligible", "score").withColumn("n_rounds", F.lit(rounds))
