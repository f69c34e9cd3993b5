"""Assembly, encoding, models, evaluation and resampling."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from propensia.catalog import roles
from propensia.catalog.registry import ORACLES, query, table
from propensia.functions import exact_mean, exact_sum
from propensia.operators import encode, models, resample, rules
from propensia.operators import evaluate as ev
from propensia.operators.sets import hash_split
from propensia.plans.curated import curate, write_dataset
from propensia.plans.dataset import build_dataset, savings_target
from propensia.plans.small_job import train_small
from propensia.plans.training import score_table, train_select_save
from propensia.plans.yearly import YearlyDataset
from propensia.session import materialise, staging_path
from propensia.sources.store import bucket_number

_DATASET_TEXT = "derniere_operation_gab"


@query("build_dataset_final", roles.with_roles("dataset") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", agence AS "AGENCE", strftime(birth, '%d/%m/%Y') AS "DATE_OF_BIRTH",
      CASE WHEN CAST(radical AS BIGINT) % 53 = 0 THEN 'X' WHEN CAST(radical AS BIGINT) % 4 = 0 THEN 'FÃ©minin'
           WHEN CAST(radical AS BIGINT) % 4 = 2 THEN 'Féminin' ELSE 'Masculin' END AS "GENDER",
      'VILLE_' || code_ville AS "LIBELLE_VILLE", CAST(NULL AS VARCHAR) AS "TAILLE_ENTREPRI",
      code_ville AS "CODE_VILLE", bpr AS "BPR", CAST(enfants AS VARCHAR) AS "NOMBRE_ENFANT", marital AS "MARITAL_STATUS", rating AS "CUSTOMER_RATING",
      age_client, label_code, label_nom, pack_actuel, pack_etat, digital_date_activation, digital_toujours_abonne, anciennete_digitale_jours,
      solde_moyen, solde_min, solde_max, nb_mois_observes_solde, depot_moyen, flux_cred_moyen, flux_cred_total, nb_mois_avec_flux,
      nb_operations_gab, montant_total_gab, montant_moyen_gab, strftime(derniere_operation_gab, '%Y-%m-%d %H:%M:%S') AS derniere_operation_gab,
      recence_gab_jours, nb_retraits, montant_total_retraits, nb_paiements_digitaux, montant_total_payfac, nb_vignettes_payees,
      montant_total_vignette, label_eligibilite FROM dataset""")
def build_dataset_final(spark, sf):
    dataset = build_dataset(roles.raw_tables(spark, sf), codes=roles.CODES)
    return dataset.withColumn(_DATASET_TEXT, F.date_format(_DATASET_TEXT, "yyyy-MM-dd HH:mm:ss"))


@query("build_dataset_bucketed", ORACLES["build_dataset_final"])
def build_dataset_bucketed(spark, sf):
    """Through curated tables in buckets of clients, with the blocking gates counted while they are written."""
    raw, folder = roles.raw_tables(spark, sf), staging_path(spark, "curated")
    curated = curate(raw, folder, bucket_number(raw["perimetre"].count()), codes=roles.CODES)
    dataset = write_dataset(curated, f"{folder}/dataset")
    return dataset.withColumn(_DATASET_TEXT, F.date_format(_DATASET_TEXT, "yyyy-MM-dd HH:mm:ss"))


@query("build_dataset_incremental", ORACLES["build_dataset_final"])
def build_dataset_incremental(spark, sf):
    """File after file, each merged into the buckets of its own clients; one file comes twice, which changes nothing."""
    kept = YearlyDataset(spark, staging_path(spark, "yearly"), codes=roles.CODES, buckets=8)
    kept.take_all({name: [(f"{name}-{i}", raw) for i, raw in enumerate(files)] for name, files in roles.raw_files(spark, sf).items()})
    kept.take("gab", "gab-0", roles.gab_files(spark, sf)[0])
    dataset = kept.dataset()
    return dataset.withColumn(_DATASET_TEXT, F.date_format(_DATASET_TEXT, "yyyy-MM-dd HH:mm:ss"))


# ---- the table the models learn from -------------------------------------------

SPEC = models.FeatureSpec(
    label="label", numeric=("c_acctbal", "n_orders", "total", "mean", "smallest", "largest"),
    low_cardinality=("c_mktsegment",), high_cardinality=("c_nationkey",), ids=("c_custkey",),
)


def training_rows(spark, sf):
    """Customers with order statistics and label, tagged fit / val by key hash."""
    stats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n_orders"), exact_sum("o_totalprice").alias("total"), exact_mean("o_totalprice").alias("mean"),
        F.min("o_totalprice").alias("smallest"), F.max("o_totalprice").alias("largest"),
    )
    rows = roles.client_label(spark, sf).join(stats, "c_custkey", "left")
    rows = rules.fill_zero(rows, ["n_orders", "total", "mean", "smallest", "largest"])
    rows = rows.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    # Fitting passes over the rows many times: compute them once.
    return hash_split(materialise(rows, "training"), "c_custkey")


def _halves(spark, sf):
    rows = training_rows(spark, sf)
    return rows.filter("split = 'fit'").drop("split"), rows.filter("split = 'val'").drop("split")


_TRAINING = roles.with_roles("client_label") + """,
    stats AS (SELECT o_custkey, count(*)::DOUBLE AS n_orders, sum(CAST(o_totalprice AS DECIMAL(38, 9)))::DOUBLE AS total,
      sum(CAST(o_totalprice AS DECIMAL(38, 9)))::DOUBLE / count(*) AS "mean", min(o_totalprice) AS smallest, max(o_totalprice) AS largest FROM orders GROUP BY 1),
    training AS (SELECT c_custkey, c_acctbal, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS c_nationkey, label, coalesce(n_orders, 0) AS n_orders,
      coalesce(total, 0) AS total, coalesce("mean", 0) AS "mean", coalesce(smallest, 0) AS smallest, coalesce(largest, 0) AS largest,
      substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4) < 'cccc' AS is_fit FROM client_label LEFT JOIN stats ON o_custkey = c_custkey)"""


def _model_sql(where: str = "NOT is_fit") -> str:
    """What any sound model gives: a row for each client, a probability, a decision that follows it."""
    return _TRAINING + f" SELECT c_custkey, label, true AS probability_ok, true AS prediction_ok FROM training WHERE {where}"


def _scored(model, df):
    return models.class_one_probability(model.transform(df)).select("c_custkey", "label", "prediction", "probability_classe1")


def _checked(scored):
    """Scored rows as checks of probability and decision."""
    p = F.col("probability_classe1")
    return scored.select(
        "c_custkey", "label", p.between(0.0, 1.0).alias("probability_ok"), (F.col("prediction") == (p > 0.5).cast("double")).alias("prediction_ok"))


def _fit(spark, sf, algorithm, **params):
    fit, val = _halves(spark, sf)
    bins = encode.tree_bins(fit, SPEC.high_cardinality)
    return models.fit_model(fit, SPEC, models.ALGORITHMS[algorithm](bins, **params)), fit, val


# ---- encoding ------------------------------------------------------------------

_RANKED = """SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i FROM {t} GROUP BY 1"""


@query("enc_string_index", f"""
    WITH a AS ({_RANKED.format(c='o_orderpriority', t='orders')}), b AS ({_RANKED.format(c='o_orderstatus', t='orders')})
    SELECT o_orderkey, a.i::DOUBLE AS o_orderpriority_idx, b.i::DOUBLE AS o_orderstatus_idx FROM orders JOIN a ON a.v = o_orderpriority JOIN b ON b.v = o_orderstatus""")
def enc_string_index(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    for c in ("o_orderpriority", "o_orderstatus"):
        orders = encode.index_stage(c).fit(orders).transform(orders)
    return orders.select("o_orderkey", "o_orderpriority_idx", "o_orderstatus_idx")


@query("enc_one_hot", f"""
    WITH a AS ({_RANKED.format(c='o_orderpriority', t='orders')}), n AS (SELECT count(*) AS k FROM a)
    SELECT o_orderkey, o_orderpriority, [CASE WHEN j = a.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for j in range((SELECT k FROM n))] AS "values"
    FROM orders JOIN a ON a.v = o_orderpriority""")
def enc_one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    encoded = Pipeline(stages=encode.encoding_stages(["o_orderpriority"])).fit(orders).transform(orders)
    return encode.unpack_vector(encoded, "o_orderpriority_ohe").select("o_orderkey", "o_orderpriority", "values")


@query("enc_index_to_string", "SELECT o_orderkey, o_orderpriority AS label_predit FROM orders")
def enc_index_to_string(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    indexer = encode.label_stage("o_orderpriority").fit(orders)
    return encode.index_to_label(indexer.transform(orders), "label_idx", "label_predit", indexer).select("o_orderkey", "label_predit")


_ENCODED = _TRAINING + """,
    fit AS (SELECT * FROM training WHERE is_fit),
    seg AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM fit GROUP BY 1),
    nat AS (SELECT c_nationkey AS v, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1 AS i FROM fit GROUP BY 1),
    encoded AS (SELECT c_custkey, label::DOUBLE AS label_idx, list_concat([c_acctbal, n_orders, total, "mean", smallest, largest],
      list_concat([CASE WHEN j = seg.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for j in range((SELECT count(*) FROM seg))], [nat.i::DOUBLE])) AS vals
      FROM fit JOIN seg ON seg.v = c_mktsegment JOIN nat ON nat.v = c_nationkey)"""


@query("enc_assemble", _ENCODED + ' SELECT c_custkey, label_idx, vals AS "values" FROM encoded')
def enc_assemble(spark, sf):
    fit, _ = _halves(spark, sf)
    assembled = SPEC.encoder().fit(fit).transform(fit)
    return encode.unpack_vector(assembled, "features").select("c_custkey", "label_idx", "values")


@query("ml_feature_names", _ENCODED + """,
    names AS (SELECT unnest(['c_acctbal', 'n_orders', 'total', 'mean', 'smallest', 'largest']) AS feature, unnest(range(6)) AS slot
      UNION ALL SELECT 'c_mktsegment_ohe_' || v, 6 + i FROM seg UNION ALL SELECT 'c_nationkey_idx', 6 + (SELECT count(*) FROM seg))
    SELECT CAST(slot AS INTEGER) AS slot, feature, (SELECT count(*) FILTER (vals[slot + 1] <> 0) FROM encoded) AS n_nonzero FROM names""")
def ml_feature_names(spark, sf):
    fit, _ = _halves(spark, sf)
    assembled = SPEC.encoder().fit(fit).transform(fit)
    names = encode.feature_names(assembled)
    nonzero = F.expr("transform(values, x -> cast(x != 0 as int))")
    counts = encode.unpack_vector(assembled, "features").select(nonzero.alias("n")).agg(
        *[F.sum(F.col("n")[i]).alias(f"f{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(n).alias("feature"), F.col(f"f{i}").alias("n_nonzero")) for i, n in enumerate(names)])
    return counts.select(F.inline(rows))


# ---- models --------------------------------------------------------------------

@query("ml_random_forest", _model_sql())
def ml_random_forest(spark, sf):
    model, _, val = _fit(spark, sf, "RandomForest")
    return _checked(_scored(model, val))


@query("ml_logistic", _model_sql())
def ml_logistic(spark, sf):
    model, _, val = _fit(spark, sf, "LogisticRegression")
    return _checked(_scored(model, val))


@query("ml_decision_tree", _model_sql())
def ml_decision_tree(spark, sf):
    model, _, val = _fit(spark, sf, "DecisionTree")
    return _checked(_scored(model, val))


@query("ml_naive_bayes", _model_sql())
def ml_naive_bayes(spark, sf):
    model, _, val = _fit(spark, sf, "NaiveBayes_Gaussian")
    return _checked(_scored(model, val))


@query("ml_gbt", _model_sql())
def ml_gbt(spark, sf):
    model, _, val = _fit(spark, sf, "BoostedTrees")
    return _checked(_scored(model, val))


@query("ml_boosted_oversampled", _model_sql())
def ml_boosted_oversampled(spark, sf):
    fit, val = _halves(spark, sf)
    bins = encode.tree_bins(fit, SPEC.high_cardinality)
    return _checked(_scored(models.fit_oversampled(fit, SPEC, models.boosted_trees(bins), "c_custkey"), val))


@query("ml_undersampled", _model_sql())
def ml_undersampled(spark, sf):
    fit, val = _halves(spark, sf)
    bins = encode.tree_bins(fit, SPEC.high_cardinality)
    return _checked(_scored(models.fit_undersampled(fit, SPEC, models.decision_tree(bins)), val))


@query("enc_frequency", _TRAINING + """,
    f AS (SELECT c_nationkey, count(*)::DOUBLE / (SELECT count(*) FROM training WHERE is_fit) AS share FROM training WHERE is_fit GROUP BY 1)
    SELECT c_custkey, round(coalesce(share, 0.0), 9) AS nation_share FROM training LEFT JOIN f USING (c_nationkey) WHERE NOT is_fit""")
def enc_frequency(spark, sf):
    fit, val = _halves(spark, sf)
    encoded = encode.apply_encoding(val, "c_nationkey", encode.fit_frequency(fit, "c_nationkey"), "nation_share", 0.0)
    return encoded.select("c_custkey", F.round("nation_share", 9).alias("nation_share"))


@query("enc_target_rate", _TRAINING + """,
    o AS (SELECT avg(label::DOUBLE) AS m FROM training WHERE is_fit),
    f AS (SELECT c_nationkey, (sum(label)::DOUBLE + 20.0 * (SELECT m FROM o)) / (count(*) + 20.0) AS rate FROM training WHERE is_fit GROUP BY 1)
    SELECT c_custkey, round(coalesce(rate, 0.0), 9) AS nation_rate FROM training LEFT JOIN f USING (c_nationkey) WHERE NOT is_fit""")
def enc_target_rate(spark, sf):
    fit, val = _halves(spark, sf)
    encoded = encode.apply_encoding(val, "c_nationkey", encode.fit_target_rate(fit, "c_nationkey", "label"), "nation_rate", 0.0)
    return encoded.select("c_custkey", F.round("nation_rate", 9).alias("nation_rate"))


@query("ml_product_score", roles.with_roles("cible") + """
    SELECT CAST(radical AS BIGINT) AS c_custkey, true AS known_class, true AS sums_to_one, true AS most_probable
    FROM cible WHERE CAST(radical AS BIGINT) IN (SELECT c_custkey FROM customer) AND substr(md5(radical), 1, 4) >= 'cccc'""")
def ml_product_score(spark, sf):
    """Which product: three classes, clients that hold one."""
    target = savings_target(roles.assi(spark, sf), roles.CODES).select(F.col("RADICAL").cast("bigint").alias("c_custkey"), "label_nom")
    holders = materialise(training_rows(spark, sf).drop("label", "split").join(target, "c_custkey"), "holders")
    spec = replace(SPEC, label="label_nom")
    bins = encode.tree_bins(holders, SPEC.high_cardinality)
    split = hash_split(holders, "c_custkey")
    model = models.fit_model(split.filter("split = 'fit'").drop("split"), spec, models.random_forest(bins), softened=False)
    scores = models.batch_score_classes(split.filter("split = 'val'").drop("label_nom", "split"), model, spec)
    names = sorted(r[0] for r in holders.select("label_nom").distinct().collect())  # one row per product
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("probability", F.array_max("probability")).cast("int"))
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    return scores.select("c_custkey", F.col("label_predit").isin(names).alias("known_class"), (F.abs(total - 1.0) < 1e-9).alias("sums_to_one"), (F.col("label_predit") == best).alias("most_probable"))


@query("ml_train_select_score", _TRAINING + " SELECT c_custkey, true AS label_ok, true AS probability_ok FROM training")
def ml_train_select_score(spark, sf):
    rows = training_rows(spark, sf).drop("split")
    path = staging_path(spark, "winner")
    # All five algorithms; boosting at its default rounds, since 200 of depth 8 take minutes on a test table.
    params = {**models.FROZEN, "BoostedTrees": {}}
    train_select_save(rows, SPEC, "c_custkey", path, params)
    scores = score_table(spark, rows.drop("label"), path, SPEC, staging_path(spark, "predictions"))
    threshold = models.load_model(spark, path)[1]
    p = F.col("probability_classe1")
    return scores.select("c_custkey", (F.col("label_predit") == F.when(p >= threshold, "1").otherwise("0")).alias("label_ok"), p.between(0.0, 1.0).alias("probability_ok"))


@query("ml_imbalance_weight", _TRAINING + """,
    r AS (SELECT count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1) AS ratio FROM training WHERE is_fit)
    SELECT round(unnest([1.0, ratio * 0.25, ratio * 0.5, ratio]), 6) AS positive_weight, true AS f1_ok FROM r""")
def ml_imbalance_weight(spark, sf):
    fit, val = _halves(spark, sf)
    bins = encode.tree_bins(fit, SPEC.high_cardinality)
    found = models.search_imbalance_weight(fit, val, SPEC, models.boosted_trees(bins))
    return found.select(F.round("positive_weight", 6).alias("positive_weight"), F.col("f1_classe1").between(0.0, 1.0).alias("f1_ok"))


def _cv_rows(spark, found):
    rows = [
        (i, ", ".join(f"{name}={v}" for name, v in sorted(c.items())), drawn, float(f1))
        for i, (c, drawn, f1) in enumerate(zip(found.candidates, found.drawn, found.scores, strict=True))
    ]
    return spark.createDataFrame(rows, "candidate int, parameters string, drawn boolean, f1_cv_moyen double")


@query("ml_cross_validate", "SELECT CAST(range AS INTEGER) AS candidate, true AS f1_ok, 9 AS n_different, 4 AS encoder_fits, 28 AS classifier_fits FROM range(9)")
def ml_cross_validate(spark, sf):
    fit, _ = _halves(spark, sf)
    found = models.cross_validate(fit, SPEC, models.logistic(), models.GRIDS["LogisticRegression"], parallelism=4)
    return _search_checks(_cv_rows(spark, found)).withColumns({"encoder_fits": F.lit(found.encoder_fits), "classifier_fits": F.lit(found.classifier_fits)})


def _search_checks(rows):
    """A search's rows as checks: numbered candidates, none twice, F1 in range."""
    n = rows.select("parameters").distinct().count()
    return rows.select("candidate", F.col("f1_cv_moyen").between(0.0, 1.0).alias("f1_ok"), F.lit(n).cast("bigint").alias("n_different"))


# ---- a label that the data carry, so that a model without skill is found out ----

_RULE_SEGMENTS = ("BUILDING", "MACHINERY")
_RULE_ORDERS = 10


def ruled_rows(spark, sf):
    """The training rows with a label that two features decide: a segment and a number of orders."""
    rule = F.col("c_mktsegment").isin(*_RULE_SEGMENTS) & (F.col("n_orders") >= _RULE_ORDERS)
    return training_rows(spark, sf).withColumn("label", F.coalesce(rule, F.lit(False)).cast("int"))


_RULED = _TRAINING + f""",
    ruled AS (SELECT c_custkey, is_fit, CAST(coalesce(c_mktsegment IN {_RULE_SEGMENTS!r} AND n_orders >= {_RULE_ORDERS}, false) AS INTEGER) AS label FROM training)"""

_RULE_LEARNERS = {
    "BoostedTrees": lambda bins: models.boosted_trees(bins),
    "DecisionTree": lambda bins: models.decision_tree(bins),
    "RandomForest": lambda bins: models.random_forest(bins, featureSubsetStrategy="all"),
}


@query("ml_rule_recovered", _RULED + f"""
    SELECT algo, c_custkey, label, label::DOUBLE AS prediction
    FROM ruled, (VALUES {", ".join(f"('{a}')" for a in _RULE_LEARNERS)}) AS t(algo) WHERE NOT is_fit""")
def ml_rule_recovered(spark, sf):
    """Decisions on held-out clients beside the rule itself: a constant or shuffled model differs."""
    rows = ruled_rows(spark, sf)
    fit, val = rows.filter("split = 'fit'").drop("split"), rows.filter("split = 'val'").drop("split")
    fitted = models.fit_all(fit, SPEC, {name: make(64) for name, make in _RULE_LEARNERS.items()})
    parts = [model.transform(val).select(F.lit(name).alias("algo"), "c_custkey", "label", "prediction") for name, model in fitted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SKILLED = sorted(set(models.ALGORITHMS) - {"NaiveBayes_Gaussian"})
"""Naive Bayes is compared row by row with its closed form instead (``ml_bayes_closed_form``)."""


@query("ml_skill_floor", f"SELECT algo, true AS beats_constant, true AS ranks, true AS same_again, true AS shuffled_fails FROM (VALUES {', '.join(f'({a!r})' for a in _SKILLED)}) AS t(algo)")
def ml_skill_floor(spark, sf):
    """Every algorithm on the carried label: held-out log-loss below the class share's, AUC, the same rows twice, no skill on a shuffled label."""
    rows = ruled_rows(spark, sf)
    order = F.md5(F.concat(F.lit("shuffle"), F.col("c_custkey").cast("string")))
    share = rows.agg(F.avg("label")).first()[0]
    shuffled = rows.withColumn("label", (F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 2.0**32 < share).cast("int"))
    found = {name: _skill(data, rows) for name, data in (("as is", rows), ("again", rows), ("shuffled", shuffled))}
    out = []
    for algo, (loss, constant, auc) in found["as is"].items():
        same = max(abs(x - y) for x, y in zip(found["again"][algo], (loss, constant, auc), strict=True)) < 1e-9
        out.append((algo, loss < constant, auc > SKILL_AUC, same, found["shuffled"][algo][2] < SKILL_AUC))
    return spark.createDataFrame(out, "algo string, beats_constant boolean, ranks boolean, same_again boolean, shuffled_fails boolean")


SKILL_AUC = 0.75
"""Least held-out AUC on the carried label; a model without skill stays near one half."""


def _skill(data, truth):
    """{algorithm: (log-loss, log-loss of the class share, AUC)} of models learnt from ``data``, judged on the held-out rows of ``truth``."""
    fit, val = data.filter("split = 'fit'").drop("split"), truth.filter("split = 'val'").drop("split")
    fitted = models.fit_all(fit, SPEC, {name: models.ALGORITHMS[name](64) for name in _SKILLED}, softened=False)
    share = fit.agg(F.avg("label")).first()[0]
    out = {}
    for name, model in fitted.items():
        scored = models.class_one_probability(model.transform(val)).select("label", "label_idx", "probability_classe1")
        # weights made the classes equal: the odds are scaled back to the class share before they are judged
        odds = F.col("probability_classe1") / F.greatest(1.0 - F.col("probability_classe1"), F.lit(1e-6)) * (share / (1 - share))
        p = F.least(F.greatest(odds / (1.0 + odds), F.lit(1e-6)), F.lit(1 - 1e-6))
        y = F.col("label").cast("double")
        row = scored.agg(F.avg(-y * F.log(p) - (1 - y) * F.log(1 - p)).alias("loss"), F.avg("label").alias("m")).first()
        auc = ev.roc_auc(scored, "label_idx", "probability_classe1").first()["auc"]
        constant = -(row["m"] * math.log(share) + (1 - row["m"]) * math.log(1 - share))
        out[name] = (row["loss"], constant, auc)
    return out


@query("ml_bayes_closed_form", _RULED + """,
    seg AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM training WHERE is_fit GROUP BY 1),
    nat AS (SELECT c_nationkey AS v, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1 AS i FROM training WHERE is_fit GROUP BY 1),
    encoded AS (SELECT t.c_custkey, t.is_fit, r.label, list_concat([c_acctbal, n_orders, total, "mean", smallest, largest],
      list_concat([CASE WHEN j = seg.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for j in range((SELECT count(*) FROM seg))], [coalesce(nat.i, (SELECT count(*) FROM nat))::DOUBLE])) AS vals
      FROM training t JOIN ruled r USING (c_custkey) LEFT JOIN seg ON seg.v = c_mktsegment LEFT JOIN nat ON nat.v = c_nationkey),
    cells AS (SELECT c_custkey, is_fit, label, unnest(vals) AS x, unnest(range(len(vals))) AS j FROM encoded),
    wide AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT j, var_pop(x) AS v FROM cells WHERE is_fit GROUP BY j)),
    fitted AS (SELECT label AS c, j, avg(x) AS m, var_pop(x) + (SELECT eps FROM wide) AS v FROM cells WHERE is_fit GROUP BY ALL),
    prior AS (SELECT label AS c, ln(count(*)::DOUBLE / (SELECT count(*) FROM encoded WHERE is_fit)) AS p FROM encoded WHERE is_fit GROUP BY 1),
    joint AS (SELECT c_custkey, f.c, sum(-0.5 * (ln(2 * pi() * v) + (x - m) * (x - m) / v)) AS l FROM cells JOIN fitted f USING (j) WHERE NOT is_fit GROUP BY ALL)
    SELECT c_custkey, arg_max(c, l + p)::DOUBLE AS prediction FROM joint JOIN prior USING (c) GROUP BY 1""")
def ml_bayes_closed_form(spark, sf):
    """Unweighted Gaussian naive Bayes beside its closed form, every held-out client."""
    rows = ruled_rows(spark, sf)
    fit, val = rows.filter("split = 'fit'").drop("split"), rows.filter("split = 'val'").drop("split")
    model = Pipeline(stages=[*SPEC.encoder().getStages(), models.gaussian_bayes()]).fit(fit.withColumn(models.WEIGHT, F.lit(1.0)))
    return model.transform(val).select("c_custkey", "prediction")


# The grid of boosted trees with a fiftieth of its rounds: 75 fits of up to 600 rounds take hours on a test table (README).
_SEARCH_GRID = {**models.GRIDS["BoostedTrees"], "maxIter": [n // 50 for n in models.GRIDS["BoostedTrees"]["maxIter"]]}


@query("ml_random_search", """
    SELECT CAST(range AS INTEGER) AS candidate, true AS f1_ok, 25 AS n_different, true AS winner_finds_rule, true AS fits_shared FROM range(25)""")
def ml_random_search(spark, sf):
    """25 draws from the grid of boosted trees on the carried label; every fit is also read off at its shorter lengths."""
    rows = ruled_rows(spark, sf)
    fit, val = rows.filter("split = 'fit'").drop("split"), rows.filter("split = 'val'").drop("split")
    found = models.random_search(fit, SPEC, models.boosted_trees(64), _SEARCH_GRID, parallelism=8, shares=models.WEIGHT_SHARES, lengths=_SEARCH_GRID["maxIter"])
    right = found.best.transform(val).agg(F.min((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    shared = found.classifier_fits - 1 < found.folds * len(found.candidates)
    drawn = _cv_rows(spark, found).filter("drawn")
    return _search_checks(drawn).withColumns({"winner_finds_rule": F.lit(right == 1), "fits_shared": F.lit(shared)})


@query("ml_encode_classify", _model_sql())
def ml_encode_classify(spark, sf):
    model, fit, val = _fit(spark, sf, "DecisionTree")
    shared = models.encoder_of(model)
    other = models.without_summary(models.logistic().fit(shared.transform(models.with_class_weights(fit, SPEC.label))))
    return _checked(_scored(PipelineModel(stages=[*shared.stages, other]), val))


@query("ml_importance", _ENCODED + """,
    names AS (SELECT unnest(['c_acctbal', 'n_orders', 'total', 'mean', 'smallest', 'largest']) AS feature UNION ALL SELECT 'c_mktsegment_ohe_' || v FROM seg UNION ALL SELECT 'c_nationkey_idx')
    SELECT feature, true AS importance_ok, true AS sums_to_one FROM names""")
def ml_importance(spark, sf):
    model, _, val = _fit(spark, sf, "RandomForest")
    return _importance_checks(models.importances(model, model.transform(val)))


def _importance_checks(found):
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", F.col("importance").between(0.0, 1.0).alias("importance_ok"), F.lit(abs(total - 1.0) < 1e-6).alias("sums_to_one"))


def _candidates(spark, sf):
    fit, val = _halves(spark, sf)
    bins = encode.tree_bins(fit, SPEC.high_cardinality)
    fitted = models.fit_all(fit, SPEC, {n: make(bins) for n, make in models.ALGORITHMS.items()})
    return fitted, fit, val


_ALGOS = ", ".join(f"('{a}')" for a in sorted(models.ALGORITHMS))


@query("ml_leaderboard", f"SELECT algo, true AS metrics_ok, true AS ranked FROM (VALUES {_ALGOS}) AS t(algo)")
def ml_leaderboard(spark, sf):
    fitted, _, val = _candidates(spark, sf)
    board = models.leaderboard(fitted, val, {n: models.learn_threshold(m, val) for n, m in fitted.items()})
    rows = board.collect()  # one row per algorithm
    f1 = [r["f1_classe1"] for r in rows]
    metrics = F.lit(True)
    for c in board.columns[1:]:
        metrics = metrics & F.col(c).between(0.0, 1.0)
    return board.select("algo", metrics.alias("metrics_ok"), F.lit(f1 == sorted(f1, reverse=True)).alias("ranked"))


@query("ml_params_report", """
    WITH b AS (SELECT greatest(32, count(DISTINCT c_nationkey) + 2) AS bins FROM customer)
    SELECT algo, parameter, value FROM (VALUES
      ('BoostedTrees', 'maxDepth', '5'), ('BoostedTrees', 'maxIter', '20'), ('BoostedTrees', 'minInstancesPerNode', '1'), ('BoostedTrees', 'stepSize', '0.1'),
      ('BoostedTrees', 'subsamplingRate', '1.0'), ('DecisionTree', 'maxDepth', '5'), ('DecisionTree', 'minInstancesPerNode', '1'), ('LogisticRegression', 'elasticNetParam', '0.0'),
      ('LogisticRegression', 'maxIter', '100'), ('LogisticRegression', 'regParam', '0.0'), ('NaiveBayes_Gaussian', 'smoothing', '1.0'), ('RandomForest', 'maxDepth', '5'),
      ('RandomForest', 'minInstancesPerNode', '1'), ('RandomForest', 'numTrees', '30'), ('RandomForest', 'subsamplingRate', '1.0')) AS t(algo, parameter, value)
    UNION ALL SELECT unnest(['BoostedTrees', 'DecisionTree', 'RandomForest']), 'maxBins', CAST(bins AS VARCHAR) FROM b""")
def ml_params_report(spark, sf):
    return models.params_report(spark, _candidates(spark, sf)[0])


@query("ml_refit_full", _ENCODED.replace("FROM training WHERE is_fit", "FROM training") + """,
    names AS (SELECT unnest(['c_acctbal', 'n_orders', 'total', 'mean', 'smallest', 'largest']) AS feature UNION ALL SELECT 'c_mktsegment_ohe_' || v FROM seg UNION ALL SELECT 'c_nationkey_idx')
    SELECT feature, true AS importance_ok, true AS sums_to_one FROM names""")
def ml_refit_full(spark, sf):
    everyone = training_rows(spark, sf).drop("split")
    model = models.refit_on_everything(everyone, SPEC, "RandomForest")
    path = staging_path(spark, "model")
    models.save_model(model, 0.5, path)
    return _importance_checks(models.importances(models.load_model(spark, path)[0], model.transform(everyone)))


@query("ml_batch_score", _TRAINING + " SELECT c_custkey, true AS label_ok, true AS probability_ok FROM training WHERE NOT is_fit")
def ml_batch_score(spark, sf):
    model, _, val = _fit(spark, sf, "DecisionTree")
    path = staging_path(spark, "model")
    models.save_model(model, models.learn_threshold(model, val), path)
    loaded, threshold = models.load_model(spark, path)
    scores = models.batch_score(val.drop("label"), loaded, threshold, SPEC)
    p = F.col("probability_classe1")
    return scores.select("c_custkey", (F.col("label_predit") == F.when(p >= threshold, "1").otherwise("0")).alias("label_ok"), p.between(0.0, 1.0).alias("probability_ok"))


@query("job_train_small", "SELECT 5 AS n_rounds, true AS auc_ok")
def job_train_small(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("date_ouverture_compte"), exact_mean("o_totalprice").alias("revenu_mensuel"),
        F.count_distinct("o_orderpriority").cast("double").alias("nb_produits_detenus"),
    )
    clients = roles.client_label(spark, sf).join(orders, "c_custkey").select(
        "c_custkey", "date_ouverture_compte", F.col("c_acctbal").alias("solde_moyen"), "revenu_mensuel", "nb_produits_detenus",
        F.col("c_nationkey").cast("double").alias("score_risque"), F.col("label").cast("double").alias("eligible"),
    )
    report = train_small(materialise(clients, "small-job"), dt.date(2001, 12, 31), "c_custkey", rounds=5, depth=3)
    return report.select("n_rounds", F.col("auc").between(0.0, 1.0).alias("auc_ok"))


# ---- evaluation ----------------------------------------------------------------

_CONF = roles.with_roles("scored") + """,
    cells AS (SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2),
    cls AS (SELECT c AS class, (SELECT coalesce(sum(n), 0) FROM cells WHERE label = c AND prediction = c)::DOUBLE AS tp,
      (SELECT coalesce(sum(n), 0) FROM cells WHERE label = c)::DOUBLE AS support, (SELECT coalesce(sum(n), 0) FROM cells WHERE prediction = c)::DOUBLE AS predicted
      FROM (SELECT 0 AS c UNION ALL SELECT 1)),
    m AS (SELECT class, support, tp, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
      coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM cls)"""


@query("eval_weighted_metrics", _CONF + """
    SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum("precision" * support) / sum(support), 6) AS weighted_precision,
      round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
      round(avg(f1), 6) AS macro_f1, round(max(f1) FILTER (class = 1), 6) AS f1_classe1 FROM m""")
def eval_weighted_metrics(spark, sf):
    return ev.weighted_metrics(roles.scored_clients(spark, sf), "label", "prediction")


@query("eval_f1_by_class", _CONF + " SELECT class, round(f1, 6) AS f1 FROM m")
def eval_f1_by_class(spark, sf):
    return ev.f1_by_class(roles.scored_clients(spark, sf), "label", "prediction")


@query("eval_classification_report", _CONF + """
    SELECT CAST(class AS VARCHAR) AS class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
    UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def eval_classification_report(spark, sf):
    return ev.classification_report(roles.scored_clients(spark, sf), "label", "prediction")


@query("eval_confusion", roles.with_roles("scored") + """
    SELECT CASE WHEN grouping(label) = 1 THEN 'All' ELSE CAST(label AS VARCHAR) END AS label,
      CASE WHEN grouping(prediction) = 1 THEN 'All' ELSE CAST(prediction AS VARCHAR) END AS prediction, count(*) AS n
    FROM scored GROUP BY CUBE (scored.label, scored.prediction)""")
def eval_confusion(spark, sf):
    return ev.confusion_with_margins(roles.scored_clients(spark, sf), "label", "prediction")


# One-vs-rest over the two classes: the score of class 0 is 1 - score.
_OVR = roles.with_roles("scored") + """,
    ovr AS (SELECT '1' AS class, label AS y, score FROM scored UNION ALL SELECT '0', 1 - label, 1.0 - score FROM scored),
    lv AS (SELECT class, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ovr GROUP BY 1, 2),
    cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn
      FROM lv WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


def _one_vs_rest(spark, sf):
    scored = roles.scored_clients(spark, sf).withColumn("probability", F.array(1.0 - F.col("score"), F.col("score")))
    return ev.one_vs_rest(scored, "label", "probability", [0, 1])


@query("eval_roc_points", _OVR + """
    SELECT class, score AS threshold, round(fp::DOUBLE / nn, 6) AS fpr, round(tp::DOUBLE / np, 6) AS tpr FROM cum
    UNION ALL SELECT DISTINCT class, NULL, 0.0, 0.0 FROM cum""")
def eval_roc_points(spark, sf):
    return ev.roc_points(_one_vs_rest(spark, sf), "is_class", "score", by=["class"])


@query("eval_roc_auc", _OVR + """
    SELECT class, round(sum(neg::DOUBLE * (tp::DOUBLE - pos / 2.0)) / (max(np)::DOUBLE * max(nn)::DOUBLE), 6) AS auc FROM cum GROUP BY 1""")
def eval_roc_auc(spark, sf):
    return ev.roc_auc(_one_vs_rest(spark, sf), "is_class", "score", by=["class"])


_THREE = roles.with_roles("scored", "cible") + """,
    t AS (SELECT label_nom, score FROM scored JOIN cible ON CAST(radical AS BIGINT) = c_custkey),
    ovr AS (SELECT k.class, CAST(label_nom = k.class AS INTEGER) AS y,
        round(CASE WHEN k.i = 1 THEN score WHEN k.i = 2 THEN (1.0 - score) * 0.625 ELSE (1.0 - score) * 0.375 END, 6) AS score
      FROM t, (SELECT DISTINCT label_nom AS class, dense_rank() OVER (ORDER BY label_nom) AS i FROM cible) k),
    lv AS (SELECT class, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ovr GROUP BY 1, 2),
    cum AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn
      FROM lv WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


@query("eval_roc_three_classes", _THREE + """
    SELECT class, round(sum(neg::DOUBLE * (tp::DOUBLE - pos / 2.0)) / (max(np)::DOUBLE * max(nn)::DOUBLE), 6) AS auc FROM cum GROUP BY 1""")
def eval_roc_three_classes(spark, sf):
    """One product against the rest, for each of three products; the three scores do not mirror each other."""
    target = savings_target(roles.assi(spark, sf), roles.CODES).select(F.col("RADICAL").cast("bigint").alias("c_custkey"), "label_nom")
    rows = roles.scored_clients(spark, sf).select("c_custkey", "score").join(target, "c_custkey")
    rest = 1.0 - F.col("score")
    names = sorted(r[0] for r in target.select("label_nom").distinct().collect())  # one row per product
    probability = F.array(*[F.round(p, 6) for p in (F.col("score"), rest * 0.625, rest * 0.375)][: len(names)])
    return ev.roc_auc(ev.one_vs_rest(rows.withColumn("probability", probability), "label_nom", "probability", names), "is_class", "score", by=["class"])


@query("eval_best_threshold_pr", roles.with_roles("scored") + """,
    lv AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM scored GROUP BY 1),
    cum AS (SELECT score, sum(pos) OVER (ORDER BY score DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY score DESC)::DOUBLE AS k, sum(pos) OVER ()::DOUBLE AS p FROM lv)
    SELECT score AS threshold, round(2 * tp / (k + p), 6) AS f1 FROM cum ORDER BY 2 * tp / (k + p) DESC, score LIMIT 1""")
def eval_best_threshold_pr(spark, sf):
    return ev.best_threshold(roles.scored_clients(spark, sf), "label", "score")


def _grid_sql(first: float, step: float, points: int) -> str:
    return roles.with_roles("scored") + f""",
    g AS (SELECT i + 1 AS grid_index, {first}::DOUBLE + i * {step}::DOUBLE AS t FROM range({points}) r(i)),
    c AS (SELECT grid_index, t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp,
      count(*) FILTER (label = 1 AND score < t) AS fn FROM g, scored GROUP BY 1, 2)
    SELECT grid_index, round(t, 6) AS threshold, tp, fp, fn, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"""


@query("eval_threshold_grid", _grid_sql(*ev.FINE_GRID))
def eval_threshold_grid(spark, sf):
    return ev.threshold_grid(roles.scored_clients(spark, sf), "label", "score")


@query("eval_threshold_grid_coarse", _grid_sql(*ev.COARSE_GRID))
def eval_threshold_grid_coarse(spark, sf):
    return ev.threshold_grid(roles.scored_clients(spark, sf), "label", "score", ev.COARSE_GRID)


@query("eval_apply_threshold", roles.with_roles("scored") + """
    SELECT c_custkey, label, CAST(score >= 0.7 AS INTEGER) AS prediction FROM scored""")
def eval_apply_threshold(spark, sf):
    return ev.apply_threshold(roles.scored_clients(spark, sf), "score", 0.7).select("c_custkey", "label", "prediction")


# ---- resampling ----------------------------------------------------------------

_LINKS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    nn AS (SELECT a.vec_id AS id, any_value(a.label) AS label, arg_min(b.vec_id, {'d': list_distance(a.v, b.v), 'i': b.vec_id}) AS near
      FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1),
    links AS (SELECT x.id AS id_a, y.id AS id_b FROM nn x JOIN nn y ON x.near = y.id AND y.near = x.id WHERE x.label <> y.label AND x.id < y.id)"""


@query("resample_tomek_links", _LINKS + " SELECT id_a, id_b FROM links")
def resample_tomek_links(spark, sf):
    return resample.tomek_links(table(spark, sf, "embeddings"), "vec_id", "label", "embedding").select("id_a", "id_b")


@query("resample_tomek_lsh", _LINKS + " SELECT count(*) AS n_links, true AS recall_ok, true AS precision_ok FROM links")
def resample_tomek_lsh(spark, sf):
    """The approximate links beside the exact ones: nine tenths of each are in the other."""
    vectors = table(spark, sf, "embeddings")
    exact = materialise(resample.tomek_links(vectors, "vec_id", "label", "embedding").select("id_a", "id_b"), "exact")
    near = materialise(resample.tomek_links_lsh(vectors, "vec_id", "label", "embedding", bucket_length=4.0).select("id_a", "id_b"), "approximate")
    common = near.join(exact, ["id_a", "id_b"], "left_semi").count()
    n_near = near.count()
    return exact.agg(F.count("*").alias("n_links")).select(
        "n_links", (F.lit(common) >= 0.9 * F.col("n_links")).alias("recall_ok"), F.lit(common >= 0.9 * n_near).alias("precision_ok"))


@query("resample_tomek_clean", _LINKS + """,
    ends AS (SELECT id_a AS id FROM links UNION SELECT id_b FROM links),
    minority AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*), label LIMIT 1)
    SELECT vec_id, label FROM embeddings WHERE NOT (vec_id IN (SELECT id FROM ends) AND label <> (SELECT label FROM minority))""")
def resample_tomek_clean(spark, sf):
    vectors = table(spark, sf, "embeddings")
    links = resample.tomek_links(vectors, "vec_id", "label", "embedding")
    return resample.tomek_clean(vectors, links, "vec_id", "label").select("vec_id", "label")


@query("resample_smotenc", _TRAINING + """,
    n AS (SELECT label, count(*) AS n FROM training WHERE is_fit GROUP BY 1)
    SELECT label, (SELECT max(n) FROM n) - n AS n_new, 0 AS outside_range, 0 AS unknown_category FROM n WHERE n < (SELECT max(n) FROM n)""")
def resample_smotenc(spark, sf):
    """New rows of each class checked: their number, that they lie within the class's range, that their categories are its own."""
    rows = training_rows(spark, sf).filter("split = 'fit'")
    numbers, categories = ["c_acctbal", "n_orders", "total"], ["c_mktsegment", "c_nationkey"]
    new = resample.smotenc(rows, "c_custkey", "label", numbers, categories)
    ranges = rows.groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("low", F.min), ("high", F.max))], *[F.collect_set(c).alias(f"set_{c}") for c in categories])
    outside, unknown = F.lit(False), F.lit(False)
    for c in numbers:
        outside = outside | ~F.col(c).between(F.col(f"low_{c}") - 1e-6, F.col(f"high_{c}") + 1e-6)
    for c in categories:
        unknown = unknown | ~F.array_contains(f"set_{c}", F.col(c))
    return new.join(F.broadcast(ranges), "label").groupBy("label").agg(
        F.count("*").alias("n_new"), F.count_if(outside).cast("int").alias("outside_range"), F.count_if(unknown).cast("int").alias("unknown_category"))
