"""Learned statistics, associations, profiles and data-quality gates."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import Imputer
from pyspark.sql import functions as F

from propensia.catalog import roles
from propensia.catalog.registry import query, table
from propensia.functions import fr_decimal
from propensia.operators import association as assoc
from propensia.operators import learned, quality, rules
from propensia.operators.aggregates import balance_summary, channel_summary, operations_summary
from propensia.operators.gates import key_report, observe_keys
from propensia.operators.sets import union_by_name
from propensia.plans.cleaning import clean_score, clean_train
from propensia.plans.curated import curate, join_curated
from propensia.plans.dataset import KEY, REFERENCE_DATE, build_dataset, client_base, feature_tables
from propensia.session import materialise, staging_path
from propensia.sources.store import bucket_number

TOTALS = ["montant_total_gab", "montant_total_retraits", "c_acctbal", "n_orders"]


def client_usage(spark, sf):
    """Customers with channel totals (0 when absent), recency and label."""
    e = table(spark, sf, "events")
    gab = operations_summary(e.filter("event_type = 'view'"), "user_id", "value", "ts", REFERENCE_DATE)
    retrait = channel_summary(e.filter("event_type = 'error'"), "user_id", "value", "nb_retraits", "montant_total_retraits")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    usage = gab.join(retrait, "user_id", "full_outer").withColumnRenamed("user_id", "c_custkey")
    joined = roles.client_label(spark, sf).join(usage, "c_custkey", "left").join(orders, "c_custkey", "left")
    zeros = ["nb_operations_gab", "montant_total_gab", "nb_retraits", "montant_total_retraits", "n_orders"]
    return rules.fill_zero(joined, zeros)


_USAGE = roles.with_roles("client_label", "gab", "retrait") + """,
    o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1),
    usage AS (SELECT c.*, coalesce(nb_operations_gab, 0) AS nb_operations_gab, coalesce(montant_total_gab, 0.0) AS montant_total_gab,
        recence_gab_jours, derniere_operation_gab, coalesce(nb_retraits, 0) AS nb_retraits,
        coalesce(montant_total_retraits, 0.0) AS montant_total_retraits, coalesce(n_orders, 0) AS n_orders
      FROM client_label c LEFT JOIN gab g ON g.radical = CAST(c_custkey AS VARCHAR)
        LEFT JOIN retrait r ON r.radical = CAST(c_custkey AS VARCHAR) LEFT JOIN o ON o_custkey = c_custkey)"""

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS colonne, {c}::DOUBLE AS v FROM usage" for c in TOTALS)
_BOUNDS = _USAGE + f""",
    long AS ({_LONG}),
    z AS (SELECT colonne, count(*) FILTER (v = 0)::DOUBLE / count(*) AS zero_share FROM long GROUP BY 1),
    q AS (SELECT colonne, any_value(zero_share) AS zs, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, count(*) AS n
      FROM long JOIN z USING (colonne) WHERE zero_share < 0.5 OR v > 0 GROUP BY 1),
    bounds AS (SELECT colonne, CASE WHEN zs >= 0.5 THEN least(q1 - (q3 - q1) * 1.5, 0.0) ELSE q1 - (q3 - q1) * 1.5 END AS borne_min,
      q3 + (q3 - q1) * 1.5 AS borne_max FROM q WHERE n >= 10 AND q3 <> q1)"""


# ---- learned statistics --------------------------------------------------------

@query("fit_median_impute", _USAGE + """
    SELECT c_custkey, coalesce(recence_gab_jours, (SELECT CAST(quantile_disc(recence_gab_jours, 0.5) AS BIGINT) FROM usage)) AS recence_gab_jours_imp FROM usage""")
def fit_median_impute(spark, sf):
    df = materialise(client_usage(spark, sf).select("c_custkey", "recence_gab_jours"), "usage")
    return learned.apply_medians(df, learned.fit_medians(df, ["recence_gab_jours"]))


@query("ml_imputer", _USAGE + """
    SELECT c_custkey, recence_gab_jours, coalesce(recence_gab_jours, (SELECT quantile_disc(recence_gab_jours, 0.5) FROM usage)) AS recence_gab_jours_imp FROM usage""")
def ml_imputer(spark, sf):
    df = client_usage(spark, sf).select("c_custkey", "recence_gab_jours")
    return Imputer(inputCols=["recence_gab_jours"], outputCols=["recence_gab_jours_imp"], strategy="median").fit(df).transform(df)


def _volatility(spark, sf):
    amounts = union_by_name(roles.solde_files(spark, sf)).select("RADICAL", fr_decimal("SOLDEVERIF").alias("amount"))
    return rules.relative_volatility(balance_summary(amounts, "RADICAL", "amount"), "solde_max", "solde_min", "solde_moyen", "volatilite", "indefinie")


@query("impute_volatility", roles.with_roles("solde") + """,
    v AS (SELECT radical, CASE WHEN solde_moyen > 0 THEN (solde_max - solde_min) / solde_moyen END AS x, CASE WHEN solde_moyen <= 0 THEN 1 ELSE 0 END AS indefinie FROM solde)
    SELECT radical AS "RADICAL", indefinie, round(coalesce(x, (SELECT quantile_disc(x, 0.5) FROM v)), 6) AS volatilite_imp FROM v""")
def impute_volatility(spark, sf):
    df = materialise(_volatility(spark, sf).select("RADICAL", "volatilite", "indefinie"), "volatility")
    imputed = learned.apply_medians(df, learned.fit_medians(df, ["volatilite"]))
    return imputed.withColumn("volatilite_imp", F.round("volatilite_imp", 6))


@query("detect_zero_inflated", _BOUNDS + """
    SELECT colonne AS "column", zero_share FROM z WHERE zero_share >= 0.5""")
def detect_zero_inflated(spark, sf):
    return learned.detect_zero_inflated(client_usage(spark, sf), TOTALS)


@query("fit_iqr_bounds", _BOUNDS + """
    SELECT colonne, round(borne_min, 4) AS borne_min, round(borne_max, 4) AS borne_max FROM bounds""")
def fit_iqr_bounds(spark, sf):
    bounds = learned.fit_iqr_bounds(materialise(client_usage(spark, sf).select(*TOTALS), "usage"), TOTALS)
    return bounds.select("colonne", F.round("borne_min", 4).alias("borne_min"), F.round("borne_max", 4).alias("borne_max"))


def _winsor_sql(c: str) -> str:
    low, high = (f"(SELECT borne_{side} FROM bounds WHERE colonne = '{c}')" for side in ("min", "max"))
    return (f"round(CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END, 4) AS {c}, "
            f"CASE WHEN {c} < {low} OR {c} > {high} THEN 1 ELSE 0 END AS {c}_etait_extreme")


@query("apply_winsorize", _BOUNDS + f"""
    SELECT c_custkey, {_winsor_sql('montant_total_gab')}, {_winsor_sql('c_acctbal')} FROM usage""")
def apply_winsorize(spark, sf):
    df = materialise(client_usage(spark, sf).select("c_custkey", "montant_total_gab", "c_acctbal"), "usage")
    cut = learned.apply_bounds(df, learned.fit_iqr_bounds(df, ["montant_total_gab", "c_acctbal"]))
    return cut.withColumns({c: F.round(c, 4) for c in ("montant_total_gab", "c_acctbal")})


FLAGS = ["gab_etait_extreme", "orders_etait_extreme", "solde_etait_extreme", "jamais_retire", "jamais_vu_etait_extreme"]


def _flags(spark, sf):
    df = client_usage(spark, sf)
    return df.select(
        "c_custkey", "label",
        (F.col("montant_total_gab") > 700).cast("int").alias("gab_etait_extreme"),
        (F.col("n_orders") > 16).cast("int").alias("orders_etait_extreme"),
        (F.col("c_acctbal") < 0).cast("int").alias("solde_etait_extreme"),
        (F.col("nb_retraits") == 0).cast("int").alias("jamais_retire"),
        (F.col("n_orders") < 0).cast("int").alias("jamais_vu_etait_extreme"),
    )


_FLAG_SQL = _USAGE + """,
    f AS (SELECT label, CAST(montant_total_gab > 700 AS INTEGER) AS gab_etait_extreme, CAST(n_orders > 16 AS INTEGER) AS orders_etait_extreme,
      CAST(c_acctbal < 0 AS INTEGER) AS solde_etait_extreme, CAST(nb_retraits = 0 AS INTEGER) AS jamais_retire,
      CAST(n_orders < 0 AS INTEGER) AS jamais_vu_etait_extreme FROM usage),
    fl AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS flag, {c} AS v, label FROM f" for c in FLAGS) + """),
    lift AS (SELECT flag, count(*) FILTER (v = 1) AS n_active, count(*) FILTER (v = 1)::DOUBLE / count(*) AS rate,
      (count(*) FILTER (v = 1 AND label = 1)::DOUBLE / nullif(count(*) FILTER (v = 1), 0)) AS rate_if_active,
      (count(*) FILTER (v = 1 AND label = 1)::DOUBLE / nullif(count(*) FILTER (v = 1), 0)) / (count(*) FILTER (label = 1)::DOUBLE / count(*)) AS lift
      FROM fl GROUP BY 1)"""


@query("prune_flags_rate", _FLAG_SQL + " SELECT flag AS colonne FROM lift WHERE rate < 0.03")
def prune_flags_rate(spark, sf):
    return learned.fit_flags_to_drop(_flags(spark, sf), FLAGS)


@query("prune_flags_lift", _FLAG_SQL + """
    SELECT flag AS colonne FROM lift WHERE rate < 0.03 AND NOT coalesce(lift >= 1.5 OR lift <= 1.0 / 1.5, FALSE)""")
def prune_flags_lift(spark, sf):
    return learned.fit_flags_to_drop(_flags(spark, sf), FLAGS, label="label")


@query("detect_constant_columns", roles.with_roles("perimetre") + """
    SELECT * FROM (
      SELECT 'TAILLE_ENTREPRI' AS colonne, 1 AS k UNION ALL SELECT 'GENDER', (SELECT count(*) FROM (SELECT DISTINCT gender FROM perimetre))
      UNION ALL SELECT 'BPR', (SELECT count(*) FROM (SELECT DISTINCT bpr FROM perimetre))
      UNION ALL SELECT 'CUSTOMER_RATING', (SELECT count(*) FROM (SELECT DISTINCT rating FROM perimetre))) WHERE k <= 1
    """.replace("SELECT * FROM (", "SELECT colonne FROM (", 1))
def detect_constant_columns(spark, sf):
    return learned.detect_constant_columns(roles.perimetre(spark, sf), ["TAILLE_ENTREPRI", "GENDER", "BPR", "CUSTOMER_RATING"])


_WEIGHTS = roles.with_roles("client_label") + """
    SELECT label, round({f}((SELECT count(*) FROM client_label)::DOUBLE / (SELECT count(DISTINCT label) FROM client_label) / count(*)), 6) AS poids_classe
    FROM client_label GROUP BY 1"""


@query("class_weights_inverse", _WEIGHTS.format(f=""))
def class_weights_inverse(spark, sf):
    weights = learned.class_weights(roles.client_label(spark, sf), "label", softened=False)
    return weights.withColumn("poids_classe", F.round("poids_classe", 6))


@query("class_weights_sqrt", _WEIGHTS.format(f="sqrt"))
def class_weights_sqrt(spark, sf):
    return learned.class_weights(roles.client_label(spark, sf), "label").withColumn("poids_classe", F.round("poids_classe", 6))


# ---- the cleaning plan: learned on four fifths of the clients, replayed on the rest

_COUNT_COLUMNS = ["nb_operations_gab", "nb_retraits", "nb_paiements_digitaux", "nb_vignettes_payees", "nb_mois_avec_flux"]
_CLEAN_AMOUNTS = ["solde_moyen", "solde_min", "solde_max", "depot_moyen", "flux_cred_moyen", "flux_cred_total", "montant_total_gab",
                  "montant_moyen_gab", "montant_total_retraits", "montant_total_payfac", "montant_total_vignette"]
_OUT_AMOUNTS = [c for c in _CLEAN_AMOUNTS if c not in ("solde_max", "flux_cred_moyen")]
_TRAIN = "substr(md5(radical), 1, 4) < 'cccc'"
_CAPPED = {"NOMBRE_ENFANT": "enfants > 12", "nb_mois_observes_solde": "nb_mois_observes_solde > 36"}
_FLAGS = [f"{c}_etait_extreme" for c in (*_CAPPED, *_CLEAN_AMOUNTS)]


def _clean_sql(final: str) -> str:
    """The cleaning steps in SQL: learned on the training rows, applied to ``final``."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS colonne, {c}::DOUBLE AS v FROM possible WHERE is_train" for c in _CLEAN_AMOUNTS)

    def low(c):
        return f"(SELECT borne_min FROM bounds WHERE colonne = '{c}')"

    def high(c):
        return f"(SELECT borne_max FROM bounds WHERE colonne = '{c}')"

    cut = ", ".join(
        f"CASE WHEN {c} < {low(c)} THEN {low(c)} WHEN {c} > {high(c)} THEN {high(c)} ELSE {c} END AS {c}" for c in _CLEAN_AMOUNTS)
    caps = ", ".join(f'CAST(coalesce({rule}, false) AS INTEGER) AS "{c}_etait_extreme"' for c, rule in _CAPPED.items())
    flags = ", ".join(
        f"""CASE WHEN (SELECT count(*) FROM bounds WHERE colonne = '{c}') = 0 THEN NULL WHEN {c} < {low(c)} OR {c} > {high(c)} THEN 1 ELSE 0 END AS "{c}_etait_extreme" """
        for c in _CLEAN_AMOUNTS)
    long_flags = " UNION ALL ".join(f"""SELECT '{f}' AS flag, "{f}" AS f, label_eligibilite AS y FROM flagged WHERE is_train""" for f in _FLAGS)
    kept = ", ".join(f"""CASE WHEN NOT (SELECT dropped FROM verdicts WHERE flag = '{f}') THEN "{f}" END AS "{f}" """ for f in _FLAGS)
    return roles.with_roles("dataset") + f""",
    filled AS (SELECT radical, gender, code_ville, bpr, coalesce(enfants, 0) AS enfants, coalesce(marital, 'NON_RENSEIGNE') AS marital,
        coalesce(rating, 'NON_RENSEIGNE') AS rating, coalesce(pack_actuel, 'SANS_PACK') AS pack_actuel, coalesce(pack_etat, 'SANS_ETAT') AS pack_etat,
        coalesce(depot_moyen, 0.0) AS depot_moyen, coalesce(montant_moyen_gab, 0.0) AS montant_moyen_gab, age_client,
        CAST(digital_date_activation IS NULL AS INTEGER) AS jamais_active_digital, CAST(derniere_operation_gab IS NULL AS INTEGER) AS jamais_utilise_gab,
        anciennete_digitale_jours, recence_gab_jours, solde_moyen, solde_min, solde_max, nb_mois_observes_solde, flux_cred_moyen, flux_cred_total,
        nb_mois_avec_flux, nb_operations_gab, montant_total_gab, nb_retraits, montant_total_retraits, nb_paiements_digitaux, montant_total_payfac,
        nb_vignettes_payees, montant_total_vignette, label_eligibilite, label_code, label_nom, {_TRAIN} AS is_train
      FROM dataset WHERE bpr IS NOT NULL AND gender IS NOT NULL),
    med AS (SELECT quantile_disc(anciennete_digitale_jours, 0.5) AS m1, quantile_disc(recence_gab_jours, 0.5) AS m2 FROM filled WHERE is_train),
    possible AS (SELECT * REPLACE (greatest(least(enfants, 12), 0) AS enfants, least(nb_mois_observes_solde, 36) AS nb_mois_observes_solde),
        coalesce(anciennete_digitale_jours, (SELECT m1 FROM med)) AS anciennete_digitale_jours_imp,
        coalesce(recence_gab_jours, (SELECT m2 FROM med)) AS recence_gab_jours_imp, {caps}
      FROM filled WHERE NOT is_train OR age_client BETWEEN 16 AND 100),
    long AS ({long}),
    z AS (SELECT colonne, count(*) FILTER (v = 0)::DOUBLE / count(*) AS zs FROM long GROUP BY 1),
    q AS (SELECT colonne, any_value(zs) AS zs, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3, count(*) AS n
      FROM long JOIN z USING (colonne) WHERE zs < 0.5 OR v > 0 GROUP BY 1),
    bounds AS (SELECT colonne, CASE WHEN zs >= 0.5 THEN least(q1 - (q3 - q1) * 1.5, 0.0) ELSE q1 - (q3 - q1) * 1.5 END AS borne_min,
      q3 + (q3 - q1) * 1.5 AS borne_max FROM q WHERE n >= 10 AND q3 <> q1),
    flagged AS (SELECT *, {flags} FROM possible),
    turned_on AS (SELECT flag, count(*)::DOUBLE AS n, count(*) FILTER (f = 1)::DOUBLE AS n_on, count(*) FILTER (f = 1 AND y = 1)::DOUBLE AS n_both, count(*) FILTER (y = 1)::DOUBLE AS n_pos
      FROM ({long_flags}) GROUP BY 1),
    verdicts AS (SELECT flag, n_on / n < 0.03 AND NOT coalesce(lift >= 1.5 OR lift <= 1 / 1.5, false) AS dropped
      FROM (SELECT *, (n_both / nullif(n_on, 0)) / nullif(n_pos / n, 0) AS lift FROM turned_on)),
    cut AS (SELECT * REPLACE ({cut}) FROM flagged),
    vol AS (SELECT *, CASE WHEN solde_moyen > 0 THEN (solde_max - solde_min) / solde_moyen END AS vr, CASE WHEN solde_moyen <= 0 THEN 1 ELSE 0 END AS vi FROM cut),
    vmed AS (SELECT quantile_disc(vr, 0.5) AS m FROM vol WHERE is_train)
    SELECT radical AS "RADICAL", gender AS "GENDER", code_ville AS "CODE_VILLE", bpr AS "BPR", enfants AS "NOMBRE_ENFANT", marital AS "MARITAL_STATUS",
      rating AS "CUSTOMER_RATING", pack_actuel, pack_etat, age_client, jamais_active_digital, jamais_utilise_gab, anciennete_digitale_jours_imp,
      recence_gab_jours_imp, nb_mois_observes_solde, {', '.join(_COUNT_COLUMNS)}, {', '.join(_OUT_AMOUNTS)},
      vi AS solde_volatilite_indefinie, coalesce(vr, (SELECT m FROM vmed)) AS solde_volatilite_relative_imp, label_eligibilite,
      label_code, label_nom, CAST(NULL AS VARCHAR) AS "TAILLE_ENTREPRI", {kept}
    FROM vol WHERE {final}"""


_CLEAN_COLUMNS = [
    "RADICAL", "GENDER", "CODE_VILLE", "BPR", "NOMBRE_ENFANT", "MARITAL_STATUS", "CUSTOMER_RATING", "pack_actuel", "pack_etat", "age_client",
    "jamais_active_digital", "jamais_utilise_gab", "anciennete_digitale_jours_imp", "recence_gab_jours_imp", "nb_mois_observes_solde",
    *_COUNT_COLUMNS, *_OUT_AMOUNTS, "solde_volatilite_indefinie", "solde_volatilite_relative_imp", "label_eligibilite", "label_code", "label_nom",
]


def _clean_columns(df):
    """Every column; one that was learned to be left out (a rare flag, a constant) is NULL."""
    def learned_column(name, kind):
        return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)

    return df.select(*_CLEAN_COLUMNS, learned_column("TAILLE_ENTREPRI", "string"), *[learned_column(f, "int") for f in _FLAGS])


def _train_and_rest(spark, sf):
    dataset = materialise(build_dataset(roles.raw_tables(spark, sf), codes=roles.CODES), "dataset")
    in_train = F.substring(F.md5("RADICAL"), 1, 4) < "cccc"
    return dataset.filter(in_train), dataset.filter(~in_train)


@query("clean_train_set", _clean_sql("is_train"))
def clean_train_set(spark, sf):
    train, _ = _train_and_rest(spark, sf)
    return _clean_columns(clean_train(train)[0])


@query("clean_score_set", _clean_sql("NOT is_train"))
def clean_score_set(spark, sf):
    train, rest = _train_and_rest(spark, sf)
    return _clean_columns(clean_score(rest, clean_train(train)[1]))


# ---- association ---------------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _pairs_sql(columns, source):
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, round(corr({a}, {b}), 6) AS correlation FROM {source}" for a, b in pairs)


_USAGE_NUMBERS = ["c_acctbal", "nb_operations_gab", "montant_total_gab", "nb_retraits", "montant_total_retraits", "n_orders"]


@query("corr_pairs_spark", _USAGE + f""", p AS ({_pairs_sql(_USAGE_NUMBERS, 'usage')})
    SELECT * FROM p WHERE abs(correlation) >= 0.85""")
def corr_pairs_spark(spark, sf):
    return assoc.strong_pairs(assoc.correlation_matrix_pairs(client_usage(spark, sf), _USAGE_NUMBERS), 0.85)


@query("corr_pairs_ranked", _USAGE + f""", p AS ({_pairs_sql(_USAGE_NUMBERS + ['recence_gab_jours'], 'usage')})
    SELECT *, abs(correlation) AS abs_corr FROM p WHERE correlation IS NOT NULL ORDER BY abs_corr DESC, variable_1, variable_2 LIMIT 20""")
def corr_pairs_ranked(spark, sf):
    return assoc.ranked_pairs(assoc.correlation_pairs(client_usage(spark, sf), _USAGE_NUMBERS + ["recence_gab_jours"]), 20)


_BISERIAL_SQL = _USAGE + ", pb AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, label) AS r, count({c}) AS n FROM usage" for c in _USAGE_NUMBERS + ["recence_gab_jours"]
) + ") WHERE r IS NOT NULL AND NOT isnan(r) AND n >= 30)"


@query("assoc_point_biserial", _BISERIAL_SQL + """
    SELECT feature, round(r, 6) AS r, round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) AS t, n FROM pb""")
def assoc_point_biserial(spark, sf):
    return assoc.point_biserial(client_usage(spark, sf), _USAGE_NUMBERS + ["recence_gab_jours"], "label")


_CATEGORIES = ["c_mktsegment", "c_nationkey", "rating"]
_CRAMER = _USAGE + """,
    cats AS (SELECT *, CASE WHEN c_acctbal < 4500 THEN 'low' ELSE 'high' END AS rating FROM usage),
    cl AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, label FROM cats" for c in _CATEGORIES) + """),
    cells AS (SELECT feature, v, label, count(*) AS o FROM cl GROUP BY 1, 2, 3),
    ra AS (SELECT feature, v, sum(o) AS rn FROM cells GROUP BY 1, 2), ca AS (SELECT feature, label, sum(o) AS cn FROM cells GROUP BY 1, 2),
    tot AS (SELECT feature, sum(rn)::DOUBLE AS n, count(*) AS r FROM ra GROUP BY 1), ks AS (SELECT feature, count(*) AS k FROM ca GROUP BY 1),
    grid AS (SELECT ra.feature, n, r, k, coalesce(o, 0)::DOUBLE AS o, rn * cn / n AS e FROM ra JOIN ca USING (feature) JOIN tot USING (feature) JOIN ks USING (feature)
      LEFT JOIN cells ON cells.feature = ra.feature AND cells.v = ra.v AND cells.label = ca.label),
    chi AS (SELECT feature, n, r, k, sum(CASE WHEN r = 2 AND k = 2 THEN (abs(o - e) - least(0.5, abs(o - e))) ^ 2 / e ELSE (o - e) ^ 2 / e END) AS chi2 FROM grid GROUP BY 1, 2, 3, 4),
    cv AS (SELECT feature, r AS n_modalites, CAST(n AS BIGINT) AS n,
      sqrt(greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) ^ 2 / (n - 1) - 1, r - (r - 1) ^ 2 / (n - 1) - 1)) AS cramers_v FROM chi WHERE r >= 2)"""


def _categorical(spark, sf):
    return client_usage(spark, sf).withColumn("rating", F.when(F.col("c_acctbal") < 4500, "low").otherwise("high"))


@query("assoc_cramers_v", _CRAMER + " SELECT feature, round(cramers_v, 6) AS cramers_v, n_modalites, n FROM cv")
def assoc_cramers_v(spark, sf):
    return assoc.cramers_v(_categorical(spark, sf), _CATEGORIES, "label")


@query("assoc_flag_lift", _FLAG_SQL + """
    SELECT flag AS feature, round(rate, 6) AS taux_activation, round(rate_if_active, 6) AS taux_eligible_si_actif, round(lift, 6) AS lift,
      round(CASE WHEN lift > 0 THEN abs(ln(lift)) ELSE 0.0 END, 6) AS abs_log_lift FROM lift WHERE n_active > 0""")
def assoc_flag_lift(spark, sf):
    return assoc.flag_association(_flags(spark, sf), FLAGS, "label")


@query("assoc_ranking", _CRAMER + _BISERIAL_SQL[len(_USAGE):] + _FLAG_SQL[len(_USAGE):] + """,
    fam AS (SELECT feature, abs(round(r, 6)) AS force_association, 'numerique' AS "type" FROM pb
      UNION ALL SELECT feature, round(cramers_v, 6), 'categoriel' FROM cv
      UNION ALL SELECT flag, round(CASE WHEN lift > 0 THEN abs(ln(lift)) ELSE 0.0 END, 6), 'flag_binaire' FROM lift WHERE n_active > 0)
    SELECT *, rank() OVER (PARTITION BY "type" ORDER BY force_association DESC) + (count(*) OVER (PARTITION BY "type", force_association) - 1) / 2.0::DOUBLE AS rang_dans_sa_famille FROM fam""")
def assoc_ranking(spark, sf):
    numeric = assoc.point_biserial(client_usage(spark, sf), _USAGE_NUMBERS + ["recence_gab_jours"], "label")
    categorical = assoc.cramers_v(_categorical(spark, sf), _CATEGORIES, "label")
    return assoc.association_ranking(numeric, categorical, assoc.flag_association(_flags(spark, sf), FLAGS, "label"))


@query("assoc_rate_by_category", roles.with_roles("client_label") + """
    SELECT c_mktsegment, count(*) AS n, round(sum(label)::DOUBLE / count(*), 6) AS rate,
      round((SELECT sum(label)::DOUBLE / count(*) FROM client_label), 6) AS global_rate FROM client_label GROUP BY 1""")
def assoc_rate_by_category(spark, sf):
    return assoc.rates_against_global(roles.client_label(spark, sf), "c_mktsegment", "label")


# ---- profiles ------------------------------------------------------------------

_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PROFILE_LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM lineitem" for c in _PROFILE)


@query("profile_outliers", f"""
    WITH l AS ({_PROFILE_LONG}),
    q AS (SELECT col, min(v) AS mi, max(v) AS ma, round(avg(v), 4) AS me, quantile_disc(v, 0.5) AS median, quantile_disc(v, 0.01) AS p1, quantile_disc(v, 0.99) AS p99,
      quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM l GROUP BY 1)
    SELECT col AS "column", any_value(mi) AS "min", any_value(ma) AS "max", any_value(me) AS "mean", any_value(median) AS median, any_value(p1) AS p1, any_value(p99) AS p99,
      round(any_value(q1 - (q3 - q1) * 1.5), 4) AS fence_low, round(any_value(q3 + (q3 - q1) * 1.5), 4) AS fence_high,
      count(*) FILTER (v < 0) AS n_negative, count(*) FILTER (v < q1 - (q3 - q1) * 1.5 OR v > q3 + (q3 - q1) * 1.5) AS n_outside
    FROM l JOIN q USING (col) GROUP BY 1""")
def profile_outliers(spark, sf):
    return assoc.outlier_profile(table(spark, sf, "lineitem"), _PROFILE)


@query("profile_birthdates", roles.with_roles("perimetre") + """,
    a AS (SELECT CAST(floor(date_diff('day', birth, DATE '2025-12-31') / 365.25) AS BIGINT) AS age FROM perimetre)
    SELECT min(age) AS age_min, max(age) AS age_max, count(*) FILTER (age < 0) AS n_future, count(*) FILTER (age BETWEEN 0 AND 15) AS n_too_young,
      count(*) FILTER (age > 100) AS n_too_old FROM a""")
def profile_birthdates(spark, sf):
    return assoc.birthdate_profile(roles.perimetre(spark, sf), "DATE_OF_BIRTH", REFERENCE_DATE)


@query("profile_cardinality", roles.with_roles("perimetre") + """
    SELECT 'CODE_VILLE' AS "column", count(DISTINCT code_ville) AS n_modalites, count(*) AS n_rows, round(count(DISTINCT code_ville)::DOUBLE / count(*), 6) AS ratio FROM perimetre
    UNION ALL SELECT 'MARITAL_STATUS', count(DISTINCT marital) + 1, count(*), round((count(DISTINCT marital) + 1)::DOUBLE / count(*), 6) FROM perimetre""")
def profile_cardinality(spark, sf):
    return assoc.cardinality_profile(roles.perimetre(spark, sf), ["CODE_VILLE", "MARITAL_STATUS"])


@query("profile_pair_sample", _USAGE + """
    SELECT c_acctbal, n_orders, montant_total_gab, label FROM usage ORDER BY md5(CAST(c_custkey AS VARCHAR)) LIMIT 1000""")
def profile_pair_sample(spark, sf):
    return assoc.pair_sample(client_usage(spark, sf), ["c_acctbal", "n_orders", "montant_total_gab"], "label", 1000, key="c_custkey")


@query("profile_column_roles", _USAGE + """
    SELECT 'c_acctbal' AS "column", 'continuous' AS role, count(c_acctbal) AS n_known FROM usage
    UNION ALL SELECT 'n_orders', 'continuous', count(n_orders) FROM usage
    UNION ALL SELECT 'recence_gab_jours', 'continuous', count(recence_gab_jours) FROM usage
    UNION ALL SELECT 'c_nationkey', 'categorical', count(c_nationkey) FROM usage
    UNION ALL SELECT 'c_mktsegment', 'categorical', count(c_mktsegment) FROM usage
    UNION ALL SELECT 'label', 'target', count(label) FROM usage
    UNION ALL SELECT 'jamais_utilise_gab', 'flag', count(*) FROM usage""")
def profile_column_roles(spark, sf):
    df = rules.missing_flags(client_usage(spark, sf), {"jamais_utilise_gab": "derniere_operation_gab"})
    df = df.select("c_acctbal", "n_orders", "recence_gab_jours", "c_nationkey", "c_mktsegment", "label", "jamais_utilise_gab")
    roles_of = assoc.column_roles(df, targets=["label"], codes=["c_nationkey"])
    known = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_known")
    return roles_of.join(known, "column")


# ---- quality gates -------------------------------------------------------------

@query("dq_unique_keys", roles.with_roles("perimetre", "base", "cible", "pack", "digital", "solde") + """
    SELECT 'perimetre' AS "table", count(*) AS n_rows, count(DISTINCT radical) AS n_keys, count(*) - count(DISTINCT radical) AS n_extra FROM perimetre
    UNION ALL SELECT 'base', count(*), count(DISTINCT radical), 0 FROM base UNION ALL SELECT 'cible', count(*), count(DISTINCT radical), 0 FROM cible
    UNION ALL SELECT 'pack', count(*), count(DISTINCT radical), 0 FROM pack UNION ALL SELECT 'digital', count(*), count(DISTINCT radical), 0 FROM digital
    UNION ALL SELECT 'solde', count(*), count(DISTINCT radical), 0 FROM solde""")
def dq_unique_keys(spark, sf):
    raw = roles.raw_tables(spark, sf)
    features = feature_tables(raw, REFERENCE_DATE, roles.CODES)
    tables = {"perimetre": raw["perimetre"], "base": client_base(raw["perimetre"], REFERENCE_DATE)}
    tables.update({n: features[n] for n in ("cible", "pack", "digital", "solde")})
    return quality.unique_keys(tables, KEY)


_GATED = ("base", "cible", "pack", "digital", "solde", "depot", "flux", "gab", "retrait", "payfac", "vignette", "dataset")


@query("dq_gates_observed", roles.with_roles(*_GATED) + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows, count(DISTINCT radical) AS n_keys, 0 AS n_extra FROM {t}" for t in _GATED))
def dq_gates_observed(spark, sf):
    """Both gates of the feature table as counted by the writes themselves."""
    raw, folder = roles.raw_tables(spark, sf), staging_path(spark, "curated")
    curated = curate(raw, folder, bucket_number(raw["perimetre"].count()), codes=roles.CODES)
    dataset, seen = observe_keys(join_curated(curated), KEY, "dataset", 8)
    dataset.write.parquet(f"{folder}/dataset")
    return key_report(spark, {**curated.gates, "dataset": seen})


@query("dq_row_conservation", roles.with_roles("base", "dataset") + """
    SELECT b AS n_base, d AS n_result, CAST(b = d AS INTEGER) AS conserved FROM (SELECT (SELECT count(*) FROM base) AS b, (SELECT count(*) FROM dataset) AS d)""")
def dq_row_conservation(spark, sf):
    raw = roles.raw_tables(spark, sf)
    return quality.row_conservation(client_base(raw["perimetre"], REFERENCE_DATE), build_dataset(raw, codes=roles.CODES))


@query("dq_unexpected_codes", """
    SELECT substr(o_orderpriority, 1, 1) AS "CODE_PRODUIT", count(*) AS n FROM orders
    WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '2001-01-01' AND substr(o_orderpriority, 1, 1) NOT IN ('1', '2', '3') GROUP BY 1""")
def dq_unexpected_codes(spark, sf):
    return quality.unexpected_codes(roles.assi(spark, sf), "CODE_PRODUIT", roles.CODES)


@query("dq_exclusivity", """
    WITH k AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT count(*) AS n_keys_with_repeats, count(*) FILTER (c > 1) AS n_keys_with_several_codes FROM k WHERE n > 1""")
def dq_exclusivity(spark, sf):
    return quality.exclusivity(table(spark, sf, "orders").filter("o_orderstatus = 'F'"), "o_custkey", "o_orderpriority")


@query("dq_residual_nulls", roles.with_roles("perimetre") + """
    SELECT 'BPR' AS "column", count(*) FILTER (bpr IS NULL) AS n_null, 0 AS is_constant FROM perimetre
    UNION ALL SELECT 'MARITAL_STATUS', count(*) FILTER (marital IS NULL), 0 FROM perimetre
    UNION ALL SELECT 'TAILLE_ENTREPRI', count(*), 1 FROM perimetre""")
def dq_residual_nulls(spark, sf):
    return quality.residual_problems(roles.perimetre(spark, sf).select("RADICAL", "BANQUE", "BPR", "MARITAL_STATUS", "TAILLE_ENTREPRI"))


@query("dq_schema_parity", """
    SELECT 'CODE_FONCT' AS "column", 'string' AS left_type, CAST(NULL AS VARCHAR) AS right_type,
      (SELECT count(*) FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-16') AS n_not_scorable""")
def dq_schema_parity(spark, sf):
    first, second = roles.gab_files(spark, sf)
    differences = quality.schema_parity(first, second, ignore=["RADICAL"])
    return differences.withColumn("n_not_scorable", second.agg(F.count("*")).scalar())


@query("dq_freshness", """
    SELECT strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS latest,
      round((epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE, 4) AS age_hours,
      CAST((epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(ts))) / 3600000000.0 <= 24 AS INTEGER) AS ready FROM events""")
def dq_freshness(spark, sf):
    return quality.freshness(table(spark, sf, "events"), "ts", dt.datetime(2024, 1, 31, 6, 0, 0), 24)
