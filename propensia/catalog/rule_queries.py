"""Row-wise rules, parsing and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propensia.catalog import roles
from propensia.catalog.registry import query, table
from propensia.functions import age_years, fr_date, fr_decimal, fr_timestamp, months_since, recency_days, to_fr_text, year_from_name
from propensia.operators import rules
from propensia.operators.aggregates import balance_summary, channel_summary, operations_summary
from propensia.operators.encode import unpack_vector
from propensia.operators.sets import union_by_name
from propensia.plans.cleaning import GENDER_SPELLINGS, reduce_and_derive
from propensia.plans.dataset import REFERENCE_DATE, savings_target
from propensia.session import staging_path
from propensia.sources import delimited

ORDERS_REFERENCE = dt.date(2001, 12, 31)


def _usage(spark, sf):
    """Customers with the counters of one channel attached, absent ones NULL."""
    views = table(spark, sf, "events").filter("event_type = 'view'")
    usage = operations_summary(views, "user_id", "value", "ts", REFERENCE_DATE)
    customers = table(spark, sf, "customer")
    return customers.join(usage, F.col("c_custkey") == F.col("user_id"), "left").drop("user_id")


_USAGE_SQL = """WITH usage AS (
      SELECT user_id, count(*) AS n, sum(CAST(value AS DECIMAL(38, 9)))::DOUBLE AS total,
        sum(CAST(value AS DECIMAL(38, 9)))::DOUBLE / count(*) AS mean,
        date_diff('day', CAST(max(ts) AS DATE), DATE '2025-12-31') AS recency
      FROM events WHERE event_type = 'view' GROUP BY 1),
    u AS (SELECT * FROM customer LEFT JOIN usage ON c_custkey = user_id)"""


@query("fr_decimal_parse", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amount FROM orders""")
def fr_decimal_parse(spark, sf):
    # Every seventh amount is written with a thousands separator, which is no number.
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("1 "), to_fr_text("o_totalprice"))).otherwise(to_fr_text("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", fr_decimal(text).alias("amount"))


@query("fr_date_parse", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def fr_date_parse(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(fr_date(text), "yyyy-MM-dd").alias("day"))


@query("fr_timestamp_parse", """
    SELECT user_id, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS latest FROM events GROUP BY 1""")
def fr_timestamp_parse(spark, sf):
    moment = fr_timestamp(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    latest = table(spark, sf, "events").groupBy("user_id").agg(F.max(moment).alias("latest"))
    return latest.select("user_id", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("filter_isin_products", """
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def filter_isin_products(spark, sf):
    codes = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return table(spark, sf, "orders").filter(F.col("o_orderpriority").isin(codes)).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("resolve_alt_column", """
    SELECT CAST(user_id AS VARCHAR) AS "RADICAL", count(*) AS n,
      sum(CAST(value AS DECIMAL(38, 9)))::DOUBLE AS total FROM events WHERE event_type = 'signup' GROUP BY 1""")
def resolve_alt_column(spark, sf):
    raw = union_by_name(roles.vignette_files(spark, sf))
    named = rules.resolve_column(raw, ["TOTAL_TTC", "TOTAL_TTC/100"], "TOTAL_TTC")
    return channel_summary(named.select("RADICAL", fr_decimal("TOTAL_TTC").alias("amount")), "RADICAL", "amount", "n", "total")


@query("drop_if_present", "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def drop_if_present(spark, sf):
    return rules.drop_present(table(spark, sf, "part"), ["p_name", "LIBELLE_VILLE"])


@query("category_repair_map", roles.with_roles("perimetre") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", gender AS "GENDER" FROM perimetre""")
def category_repair_map(spark, sf):
    return rules.repair_categories(roles.perimetre(spark, sf), "GENDER", GENDER_SPELLINGS).select("RADICAL", "BANQUE", "GENDER")


@query("dropna_subset", roles.with_roles("perimetre") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", bpr AS "BPR" FROM perimetre WHERE bpr IS NOT NULL AND gender IS NOT NULL""")
def dropna_subset(spark, sf):
    repaired = rules.repair_categories(roles.perimetre(spark, sf), "GENDER", GENDER_SPELLINGS)
    return rules.drop_null_keys(repaired, ["BPR", "GENDER"]).select("RADICAL", "BANQUE", "BPR")


@query("fillna_map", roles.with_roles("perimetre") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", coalesce(CAST(enfants AS VARCHAR), '0') AS "NOMBRE_ENFANT",
      'PARTICULIER' AS "TAILLE_ENTREPRI", coalesce(marital, 'NON_RENSEIGNE') AS "MARITAL_STATUS",
      coalesce(rating, 'NON_RENSEIGNE') AS "CUSTOMER_RATING" FROM perimetre""")
def fillna_map(spark, sf):
    filled = rules.fill_constants(roles.perimetre(spark, sf), {
        "NOMBRE_ENFANT": 0, "TAILLE_ENTREPRI": "PARTICULIER", "MARITAL_STATUS": "NON_RENSEIGNE", "CUSTOMER_RATING": "NON_RENSEIGNE",
    })
    return filled.select("RADICAL", "BANQUE", "NOMBRE_ENFANT", "TAILLE_ENTREPRI", "MARITAL_STATUS", "CUSTOMER_RATING")


@query("fillna_counters", _USAGE_SQL + """
    SELECT c_custkey, coalesce(n, 0) AS nb_operations_gab, coalesce(total, 0.0) AS montant_total_gab, mean AS montant_moyen_gab FROM u""")
def fillna_counters(spark, sf):
    filled = rules.fill_zero(_usage(spark, sf), ["nb_operations_gab", "montant_total_gab"])
    return filled.select("c_custkey", "nb_operations_gab", "montant_total_gab", "montant_moyen_gab")


@query("missing_flag", _USAGE_SQL + """
    SELECT c_custkey, CAST(n IS NULL AS INTEGER) AS jamais_utilise_gab FROM u""")
def missing_flag(spark, sf):
    return rules.missing_flags(_usage(spark, sf), {"jamais_utilise_gab": "derniere_operation_gab"}).select("c_custkey", "jamais_utilise_gab")


@query("dropna_any", _USAGE_SQL + """
    SELECT c_custkey, c_mktsegment, recency AS recence_gab_jours FROM u WHERE n IS NOT NULL""")
def dropna_any(spark, sf):
    return _usage(spark, sf).select("c_custkey", "c_mktsegment", "recence_gab_jours").na.drop()


@query("clip_negative", roles.with_roles("perimetre") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", CASE WHEN enfants < 0 THEN 0 ELSE enfants END AS "NOMBRE_ENFANT" FROM perimetre""")
def clip_negative(spark, sf):
    typed = roles.perimetre(spark, sf).withColumn("NOMBRE_ENFANT", F.col("NOMBRE_ENFANT").try_cast("int"))
    return rules.clip_negative(typed, ["NOMBRE_ENFANT"]).select("RADICAL", "BANQUE", "NOMBRE_ENFANT")


@query("cap_and_flag", roles.with_roles("perimetre") + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", CASE WHEN enfants > 12 THEN 12 ELSE enfants END AS "NOMBRE_ENFANT",
      CASE WHEN enfants > 12 THEN 1 ELSE 0 END AS "NOMBRE_ENFANT_etait_extreme" FROM perimetre""")
def cap_and_flag(spark, sf):
    typed = roles.perimetre(spark, sf).withColumn("NOMBRE_ENFANT", F.col("NOMBRE_ENFANT").try_cast("int"))
    capped = rules.cap_and_flag(typed, {"NOMBRE_ENFANT": 12, "nb_mois_observes_solde": 36})
    return capped.select("RADICAL", "BANQUE", "NOMBRE_ENFANT", "NOMBRE_ENFANT_etait_extreme")


_AGED = roles.with_roles("perimetre") + """,
    aged AS (SELECT *, CAST(floor(date_diff('day', birth, DATE '2025-12-31') / 365.25) AS BIGINT) AS age FROM perimetre)"""


@query("age_filter_train", _AGED + """
    SELECT radical AS "RADICAL", banque AS "BANQUE" FROM aged WHERE age BETWEEN 16 AND 100""")
def age_filter_train(spark, sf):
    return rules.keep_plausible_age(roles.perimetre(spark, sf), "DATE_OF_BIRTH", REFERENCE_DATE, True).select("RADICAL", "BANQUE")


@query("age_filter_score", _AGED + """
    SELECT count(*) AS n_rows, count(*) FILTER (age < 16 OR age > 100) AS n_implausible FROM aged""")
def age_filter_score(spark, sf):
    kept = rules.keep_plausible_age(roles.perimetre(spark, sf), "DATE_OF_BIRTH", REFERENCE_DATE, False)
    return rules.count_implausible_age(kept, "DATE_OF_BIRTH", REFERENCE_DATE)


@query("label_from_presence", roles.with_roles("cible") + """
    SELECT c_custkey, CAST(label_nom IS NOT NULL AS INTEGER) AS label_eligibilite
    FROM customer LEFT JOIN cible ON radical = CAST(c_custkey AS VARCHAR)""")
def label_from_presence(spark, sf):
    target = savings_target(roles.assi(spark, sf), roles.CODES)
    joined = table(spark, sf, "customer").withColumn("RADICAL", F.col("c_custkey").cast("string")).join(target, "RADICAL", "left")
    return rules.presence_label(joined, "label_nom", "label_eligibilite").select("c_custkey", "label_eligibilite")


@query("population_split", roles.with_roles("client_label") + """
    SELECT 'dataset_eligibilite' AS population, count(*) AS n, sum(label)::BIGINT AS n_positive FROM client_label
    UNION ALL SELECT 'dataset_produit', count(*), sum(label)::BIGINT FROM client_label WHERE label = 1""")
def population_split(spark, sf):
    everyone, holders = rules.split_population(roles.client_label(spark, sf), "label")
    def size(df, name):
        return df.agg(F.count("*").alias("n"), F.sum("label").alias("n_positive")).select(F.lit(name).alias("population"), "*")

    return size(everyone, "dataset_eligibilite").unionByName(size(holders, "dataset_produit"))


@query("numeric_feature_list", """
    SELECT 'c_custkey' AS feature, count(c_custkey) AS n_known FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer""")
def numeric_feature_list(spark, sf):
    df = roles.client_label(spark, sf)
    features = rules.numeric_features(df, ["label", "c_nationkey"])
    values = df.agg(*[F.count(c).alias(c) for c in features])
    return values.unpivot([], features, "feature", "n_known")


@query("safe_ratio", """
    SELECT p_partkey, round(p_retailprice / nullif(p_size - 10, 0), 6) AS ratio FROM part""")
def safe_ratio(spark, sf):
    parts = table(spark, sf, "part").withColumn("room", F.col("p_size") - 10)
    return rules.safe_ratio(parts, "p_retailprice", "room", "ratio").select("p_partkey", F.round("ratio", 6).alias("ratio"))


@query("relative_volatility", roles.with_roles("solde") + """
    SELECT radical AS "RADICAL", round(CASE WHEN solde_moyen > 0 THEN (solde_max - solde_min) / solde_moyen END, 6) AS volatility,
      CASE WHEN solde_moyen <= 0 THEN 1 ELSE 0 END AS undefined FROM solde""")
def relative_volatility(spark, sf):
    amounts = union_by_name(roles.solde_files(spark, sf)).select("RADICAL", fr_decimal("SOLDEVERIF").alias("amount"))
    df = rules.relative_volatility(balance_summary(amounts, "RADICAL", "amount"), "solde_max", "solde_min", "solde_moyen", "volatility", "undefined")
    return df.select("RADICAL", F.round("volatility", 6).alias("volatility"), "undefined")


@query("reduce_columns", roles.with_roles("perimetre", "solde") + """
    SELECT p.radical AS "RADICAL", p.code_ville AS "CODE_VILLE", rating AS "CUSTOMER_RATING", solde_moyen, solde_min,
      nb_mois_observes_solde, round(CASE WHEN solde_moyen > 0 THEN (solde_max - solde_min) / solde_moyen END, 6) AS solde_volatilite_relative,
      CASE WHEN solde_moyen <= 0 THEN 1 ELSE 0 END AS solde_volatilite_indefinie,
      CAST(floor(date_diff('day', birth, DATE '2025-12-31') / 365.25) AS BIGINT) AS age_client
    FROM perimetre p LEFT JOIN solde s ON p.radical = s.radical""")
def reduce_columns(spark, sf):
    amounts = union_by_name(roles.solde_files(spark, sf)).select("RADICAL", fr_decimal("SOLDEVERIF").alias("amount"))
    base = roles.perimetre(spark, sf).select("RADICAL", "BANQUE", "AGENCE", "CODE_VILLE", "CUSTOMER_RATING", "DATE_OF_BIRTH")
    reduced = reduce_and_derive(base.join(balance_summary(amounts, "RADICAL", "amount"), "RADICAL", "left"), REFERENCE_DATE)
    return reduced.withColumn("solde_volatilite_relative", F.round("solde_volatilite_relative", 6))


@query("age_from_birth", _AGED + """
    SELECT radical AS "RADICAL", banque AS "BANQUE", age AS age_client FROM aged""")
def age_from_birth(spark, sf):
    return roles.perimetre(spark, sf).select("RADICAL", "BANQUE", age_years(fr_date("DATE_OF_BIRTH"), REFERENCE_DATE).alias("age_client"))


# ---- scalar functions ----------------------------------------------------------

@query("fn_age_floor", """
    SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') / 365.25) AS BIGINT) AS age FROM orders""")
def fn_age_floor(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", age_years(F.col("o_orderdate").cast("date"), ORDERS_REFERENCE).alias("age"))


@query("fn_months_between", """
    WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '2001-12-31' AS r FROM orders)
    SELECT o_orderkey, round((year(r) - year(d)) * 12 + (month(r) - month(d)) +
      CASE WHEN d = last_day(d) AND r = last_day(r) OR day(d) = day(r) THEN 0 ELSE (day(r) - day(d)) / 31.0 END, 6) AS months FROM d""")
def fn_months_between(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(months_since(F.col("o_orderdate").cast("date"), ORDERS_REFERENCE), 6).alias("months"))


@query("fn_recency_days", """
    SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') AS recency FROM orders GROUP BY 1""")
def fn_recency_days(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.select("o_custkey", recency_days("last", ORDERS_REFERENCE).alias("recency"))


@query("fn_year_from_filename", """
    SELECT CASE WHEN o_orderdate < DATE '1998-01-01' THEN 2023 WHEN o_orderdate < DATE '2000-01-01' THEN 2024 ELSE 2025 END AS file_year, count(*) AS n
    FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1""")
def fn_year_from_filename(spark, sf):
    columns = ["RADICAL", "CODE_PACK", "DATE_CHARG", "ETATC"]
    root = staging_path(spark, "yearly")
    # Spark names part files itself, so the year sits in the folder name; the files of the first years lack a column.
    for year, part in zip((2023, 2024, 2025), roles.opk_files(spark, sf)):
        part.select(*[c for c in columns if c in part.columns]).write.option("header", "true").option("sep", ";").csv(f"{root}/OPK{year}")
    rows = delimited.read_with_file_year(spark, f"{root}/*", columns, folder=True)
    return rows.groupBy("file_year").agg(F.count("*").alias("n"))


@query("fn_math_mix", """
    SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, CAST(floor(l_extendedprice) AS BIGINT) AS whole,
      round(abs(l_discount - 0.05), 6) AS distance, round(ln(l_quantity), 6) AS log_quantity FROM lineitem""")
def fn_math_mix(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.floor("l_extendedprice").cast("bigint").alias("whole"),
        F.round(F.abs(F.col("l_discount") - 0.05), 6).alias("distance"),
        F.round(F.ln("l_quantity"), 6).alias("log_quantity"),
    )


@query("fn_conditional", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'open' END AS state,
      coalesce(nullif(o_orderpriority, '5-LOW'), 'NONE') AS priority FROM orders""")
def fn_conditional(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hot").otherwise("open")
    priority = F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("NONE"))
    return table(spark, sf, "orders").select("o_orderkey", state.alias("state"), priority.alias("priority"))


@query("fn_vector_unpack", """
    SELECT vec_id, len(embedding)::INTEGER AS width, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS norm2 FROM embeddings""")
def fn_vector_unpack(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))
    unpacked = unpack_vector(vectors, "v")
    return unpacked.select("vec_id", F.size("values").alias("width"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))
