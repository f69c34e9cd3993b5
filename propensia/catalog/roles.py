"""The given tables in the roles of the raw client files.

Every role exists twice: as a DataFrame in the raw text form (decimal commas,
dd/MM/yyyy) and as a SQL common table expression with the typed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensia.catalog.registry import table
from propensia.functions import minor_units, to_fr_text
from propensia.operators.sets import union_by_name

# Role parameters.
CODES = ("1", "2", "3")
TARGET_SINCE = "2001-01-01"
SIBLING_CODES = (1, 17, 27, 30, 43, 45, 50, 57, 64, 78, 81, 90)


def _person(key: Column, nation: Column, balance: Column, segment: Column, bank: Column) -> list[Column]:
    """Client attributes as functions of the key, with the spellings and gaps of raw data."""
    birth = F.date_add(F.lit("1920-01-01").cast("date"), F.pmod(key * 7919, F.lit(38000)).cast("int"))
    codes = F.array(*[F.lit(c) for c in SIBLING_CODES])
    gender = F.when(key % 53 == 0, "X").when(key % 4 == 0, "FÃ©minin").when(key % 4 == 2, "Féminin").otherwise("Masculin")
    return [
        key.cast("string").alias("RADICAL"),
        bank.alias("BANQUE"),
        F.lpad(nation.cast("string"), 3, "0").alias("AGENCE"),
        F.when(key % 97 != 0, F.date_format(birth, "dd/MM/yyyy")).alias("DATE_OF_BIRTH"),
        gender.alias("GENDER"),
        nation.cast("string").alias("CODE_VILLE"),
        F.concat(F.lit("VILLE_"), nation.cast("string")).alias("LIBELLE_VILLE"),
        F.when(key % 101 != 0, F.element_at(codes, (key % 12 + 1).cast("int"))).alias("BPR"),
        F.when(key % 5 != 0, (key % 17 - 1).cast("string")).alias("NOMBRE_ENFANT"),
        F.lit(None).cast("string").alias("TAILLE_ENTREPRI"),
        segment.alias("MARITAL_STATUS"),
        F.when(balance < 0, F.lit(None)).when(balance < 3000, "C").when(balance < 6000, "B").otherwise("A").alias("CUSTOMER_RATING"),
    ]


def perimetre(spark: SparkSession, sf: str) -> DataFrame:
    """Customers plus suppliers: supplier keys repeat customer keys, as duplicate accounts do."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    customers = c.select(*_person(F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment"), F.lit("01")))
    bank = F.when(F.col("s_suppkey") % 2 == 0, "00").otherwise("02")
    suppliers = s.select(*_person(F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal"), F.lit(None).cast("string"), bank))
    return customers.unionByName(suppliers)


def _date_text(c: str) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def _client(c: str) -> Column:
    return F.col(c).cast("string").alias("RADICAL")


def assi(spark: SparkSession, sf: str) -> DataFrame:
    """Product snapshots: settled orders of the observed year."""
    o = table(spark, sf, "orders")
    o = o.filter(F.col("o_orderstatus") == "F").filter(_between(o, "o_orderdate", TARGET_SINCE, None))
    return o.select(
        _client("o_custkey"),
        F.substring("o_orderpriority", 1, 1).alias("CODE_PRODUIT"),
        F.col("o_orderpriority").alias("LIBELLE_PRODUIT"),
        _date_text("o_orderdate").alias("DATE_CHARG"),
    )


def _between(df: DataFrame, c: str, start: str | None, end: str | None) -> Column:
    """start <= c < end; the bounds take the column's type, so the scan can use them."""
    kind = df.schema[c].dataType
    keep = F.lit(True)
    if start:
        keep = keep & (F.col(c) >= F.lit(start).cast(kind))
    if end:
        keep = keep & (F.col(c) < F.lit(end).cast(kind))
    return keep


def opk_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Pack snapshots in three yearly files; the oldest lacks the state column."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    columns = [
        _client("o_custkey"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("CODE_PACK"),
        _date_text("o_orderdate").alias("DATE_CHARG"), F.col("o_orderstatus").alias("ETATC"),
    ]
    cuts = [(None, "1998-01-01"), ("1998-01-01", "2000-01-01"), ("2000-01-01", None)]
    files = [o.filter(_between(o, "o_orderdate", *cut)).select(*columns) for cut in cuts]
    return [files[0].drop("ETATC"), *files[1:]]


def solde_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    o = table(spark, sf, "orders")
    columns = [_client("o_custkey"), to_fr_text(F.col("o_totalprice") - 200000).alias("SOLDEVERIF")]
    return [o.filter(_between(o, "o_orderdate", *cut)).select(*columns) for cut in [(None, "2000-01-01"), ("2000-01-01", None)]]


def depot_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    columns = [_client("o_custkey"), to_fr_text("o_totalprice").alias("MONTANT_DEPOT")]
    return [o.filter(_between(o, "o_orderdate", *cut)).select(*columns) for cut in [(None, "1999-01-01"), ("1999-01-01", None)]]


def flux(spark: SparkSession, sf: str) -> DataFrame:
    """Credit flows from order lines; a returned line is a month without movement."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    owners = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.when(F.col("l_returnflag") != "R", to_fr_text("l_extendedprice")).alias("FLUX_CRED")
    return joined.select(_client("o_custkey"), amount, "l_shipdate")


def flux_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    flows = flux(spark, sf)
    cuts = [(None, "1999-01-01"), ("1999-01-01", None)]
    return [flows.filter(_between(flows, "l_shipdate", *cut)).drop("l_shipdate") for cut in cuts]


def _event_files(spark: SparkSession, sf: str, kind: str, cuts: Sequence[str], columns: Sequence[Column]) -> list[DataFrame]:
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    edges = [None, *cuts, None]
    return [e.filter(_between(e, "ts", a, b)).select(_client("user_id"), *columns) for a, b in zip(edges, edges[1:])]


def gab_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Cash-machine operations; the complement file has no function code."""
    columns = [
        to_fr_text("value").alias("MONTANT"), F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("DATE_OP"),
        F.lit("031").alias("CODE_FONCT"),
    ]
    first, second = _event_files(spark, sf, "view", ["2024-01-16"], columns)
    return [first, second.drop("CODE_FONCT")]


def retrait_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    return _event_files(spark, sf, "error", ["2024-01-16"], [to_fr_text("value").alias("MONTANT")])


def payfac_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    return _event_files(spark, sf, "purchase", ["2024-01-10", "2024-01-20"], [to_fr_text("value").alias("MONTANT_TOTAL")])


def vignette_files(spark: SparkSession, sf: str) -> list[DataFrame]:
    return _event_files(spark, sf, "signup", ["2024-01-16"], [to_fr_text("value").alias("TOTAL_TTC/100")])


def digitaux(spark: SparkSession, sf: str) -> DataFrame:
    """Subscriptions: one per click; large values end after that many days."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "click")
    end = F.date_add(F.col("ts").cast("date"), F.floor("value").cast("int"))
    return e.select(
        _client("user_id"),
        _date_text("ts").alias("DATE_VAL_ABON"),
        F.when(F.col("value") >= 20, F.date_format(end, "dd/MM/yyyy")).alias("DATE_RES_ABON"),
    )


def raw_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "perimetre": perimetre(spark, sf),
        "assi": assi(spark, sf),
        "opk": union_by_name(opk_files(spark, sf)),
        "digitaux": digitaux(spark, sf),
        "solde": union_by_name(solde_files(spark, sf)),
        "depot": union_by_name(depot_files(spark, sf)),
        "flux": flux(spark, sf).drop("l_shipdate"),  # both files at once: one join with the owners
        "gab": union_by_name(gab_files(spark, sf)),
        "retrait": union_by_name(retrait_files(spark, sf)),
        "payfac": union_by_name(payfac_files(spark, sf)),
        "vignette": union_by_name(vignette_files(spark, sf)),
    }


def raw_files(spark: SparkSession, sf: str) -> dict[str, list[DataFrame]]:
    """The raw tables as the single files they arrive in."""
    return {
        "perimetre": [perimetre(spark, sf)], "assi": [assi(spark, sf)], "opk": opk_files(spark, sf), "digitaux": [digitaux(spark, sf)],
        "solde": solde_files(spark, sf), "depot": depot_files(spark, sf), "flux": flux_files(spark, sf), "gab": gab_files(spark, sf),
        "retrait": retrait_files(spark, sf), "payfac": payfac_files(spark, sf), "vignette": vignette_files(spark, sf),
    }


def client_label(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, label): 1 for clients with a product in scope."""
    holders = assi(spark, sf).filter(F.col("CODE_PRODUIT").isin(*CODES)).select("RADICAL").distinct()
    keyed = table(spark, sf, "customer").withColumn("RADICAL", F.col("c_custkey").cast("string"))
    return keyed.join(holders.withColumn("held", F.lit(1)), "RADICAL", "left").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.coalesce("held", F.lit(0)).alias("label")
    )


def scored_clients(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, label, score, prediction): a score from the balance, with many ties."""
    score = F.floor((minor_units("c_acctbal") + 100000) / 11000.0) / 100.0
    return client_label(spark, sf).select(
        "c_custkey", "label", score.alias("score"), (score >= 0.5).cast("int").alias("prediction"), "c_mktsegment", "c_nationkey"
    )


# ---- the same roles in SQL -----------------------------------------------------

def _person_sql(key: str, nation: str, balance: str, segment: str, bank: str, source: str) -> str:
    codes = ", ".join(str(c) for c in SIBLING_CODES)
    return f"""
      SELECT CAST({key} AS VARCHAR) AS radical, {bank} AS banque, lpad(CAST({nation} AS VARCHAR), 3, '0') AS agence,
        CASE WHEN {key} % 97 <> 0 THEN DATE '1920-01-01' + CAST(({key} * 7919) % 38000 AS INTEGER) END AS birth,
        CASE WHEN {key} % 53 = 0 THEN NULL WHEN {key} % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CAST({nation} AS VARCHAR) AS code_ville,
        CASE WHEN {key} % 101 <> 0 THEN list_extract([{codes}], CAST({key} % 12 + 1 AS BIGINT)) END AS bpr,
        CASE WHEN {key} % 5 <> 0 THEN CAST({key} % 17 - 1 AS INTEGER) END AS enfants,
        {segment} AS marital,
        CASE WHEN {balance} < 0 THEN NULL WHEN {balance} < 3000 THEN 'C' WHEN {balance} < 6000 THEN 'B' ELSE 'A' END AS rating
      FROM {source}"""


ROLE_SQL: dict[str, str] = {
    "perimetre": _person_sql("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "'01'", "customer")
    + "\n      UNION ALL"
    + _person_sql("s_suppkey", "s_nationkey", "s_acctbal", "CAST(NULL AS VARCHAR)", "CASE WHEN s_suppkey % 2 = 0 THEN '00' ELSE '02' END", "supplier"),
    "base": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY radical ORDER BY banque, agence) AS rn FROM perimetre) WHERE rn = 1""",
    "assi": f"""
      SELECT CAST(o_custkey AS VARCHAR) AS radical, substr(o_orderpriority, 1, 1) AS code, o_orderpriority AS nom,
        CAST(o_orderdate AS DATE) AS charg
      FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '{TARGET_SINCE}'""",
    "cible": """
      SELECT radical, code AS label_code, nom AS label_nom FROM (
        SELECT *, row_number() OVER (PARTITION BY radical ORDER BY charg DESC, code, nom) AS rn
        FROM assi WHERE code IN ('1', '2', '3')) WHERE rn = 1""",
    "opk": """
      SELECT CAST(o_custkey AS VARCHAR) AS radical, 'P' || substr(o_orderpriority, 1, 1) AS code_pack,
        CASE WHEN o_orderdate >= DATE '1998-01-01' THEN o_orderstatus END AS etatc, CAST(o_orderdate AS DATE) AS charg
      FROM orders WHERE o_orderstatus IN ('O', 'P')""",
    "pack": """
      SELECT radical, code_pack AS pack_actuel, etatc AS pack_etat FROM (
        SELECT *, row_number() OVER (PARTITION BY radical ORDER BY charg DESC, code_pack, etatc NULLS FIRST) AS rn
        FROM opk) WHERE rn = 1""",
    "digitaux": """
      SELECT CAST(user_id AS VARCHAR) AS radical, CAST(ts AS DATE) AS val_abon,
        CASE WHEN value >= 20 THEN CAST(ts AS DATE) + CAST(floor(value) AS INTEGER) END AS res_abon
      FROM events WHERE event_type = 'click'""",
    "digital": """
      SELECT radical, strftime(val_abon, '%d/%m/%Y') AS digital_date_activation,
        CAST(res_abon IS NULL AS INTEGER) AS digital_toujours_abonne,
        date_diff('day', val_abon, DATE '2025-12-31') AS anciennete_digitale_jours
      FROM (SELECT *, row_number() OVER (PARTITION BY radical
              ORDER BY CAST(res_abon IS NULL AS INTEGER) DESC, val_abon DESC, strftime(res_abon, '%d/%m/%Y') NULLS FIRST) AS rn
            FROM digitaux) WHERE rn = 1""",
    "solde": """
      SELECT radical, sum(amount)::DOUBLE / count(*) AS solde_moyen, min(amount)::DOUBLE AS solde_min,
        max(amount)::DOUBLE AS solde_max, count(*) AS nb_mois_observes_solde
      FROM (SELECT CAST(o_custkey AS VARCHAR) AS radical, CAST(o_totalprice - 200000 AS DECIMAL(18, 2)) AS amount FROM orders)
      GROUP BY radical""",
    "depot": """
      SELECT CAST(o_custkey AS VARCHAR) AS radical,
        sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS depot_moyen
      FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""",
    "flux": """
      SELECT CAST(o_custkey AS VARCHAR) AS radical, sum(amount)::DOUBLE / count(*) AS flux_cred_moyen,
        sum(amount)::DOUBLE AS flux_cred_total, count(*) FILTER (amount > 0) AS nb_mois_avec_flux
      FROM (SELECT o_custkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END AS amount
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      GROUP BY 1""",
    "gab": """
      SELECT CAST(user_id AS VARCHAR) AS radical, count(*) AS nb_operations_gab, sum(amount)::DOUBLE AS montant_total_gab,
        sum(amount)::DOUBLE / count(*) AS montant_moyen_gab, max(date_trunc('second', ts)) AS derniere_operation_gab,
        date_diff('day', CAST(max(ts) AS DATE), DATE '2025-12-31') AS recence_gab_jours
      FROM (SELECT *, CAST(value AS DECIMAL(18, 2)) AS amount FROM events WHERE event_type = 'view') GROUP BY 1""",
    "retrait": """
      SELECT CAST(user_id AS VARCHAR) AS radical, count(*) AS nb_retraits,
        sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS montant_total_retraits
      FROM events WHERE event_type = 'error' GROUP BY 1""",
    "payfac": """
      SELECT CAST(user_id AS VARCHAR) AS radical, count(*) AS nb_paiements_digitaux,
        sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS montant_total_payfac
      FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "vignette": """
      SELECT CAST(user_id AS VARCHAR) AS radical, count(*) AS nb_vignettes_payees,
        sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS montant_total_vignette
      FROM events WHERE event_type = 'signup' GROUP BY 1""",
    "dataset": """
      SELECT base.*, CAST(floor(date_diff('day', birth, DATE '2025-12-31') / 365.25) AS BIGINT) AS age_client,
        label_code, label_nom, pack_actuel, pack_etat, digital_date_activation,
        coalesce(digital_toujours_abonne, 0) AS digital_toujours_abonne, anciennete_digitale_jours,
        solde_moyen, solde_min, solde_max, coalesce(nb_mois_observes_solde, 0) AS nb_mois_observes_solde, depot_moyen,
        flux_cred_moyen, coalesce(flux_cred_total, 0) AS flux_cred_total, coalesce(nb_mois_avec_flux, 0) AS nb_mois_avec_flux,
        coalesce(nb_operations_gab, 0) AS nb_operations_gab, coalesce(montant_total_gab, 0) AS montant_total_gab,
        montant_moyen_gab, derniere_operation_gab, recence_gab_jours, coalesce(nb_retraits, 0) AS nb_retraits,
        coalesce(montant_total_retraits, 0) AS montant_total_retraits, coalesce(nb_paiements_digitaux, 0) AS nb_paiements_digitaux,
        coalesce(montant_total_payfac, 0) AS montant_total_payfac, coalesce(nb_vignettes_payees, 0) AS nb_vignettes_payees,
        coalesce(montant_total_vignette, 0) AS montant_total_vignette, CAST(label_nom IS NOT NULL AS INTEGER) AS label_eligibilite
      FROM base LEFT JOIN cible USING (radical) LEFT JOIN pack USING (radical) LEFT JOIN digital USING (radical)
        LEFT JOIN solde USING (radical) LEFT JOIN depot USING (radical) LEFT JOIN flux USING (radical)
        LEFT JOIN gab USING (radical) LEFT JOIN retrait USING (radical) LEFT JOIN payfac USING (radical)
        LEFT JOIN vignette USING (radical)""",
    "client_label": """
      SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, CAST(c_custkey IN (
        SELECT CAST(radical AS BIGINT) FROM assi WHERE code IN ('1', '2', '3')) AS INTEGER) AS label FROM customer""",
    "scored": """
      SELECT c_custkey, label, score, CAST(score >= 0.5 AS INTEGER) AS prediction, c_mktsegment, c_nationkey
      FROM (SELECT *, floor((CAST(round(c_acctbal * 100) AS BIGINT) + 100000) / 11000.0) / 100.0 AS score FROM client_label)""",
}

_NEEDS: dict[str, tuple[str, ...]] = {
    "base": ("perimetre",), "cible": ("assi",), "pack": ("opk",), "digital": ("digitaux",),
    "dataset": ("base", "cible", "pack", "digital", "solde", "depot", "flux", "gab", "retrait", "payfac", "vignette"),
    "client_label": ("assi",), "scored": ("client_label",),
}


def with_roles(*names: str) -> str:
    """``WITH ...`` clause defining the named roles and what they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n    ".join(f"{n} AS ({ROLE_SQL[n]})" for n in ordered)
