"""Small cases with hand-computed answers: formats, NULLs, ties, edge rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from propensia.functions import age_years, exact_mean, exact_sum, fr_date, fr_decimal, recency_days
from propensia.operators import aggregates as ag
from propensia.operators import association as assoc
from propensia.operators import evaluate as ev
from propensia.operators import learned, quality, rules, sets, windows
from propensia.operators.quantiles import approx_quantiles, exact_quantiles
from propensia.sources import delimited
from propensia.streaming.ingest import ingest_landed_files

REFERENCE = dt.date(2025, 12, 31)


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_french_amounts(spark):
    texts = ["5126,34", "-12,5", "0", None, "1 234,5", "1.234,5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(fr_decimal("t")).collect()]
    assert got == [5126.34, -12.5, 0.0, None, None, None]


def test_french_dates(spark):
    df = spark.createDataFrame([(0, "01/11/2023"), (1, "2024-01-01"), (2, None)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(fr_date("t")).collect()] == [dt.date(2023, 11, 1), None, None]


def test_latest_snapshot_is_chronological_not_alphabetical(spark):
    df = spark.createDataFrame([("1", "53", "01/11/2023"), ("1", "09", "01/02/2025")], "k string, code string, d string")
    assert values(windows.latest_per_key(df, ["k"], fr_date("d")), "code") == [("09",)]


def test_latest_snapshot_breaks_ties_the_same_way(spark):
    rows = [("1", c, "01/01/2025") for c in "dbca"]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, code string, d string").repartition(3)
        assert values(windows.latest_per_key(df, ["k"], fr_date("d")), "code") == [("a",)]


def test_active_subscription_wins(spark):
    df = spark.createDataFrame([
        ("7", "01/01/2020", None), ("7", "01/01/2024", "01/06/2024"), ("8", "01/01/2021", "02/01/2021"), ("8", "01/01/2023", "02/01/2023"),
    ], "k string, start string, end string")
    got = windows.active_first_per_key(df, ["k"], fr_date("start"), "end")
    assert sorted(values(got, "k", "start")) == [("7", "01/01/2020"), ("8", "01/01/2023")]


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = windows.first_per_key(df, ["k"], [F.col("v").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_union_with_missing_columns(spark):
    a = spark.createDataFrame([("1", "5")], "RADICAL string, MONTANT string")
    b = spark.createDataFrame([("2", "031")], "RADICAL string, CODE_FONCT string")
    united = sets.union_by_name([a, b])
    assert united.columns == ["RADICAL", "MONTANT", "CODE_FONCT"]
    assert united.filter("CODE_FONCT is null").count() == 1 and united.filter("MONTANT is null").count() == 1


def test_flow_without_movement_counts_as_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", 10.0), ("a", 0.0)], "k string, amount double")
    mean, total, months = values(ag.flow_summary(df, "k", "amount"), "flux_cred_moyen", "flux_cred_total", "nb_mois_avec_flux")[0]
    assert (round(mean, 4), total, months) == (3.3333, 10.0, 1)


def test_absent_client_has_zero_counts_and_unknown_means(spark):
    base = spark.createDataFrame([("1",)], "k string")
    ops = spark.createDataFrame([("2", 5.0, dt.datetime(2025, 3, 1))], "k string, amount double, at timestamp")
    joined = base.join(ag.operations_summary(ops, "k", "amount", "at", REFERENCE), "k", "left")
    out = rules.missing_flags(rules.fill_zero(joined, ["nb_operations_gab", "montant_total_gab"]), {"jamais_utilise_gab": "derniere_operation_gab"})
    assert values(out, "nb_operations_gab", "montant_total_gab", "montant_moyen_gab", "recence_gab_jours", "jamais_utilise_gab") == [(0, 0.0, None, None, 1)]


def test_age_and_recency(spark):
    df = spark.createDataFrame([(0, dt.date(1990, 1, 1)), (1, dt.date(2010, 1, 1)), (2, dt.date(1920, 6, 1))], "i int, d date")
    assert [r[0] for r in df.orderBy("i").select(age_years("d", REFERENCE)).collect()] == [35, 15, 105]
    one = spark.createDataFrame([(dt.date(2025, 3, 1),)], "d date")
    assert one.select(recency_days("d", REFERENCE)).first()[0] == 305


def test_age_rule_drops_training_rows_only(spark):
    df = spark.createDataFrame([("01/01/1990",), ("01/01/2010",), ("01/06/1920",), (None,), ("x",)], "b string")
    assert rules.keep_plausible_age(df, "b", REFERENCE, True).count() == 1
    assert rules.keep_plausible_age(df, "b", REFERENCE, False).count() == 5


def test_relative_volatility(spark):
    df = spark.createDataFrame([(0, 100.0, 20.0, 40.0), (1, 1.0, 0.0, -5.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 0.0, None)], "i int, hi double, lo double, m double")
    out = rules.relative_volatility(df, "hi", "lo", "m", "v", "u").orderBy("i")
    assert values(out, "v", "u") == [(2.0, 0), (None, 1), (None, 1), (None, 0)]


def test_zero_inflated_bounds(spark):
    df = spark.createDataFrame([(0.0,)] * 12 + [(float(i),) for i in range(1, 13)], "x double")
    assert values(learned.detect_zero_inflated(df, ["x"]), "column", "zero_share") == [("x", 0.5)]
    assert values(learned.fit_iqr_bounds(df, ["x"]), "colonne", "borne_min", "borne_max") == [("x", -6.0, 18.0)]


def test_zero_share_counts_null_rows(spark):
    df = spark.createDataFrame([(0.0,), (None,), (None,), (3.0,)], "x double")
    assert values(ag.zero_shares(df, ["x"]), "zero_share") == [(0.25,)]


@pytest.mark.parametrize("rows", [[5.0] * 20, [1.0, 2.0, 3.0]])
def test_bounds_skipped_leave_the_column_alone(spark, rows):
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    bounds = learned.fit_iqr_bounds(df, ["x"])
    assert bounds.count() == 0
    assert learned.apply_bounds(df, bounds).columns == ["x"]


def test_winsorise_keeps_null_and_is_idempotent(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    bounds = learned.fit_iqr_bounds(df, ["x"])
    once = learned.apply_bounds(df, bounds)
    low, high = learned.as_bounds(bounds)["x"]
    assert once.filter("x is null").select("x_etait_extreme").first()[0] == 0
    assert once.filter((F.col("x") < low) | (F.col("x") > high)).count() == 0
    assert once.agg(F.sum("x_etait_extreme")).first()[0] == 1
    twice = learned.apply_bounds(once.drop("x_etait_extreme"), bounds)
    assert sorted(map(str, twice.select("x").collect())) == sorted(map(str, once.select("x").collect()))


def test_flag_pruning_keeps_rare_flags_tied_to_the_label(spark):
    # 1000 rows, 20 % positive; a: 2 % with lift 1; b: 2 % with lift 2; c: 10 %; d: never on.
    rows = [(i, int(i % 5 == 0), int(i < 20), int(i < 60 and (i % 5 == 0 or i % 5 == 1) and i // 5 < 10), int(i % 10 == 0), 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, y int, a_etait_extreme int, b_etait_extreme int, c_etait_extreme int, d_etait_extreme int")
    flags = [c for c in df.columns if c.endswith("_etait_extreme")]
    lifts = {r["flag"]: (r["rate"], r["lift"]) for r in learned.flag_lift(df, flags, "y").collect()}
    assert lifts["a_etait_extreme"] == (0.02, 1.0)
    assert lifts["b_etait_extreme"][0] == 0.02 and lifts["b_etait_extreme"][1] == pytest.approx(2.5)
    assert lifts["d_etait_extreme"] == (0.0, None)
    dropped = {r[0] for r in learned.fit_flags_to_drop(df, flags, "y").collect()}
    assert dropped == {"a_etait_extreme", "d_etait_extreme"}
    without_label = {r[0] for r in learned.fit_flags_to_drop(df, flags).collect()}
    assert without_label == {"a_etait_extreme", "b_etait_extreme", "d_etait_extreme"}


def test_constant_columns(spark):
    df = spark.createDataFrame([("x", None, "a", "x"), ("x", None, "b", None)], "one string, nothing string, two string, holes string")
    assert sorted(values(learned.detect_constant_columns(df, df.columns), "colonne")) == [("nothing",), ("one",)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 95 + [(1,)] * 5, "y int")
    inverse = dict(values(learned.class_weights(df, "y", softened=False), "y", "poids_classe"))
    softened = dict(values(learned.class_weights(df, "y"), "y", "poids_classe"))
    assert (round(inverse[0], 4), inverse[1]) == (0.5263, 10.0)
    assert (round(softened[0], 4), round(softened[1], 4)) == (0.7255, 3.1623)
    assert 95 * inverse[0] + 5 * inverse[1] == pytest.approx(100)


def test_skewness_band(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert values(ag.skewness_bands(df, ["x"], 6), "skewness", "band") == [(1.763633, "strongly asymmetric")]


def test_average_ties(spark):
    df = spark.createDataFrame([("f", 20.0), ("f", 20.0), ("f", 10.0), ("f", 5.0)], "f string, v double")
    assert sorted(r["rank"] for r in windows.average_rank(df, ["f"], "v").collect()) == [1.5, 1.5, 3.0, 4.0]


def test_cramers_v_two_by_two(spark):
    rows = [("a", 0)] * 30 + [("a", 1)] * 10 + [("b", 0)] * 10 + [("b", 1)] * 30
    df = spark.createDataFrame(rows, "c string, y int")
    assert values(assoc.cramers_v(df, ["c"], "y"), "cramers_v", "n_modalites", "n") == [(0.464432, 2, 80)]


def test_point_biserial_skips_constant_and_short_columns(spark):
    rows = [(float(i), 1.0, float(i) if i < 10 else None, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, constant double, short double, y int")
    got = assoc.point_biserial(df, ["x", "constant", "short"], "y").collect()
    assert [r["feature"] for r in got] == ["x"]
    r, n = got[0]["r"], got[0]["n"]
    assert got[0]["t"] == pytest.approx(r * ((n - 2) / (1 - r * r)) ** 0.5, abs=1e-3)


TIED = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)]


def test_roc_with_ties(spark):
    df = spark.createDataFrame(TIED, "y int, s double")
    points = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(df, "y", "s").collect())
    assert points == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert ev.roc_auc(df, "y", "s").first()["auc"] == 0.625


def test_best_threshold(spark):
    df = spark.createDataFrame(TIED, "y int, s double")
    assert tuple(ev.best_threshold(df, "y", "s").first()) == (0.5, 0.8)


def test_grid_matches_direct_count(spark):
    rows = [(i % 3 == 0, (i * 37 % 101) / 100.0) for i in range(500)] + [(True, 0.05), (False, 0.95), (True, 0.07), (True, 0.29)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "y int, s double")
    for grid in (ev.FINE_GRID, ev.COARSE_GRID):
        start, step, points = grid
        got = {r["grid_index"]: (r["tp"], r["fp"]) for r in ev.threshold_grid(df, "y", "s", grid).collect()}
        assert len(got) == points
        for i in range(points):
            t = start + i * step
            assert got[i + 1] == (sum(1 for y, s in rows if y and s >= t), sum(1 for y, s in rows if not y and s >= t))


def test_grid_best_takes_the_lowest_threshold(spark):
    df = spark.createDataFrame(TIED, "y int, s double")
    best = ev.best_of_grid(ev.threshold_grid(df, "y", "s")).first()
    assert (best["threshold"], best["f1"]) == (0.11, 0.8)


def test_fill_forms(spark):
    df = spark.createDataFrame([(None, None)], "t string, n bigint")
    assert values(rules.fill_constants(df, {"t": 0, "n": 0}), "t", "n") == [("0", 0)]


def test_category_repair(spark):
    df = spark.createDataFrame([("FÃ©minin",), ("Féminin",), ("Masculin",), ("?",), (None,)], "g string")
    repaired = rules.repair_categories(df, "g", {"F": ("FÃ©minin", "Féminin"), "M": ("Masculin",)})
    assert [r[0] for r in repaired.collect()] == ["F", "F", "M", None, None]


def test_exact_quantiles_and_heavy_ties(spark):
    # A third of all rows share one value; NULLs do not count.
    data = [7.0] * 400 + [float(i) for i in range(800)] + [None] * 50
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(5)
    known = sorted(x for x in data if x is not None)
    got = exact_quantiles(df, ["x"], {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}).first()
    import math

    for name, p in (("a", 0.01), ("b", 0.25), ("c", 0.5), ("d", 0.99)):
        assert got[name] == known[max(1, math.ceil(p * len(known))) - 1]
    import numpy as np

    smooth = exact_quantiles(df, ["x"], {"b": 0.25, "c": 0.33}, interpolate=True).first()
    assert smooth["b"] == pytest.approx(np.quantile(known, 0.25)) and smooth["c"] == pytest.approx(np.quantile(known, 0.33))
    rough = approx_quantiles(df, ["x"], {"c": 0.5}).first()
    assert rough["n"] == len(known)


def test_exact_sums_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([("k", i * 0.1) for i in range(1000)], "k string, v double")
    sums = {df.repartition(n).groupBy("k").agg(exact_sum("v").alias("s"), exact_mean("v").alias("m")).first()[1] for n in (1, 3, 7)}
    assert len(sums) == 1


def test_row_numbers_are_consecutive(spark):
    df = spark.createDataFrame([(i * i,) for i in range(300)], "i bigint").repartition(6)
    got = windows.row_numbers(df, "i").orderBy("i").collect()
    assert [r["row_index"] for r in got] == list(range(300))


def test_quality_gates_raise(spark):
    df = spark.createDataFrame([("1",), ("1",), ("2",)], "k string")
    with pytest.raises(quality.QualityError):
        quality.require_unique_keys({"t": df}, "k")
    quality.require_unique_keys({"t": df.distinct()}, "k")
    with pytest.raises(quality.QualityError):
        quality.require_row_conservation(df, df.distinct())


def test_exclusivity_tells_snapshots_from_codes(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "a"), ("2", "b"), ("3", "a")], "k string, c string")
    assert tuple(quality.exclusivity(df, "k", "c").first()) == (2, 1)


def test_hot_key_and_null_family(spark):
    # One key holds a third of the rows and one family is NULL.
    rows = [(0 if i % 3 == 0 else i, None if i % 7 == 0 else "f", float(i % 11)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, family string, v double").repartition(6)
    first = windows.first_per_key(df, ["k"], [F.col("v").desc()])
    assert first.count() == len({k for k, _, _ in rows})
    assert first.filter("k = 0").first()["v"] == max(v for k, _, v in rows if k == 0)
    ranked = windows.average_rank(df, ["family"], "v").collect()
    assert len(ranked) == len(rows)
    for family in (None, "f"):
        vs = [v for _, f, v in rows if f == family]
        for r in (r for r in ranked if r["family"] == family):
            assert r["rank"] == sum(1 for v in vs if v > r["v"]) + (vs.count(r["v"]) + 1) / 2


def test_quantiles_by_group_and_infinite_values(spark):
    import math

    rows = [("a" if i % 2 else None, float(i)) for i in range(200)] + [("a", float("inf")), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["m"]) for r in exact_quantiles(df, ["x"], {"m": 0.5}, by=["g"]).collect()}
    for g in ("a", None):
        known = sorted(v for k, v in rows if k == g and not math.isnan(v))
        assert got[g] == (len(known), known[math.ceil(len(known) / 2) - 1])
    top = exact_quantiles(df, ["x"], {"top": 1.0, "low": 0.0}).first()
    assert (top["top"], top["low"], top["n"]) == (float("inf"), 0.0, 201)


# ---- nothing is lost on the way --------------------------------------------------

def test_amounts_keep_their_decimals(spark):
    df = spark.createDataFrame([("a", 0.004), ("a", 0.003), ("b", 1e15), ("b", float("nan")), ("b", None), ("c", -2.5)], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(exact_sum("v").alias("s"), exact_mean("v").alias("m")).collect()}
    assert got == {"a": (0.007, 0.0035), "b": (1e15, 1e15), "c": (-2.5, -2.5)}
    out = values(ag.balance_summary(df.filter("k = 'a'"), "k", "v"), "solde_moyen", "solde_min")
    assert out == [(0.0035, 0.003)]


def test_french_nan_is_null(spark):
    assert spark.createDataFrame([("NaN",)], "t string").select(fr_decimal("t")).first()[0] is None


def _file(path, text, encoding="iso-8859-1"):
    path.write_bytes(text.encode(encoding))


def test_files_are_read_by_their_headers(spark, tmp_path):
    _file(tmp_path / "a.txt", "MONTANT;RADICAL\n1,5;7\n")
    _file(tmp_path / "b.txt", "RADICAL;MONTANT;PÉRIODE\n8;2,5;été\n")
    df = delimited.read_delimited(spark, str(tmp_path / "*.txt"), ["RADICAL", "MONTANT", "PÉRIODE"])
    assert sorted(map(tuple, df.collect())) == [("7", "1,5", None), ("8", "2,5", "été")]
    assert sorted(map(tuple, delimited.read_delimited(spark, str(tmp_path)).select("RADICAL", "MONTANT").collect())) == [("7", "1,5"), ("8", "2,5")]
    assert [tuple(r) for r in delimited.search_columns(spark, str(tmp_path), "période").collect()] == [("b.txt", "PÉRIODE")]
    assert {tuple(r) for r in delimited.sniff_separator(spark, str(tmp_path)).collect()} == {("a.txt", ";", 2), ("b.txt", ";", 3)}
    inventory = {r.file: (r.columns, r.n_rows, r.preview) for r in delimited.file_inventory(spark, str(tmp_path)).collect()}
    assert inventory["b.txt"] == (["RADICAL", "MONTANT", "PÉRIODE"], 1, ["8;2,5;été"])


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    _file(tmp_path / "x.csv", "v\n" + "\n".join("2.75" if i == 1717 else str(i) for i in range(3000)) + "\n")
    df = delimited.read_typed_csv(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("v", "double")] and df.filter("v = 2.75").count() == 1


def test_stream_refuses_a_swapped_header(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    _file(landing / "a.csv", "MONTANT;RADICAL\n1,5;7\n")
    with pytest.raises(Exception):
        ingest_landed_files(spark, str(landing), str(tmp_path / "t"), str(tmp_path / "c"), ["RADICAL", "MONTANT"])


def test_both_names_of_an_amount_count(spark):
    df = spark.createDataFrame([("1", None), (None, "2"), ("3", "4")], ["TOTAL_TTC/100", "TOTAL_TTC"])
    assert sorted(r[0] for r in rules.resolve_column(df, ["TOTAL_TTC", "TOTAL_TTC/100"], "TOTAL_TTC").collect()) == ["1", "2", "4"]


def test_nan_has_no_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)] + [(float("nan"),), (None,)], "v double")
    assert sorted(values(ag.histogram(df, ["v"], 4), "bin", "n")) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert values(ag.min_max_mean(df, ["v"]), "min", "max", "mean") == [(0.0, 7.0, 3.5)]


def test_null_takes_no_place_in_the_top(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [("a", 1)] * 3 + [("b", 0)] * 2 + [("c", 0)], "c string, y int")
    assert [r[0] for r in ag.top_categories(df, "c", 2).collect()] == ["a", "b"]
    assert {r[0] for r in ag.top_crosstab(df, "c", "y", 2).collect()} == {"a", "b"}


def test_scoring_keeps_every_client(spark):
    from propensia.operators import models

    rows = [(i, float(i), "x" if i % 2 else "y", int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v double, c string, y int")
    spec = models.FeatureSpec("y", ["v"], ["c"], ids=("id",))
    model = models.fit_model(df, spec, models.decision_tree())
    new = spark.createDataFrame([(1, 1.0, "x"), (2, None, "x"), (3, float("nan"), "y"), (4, 2.0, None)], "id long, v double, c string")
    got = {r.id: (r.label_predit, r.probability_classe1) for r in models.batch_score(new, model, 0.5, spec).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == (None, None) and None not in (*got[1], *got[4])


def test_every_small_class_is_filled_up(spark):
    from propensia.operators.resample import smotenc

    rows = [(i, float(i), "a", "k0") for i in range(9)] + [(20 + i, 100.0 + i, "b", "k1") for i in range(3)] + [(40, 7.0, "c", "k2")]
    df = spark.createDataFrame(rows, "id long, v double, y string, k string")
    new = smotenc(df, "id", "y", ["v"], ["k"], k=2)
    got = {r.y: (r.n, r.lo, r.hi, r.k) for r in new.groupBy("y").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("k").alias("k")).collect()}
    assert got["b"][0] == 6 and 100.0 <= got["b"][1] <= got["b"][2] <= 102.0 and got["b"][3] == "k1"
    assert got["c"] == (8, 7.0, 7.0, "k2") and set(got) == {"b", "c"}


def test_correlations_of_many_columns(spark):
    import random

    rng = random.Random(1)
    rows = [tuple(rng.gauss(0, 1) if rng.random() > 0.1 else None for _ in range(12)) + (5.0, None) for _ in range(300)]
    names = [f"c{i}" for i in range(14)]
    got = {(r.variable_1, r.variable_2): r.correlation for r in assoc.correlation_pairs(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names).collect()}
    for i in range(12):
        for j in range(i + 1, 12):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            mx, my = (sum(v) / len(both) for v in zip(*both))
            cov = sum((x - mx) * (y - my) for x, y in both)
            r = cov / (sum((x - mx) ** 2 for x, _ in both) * sum((y - my) ** 2 for _, y in both)) ** 0.5
            assert got[f"c{i}", f"c{j}"] == pytest.approx(r, abs=1e-6)
    assert got["c0", "c12"] is None and got["c0", "c13"] is None and len(got) == 91


def test_copies_do_not_multiply_the_search(spark):
    from propensia.operators.neighbours import nearest_neighbours

    rows = [(i, [1.0, 1.0]) for i in range(50)] + [(100, [2.0, 1.0]), (101, [5.0, 1.0])]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", k=3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, r.distance))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, 0.0)] and got[49] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert got[100] == [(0, 1.0), (1, 1.0), (2, 1.0)] and got[101] == [(100, 3.0), (0, 4.0), (1, 4.0)]
