"""The state kept file by file beside a build over all files."""

import pytest
from pyspark.sql import functions as F

from propensia.catalog import roles
from propensia.operators import partials
from propensia.operators.windows import first_per_key
from propensia.plans.dataset import build_dataset
from propensia.plans.yearly import YearlyDataset
from propensia.sources.versioned import BucketedState

SF = "/root/testdata/sf0.001"


def totals(rows, keys):
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, n bigint, last int")


def stored(state):
    return sorted(((r["k"], r["n"], r["last"]) for r in state.read().collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), "k", totals, 16)
    assert state.read() is None
    many = [(f"c{i}", 1, i) for i in range(200)]
    assert state.take("2023", rows(spark, *many)) == 16
    before = dict(state.versions)
    assert state.take("2024", rows(spark, ("c5", 10, 1000), ("c5", 1, 3))) == 1
    assert sum(before[b] != state.versions[b] for b in before) == 1
    want = {k: (n, last) for k, n, last in many}
    want["c5"] = (12, 1000)
    assert {k: (n, last) for k, n, last in stored(state)} == want


def test_a_source_counts_once_and_states_reopen(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), "k", totals, 4)
    state.take("a", rows(spark, ("x", 1, 1), (None, 5, 1)))
    again = BucketedState(spark, str(tmp_path), "k", totals, 999)  # the number of buckets is the first one
    assert again.buckets == 4 and again.take("a", rows(spark, ("x", 1, 1))) == 0
    again.take("b", rows(spark, ("x", 2, 0), (None, 1, 7)))
    assert stored(again) == sorted([("x", 3, 1), (None, 6, 7)], key=str)


def test_an_empty_source_is_entered(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path), "k", totals, 4)
    assert state.take("none", rows(spark, ("x", 1, 1)).limit(0)) == 0
    assert state.sources == ["none"] and state.read().count() == 0
    state.take("some", rows(spark, ("x", 1, 1)))
    assert stored(state) == [("x", 1, 1)]


def test_a_failure_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    state = BucketedState(spark, str(tmp_path), "k", totals, 4)
    state.take("a", rows(spark, ("x", 1, 1), ("y", 1, 1)))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(BucketedState, "_commit", fail)
        with pytest.raises(OSError):
            state.take("b", rows(spark, ("x", 5, 5)))
    reopened = BucketedState(spark, str(tmp_path), "k", totals, 4)
    assert reopened.sources == ["a"] and stored(reopened) == [("x", 1, 1), ("y", 1, 1)]
    reopened.take("b", rows(spark, ("x", 5, 5)))
    assert stored(reopened) == [("x", 6, 5), ("y", 1, 1)]
    # What the failure and the older versions left is no longer named by the manifest.
    assert reopened.vacuum() >= 2
    assert stored(reopened) == [("x", 6, 5), ("y", 1, 1)] and reopened.vacuum() == 0


def test_the_second_of_two_writers_stops(spark, tmp_path):
    first, second = (BucketedState(spark, str(tmp_path), "k", totals, 4) for _ in range(2))
    first.take("a", rows(spark, ("x", 1, 1)))
    with pytest.raises(RuntimeError, match="another update"):
        second.take("b", rows(spark, ("x", 1, 1)))
    assert BucketedState(spark, str(tmp_path), "k", totals, 4).sources == ["a"]


def test_new_columns_and_winners_of_an_order(spark, tmp_path):
    def newest(df, keys):
        return first_per_key(df, keys, [F.col("day").desc()])

    state = BucketedState(spark, str(tmp_path), "k", newest, 4)
    old = spark.createDataFrame([("x", 1, "p"), ("y", 9, "q"), ("z", 2, "b"), ("z", 2, "a")], "k string, day int, pack string")
    new = spark.createDataFrame([("x", 2, "r", "A"), ("y", 3, "s", "B")], "k string, day int, pack string, state string")
    state.take("old", old)
    state.take("new", new)
    assert sorted(tuple(r) for r in state.read().select("k", "day", "pack", "state").collect()) == [
        ("x", 2, "r", "A"), ("y", 9, "q", None), ("z", 2, "a", None)]


def test_parts_of_parts_are_the_parts_of_all(spark):
    df = spark.createDataFrame(
        [("x", 0.1, 0), ("x", 0.2, 1), ("x", None, 1), ("x", -5.25, 2), ("y", None, 0), ("z", float("nan"), 1), ("z", 3.0, 2), (None, 1.0, 0)],
        "k string, amount double, part int")
    whole = partials.movement_parts(df, ["k"], "amount")
    pieces = [partials.movement_parts(df.filter(F.col("part") == p), ["k"], "amount") for p in range(3)]
    merged = partials.merge_parts(pieces[0].union(pieces[1]).union(pieces[2]), ["k"])
    assert sorted(map(str, merged.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert {r["k"]: r["depot_moyen"] for r in partials.deposit_of_parts(merged, "k").collect()} == {
        "x": pytest.approx(-1.65), "y": None, "z": 3.0, None: 1.0}


def test_dataset_kept_in_any_order_equals_the_full_build(spark, tmp_path):
    files = roles.raw_files(spark, SF)
    kept = YearlyDataset(spark, str(tmp_path), codes=roles.CODES, buckets=4)
    with pytest.raises(ValueError, match="no file of solde"):
        kept.feature_table("solde")
    movements = ("solde", "depot", "flux", "gab", "retrait", "payfac", "vignette")
    # Movements in reverse order: their sums do not depend on it.
    kept.take_all({t: [(f"{t}-{i}", df) for i, df in (list(enumerate(fs))[::-1] if t in movements else list(enumerate(fs)))] for t, fs in files.items()})
    full = build_dataset(roles.raw_tables(spark, SF), codes=roles.CODES)
    got = kept.dataset()
    assert set(got.columns) == set(full.columns)
    got = got.select(full.columns)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    # A second run over the same files, from the manifests alone, takes nothing.
    again = YearlyDataset(spark, str(tmp_path), codes=roles.CODES)
    assert again.take_all({t: [(f"{t}-{i}", df) for i, df in enumerate(fs)] for t, fs in files.items()}) == 0
