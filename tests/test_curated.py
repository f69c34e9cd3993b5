"""Curated tables in buckets, gates counted by the writes, stored sketches."""

import uuid

import pytest
from pyspark.sql import functions as F

from propensia.operators import gates, sketches
from propensia.operators.joins import left_join_chain
from propensia.operators.quality import QualityError
from propensia.plans import curated as cu
from propensia.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large_tables(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def name():
    return f"t_{uuid.uuid4().hex}"


def test_chain_over_buckets_has_no_exchange(spark, tmp_path, large_tables):
    base = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("a"))
    features = [spark.range(i, 1000, 3).select(F.col("id").cast("string").alias("k"), F.lit(i).alias(f"f{i}")) for i in (1, 2)]
    tables = [store.save_bucketed(df, name(), f"{tmp_path}/{i}", "k", 8) for i, df in enumerate([base, *features])]
    joined = left_join_chain(tables[0], tables[1:], "k")
    assert "Exchange" not in plan(joined)
    assert "Exchange" in plan(left_join_chain(base, features, "k"))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left_join_chain(base, features, "k").collect()))
    # Grouping a curated table by its key needs none either.
    assert "Exchange" not in plan(tables[0].groupBy("k").agg(F.sum("a")))


def test_each_bucket_is_one_file(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    table = store.save_bucketed(df, name(), f"{tmp_path}/t", "k", 8)
    assert len(table.inputFiles()) == 8 and table.count() == 5000


def test_bucket_number_is_a_power_of_two():
    assert [store.bucket_number(n, 100) for n in (0, 800, 801, 1600, 1601)] == [8, 8, 16, 16, 32]


@pytest.mark.parametrize("rows, want", [
    ([], (0, 0)), ([("a",), ("b",)], (2, 0)), ([("a",), ("a",), ("a",), ("b",)], (4, 2)), ([(None,), (None,), ("a",)], (3, 1)),
])
def test_gate_counts_rows_and_surplus_without_a_job(spark, tmp_path, rows, want):
    df = spark.createDataFrame(rows, "k string")
    observed, seen = gates.observe_keys(df, "k", name(), 4)
    assert observed.columns == ["k"]
    tracker, group = spark.sparkContext.statusTracker(), uuid.uuid4().hex
    observed.write.parquet(f"{tmp_path}/t")
    spark.sparkContext.setJobGroup(group, "gate")
    assert (seen.get["n_rows"], seen.get["n_extra"]) == want
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    report = gates.key_report(spark, {"t": seen}).first()
    assert (report["n_rows"], report["n_keys"], report["n_extra"]) == (want[0], want[0] - want[1], want[1])


def test_broken_gates_stop_the_build(spark, tmp_path):
    base = spark.createDataFrame([("a",), ("b",)], "RADICAL string")
    good, good_seen = cu.write_bucketed(base, name(), f"{tmp_path}/good", "RADICAL", 4, "base")
    twice, twice_seen = cu.write_bucketed(base.union(base.limit(1)), name(), f"{tmp_path}/twice", "RADICAL", 4, "twice")
    gates.require_unique({"base": good_seen}, "RADICAL")
    with pytest.raises(QualityError, match="twice"):
        gates.require_unique({"base": good_seen, "twice": twice_seen}, "RADICAL")
    joined, seen = gates.observe_rows(left_join_chain(good, [twice.withColumn("x", F.lit(1))], "RADICAL"), "joined")
    joined.write.parquet(f"{tmp_path}/joined")
    with pytest.raises(QualityError, match="3 rows after the joins, 2 before"):
        gates.require_conserved(good_seen, seen)


# ---- sketches ------------------------------------------------------------------

QUARTERS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(40000).select(
        ((F.col("id") * 7919) % 40009).cast("double").alias("v"), (F.col("id") % 900).cast("string").alias("t"),
        F.when(F.col("id") % 4 != 0, F.col("id") + F.lit(2**60)).alias("w"), (F.col("id") < 20000).alias("first"))


def test_union_of_halves_is_the_sketch_of_the_whole(numbers):
    columns = ["v", "t", "w"]
    whole = sketches.column_sketches(numbers, columns)
    halves = sketches.unite(sketches.column_sketches(numbers, columns, by=["first"]))
    a = {r["column"]: r for r in sketches.estimates(whole, QUARTERS).collect()}
    b = {r["column"]: r for r in sketches.estimates(halves, QUARTERS).collect()}
    for c in columns:
        for exact in ("n_rows", "n_null", "low", "high"):
            assert a[c][exact] == b[c][exact]
        assert a[c]["n_distinct"] == b[c]["n_distinct"]  # the same registers
    assert a["w"]["n_null"] == 10000 and a["t"]["low"] is None and a["t"]["q50"] is None
    for c, n in (("v", 40000), ("t", 900), ("w", 30000)):
        assert abs(b[c]["n_distinct"] - n) <= 4 * 0.01625 * n
    values = sorted(r[0] for r in numbers.select("v").collect())
    for row in (a["v"], b["v"]):
        for q, p in QUARTERS.items():
            assert abs(sum(v <= row[q] for v in values) / len(values) - p) <= 0.01


def test_odd_columns(spark):
    df = spark.createDataFrame(
        [(float("nan"), None, 0.0), (1.0, None, -0.0), (None, None, 0.0)], "v double, `a.b` int, z double")
    got = {r["column"]: r for r in sketches.estimates(sketches.column_sketches(df, df.columns), QUARTERS).collect()}
    assert (got["v"]["n_null"], got["v"]["n_distinct"], got["v"]["q50"]) == (2, 1, 1.0)
    assert (got["a.b"]["n_null"], got["a.b"]["n_distinct"], got["a.b"]["q50"], got["a.b"]["low"]) == (3, 0, None, None)
    assert got["z"]["n_distinct"] == 1
    empty = {r["column"]: r for r in sketches.estimates(sketches.column_sketches(df.limit(0), df.columns), QUARTERS).collect()}
    assert all((r["n_rows"], r["n_distinct"], r["q50"]) == (0, 0, None) for r in empty.values())


def test_store_reads_new_files_only(spark, tmp_path):
    landing, kept = tmp_path / "in put%41", f"{tmp_path}/profiles"
    landing.mkdir()
    asked = []

    def read(paths):
        asked.append(sorted(paths))
        return spark.read.schema("a int, b string").csv(paths)

    def put(file, text):
        (landing / file).write_text(text)
        return str(landing / file)

    one, two = put("one.csv", "1,x\n2,y\n"), put("t+wo é.csv", "2,x\n,z\n")
    assert sketches.update_profiles(spark, kept, [one, two], read, ["a", "b"]) == 2
    assert sketches.update_profiles(spark, kept, [one, two], read, ["a", "b"]) == 0
    three, nothing = put("three.csv", "9,x\n"), put("nothing.csv", "")
    assert sketches.update_profiles(spark, kept, [one, two, three, nothing], read, ["a", "b"]) == 2
    assert asked == [sorted([one, two]), sorted([three, nothing])]
    per_file = {(r["file"], r["column"]): r["n_rows"] for r in sketches.read_profiles(spark, kept).collect()}
    assert per_file == {(f, c): n for f, n in ((one, 2), (two, 2), (three, 1), (nothing, 0)) for c in "ab"}
    united = {r["column"]: r for r in sketches.estimates(sketches.unite(sketches.read_profiles(spark, kept)), QUARTERS).collect()}
    assert (united["a"]["n_rows"], united["a"]["n_null"], united["a"]["n_distinct"], united["a"]["low"], united["a"]["high"]) == (5, 1, 3, 1.0, 9.0)
    assert united["b"]["n_distinct"] == 3


def test_a_failed_update_does_not_count(spark, tmp_path):
    kept = f"{tmp_path}/profiles"
    (tmp_path / "a.csv").write_text("1,x\n")
    file = str(tmp_path / "a.csv")
    read = lambda paths: spark.read.schema("a int, b string").csv(paths)
    sketches.update_profiles(spark, kept, [file], read, ["a"])
    done = next((tmp_path / "profiles").glob("batch=*/_SUCCESS"))
    # As after a failure between the files and the mark.
    done.unlink()
    assert sketches.read_profiles(spark, kept).count() == 0
    assert sketches.update_profiles(spark, kept, [file], read, ["a"]) == 1
    assert sketches.read_profiles(spark, kept).count() == 1
