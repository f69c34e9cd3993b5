"""First lines of many files, years of files with different headers, samples of exact size."""

import gzip

import pytest
from pyspark.sql import functions as F

from propensia.operators import sets
from propensia.sources import delimited
from propensia.sources.first_lines import first_line


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f {i} é%.csv").write_bytes(("\n\r\nclé;b" + ";x" * (i % 3) + ("\r\n" if i % 2 else "\n") + "1;2\n").encode("iso-8859-1"))
    files = delimited._read_files(spark, str(tmp_path))
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    found = delimited.headers(spark, files)
    jobs = sc.statusTracker().getJobIdsForGroup("headers")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and len(found) == 300
    assert sorted(set(found.values())) == ["clé;b", "clé;b;x", "clé;b;x;x"]


@pytest.mark.parametrize("body,encoding,want", [
    (b"", "utf-8", ""), (b"\n\n", "utf-8", ""), (b"a;b", "utf-8", "a;b"), (b"\xef\xbb\xbfa;\xc3\xa9\r\n1;2", "utf-8", "a;é"), (b"   \na;b\n", "utf-8", "a;b"),
    ("é;ü\n1;2\n".encode("utf-16"), "utf-16", "é;ü"), (("x" * 40_000 + "\ny").encode(), "utf-8", "x" * 40_000), (b"a\rb", "iso-8859-1", "a"),
])
def test_first_line(tmp_path, body, encoding, want):
    (tmp_path / "one file.csv").write_bytes(body)
    assert first_line(f"file:{tmp_path}/one%20file.csv", encoding) == want
    with gzip.open(tmp_path / "g.csv.gz", "wb") as f:
        f.write(body)
    assert first_line(str(tmp_path / "g.csv.gz"), encoding) == want


def test_stores_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes("hé;i\n1;2\n".encode("iso-8859-1"))
    monkeypatch.setattr(delimited, "can_open", lambda uri: False)
    assert list(delimited.headers(spark, delimited._read_files(spark, str(tmp_path))).values()) == ["hé;i"]


def test_file_year_over_two_headers(spark, tmp_path):
    (tmp_path / "solde_2023.csv").write_text("id;a\n1;x\n2;y\n")
    (tmp_path / "solde_2024.csv").write_text("id;b;a\n3;q;z\n")
    (tmp_path / "solde_2025.csv").write_text("id;a\n4;w\n")
    rows = delimited.read_with_file_year(spark, str(tmp_path), ["id", "a", "b"])
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x", None, 2023), ("2", "y", None, 2023), ("3", "z", "q", 2024), ("4", "w", None, 2025)]
    every = delimited.read_with_file_year(spark, str(tmp_path))
    assert set(every.columns) == {"id", "a", "b", "file_year"} and every.count() == 4


def test_exact_samples(spark):
    rows = spark.createDataFrame([(i, "big" if i % 10 else "small", i) for i in range(1000)] + [(None, None, 1), (5, "big", 5)], "k long, g string, v int").repartition(6)
    sizes = {r["g"]: r["count"] for r in sets.balanced_sample(rows, "g", "k").groupBy("g").count().collect()}
    assert sizes == {"big": 100, "small": 100}
    one = sets.exact_sample(rows, "g", {"big": 30, "small": 500}, "k", salt="s")
    assert {r["g"]: r["count"] for r in one.groupBy("g").count().collect()} == {"big": 30, "small": 100}
    again = sets.exact_sample(rows.repartition(2), "g", {"big": 30, "small": 500}, "k", salt="s")
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()
    assert sets.balanced_sample(rows.filter(F.lit(False)), "g", "k").count() == 0
