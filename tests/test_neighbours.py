"""Exact neighbours and Tomek links against brute force."""

import numpy as np
import pytest

from propensia.operators.neighbours import nearest_neighbours
from propensia.operators.resample import hashed_neighbours, smotenc, tomek_clean, tomek_links

SCHEMA = "id bigint, label int, vec array<double>"


def brute(points, k):
    out = set()
    for i, _, x in points:
        ranked = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, _, y in points if j != i)
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(ranked[:k])}
    return out


def brute_links(points):
    near = {i: j for i, j, r in brute(points, 1) if r == 1}
    label = {i: y for i, y, _ in points}
    return {(i, j) for i, j in near.items() if i < j and near[j] == i and label[i] != label[j]}


def cloud(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = np.round(rng.normal(size=(n, width)) + rng.integers(0, 4, size=(n, 1)) * 6, 3)
    rows[:copies] = rows[0]
    return [(int(i * 3 + 1), int(rng.integers(0, 3)), [float(v) for v in rows[i]]) for i in range(n)]


@pytest.mark.parametrize("k,block,width", [(1, 16, 2), (3, 16, 5), (5, 64, 3)])
def test_nearest_neighbours_match_brute_force(spark, k, block, width):
    points = cloud(300, width, seed=k)
    df = spark.createDataFrame(points, SCHEMA).repartition(4)
    got = nearest_neighbours(df, "id", "vec", k=k, block_rows=block, pivots=12)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(points, k)


def test_fewer_points_than_neighbours(spark):
    points = cloud(3, 2, seed=9)
    got = nearest_neighbours(spark.createDataFrame(points, SCHEMA), "id", "vec", k=5).collect()
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got} == brute(points, 5)


def test_tomek_hand_case(spark):
    rows = [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [1.4]), (3, 1, [5.0])]
    got = tomek_links(spark.createDataFrame(rows, SCHEMA), "id", "label", "vec").collect()
    assert [(r["id_a"], r["id_b"]) for r in got] == [(1, 2)]


@pytest.mark.parametrize("copies", [0, 100])
def test_tomek_links_match_brute_force_with_copies(spark, copies):
    points = cloud(300, 3, seed=5, copies=copies)
    got = tomek_links(spark.createDataFrame(points, SCHEMA).repartition(4), "id", "label", "vec")
    assert {(r["id_a"], r["id_b"]) for r in got.collect()} == brute_links(points)


def test_tomek_clean_keeps_minority_and_all_columns(spark):
    points = cloud(200, 2, seed=3)
    df = spark.createDataFrame(points, SCHEMA)
    links = tomek_links(df, "id", "label", "vec")
    cleaned = tomek_clean(df, links, "id", "label")
    sizes = {c: sum(1 for _, y, _ in points if y == c) for c in (0, 1, 2)}
    minority = min(sizes, key=lambda c: (sizes[c], c))
    ends = {i for pair in brute_links(points) for i in pair}
    expected = {i for i, y, _ in points if not (i in ends and y != minority)}
    assert set(cleaned.columns) == set(df.columns)
    assert {r["id"] for r in cleaned.collect()} == expected


def test_smotenc_balances_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 30), float(rng.normal()), float(rng.normal() * 5), "abc"[i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double, c string")
    made = smotenc(df, "id", "y", ["a", "b"], ["c"], k=5)
    got = made.collect()
    assert len(got) == 170 - 30
    minority = [r for r in rows if r[1] == 1]
    assert {r["y"] for r in got} == {1} and {r["c"] for r in got} <= {"a", "b", "c"}
    for name, i in (("a", 2), ("b", 3)):
        low, high = min(r[i] for r in minority), max(r[i] for r in minority)
        assert all(low - 1e-9 <= r[name] <= high + 1e-9 for r in got)
    again = smotenc(df.repartition(5), "id", "y", ["a", "b"], ["c"], k=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_hashed_neighbours_grow_in_proportion_and_keep_recall(spark):
    """One crowded bucket: rows compared grow about linearly, nine tenths of the nearest are found."""
    from propensia.operators.resample import hashed_neighbours

    for n in (1000, 2000, 4000):
        rng = np.random.default_rng(n)
        x = rng.random((n, 2))
        df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>").repartition(3)
        got = {r["id"]: r["distance"] for r in hashed_neighbours(df, bucket_length=100.0, tables=3, crowd=200).collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        hit = sum(abs(got.get(i, np.inf) - d[i].min()) < 1e-12 for i in range(n))
        assert hit >= 0.9 * n and len(got) == n


def test_hashed_links_of_copies_and_equal_projections(spark):
    from propensia.operators.resample import tomek_links_lsh

    points = cloud(300, 3, seed=5, copies=100)
    got = tomek_links_lsh(spark.createDataFrame(points, SCHEMA).repartition(4), "id", "label", "vec", bucket_length=50.0, crowd=40)
    want, links = brute_links(points), {(r["id_a"], r["id_b"]) for r in got.collect()}
    assert len(links & want) >= 0.9 * len(want) and len(links - want) <= 0.1 * len(want) + 1
    same = spark.createDataFrame([(i, 0, [float(i), 0.0]) for i in range(0)], SCHEMA)
    assert tomek_links_lsh(same, "id", "label", "vec", bucket_length=1.0).count() == 0


@pytest.mark.parametrize("k,n,width,codes", [(1, 900, 2, 0), (3, 600, 3, 0), (2, 500, 3, 1)])
def test_two_levels_of_pivots_match_brute_force(spark, k, n, width, codes):
    """More cells than one level of pivots names: same neighbours."""
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, width)) + rng.integers(0, 3, size=(n, 1)) * 8, 3)
    if codes:
        x[:, -1] = rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, 0, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA).repartition(4)
    got = nearest_neighbours(df, "id", "vec", k=k, block_rows=16, pivots=4, n_codes=codes, code_gap=2.5)
    lone = nearest_neighbours(df, "id", "vec", k=k, block_rows=16, pivots=4096, n_codes=codes, code_gap=2.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lone.collect()))
    if not codes:
        points = [(i, 0, list(row)) for i, row in enumerate(x.tolist())]
        assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(points, k)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k,pivots", [(1, 64), (3, 64), (1, 8)])
def test_vectors_without_structure_are_not_sent_to_every_block(spark, k, pivots):
    """Two levels of pivots and one: tasks read packs side by side, the answer is that of brute force."""
    rng = np.random.default_rng(k)
    points = [(i * 2, 0, [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(600, 24)))]
    got = nearest_neighbours(spark.createDataFrame(points, SCHEMA).repartition(3), "id", "vec", k=k, block_rows=16, pivots=pivots)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(points, k)
    assert "CartesianProduct" in plan_of(got)


def test_vectors_with_structure_are_still_sent_to_few_blocks(spark):
    points = cloud(900, 2, seed=4)
    got = nearest_neighbours(spark.createDataFrame(points, SCHEMA).repartition(3), "id", "vec", block_rows=16, pivots=64)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in got.collect()} == brute(points, 1)
    assert "CartesianProduct" not in plan_of(got)


def test_packs_side_by_side_with_codes(spark, monkeypatch):
    """Categories count as equal or different there too."""
    from propensia.operators import neighbours

    rng = np.random.default_rng(7)
    points = [(i, [float(v) for v in rng.normal(size=3)] + [float(rng.integers(0, 3))]) for i in range(120)]
    want = {}
    for i, x in points:
        want[i] = min((np.sqrt(sum((a - b) ** 2 for a, b in zip(x[:3], y[:3], strict=True)) + 0.5 * (x[3] != y[3])), j) for j, y in points if j != i)[1]
    monkeypatch.setattr(neighbours, "MOST_COPIES", 0)
    got = nearest_neighbours(spark.createDataFrame(points, "id bigint, vec array<double>"), "id", "vec", block_rows=16, n_codes=1, code_gap=0.5)
    assert {r["id"]: r["neighbour"] for r in got.collect()} == want


def test_hashed_places_are_settled_without_the_vectors(spark):
    """Strips and parts of crowded buckets move ids; the answer keeps to points that share a strip or lie beside it."""
    rng = np.random.default_rng(3)
    points = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(points, "id bigint, vec array<double>")
    got = {r["id"]: (r["neighbour"], r["distance"]) for r in hashed_neighbours(df, 50.0, tables=4, crowd=500).collect()}
    x = np.array([v for _, v in points])
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(len(x), np.inf))
    assert all(abs(got[i][1] - gaps[i, got[i][0]]) < 1e-9 for i in got)
    found = sum(got.get(i, (None,))[0] == int(gaps[i].argmin()) for i, _ in points)
    assert found >= 390  # buckets of both signs: a neighbour is missed only if all tables part them
    cut = {r["id"]: r["distance"] for r in hashed_neighbours(df, 50.0, tables=4, crowd=40).collect()}
    assert all(d >= gaps[i].min() - 1e-9 for i, d in cut.items()) and sum(abs(d - gaps[i].min()) < 1e-9 for i, d in cut.items()) >= 200
