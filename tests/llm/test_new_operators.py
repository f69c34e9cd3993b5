"""Phrase collocations, packing and whitening beside plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propensia.llm import collocations, packing, whitening
from propensia.session import materialise
from tests.llm.conftest import TABLES
from tests.llm.plain import LOWER

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- 11 collocations


def plain_collocations(rows, max_words=3, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(max_words, len(w) - i) + 1):
                    c = counts.setdefault(lang, Counter())
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        cover = {}
        for p, a in cand.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    cover[p[s : s + m]] = max(cover.get(p[s : s + m], 0), a)
        rows_ = []
        for p, a in cand.items():
            if p in cover and 100 * cover[p] >= 50 * a:
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_odd_rows(odd_docs, odd_rows):
    want = plain_collocations([(lang, t) for _, t, lang in odd_rows])
    assert len(want) > 300 and any(r[0] == "und" for r in plain_collocations([(None, "a b " * 20)]))
    assert found(collocations.collocations(odd_docs)) == want
    assert found(collocations.collocations(odd_docs, max_words=4, top=50)) == plain_collocations([(lang, t) for _, t, lang in odd_rows], max_words=4, top=50)


def test_collocations_given_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert found(collocations.collocations(docs)) == plain_collocations([tuple(r) for r in docs.select("lang", "text").collect()])


def test_collocations_edges(spark, no_docs):
    assert found(collocations.collocations(no_docs)) == []
    rows = [("x y " * 30, None), ("x y", "und"), (None, "en"), ("", "en"), ("  \t.;", "en"), ("a\tb\x0bc\x85d\x1ce " * 12, "en"), ("a\tb" + "." * 5000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(collocations.collocations(docs)) == plain_collocations([(lang, t) for t, lang in rows])


def test_collocations_small_pieces_and_heavy_words(spark, odd_docs, odd_rows, monkeypatch):
    """Many task pieces, many buckets, and one pair that makes up a third of all words."""
    monkeypatch.setattr(collocations, "POINTERS", 300)
    monkeypatch.setattr(collocations, "BUCKET_KEYS", 500)
    rows = [(lang, t) for _, t, lang in odd_rows] + [("en", "alpha beta " * 200 + f"w{i} alpha gamma.") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    # closures carry module values by reference; the functions themselves are called here as tasks call them
    batches = [b for b in docs.select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit("")).cast("binary")).toArrow().to_batches(max_chunksize=7)]
    totals = Counter()
    for b in collocations._heavy(iter(batches)):
        for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            totals[lang, word] += n
    everything = sum(n for (_, w), n in totals.items() if w is None)
    heavy = {}
    for (lang, w), n in totals.items():
        if w is not None and n * collocations.SHARE >= everything:
            heavy.setdefault(lang, set()).add(w)
    dealt = []
    for b in collocations._route(heavy, 11, 3)(iter(batches)):
        dealt += zip(*(c.to_pylist() for c in b.columns), strict=True)
    pair = [d for d in dealt if d[1] == "en" and b"alpha" in d[2] and b"beta" in d[2]]
    assert len({d[0] for d in pair}) > 3  # the pair is spread
    import pyarrow as pa

    f = Counter()
    for k in range(11):
        mine = sorted((d for d in dealt if d[0] == k), key=lambda d: d[1])
        if mine:
            batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*mine, strict=True)], ["bucket", "lang", "keys"])
            for out in collocations._count(heavy, 3, 10)(iter([batch])):
                for lang, phrase, n_words, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    f[lang, phrase, n_words] += n
    want = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for n in range(1, min(3, len(w) - i) + 1):
                    want[lang or "und", " ".join(w[i : i + n]), n] += 1
    assert {k: v for k, v in f.items() if v >= 10} == {k: v for k, v in want.items() if v >= 10}


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(4)
    for _ in range(20):
        symbols = np.append(rng.integers(0, 6, 400), [0] * 4).astype(np.int32)
        pointers = np.flatnonzero(symbols)
        want = Counter()
        for p in pointers:
            for d in range(1, 5):
                key = tuple(symbols[p : p + d])
                if 0 in key:
                    break
                want[key] += 1
        length, head, n = collocations.equal_partitions(symbols, pointers, np.ones(len(pointers), np.int64), 4, 3, np.zeros(6, bool))
        got = {tuple(symbols[p : p + d]): c for d, p, c in zip(length.tolist(), head.tolist(), n.tolist(), strict=True)}
        assert len(got) == len(length) and got == {k: v for k, v in want.items() if v >= 3}


# ---- 12 packing


def check_packing(rows, docs_rows, size=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in docs_rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k in range(-(-len(ids) // size)):
            n = (len(ids) - 1) % size + 1 if k == 0 else size
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((r[:5] for r in rows), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r[5], []).append((r[6], r[3]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by_sequence), -(-sum(r[3] for r in rows) // size)


def packed(df):
    return [tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]


def test_packing_odd_and_given(spark, odd_docs, odd_rows, given, no_docs):
    used, bound = check_packing(packed(packing.pack(odd_docs, RANKS, public_tokenizers.PATTERN)), [(i, t) for i, t, _ in odd_rows])
    assert used <= bound + 1
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").repartition(7)
    used, bound = check_packing(packed(packing.pack(docs, RANKS, public_tokenizers.PATTERN)), given)
    assert used <= bound * 1.01 + 1
    assert packed(packing.pack(no_docs, RANKS, public_tokenizers.PATTERN)) == []


def test_packing_special_strings_repeats_and_sequences(spark):
    rows = [(None, "a<|endoftext|> b"), (None, "a<|endoftext|> b"), (7, "x" * 70_000), (7, None), (8, ""), (9, " \n " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs, RANKS, public_tokenizers.PATTERN, size=64, with_ids=True)
    check_packing(packed(out), rows, size=64)
    whole = {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    for r in out.collect():
        assert zlib.crc32(whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"]
    assert all(len(r["ids"]) == 4 * r["length"] <= 256 for r in whole.values())
    with pytest.raises(ValueError):
        packing.pack(docs, RANKS, public_tokenizers.PATTERN, size=0)


def test_plan_uses_every_piece_and_stays_near_the_bound():
    rng = np.random.default_rng(2)
    cases = [np.bincount(rng.integers(1, 513, 20_000), minlength=513), np.bincount(rng.integers(1, 20, 5_000), minlength=513), rng.integers(0, 2, 513)]
    cases[2][0] = 0
    for h, slack in zip(cases, (0.01, 0.0, 0.03), strict=True):
        plan = packing.plan(h)
        used = np.zeros_like(h)
        for lengths, repeats in plan:
            assert sum(lengths) <= 512 and repeats > 0
            np.add.at(used, lengths, repeats)
        assert (used == h).all()
        bound = -(-int((np.arange(513) * h).sum()) // 512)
        assert sum(r for _, r in plan) <= bound * (1 + slack) + 1
    slots = packing.slots(packing.plan(cases[0]))
    assert len(slots) < 5 * 513  # the plan does not grow with the pieces
    assert packing.plan(np.zeros(9, np.int64)) == []


def test_least_squares_recovers_planted_patterns():
    rng = np.random.default_rng(3)
    patterns = packing.triples(np.arange(1, 65), 64)
    chosen = rng.choice(len(patterns), 12, replace=False)
    h = np.zeros(65)
    np.add.at(h, patterns[chosen].ravel(), np.repeat(rng.integers(50, 500, 12), 3))
    h[0] = 0
    used, x = packing.fit_repeats(h, patterns)
    fitted = np.bincount(patterns[used].ravel(), np.repeat(x, 3), 65)
    assert (x >= 0).all() and (np.arange(65) / 64 * np.abs(fitted - h))[1:].max() < 0.02 * h.max()  # residuals count by length


# ---- 13 whitening


def plain_whitening(rows, components):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(64.0 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    y = ((n * x - sums) / n).astype(float)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return [i for i, _ in rows], n, deviation, y @ basis / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitening(df, rows, components=32):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    ids, n, deviation, white, share = plain_whitening(rows, components)
    assert sorted(out) == sorted(ids)
    got = np.array([[out[i][k + 1]["whitened"] for k in range(white.shape[1])] for i in ids])
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-6
    assert np.abs(got.T @ got / n - np.eye(white.shape[1])).max() < 1e-9
    for k, i in enumerate(ids):
        for c, r in out[i].items():
            assert r["n"] == n and r["deviation"] == deviation[k] and abs(r["explained"] - share[c - 1]) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(5)
    check_whitening(whitening.whiten(table), [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(5) * [5, 4, 3, 2, 1] + 10]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0]), (1002, [float("nan")] * 5), (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, c string, n int")
    check_whitening(whitening.whiten(table), rows)
    check_whitening(whitening.whiten(table, components=2), rows, 2)


def test_whitening_short_flat_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    short = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [0.0, -1.0])], schema)).collect()
    assert len(short) == 8 and all(r["n"] == 4 and r["identity_error"] < 1e-9 for r in short)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in flat if r["whitened"] is None} == {2} and max(r["identity_error"] for r in flat) < 1e-9
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 6 and any(r["deviation"] is None for r in far)


def test_spectral_divide_and_conquer():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        a = rng.standard_normal((n, 2 * n))
        check_eigen(a @ a.T)
    q, _ = np.linalg.qr(rng.standard_normal((8, 8)))
    for d in ([5, 5, 5, 2, 2, 1e-9, 0, 0], [1] * 8, [0] * 8, [1e12, 1, 1e-6, 1e-6, 0, 0, 0, 0]):
        check_eigen(q @ np.diag(np.array(d, float)) @ q.T)
    u = whitening.polar(q @ np.diag([3, 2, 1, 0.1, -0.1, -1, -2, -3]) @ q.T)
    assert np.abs(u - q @ np.diag([1, 1, 1, 1, -1, -1, -1, -1]) @ q.T).max() < 1e-12


def check_eigen(m):
    m = (m + m.T) / 2
    values, vectors = whitening.eigen(m)
    scale = max(np.linalg.norm(m), 1.0)
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(m)).max() < 1e-13 * scale
    assert (np.diff(values) <= 0).all() and np.linalg.norm(m @ vectors - vectors * values) < 1e-13 * len(m) * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(m))).max() < 1e-13


def test_components_of_stars_need_no_round_and_paths_few(spark, monkeypatch):
    """Each round is one written table; what is settled is seen without running a round."""
    from propensia.llm import graph

    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    star = spark.createDataFrame([(7, 1), (1, 9), (9, 1), (4, 4), (5, 2), (None, 3)], "a bigint, b bigint")
    assert {(r["node"], r["component"]) for r in graph.components(star).collect()} == {(1, 1), (7, 1), (9, 1), (2, 2), (5, 2)}
    assert len(written) == 1
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    lowest = {x: x for e in edges for x in e}
    for _ in lowest:
        for a, b in edges:
            lowest[a] = lowest[b] = min(lowest[a], lowest[b])
    want = {(x, c) for x, c in lowest.items() if any(x in e and e[0] != e[1] for e in edges)}
    for most in (400_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_NODES", most)
        got = [(r["node"], r["component"]) for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
