import random

import pytest

TABLES = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __hit string, k int, t double, node string"


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls, empty and very long texts, ties, repeats, near copies, planted cases."""
    rng = random.Random(3)
    words = ["the", "of", "and", "in", "to", "le", "der", "que", "café", "straße", "naïve", "alpha", "beta", "gamma", "delta", "omega", "x1", "42"]

    def prose(n):
        return " ".join(rng.choice(words) + (rng.choice([".", ",", "\n", ""]) if rng.random() < 0.2 else "") for _ in range(n))

    base = [prose(200) for _ in range(4)]
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "one", "en"), (6, "One two", "fr"), (7, "日本語 の 文章", "xx"), (8, "### $$$", None)]
    for i in range(12):
        w = base[i % 4].split(" ")
        for _ in range(i // 4 * 2):
            w[rng.randrange(len(w))] = "changed"
        rows.append((20 + i, " ".join(w), ["en", "fr", "de", "es"][i % 4]))
    rows += [(40 + i, base[0], "en") for i in range(6)]
    rows.append((50, prose(30_000), "de"))
    rows.append((51, "the same line of words again and again\n" * 400, "en"))
    rows.append((52, "mail a.b@c.example.com or 10.0.0.1 and 999.1.1.1, call +1 (555) 555-0100, card 4111 1111 1111 1111. password=7602ad27cf5550de1c " + prose(40), "en"))
    rows.append((53, "MIT License. Under the Apache License, Version 2.0. GNU General Public License, version 3 " + prose(30), "en"))
    rows.append((60, base[1], "fr"))
    rows.append((60, base[1], "fr"))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, 2.0, "n") for i, t, lang in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(spark):
    """[(doc_id, text)] of the smallest given table."""
    return [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
