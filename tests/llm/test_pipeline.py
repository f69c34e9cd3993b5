"""The pipeline's stages on the smallest tables, each beside a plain version of its own input."""

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from propensia.llm import personal
from tests.llm import plain
from tests.llm.conftest import TABLES


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """What every stage returned, written and read as the pipeline does."""
    docs, out = spark.read.parquet(f"{TABLES}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, TABLES).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def data(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, results, given):
    quality, distinct, clean, private, tokens = results
    for df in (quality, distinct, clean, private):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {i for i, _ in data(quality)} <= {i for i, t in given if not plain.quality_counts(t)[-1]}
    classes = plain.jaccard_classes(data(quality), 5, (80, 100))
    assert {i for i, _ in data(distinct)} == {c for _, c in classes.values()}
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, _ in data(clean)} == {i for i, (_, hit, _) in plain.passages(data(distinct), items).items() if not hit}
    finder = personal.Finder(personal._trained())
    before, after = dict(data(clean)), dict(data(private))
    assert {i: personal.redacted(t, s) for (i, t), s in zip(before.items(), finder([t.encode() for t in before.values()]), strict=True)} == after
    assert all(plain.base_spans(t) == "" for t in after.values()) and all(r.n_chars == len(r.text) for r in private.collect())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: np.frombuffer(r.ids, np.uint32).tolist() for r in tokens.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in after.items()}


def test_registered_query(spark, results):
    got = entry.queries()["pipeline"](spark, TABLES)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, results[-1].select("doc_id", "ids_sha256").collect()))


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
