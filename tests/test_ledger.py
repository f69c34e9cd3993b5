"""Ingestion with a ledger: headers of every kind, failures between the steps, new checkpoints."""

import pytest

from propensia.streaming import ledger as lg

COLUMNS = ["ID", "MONTANT"]


@pytest.fixture
def place(tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, text):
        (tmp_path / "in" / name).write_bytes(text.encode("iso-8859-1"))

    def run(spark, checkpoint="checkpoint", **options):
        return lg.ingest_with_ledger(spark, f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/ledger", f"{tmp_path}/{checkpoint}", COLUMNS, **options)

    return put, run, str(tmp_path)


def rows(df):
    return sorted((r.ID, r.MONTANT) for r in df.collect())


def entries(spark, root):
    return {r.path.rsplit("/", 1)[-1]: (r.status, r.reason, r.n_rows) for r in lg.read_ledger(spark, f"{root}/ledger").collect()}


def test_columns_are_bound_by_name_and_misfits_set_aside(spark, place):
    put, run, root = place
    put("a.txt", "ID;MONTANT\n1;1,5\n2;\n")
    put("b é+[1].txt", "PLUS;MONTANT;ID\nx;7,0;3\n")
    put("c.txt", "ID;AUTRE\n4;9\n")
    put("d.txt", "ID;MONTANT;ID\n5;9;5\n")
    put("e.txt", "\n5;6\n")
    put("empty.txt", "")
    put("f.txt", "ID;MONTANT\n")
    assert rows(run(spark, max_files_per_batch=2)) == [("1", "1,5"), ("2", None), ("3", "7,0")]
    found = entries(spark, root)
    assert found.pop(next(n for n in found if n.startswith("b"))) == (lg.TAKEN, None, 1)
    assert found == {
        "a.txt": (lg.TAKEN, None, 2), "c.txt": (lg.ASIDE, "columns missing: MONTANT", None), "d.txt": (lg.ASIDE, "column more than once: ID", None),
        "e.txt": (lg.ASIDE, "columns missing: ID, MONTANT", None), "f.txt": (lg.TAKEN, None, 0)}


def test_a_failed_batch_is_repeated_once(spark, place, monkeypatch):
    put, run, root = place
    for i in range(4):
        put(f"{i}.txt", f"ID;MONTANT\n{i};1\n{i};2\n")
    # Fails after the rows of its second batch were written, before they are in the ledger.
    calls, original = [], lg.read_ledger

    def string_schema(columns):
        calls.append(columns)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return original_schema(columns)

    original_schema = lg.string_schema
    monkeypatch.setattr(lg, "string_schema", string_schema)
    with pytest.raises(Exception):  # noqa: B017
        run(spark, max_files_per_batch=1)
    assert len(rows(lg.read_ingested(spark, f"{root}/table", f"{root}/ledger", COLUMNS))) == 2
    wanted = sorted((str(i), v) for i in range(4) for v in "12")
    assert rows(run(spark, max_files_per_batch=1)) == wanted
    assert rows(run(spark)) == wanted
    # A lost checkpoint lists all files again, in other batches: the ledger knows them.
    put("9.txt", "MONTANT;ID\n3;9\n")
    assert rows(run(spark, checkpoint="another")) == [*wanted, ("9", "3")]
    assert original(spark, f"{root}/ledger").count() == 5


def test_misfits():
    assert lg.misfit("", COLUMNS) == "no header" and lg.misfit('"MONTANT"; ID ;X', COLUMNS) is None


def test_nothing_landed(spark, place):
    _, run, root = place
    assert rows(run(spark)) == [] and entries(spark, root) == {}
