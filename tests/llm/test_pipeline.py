from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            rows = docs.collect()
            seen[name] = {r.doc_id: r.text for r in rows}
            assert all(r.n_chars == len(r.text) for r in rows)
    assert set(seen["toxicity"]) < set(before)
    assert set(seen["near_duplicates"]) < set(seen["toxicity"])
    assert set(seen["private"]) == set(seen["repeats"]) == set(seen["near_duplicates"])
    texts = [" ".join(t.split()) for t in seen["near_duplicates"].values()]
    assert len(set(texts)) == len(texts)
    assert sum(map(len, seen["repeats"].values())) < sum(map(len, seen["near_duplicates"].values()))
    assert {r.doc_id for r in docs.collect()} == set(seen["private"])


def test_rows_without_ids_and_repeated_rows(spark, sf_dir):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (2, "A b c d e f g h", "y"), (None, "a b c d e f g h", "z"), (3, None, "n"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "a b c d e f g h", "x"), (None, "a b c d e f g h", "z"), (3, None, "n"), (4, "", "e")], key=str)


COLUMNS = "doc_id long, text string, n_chars int, shard string, row string, spans string, score double, length int, n_email int"


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows and clashing names go through every stage; each keeps clean rows and columns."""
    line = "this line of more than fifty bytes stands in several of the documents here"
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (3, ""), (None, "x y z " + line), (None, None), (4, "u v w " + line), (5, "mail anna.b7@mail.example.com " + line), (6, "y " * 3000)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "s", None, "x", 0.5, 1, None) for i, t in rows], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-odd")
        assert out.columns == docs.columns, name
        before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
        assert {i for i, _ in after} == {i for i, _ in before}, name
        assert len(after) == len(before) - (name == "near_duplicates"), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.shard == "s" and r.length == 1 for r in out.collect())
        docs = out
    texts = {i: t for i, t in ((r.doc_id, r.text) for r in docs.collect()) if i is not None}
    assert texts[4] == "u v w " + line and line not in texts[5] and "anna.b7" not in texts[5] and texts[2] is None and texts[3] == ""
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(rows) - 1


def test_stages_of_no_rows(spark, sf_dir):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)
