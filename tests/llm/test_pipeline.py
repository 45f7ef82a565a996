"""The stages on the smallest tables: columns, what goes and what stays."""

import os

import pytest

import corpus_pipeline
from ledgerlane.llm import jaccard, packing
from tests.llm.conftest import SF_DIR, edge_rows, prose

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        after = docs.count()
        assert before * 0.7 <= after <= before, name
        assert name != "pii" or after == before
        before = after
    joined = jaccard.jaccard_join(docs).where("component_id != doc_id").count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert pieces.where("start = 0").count() == before
    assert pieces.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.WINDOW}").count() == 0
    assert joined <= 3  # cleaning may make two texts alike


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == want


def test_one_of_equal_rows_stays_and_strangers_with_its_id(spark, documents):
    text, near = prose(1, 60), prose(1, 59) + " other"
    rows = [(1, text), (1, text), (None, text), (None, text), (5, near), (5, prose(2, 50)), (7, prose(2, 50)), (0, None), (0, None)]
    kept = jaccard.first_of_each(documents(rows))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, text), (5, prose(2, 50)), (0, None), (0, None)], key=str)


def test_clashing_names_keep_their_values(spark, documents):
    docs = documents([(1, "Call +1 415 555 0100 now"), (None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        rows = docs.collect()
        assert {(r.terms, r._row, r._kept, r.doc) for r in rows} == {("t", "_r", "_k", "d")}, name
    assert sorted(str(r.text) for r in rows) == ["Call <PHONE> now", "None"]


def test_stages_take_edge_cases_and_empty_tables(spark, documents):
    for rows in (edge_rows(), []):
        docs = documents(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            docs.collect()
