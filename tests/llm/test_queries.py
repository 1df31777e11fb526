import glob
import os

import corpus_pipeline
import duckdb
import pytest
from codeweave.llm import decontamination, jaccard_join, queries

from .helpers import documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.sql(queries.ORACLES[name])
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        assert sorted(repr([r[c] for c in names]) for r in rows) == sorted(repr([r[want.columns.index(c)] for c in names]) for r in want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert 0 < kept.count() <= docs.count()
        docs = kept
        if name == "ngram_jaccard_join":
            assert jaccard_join.join_near_duplicates(docs).filter("doc_id <> class_id").count() == 0
        if name == "substring_dedup":
            cut = {r.doc_id: r.n_chars for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect()) and cut
    assert decontamination.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_null_rows(spark):
    docs = documents(spark, [(1, None), (None, "a text"), (2, ""), (3, "some words here")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert {(r.doc_id, r.text) for r in docs.collect()} >= {(None, "a text"), (3, "some words here")}


def test_pipeline_on_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert not docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_pipeline_on_repeated_rows(spark):
    """Rows that occur twice, copies and clean texts: one row of each group is left and packed once."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    docs = documents(spark, [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (3, texts[1]), (3, texts[2]), (4, texts[3] + " end"), (5, texts[3])]).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        if name == "toxicity":
            assert docs.count() == 8
    left = sorted((r.doc_id, r.text) for r in docs.collect())
    assert left == [(1, texts[0]), (3, texts[1]), (3, texts[2]), (4, texts[3] + " end")]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in packed) == [1, 3, 3, 4]
