from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readlake.llm.common import documents, written

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_pipeline(spark):
    docs = documents(spark, DATA)
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.agg(F.countDistinct("doc_id")).first()[0] == counts[-1]
    assert docs.filter("text is not null and n_chars <> char_length(text)").count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_takes_an_empty_table(spark, stage):
    assert stage[1](spark, documents(spark, DATA).limit(0), DATA).count() == 0
