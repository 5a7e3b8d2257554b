"""The whole pipeline on the smallest tables against a plain reading of each stage."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexiloom.llm.common import DOCUMENT_COLUMNS

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).toArrow()
        before = {r.doc_id: r.text for r in docs.collect()}
        after = out.to_pylist()
        if name != "tokens":
            assert tuple(out.column_names) == DOCUMENT_COLUMNS
        if name == "near_duplicates":
            classes = brute(list(before.items()), 5, 80, 100)
            assert {r["doc_id"] for r in after} == {d for d, (n, c) in classes.items() if c == d or not n}
        if name == "decontamination":
            items = [r.text for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
            assert {d for d in before if not any(i in before[d] for i in items)} >= {r["doc_id"] for r in after}
        if name in ("private_data", "tokens"):
            assert {r["doc_id"] for r in after} == set(before)
        docs = spark.createDataFrame(out.to_pandas(), docs.schema) if name != "tokens" else None


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
