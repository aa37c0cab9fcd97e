"""The stages one after the other on the smallest tables, and the registry."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMALL = Path("/root/testdata/sf0.001")


def test_registry():
    names = list(entry.queries())
    assert [len([n for n in names if n.startswith(f"op{k}_")]) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.skipif(not SMALL.exists(), reason="needs the given tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(SMALL))
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").isEmpty()
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    last = corpus_pipeline.run(spark, str(SMALL)).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect()) and min(r.n_tokens for r in last) > 0
