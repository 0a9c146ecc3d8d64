"""Null ids in every operator that runs Python on ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, knn, pieces, pii, suffixes, toxicity
from tests.llm.fixtures import documents

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r[0] if i % 4 else None, r[1]) for i, r in enumerate(documents()) if r[1] is None or len(r[1]) < 3000]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).cache()


def ids(frame, name="id"):
    return Counter(r[name] for r in frame.collect())


def test_ids_pass_through(spark, docs):
    want = ids(docs, "doc_id")
    labels = spark.createDataFrame([(3, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    assert ids(pieces.encode_digest(docs, tokenizers.path("piece_bpe_32k.model"))) == want
    assert ids(pii.find(docs, pii.Field())) == want
    assert ids(toxicity.run(docs, labels)) == want
    found = jaccard_join.find(docs)
    assert ids(found) == want
    assert all((r["id"] is None) == (r["component_id"] is None) for r in found.collect())
    kept = ids(jaccard_join.keep_one(docs), "doc_id")
    assert kept[None] == want[None]
    assert None not in ids(suffixes.find(docs))


def test_null_vector_ids(spark):
    rows = spark.createDataFrame([(None, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in knn.nearest(rows, F.col("vec_id") % 50 == 0).collect()] == [(0, 7)]
