"""The corpus queries on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from check_oracle import compare, connect
from stopwise.llm import near_duplicates, secret_scan
from stopwise.llm.common import staged
from stopwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SF, name) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        if name != "mixing":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        kept[name], docs = out, out
    assert near_duplicates.near_duplicates(kept["near-duplicates"]).filter("NOT kept").count() == 0
    left = secret_scan.digest(secret_scan.scan_secrets(kept["secrets"]))
    assert left.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert kept["mixing"].filter("copies < 1 OR taken <> copies * size").count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_rows_pass(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, copies int, mark string"
    rows = [
        (None, None, None, None, None, None, None, None),
        (1, "", "en", "a", 0, "x", 1, "m"),
        (1, "", "en", "a", 0, "x", 1, "m"),
        (2, "same text here for all of us", "en", "a", 28, "x", 1, "m"),
        (2, "same text here for all of us", "en", "a", 28, "x", 1, "m"),
        (3, "token = abcdefghijkl", None, None, None, "x", 1, "m"),
    ]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    got = out.collect()
    expected = {"toxicity": 6, "near-duplicates": 5, "decontamination": 6, "secrets": 6}
    assert name not in expected or len(got) == expected[name]
    if name == "secrets":
        assert sorted(r["text"] for r in got if r["text"])[0] == "[SECRET]"
    assert stage(spark, docs.limit(0), SF).count() == 0
