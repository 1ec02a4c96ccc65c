"""Registered corpus queries: their columns, and SQL twins where there are any."""

import duckdb
import pytest

import __spark_entry__ as driver
from quotaflow.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op8_ngram_lm": {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double",
    },
    "op9_sentencepiece": {"doc_id": "bigint", "ids": "array<int>", "score": "double", "n_pieces": "bigint", "round_trip": "boolean"},
    "op12_merkle_manifest": {
        "doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean",
    },
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


def test_all_are_registered():
    names = set(driver.queries())
    assert {*queries.QUERIES, "pipeline"} <= names and len(queries.QUERIES) == 13
    assert set(queries.SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()
    assert found.count() == 200


@pytest.mark.parametrize("name", queries.SQL)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = queries.QUERIES[name](spark, FOLDER)
    twin = con.execute(queries.SQL[name])
    assert [d[0] for d in twin.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(twin.fetchall())
