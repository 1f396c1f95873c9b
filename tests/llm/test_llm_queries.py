"""Queries with a SQL text give DuckDB's rows; every query runs and has its contract's columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import SF, check

from ledgerloom.llm import queries

COLUMNS = {
    "op1": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op2": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "doc_id held_out score predicted", "op7": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8": "doc_id n_bytes n_removed n_spans kept_sha256", "op10": "doc_id fingerprint component_id",
    "op11": "doc_id n_words n_removed kept_sha256", "op12": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", "op13": "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    check(queries.QUERIES[name], queries.ORACLE_SQL[name], spark)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns[: len(w := COLUMNS.get(name.split("_")[0], "").split())] == w
