"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrame to DataFrame; the queries that apply them to whole tables are in
``queries`` and the DuckDB texts they are compared with are in ``oracles``.
"""
