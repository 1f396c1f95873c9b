"""All queries of the library over the driver's tables, with the DuckDB texts they are compared with."""

from __future__ import annotations

from ledgerloom.plans import check_queries, detail_queries, document_queries, invoice_queries, layout_queries, ledger_queries, page_queries, row_queries, statement_queries, summary_queries, text_queries

_groups = (ledger_queries, document_queries, check_queries, detail_queries, page_queries, row_queries, text_queries, layout_queries, statement_queries, invoice_queries, summary_queries)

QUERIES = {name: pair[0] for g in _groups for name, pair in g.PAIRS.items()}
ORACLE_SQL = {name: pair[1] for g in _groups for name, pair in g.PAIRS.items() if pair[1]}
