"""Every query with a SQL text gives DuckDB's rows; the others give rows, the same however the input is cut."""

import pytest
from compare import SF, check, rows

from ledgerloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, name):
    check(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_same_with_other_partitions(spark, name):
    one = catalog.QUERIES[name](spark, SF)
    first = rows(one.columns, one.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        two = catalog.QUERIES[name](spark, SF)
        assert first and rows(two.columns, two.collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chain_order_keeps_newest_first_accounts(spark):
    from ledgerloom.plans.check_queries import order_rows
    from ledgerloom.plans.views import view

    rows = {}
    for r in order_rows(view(spark, SF, "ledger")).collect():
        rows.setdefault(r.doc_id, []).append((r.seq, r.before, r.after))
    got = {}
    for r in catalog.QUERIES["win_22_chain_order"](spark, SF).orderBy("place").collect():
        got.setdefault(r.doc_id, []).append(r.seq)
    ledger = {r.doc_id for r in view(spark, SF, "ledger").where("balance IS NOT NULL").select("doc_id").distinct().collect()}
    assert set(got) == set(rows) == ledger and any(k % 10 == 3 for k in got)
    for k, left in rows.items():  # walk by trying every row
        left, afters, walk, at = sorted(left), {a for _, _, a in rows[k]}, [], None
        starts = [r for r in left if r[1] not in afters]
        while left:
            at = next((r for r in left if at and r[1] == at[2]), None) or next((r for r in [*starts, *left] if r in left), None)
            left.remove(at)
            walk.append(at[0])
        assert got[k] == walk, k


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
