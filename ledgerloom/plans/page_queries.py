"""Queries of page geometry and continuity with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import pages as P
from ledgerloom.plans.detail_queries import ledger, lines, orders
from ledgerloom.plans.document_queries import LINES, STARTS
from ledgerloom.plans.views import duck, view

M = "DECIMAL(18,2)"
LEDGER, TOK = duck("ledger"), duck("tokens")


def tokens(f):
    return lambda spark, d: f(view(spark, d, "tokens"))


def trailing(o):
    body, amount, credit = P.trailing_amount(F.concat(F.lit("SHOP 12 USD 1,200.50  "), S.indian_grouping(F.col("o_totalprice").cast("decimal(18,2)")), F.when(F.col("o_orderkey") % 3 == 0, " Cr").otherwise("")))
    code, foreign = P.foreign_amount(F.lit("SHOP 12 USD 1,200.50"))
    return o.select("o_orderkey", body.alias("body"), amount.alias("amount"), credit.alias("credit"), code.alias("code"), foreign.alias("foreign_amount"))


def page_figures(df):
    return df.groupBy("doc_id", "page").agg(F.max_by("balance", "seq").alias("carried"), F.min_by("balance", "seq").alias("brought"), F.count("*").alias("n_rows"), F.count_if("ocr_corrected").alias("n_unconfirmed"))


GRID = [round(-0.15 + k * 0.0125, 6) for k in range(25)]

PAIRS = {
    "str_21_trailing_amounts": (
        orders(trailing),
        f"SELECT o_orderkey, 'SHOP 12 USD 1,200.50' AS body, o_totalprice::{M} AS amount, o_orderkey % 3 = 0 AS credit, 'USD' AS code, 1200.50::{M} AS foreign_amount FROM orders",
    ),
    "dat_08_leading_dates": (
        orders(lambda o: o.select("o_orderkey", P.leading_date(F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(". "))).otherwise(F.lit("  ")), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" paid 10.00"))).alias("d"))),
        "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders",
    ),
    "str_06_spaced_dates": (
        orders(lambda o: o.select("o_orderkey", S.rejoin_dates(F.concat(F.date_format("o_orderdate", "dd / MM/ yyyy"), F.lit(" x"))).alias("a"), S.ocr_digits(F.translate(F.date_format("o_orderdate", "dd/MM/yyyy"), "01", "Ol")).alias("b"), S.ocr_digits(F.col("o_orderpriority")).alias("c"))),
        "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') || ' x' AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, o_orderpriority AS c FROM orders",
    ),
    "str_10_similarity": (
        lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", S.party_name(F.concat(F.lit("The "), F.col("s_name"), F.lit(" & Co. Ltd"))).alias("name"), F.round(S.similarity(F.col("s_name"), F.replace("s_name", F.lit("0"), F.lit(""))) * 1000).cast("int").alias("score")),
        r"SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS name, round((1 - levenshtein(s_name, replace(s_name, '0', '')) / length(s_name)::DOUBLE) * 1000)::INT AS score FROM supplier",
    ),
    "win_15_one_unreadable": (
        ledger(P.one_unreadable),
        f"""WITH {LEDGER}, b AS (SELECT *, lag(balance) OVER (PARTITION BY doc_id ORDER BY seq) AS p, withdrawal IS NULL AND deposit IS NULL AS none FROM ledger)
SELECT doc_id, seq, (CASE WHEN none AND balance < p THEN p - balance ELSE withdrawal END)::{M} AS withdrawal, (CASE WHEN none AND balance > p THEN balance - p ELSE deposit END)::{M} AS deposit,
  (CASE WHEN balance IS NULL AND NOT none THEN p - coalesce(withdrawal, 0) + coalesce(deposit, 0) ELSE balance END)::{M} AS balance FROM b""",
    ),
    "win_19_looking_ahead": (
        ledger(P.looking_ahead),
        f"""WITH {LEDGER}, a AS (SELECT doc_id, seq, lead(txn_date) OVER w AS a, lead(txn_date, 2) OVER w AS b, lead(txn_date, 3) OVER w AS c FROM ledger WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id, seq, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)::INT AS dated_ahead, coalesce(a, b, c) AS next_date FROM a""",
    ),
    "chk_15_unverifiable": (ledger(P.unverifiable), f"WITH {LEDGER} SELECT doc_id, count(balance) < 2 AS unverifiable, count(*) FILTER (txn_date IS NULL) AS undated FROM ledger GROUP BY 1"),
    "chk_16_page_continuity": (
        ledger(lambda x: P.page_continuity(page_figures(x), 0.1)),
        f"""WITH {LEDGER}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq DESC) AS z FROM ledger),
g AS (SELECT doc_id, page, max(balance) FILTER (z = 1) AS carried, max(balance) FILTER (a = 1) AS brought, count(*) AS n, count(*) FILTER (ocr_corrected) AS u FROM f GROUP BY 1, 2)
SELECT doc_id, page, abs(brought - lag(carried) OVER (PARTITION BY doc_id ORDER BY page)) <= 0.05 AS continues, u > 0.1 * n AS "drop" FROM g""",
    ),
    "set_04_missing_pages": (
        ledger(lambda x: P.missing_pages(x.select("doc_id", (F.col("page") + (F.col("page") % 3 == 1).cast("int")).alias("page")))),
        f"""WITH {LEDGER}, p AS (SELECT DISTINCT doc_id, (page + (page % 3 = 1)::INT)::INT AS page FROM ledger), r AS (SELECT doc_id, list(page) AS h, min(page) AS a, max(page) AS b FROM p GROUP BY 1)
SELECT doc_id, array_to_string(list_filter(range(a, b + 1), lambda x: NOT list_contains(h, x::INT)), ',') AS missing FROM r""",
    ),
    "row_11_month_segments": (
        ledger(P.month_segments),
        f"""WITH {LEDGER}, m AS (SELECT doc_id, seq, last_value(date_trunc('month', txn_date) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ledger),
n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 THEN (m IS NOT NULL)::INT WHEN m IS NOT DISTINCT FROM lag(m) OVER (PARTITION BY doc_id ORDER BY seq) THEN 0 ELSE 1 END AS nw FROM m), s AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS segment FROM n)
SELECT doc_id, segment, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS n_rows FROM s GROUP BY 1, 2""",
    ),
    "row_13_gap_rows": (
        tokens(lambda t: P.gap_rows(t, 12)),
        f"""WITH {TOK}, g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, token_id) > 12 THEN 1 ELSE 0 END AS n FROM tokens), b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY y, token_id)::BIGINT AS block FROM g)
SELECT doc_id, block, min(y) AS top, max(y) AS bottom, count(*) AS n_tokens FROM b GROUP BY 1, 2""",
    ),
    "row_19_slope": (
        tokens(P.slope),
        f"""WITH {TOK}, r AS (SELECT doc_id, token_id, s AS slope, y - s * x AS h FROM tokens, unnest([{', '.join(f"{g}::DOUBLE" for g in GRID)}]) AS u(s)),
n AS (SELECT *, floor(h) = floor(lag(h) OVER (PARTITION BY doc_id, slope ORDER BY h, token_id)) AS near FROM r), c AS (SELECT doc_id, slope, count(*) FILTER (near) AS n FROM n GROUP BY 1, 2)
SELECT doc_id, slope, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, slope) = 1""",
    ),
    "row_12_column_sections": (
        lines(lambda x: P.column_sections(x, lambda t: t.rlike(STARTS))),
        f"""WITH {LINES}, s AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '{STARTS}') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM lines)
SELECT doc_id, head, count(*) AS n, min(line_no) AS "first" FROM s WHERE head < line_no GROUP BY 1, 2""",
    ),
}
