"""Ledger queries and their DuckDB texts."""

from __future__ import annotations

from ledgerloom.operators import ledger as L
from ledgerloom.plans.views import duck, view

M = "DECIMAL(18,2)"
LEDGER = duck("ledger")
ORDERED = f"""{LEDGER},
steps AS (SELECT *, max(txn_date) FILTER (TRUE) OVER () AS unused, lag(txn_date) OVER (PARTITION BY doc_id, txn_date IS NULL ORDER BY seq) AS before FROM ledger),
net AS (SELECT doc_id, count(*) FILTER (txn_date > before) AS forward, count(*) FILTER (txn_date < before) AS backward FROM steps GROUP BY doc_id),
o AS (SELECT l.*, CASE WHEN forward >= backward THEN seq ELSE -seq END AS ord, coalesce(withdrawal, 0)::{M} AS w0, coalesce(deposit, 0)::{M} AS d0 FROM ledger l JOIN net USING (doc_id)),
c AS (SELECT *, (lag(balance) OVER (PARTITION BY doc_id ORDER BY ord) - w0 + d0)::{M} AS expected, lag(balance) OVER (PARTITION BY doc_id ORDER BY ord) AS prev, lag(txn_date) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_date FROM o)""".replace("max(txn_date) FILTER (TRUE) OVER () AS unused, ", "")
SUMS = f"""sum(w0)::{M} AS debits, sum(d0)::{M} AS credits, arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS o_, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing"""
OPENING = f"try_cast(o_ AS {M}) AS opening"


def on(f, name="ledger", **kw):
    return lambda spark, sf_dir: f(view(spark, sf_dir, name), **kw)


KEY = f"""txn_date, lower(trim(regexp_replace(coalesce(particulars, ''), '\\s+', ' ', 'g'))), coalesce(withdrawal, 0), coalesce(deposit, 0), coalesce(balance, 0)"""

PAIRS = {
    "win_01_chronology": (on(L.chronology), f"WITH {ORDERED} SELECT doc_id, forward, backward, forward >= backward AS chronological FROM net"),
    "win_02_statement_order": (lambda s, d: L.statement_order(view(s, d, "ledger")).select("doc_id", "seq", "ord"), f"WITH {ORDERED} SELECT doc_id, seq, ord FROM o"),
    "win_03_balance_breaks": (on(L.balance_breaks), f"WITH {ORDERED} SELECT doc_id, seq, expected, balance, (balance - expected)::{M} AS difference FROM c WHERE abs(expected - balance) > 0.05"),
    "win_04_rebuild_amounts": (
        on(L.rebuild_amounts),
        f"""WITH {ORDERED},
m AS (SELECT *, (balance - prev)::{M} AS move, abs(balance - prev)::{M} AS size,
  balance - prev IS NULL OR ((withdrawal IS NOT NULL OR deposit IS NOT NULL) AND abs(greatest(w0, d0) - abs(balance - prev)) > 1.00
    AND (txn_date IS NULL OR prev_date IS NULL OR date_trunc('month', txn_date) <> date_trunc('month', prev_date))) AS keep FROM c),
f AS (SELECT *, (CASE WHEN keep THEN withdrawal WHEN size <= 0.01 THEN NULL WHEN move < 0 THEN size END)::{M} AS new_withdrawal,
  (CASE WHEN keep THEN deposit WHEN size <= 0.01 THEN NULL WHEN move > 0 THEN size END)::{M} AS new_deposit FROM m)
SELECT doc_id, seq, withdrawal, deposit, new_withdrawal, new_deposit, w0 <> coalesce(new_withdrawal, 0) OR d0 <> coalesce(new_deposit, 0) AS changed FROM f""",
    ),
    "win_06_side_by_delta": (
        on(L.classify_by_delta),
        f"""WITH {LEDGER}, m AS (SELECT *, (balance - lag(balance) OVER (PARTITION BY doc_id ORDER BY seq))::{M} AS move, coalesce(withdrawal, deposit) AS a FROM ledger)
SELECT doc_id, seq, move, CASE WHEN abs(move - a) <= 0.02 THEN 'CR' WHEN abs(move + a) <= 0.02 THEN 'DR' END AS side FROM m""",
    ),
    "win_07_side_newest_first": (
        on(L.classify_by_delta, newest_first=True),
        f"""WITH {LEDGER}, m AS (SELECT *, (balance - lead(balance) OVER (PARTITION BY doc_id ORDER BY seq))::{M} AS move, coalesce(withdrawal, deposit) AS a FROM ledger)
SELECT doc_id, seq, move, CASE WHEN abs(move - a) <= 0.02 THEN 'CR' WHEN abs(move + a) <= 0.02 THEN 'DR' END AS side FROM m""",
    ),
    "win_17_running_balance": (
        on(L.running_balance),
        f"""WITH {LEDGER}, i AS (SELECT *, count(balance) OVER (PARTITION BY doc_id ORDER BY seq) AS island, coalesce(deposit, 0) - coalesce(withdrawal, 0) AS move FROM ledger)
SELECT doc_id, seq, balance IS NULL AS filled, (first_value(balance) OVER w + sum(CASE WHEN balance IS NULL THEN move ELSE 0 END) OVER w)::{M} AS running FROM i
WINDOW w AS (PARTITION BY doc_id, island ORDER BY seq)""",
    ),
    "agg_01_totals_and_closing": (on(L.closing_balance), f"WITH {ORDERED}, s AS (SELECT doc_id, count(*) AS n_rows, {SUMS} FROM o GROUP BY doc_id) SELECT doc_id, n_rows, debits, credits, {OPENING}, closing FROM s"),
    "chk_02_closing_check": (
        on(L.closing_check),
        f"""WITH {ORDERED}, s AS (SELECT doc_id, count(*) FILTER (abs(expected - balance) > 0.05) AS breaks, {SUMS} FROM c GROUP BY doc_id),
t AS (SELECT doc_id, breaks, debits, credits, {OPENING}, closing FROM s), u AS (SELECT *, (opening + credits - debits - closing)::{M} AS difference FROM t)
SELECT *, CASE WHEN difference IS NULL THEN 'UNVERIFIED' WHEN abs(difference) > 0.05 OR breaks > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM u""",
    ),
    "dis_01_dedupe": (lambda s, d: L.remove_duplicates(view(s, d, "ledger")).select("doc_id", "seq"), f"WITH {LEDGER} SELECT doc_id, min(seq) AS seq FROM ledger GROUP BY doc_id, {KEY}"),
    "dis_02_duplicate_report": (
        lambda s, d: L.mark_duplicates(view(s, d, "ledger")).where("duplicate_of IS NOT NULL").select("doc_id", "seq", "duplicate_of"),
        f"WITH {LEDGER}, m AS (SELECT doc_id, seq, min(seq) OVER (PARTITION BY doc_id, {KEY}) AS duplicate_of FROM ledger) SELECT * FROM m WHERE seq <> duplicate_of",
    ),
    "flt_11_insane_amounts": (
        on(L.insane_amounts, digits=6, times=3),
        f"""WITH {LEDGER}, l AS (SELECT *, max(abs(balance)) FILTER (abs(balance) < 1000000) OVER (PARTITION BY doc_id) AS largest FROM ledger),
x AS (SELECT doc_id, seq, largest, unnest(['withdrawal', 'deposit', 'balance']) AS field, unnest([withdrawal, deposit, balance]) AS amount FROM l)
SELECT doc_id, seq, field, amount FROM x WHERE abs(amount) >= 1000000 OR (field <> 'balance' AND largest > 0 AND abs(amount) > largest * 3)""",
    ),
    "agg_12_reference_lengths": (
        on(L.suspicious_references),
        f"""WITH {LEDGER}, r AS (SELECT doc_id, seq, cheque_no, length(cheque_no) AS len FROM ledger WHERE cheque_no IS NOT NULL),
n AS (SELECT doc_id, len, count(*) AS n, min(seq) AS first, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM r GROUP BY doc_id, len),
u AS (SELECT doc_id, len AS usual FROM n WHERE total >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)
SELECT doc_id, seq, cheque_no, usual::INT AS usual FROM r JOIN u USING (doc_id) WHERE len <> usual""",
    ),
    "agg_07_monthly": (
        on(L.monthly),
        f"""WITH {LEDGER}, s AS (SELECT doc_id, date_trunc('month', txn_date)::DATE AS month, count(*) AS n_rows, count(withdrawal) AS n_debits, count(deposit) AS n_credits,
  sum(coalesce(withdrawal, 0))::{M} AS debits, sum(coalesce(deposit, 0))::{M} AS credits, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing FROM ledger WHERE txn_date IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, lag(closing) OVER (PARTITION BY doc_id ORDER BY month) AS opening FROM s), g AS (SELECT *, abs(opening + credits - debits - closing) AS gap FROM p)
SELECT * EXCLUDE (gap), CASE WHEN gap IS NULL THEN 'UNVERIFIED' WHEN gap <= 0.05 THEN 'MATCH' ELSE 'MISMATCH' END AS check_ FROM g""",
    ),
    "agg_06_page_totals": (on(L.page_totals), f"WITH {LEDGER} SELECT doc_id, page, count(*) AS n_rows, sum(coalesce(withdrawal, 0))::{M} AS debits, sum(coalesce(deposit, 0))::{M} AS credits FROM ledger GROUP BY 1, 2"),
    "chk_03_sides": (
        on(L.both_sides),
        f"""WITH {ORDERED} SELECT doc_id, seq, CASE WHEN w0 <> 0 AND d0 <> 0 THEN 'both_sides' ELSE 'negative' END AS kind FROM o
WHERE (w0 <> 0 AND d0 <> 0) OR (NOT is_reversal AND (w0 < 0 OR d0 < 0))""",
    ),
    "chk_04_confidence": (
        on(L.confidence),
        f"""WITH {ORDERED}, f AS (SELECT doc_id, seq, txn_date IS NULL AS a, withdrawal IS NULL AND deposit IS NULL AS b, coalesce(abs(expected - balance) > 0.05, FALSE) AS c, ocr_corrected AS d FROM c),
s AS (SELECT *, greatest(0, 100 - CASE WHEN a THEN 40 ELSE 0 END - CASE WHEN b THEN 40 ELSE 0 END - CASE WHEN c THEN 30 ELSE 0 END - CASE WHEN d THEN 15 ELSE 0 END) AS score FROM f)
SELECT doc_id, seq, score::INT AS score, concat_ws(',', CASE WHEN a THEN 'no_date' END, CASE WHEN b THEN 'no_amount' END, CASE WHEN c THEN 'chain' END, CASE WHEN d THEN 'ocr' END) AS reasons, score < 80 AS review FROM s""",
    ),
    "win_20_fill_dates": (
        on(L.fill_dates),
        f"""WITH {LEDGER}, n AS (SELECT doc_id, seq, txn_date AS t, last_value(txn_date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(txn_date IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM ledger)
SELECT doc_id, seq, coalesce(t, CASE WHEN b = a THEN b END) AS txn_date, t IS NULL AND coalesce(b = a, FALSE) AS filled FROM n""",
    ),
    "win_25_opening_row": (
        on(L.opening_row),
        f"""WITH {ORDERED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn, min(seq) OVER (PARTITION BY doc_id) AS first_seq FROM o)
SELECT doc_id, (txn_date - INTERVAL 1 DAY)::DATE AS txn_date, first_seq, (balance + w0 - d0)::{M} AS balance FROM f WHERE rn = 1""",
    ),
    "win_21_page_order": (
        on(L.page_order),
        f"""WITH {LEDGER}, d AS (SELECT doc_id, page, list_sort(list(txn_date)) AS d FROM ledger WHERE txn_date IS NOT NULL GROUP BY 1, 2), m AS (SELECT doc_id, page, d[len(d) // 2 + 1] AS median FROM d)
SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY median, page)::INT AS rank FROM m""",
    ),
    "snk_01_statement_sheet": (
        on(L.statement_sheet),
        f"""WITH {ORDERED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM o), s AS (SELECT doc_id, {SUMS} FROM o GROUP BY doc_id)
SELECT doc_id, 0 AS section, 0::BIGINT AS place, (txn_date - INTERVAL 1 DAY)::DATE AS txn_date, 'OPENING BALANCE' AS particulars, NULL::{M} AS withdrawal, NULL::{M} AS deposit, (balance + w0 - d0)::{M} AS balance FROM f WHERE rn = 1
UNION ALL SELECT doc_id, 1, ord, txn_date, particulars, withdrawal, deposit, balance FROM o
UNION ALL SELECT doc_id, 2, 0, NULL, 'GRAND TOTAL', debits, credits, closing FROM s""",
    ),
}
