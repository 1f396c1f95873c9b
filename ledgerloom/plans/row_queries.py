"""Queries of row assembly, sheets, checks and aggregates, each over whole tables, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import card as C
from ledgerloom.operators import claims as K
from ledgerloom.operators import details as D
from ledgerloom.operators import invoice as I
from ledgerloom.operators import ledger as L
from ledgerloom.operators import lines as T
from ledgerloom.operators import pages as P
from ledgerloom.operators import reconcile as V
from ledgerloom.operators import register as G
from ledgerloom.operators import rows as W
from ledgerloom.operators import sheets as H
from ledgerloom.operators import solvers as X
from ledgerloom.plans.ledger_queries import KEY, ORDERED
from ledgerloom.plans.views import duck, view
from ledgerloom.sources import readers as R
from ledgerloom.sources import writers

M = "DECIMAL(18,2)"
LEDGER, CARD, REG, LINES, TOKENS = duck("ledger"), duck("card"), duck("register"), duck("invoice_lines"), duck("tokens")


def ledger(f):
    return lambda spark, d: f(view(spark, d, "ledger"))


def of(name, f):
    return lambda spark, d: f(view(spark, d, name))


def table(name, f):
    return lambda spark, d: f(spark.read.parquet(f"{d}/{name}.parquet"))


def day(sep):
    t = F.col("txn_date")
    return F.concat(F.lpad(F.day(t).cast("string"), 2, "0"), F.lit(sep), F.lpad(F.month(t).cast("string"), 2, "0"), F.lit(sep), F.year(t).cast("string"))


BIG = "(balance + 50000000)::DECIMAL(18,2)"


def draft_lines(l):
    """Scanned lines of all rows: dates (one cut apart by spaces here and there), narration, type, id (its letter read as a digit here and there), cheque, amount, balance, side."""
    date = F.when(F.col("seq") % 5 == 1, F.regexp_replace(day("-"), "-", " - ")).otherwise(day("-"))
    key = F.lpad((F.col("seq") % 10000).cast("string"), 7, "0")
    ref = F.when(F.col("seq") % 7 == 3, F.concat(F.lit("5"), key)).when(F.col("seq") % 7 != 5, F.concat(F.lit("S"), key))
    balance = (F.col("balance") + 50000000).cast("decimal(18,2)").cast("string")
    text = F.concat_ws(" ", date, F.when(F.col("seq") % 3 == 0, day("-")), F.replace("particulars", F.lit(" / ref "), F.lit("/REF")), F.when((F.col("seq") % 2 == 0) & ref.isNotNull(), "TFR"), ref, F.when(ref.isNotNull(), F.col("cheque_no")), F.coalesce("withdrawal", "deposit").cast("string"), balance, F.when(F.col("seq") % 3 == 0, "Dr.").otherwise("CR"))
    return l.select("doc_id", F.col("seq").alias("line_no"), text.alias("text"))


def inline_lines(l):
    text = F.concat_ws(" ", F.when(F.col("seq") % 3 == 0, "?1/x").otherwise(day("/")), "particulars", F.concat(F.lit("REF0"), F.lpad(F.col("seq").cast("string"), 8, "0")), day("/"), F.lit("x"))
    return l.select("doc_id", F.col("seq").alias("line_no"), text.alias("text"))


def pending_lines(l):
    text = F.when(F.col("seq") % 5 == 0, F.concat_ws(" ", day("/"), F.lit("5.00"))).when(F.col("seq") % 5 == 1, F.concat_ws(" ", day("/"), "particulars")).otherwise(F.col("particulars"))
    return l.select("doc_id", F.col("seq").alias("line_no"), text.alias("text"))


def framed_lines(l):
    text = F.when(F.col("seq") % 9 == 2, "Date  Particulars  Chq").when(F.col("seq") % 9 == 7, "Grand Total : 5.00").otherwise(F.col("particulars"))
    return l.select("doc_id", "page", F.col("seq").alias("line_no"), text.alias("text"))


def cells(l):
    k = F.col("seq") % 5
    return l.select("doc_id", "seq", F.when(k == 0, "date").when(k < 3, "particulars").when(k == 3, "amount").otherwise("balance").alias("column"), F.concat("particulars", F.lit("#"), F.col("seq").cast("string")).alias("text"))


def kinds(l):
    k = F.col("seq") % 12
    return l.select("doc_id", "seq", F.when(k == 11, "heading").when(k.isin(0, 4, 5, 8), "date").when(k.isin(2, 6, 9), "balance").otherwise("amount").alias("kind"), F.col("seq").cast("string").alias("value"))


def amount_lines(items):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return items.select(F.col("l_orderkey").alias("block"), n.cast("long").alias("line_no"), (F.col("l_partkey") % 3).cast("long").alias("n_amounts"))


def balance_blocks(o):
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("block"), F.concat(F.lit("x 1.50 "), F.when(F.col("o_orderkey") % 3 != 0, F.concat(p, F.lit(" Cr"))).otherwise("")).alias("line1"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(p, F.lit("DR tail"))).otherwise("tail").alias("line2"),
    )


def summaries(l):
    """Printed summaries that are off in places."""
    t = L.closing_balance(l)
    off = lambda c, n: (F.col(c) + F.when(F.col("doc_id") % n == 0, 1).otherwise(0)).cast("decimal(18,2)")
    return t.select("doc_id", off("opening", 5).alias("printed_opening"), off("debits", 3).alias("printed_debits"), off("credits", 4).alias("printed_credits"), F.when(F.col("doc_id") % 2 == 0, off("closing", 6)).alias("printed_closing"), off("n_rows", 7).alias("printed_count"))


SUMMARY = f"""{ORDERED}, s AS (SELECT doc_id, count(*) AS n_rows, sum(w0)::{M} AS debits, sum(d0)::{M} AS credits, try_cast(arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS {M}) AS opening, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing FROM o GROUP BY 1),
p AS (SELECT *, (opening + (doc_id % 5 = 0)::INT)::{M} AS printed_opening, (debits + (doc_id % 3 = 0)::INT)::{M} AS printed_debits, (credits + (doc_id % 4 = 0)::INT)::{M} AS printed_credits, CASE WHEN doc_id % 2 = 0 THEN (closing + (doc_id % 6 = 0)::INT)::{M} END AS printed_closing, (n_rows + (doc_id % 7 = 0)::INT)::{M} AS printed_count FROM s)"""
FIXED = f"""{ORDERED},
m AS (SELECT *, (balance - prev)::{M} AS move, abs(balance - prev)::{M} AS size,
  balance - prev IS NULL OR ((withdrawal IS NOT NULL OR deposit IS NOT NULL) AND abs(greatest(w0, d0) - abs(balance - prev)) > 1.00
    AND (txn_date IS NULL OR prev_date IS NULL OR date_trunc('month', txn_date) <> date_trunc('month', prev_date))) AS keep FROM c),
f AS (SELECT *, CASE WHEN keep THEN w0 WHEN size <= 0.01 THEN 0 WHEN move < 0 THEN size ELSE 0 END::{M} AS nw, CASE WHEN keep THEN d0 WHEN size <= 0.01 THEN 0 WHEN move > 0 THEN size ELSE 0 END::{M} AS nd FROM m),
n AS (SELECT doc_id, seq, CASE WHEN w0 <> 0 THEN 'debit' WHEN d0 <> 0 THEN 'credit' ELSE 'none' END AS before, CASE WHEN nw <> 0 THEN 'debit' WHEN nd <> 0 THEN 'credit' ELSE 'none' END AS after,
  CASE WHEN w0 <> 0 THEN w0 ELSE d0 END::{M} AS old, CASE WHEN nw <> 0 THEN nw ELSE nd END::{M} AS new FROM f WHERE w0 <> nw OR d0 <> nd)"""


def checks(l):
    c = L.closing_check(l).select("doc_id", "status")
    n = l.groupBy("doc_id").agg(F.count("balance").alias("n_balances"))
    return c.join(n, "doc_id").select("doc_id", (F.col("doc_id") % 2 == 0).alias("known"), "status", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("n_balances")).alias("n_balances"))


def invoice_totals(x):
    t = x.groupBy("invoice_id").agg(F.sum("value").cast("decimal(18,2)").alias("taxable"))
    k = F.col("invoice_id")
    tax = F.round(F.col("taxable") * 9 / 100, 2).cast("decimal(18,2)")
    off = (F.element_at(F.array(*map(F.lit, (0, 40, -3, 250))), (k % 4 + 1).cast("int")) / F.lit(100)).cast("decimal(18,2)")
    return t.withColumns({"cgst": tax, "sgst": tax, "igst": F.lit(None).cast("decimal(18,2)")}).withColumn("grand_total", (F.col("taxable") + F.col("cgst") + F.col("sgst") + off).cast("decimal(18,2)")).select(
        "*", F.when(k % 3 == 0, F.lit(0).cast("decimal(18,2)")).alias("round_off"), F.when(k % 2 == 0, "cheque").alias("payment_note"), F.when(k % 5 == 0, F.col("grand_total")).when(k % 5 == 1, F.col("taxable")).alias("paid"),
        F.when(k % 4 == 0, F.lit(18).cast("decimal(5,2)")).alias("igst_rate"), F.lit(9).cast("decimal(5,2)").alias("cgst_rate"), F.when(k % 4 != 1, F.lit(9).cast("decimal(5,2)")).alias("sgst_rate"),
    )


TOTALS = f"""{LINES}, t0 AS (SELECT invoice_id, sum(value)::{M} AS taxable FROM invoice_lines GROUP BY 1), t1 AS (SELECT *, (((taxable * 100)::BIGINT * 9 + 50) // 100 / 100)::{M} AS cgst FROM t0),
t AS (SELECT *, cgst AS sgst, (taxable + cgst + cgst + CASE invoice_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.40 WHEN 2 THEN -0.03 ELSE 2.50 END)::{M} AS grand_total FROM t1)"""


def readings(x):
    k = F.col("line_no") + F.col("invoice_id")
    text = F.concat(F.lit("Item "), F.when(k % 3 == 0, F.concat(F.col("line_no").cast("string"), F.lit(" kgs"))).when(k % 3 == 1, F.lit("5 nos or 6 pcs")).otherwise("plain"))
    none = F.lit(None)
    return x.select("invoice_id", "line_no", text.alias("description"), F.when(k % 2 == 0, F.col("qty")).alias("qty"), F.when(k % 2 == 0, "NOS").alias("unit"), F.when(F.col("invoice_id") % 3 == 0, F.col("gst_rate")).otherwise(none).alias("gst_rate"))


def notes(o):
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    d = F.col("o_orderdate").cast("date")
    choice = [F.lit(" P.T.O. "), F.concat(F.lit("Rs "), p.cast("string")), F.lit("18%"), F.lit("27abcde1234f1z5"), F.concat(F.lit("no. "), k.cast("string")), F.date_format(d, "d/M/yy"), F.concat(F.lit("urgent: "), F.col("o_orderpriority")), F.lit("cheque received on monday"), F.lit("")]
    return o.select(
        k.alias("note_id"), F.element_at(F.array(*choice), (k % len(choice) + 1).cast("int")).alias("note"), F.array(p.cast("string"), F.lit("18.00")).alias("amounts"), F.array(F.lit("27ABCDE1234F1Z5")).alias("gstins"),
        F.concat(F.lit("INV-"), k.cast("string")).alias("invoice_no"), F.date_format(d, "dd/MM/yyyy").alias("invoice_date"), F.array(F.concat(F.lit("Acme urgent works "), F.col("o_orderpriority")), F.lit("Main street")).alias("sources"),
    )


def usage(e):
    cost = (F.col("event_id") % 100 * 3 + F.col("user_id") % 50 * 12).cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens_in"), F.sum(F.col("user_id") % 50).alias("tokens_out"), F.when(F.count_if(F.col("event_id") % 97 == 0) == 0, F.sum(cost)).alias("cost"))


PAGES = """doc_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), pages_ AS (SELECT doc_id, ((i - 1) // 20)::INT AS page, sum(length(l[i]))::BIGINT AS chars FROM doc_, unnest(range(1, len(l) + 1)) AS u(i) GROUP BY 1, 2)"""


def pages(spark, d):
    lines = T.lines_of(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))


def hybrid(spark, d):
    own = pages(spark, d).select("doc_id", "page", F.repeat(F.lit("x"), F.col("chars").cast("int")).alias("text"))
    return R.hybrid_pages(own, own.where("page % 2 = 1").select("doc_id", "page", F.lit("read").alias("text"))).select("doc_id", "page", "source")


def tally(x):
    sheets = H.tally_sheets(x, invoice_totals(x))
    out = None
    for name, df in sheets.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("sheet"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def summary_lines(o):
    k, p = F.col("o_orderkey") % 5, F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.when(k == 0, F.concat(F.lit("Total Amount Due: Rs "), p)).when(k == 1, F.concat(F.lit("New balance "), p)).when(k == 2, "Credit Limit :").when(k == 3, F.concat(p, F.lit(" x"))).otherwise("thank you")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), text.alias("text"))


def fragments(o):
    p, b = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), (F.col("o_totalprice").cast("decimal(18,2)") + 7).cast("decimal(18,2)").cast("string")
    parts = F.array(F.left(p, F.lit(2)), F.expr("substring(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), 3)"), F.left(b, F.lit(3)), F.expr("substring(CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 7 AS DECIMAL(18,2)) AS STRING), 4)"), F.lit("9.99"))
    return o.select(F.col("o_orderkey").alias("row_id"), F.posexplode(parts).alias("place", "text"))


def passbook_steps(l):
    """Ledger rows as a scan reads them: ones for fours here and there, checkpoints, dropped balances."""
    start = L.closing_balance(l).select("doc_id", (F.coalesce("opening", F.lit(0)) + 50000000).cast("decimal(18,2)").alias("opening"))
    amount = F.coalesce("withdrawal", "deposit").cast("string")
    balance = (F.col("balance") + 50000000).cast("decimal(18,2)").cast("string")
    rows = l.select("doc_id", "seq", F.when(F.col("seq") % 19 == 5, "checkpoint").otherwise("row").alias("kind"), F.when(F.col("seq") % 6 == 2, F.translate(amount, "4", "1")).otherwise(amount).alias("amount"), balance.alias("balance"))
    return rows.where("kind = 'row' OR balance IS NOT NULL").join(start, "doc_id")


def mixed_values(l):
    start = L.closing_balance(l).select("doc_id", F.coalesce("opening", F.lit(0)).alias("opening"))
    values = F.array_compact(F.array(F.coalesce("withdrawal", "deposit"), "balance"))
    rows = l.select("doc_id", "seq", F.posexplode(values).alias("k", "value"))
    return rows.select("doc_id", (F.col("seq") * 2 + F.col("k")).alias("seq"), "value").join(start, "doc_id")


PAIRS = {
    "row_06_pending_narration": (
        ledger(lambda l: W.pending_narration(pending_lines(l))),
        f"""WITH {LEDGER}, r AS (SELECT doc_id, seq, CASE WHEN seq % 5 < 2 AND txn_date IS NOT NULL THEN seq END AS dated FROM ledger),
n AS (SELECT *, last_value(dated IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above, first_value(dated IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM r)
SELECT doc_id, seq AS line_no, CASE WHEN below % 5 = 0 THEN below ELSE above END AS row_line FROM n WHERE dated IS NULL""",
    ),
    "row_07_split_by_amounts": (
        table("lineitem", lambda x: W.split_by_amounts(amount_lines(x))),
        """WITH RECURSIVE l AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no, l_partkey % 3 AS n FROM lineitem),
r AS (SELECT block, line_no, n, 1 AS part, n AS held FROM l WHERE line_no = 1 UNION ALL SELECT l.block, l.line_no, l.n, r.part + (r.held >= 2 AND l.n > 0)::INT, CASE WHEN r.held >= 2 AND l.n > 0 THEN l.n ELSE r.held + l.n END FROM r JOIN l ON l.block = r.block AND l.line_no = r.line_no + 1),
g AS (SELECT *, sum(n) OVER (PARTITION BY block, part) AS s FROM r) SELECT block, line_no, part, bool_and(s BETWEEN 1 AND 2) OVER (PARTITION BY block) AS whole FROM g""",
    ),
    "row_09_glued_fragments": (
        of("tokens", lambda t: W.glued_fragments(t.withColumn("line", F.floor(F.col("y") / 50)))),
        f"""WITH {TOKENS}, l AS (SELECT *, floor(y / 50)::BIGINT AS line FROM tokens), g AS (SELECT *, CASE WHEN x - lag(x + width) OVER w < 4 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id, line ORDER BY x, token_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line ORDER BY x, token_id) AS piece FROM g) SELECT doc_id, line, piece::BIGINT AS piece, string_agg(text, '' ORDER BY x, token_id) AS text, count(*) AS n_tokens FROM p GROUP BY 1, 2, 3""",
    ),
    "row_15_card_sections": (
        ledger(lambda l: W.card_sections(l.withColumn("line_no", F.col("seq")), F.when(F.col("seq") % 7 == 0, "transactions").when(F.col("seq") % 11 == 0, "ignore"), F.when(F.col("seq") % 13 == 0, F.col("particulars")))),
        f"""WITH {LEDGER} SELECT doc_id, seq AS line_no, last_value(CASE WHEN seq % 7 = 0 THEN 'transactions' WHEN seq % 11 = 0 THEN 'ignore' END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq) AS section,
last_value(CASE WHEN seq % 13 = 0 THEN particulars END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS card FROM ledger""",
    ),
    "row_20_outside_furniture": (
        ledger(lambda l: W.outside_furniture(framed_lines(l)).select("doc_id", "page", "line_no")),
        f"""WITH {LEDGER}, h AS (SELECT *, max(seq) FILTER (seq % 9 = 2) OVER (PARTITION BY doc_id, page) AS head FROM ledger), e AS (SELECT *, min(CASE WHEN seq % 9 = 7 AND seq > coalesce(head, -1) THEN seq END) OVER (PARTITION BY doc_id, page) AS last FROM h)
SELECT doc_id, page, seq AS line_no FROM e WHERE (head IS NULL OR seq > head) AND (last IS NULL OR seq < last)""",
    ),
    "row_21_cells_to_rows": (
        ledger(lambda l: W.cells_to_rows(cells(l))),
        f"""WITH {LEDGER}, c AS (SELECT doc_id, seq, seq % 5 AS k, particulars || '#' || seq AS t, sum((seq % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS row FROM ledger)
SELECT doc_id, row::BIGINT AS row, arg_min(t, seq) FILTER (k = 0) AS date, coalesce(string_agg(t, ' ' ORDER BY seq) FILTER (k IN (1, 2)), '') AS particulars, arg_min(t, seq) FILTER (k = 3) AS amount, arg_min(t, seq) FILTER (k = 4) AS balance FROM c WHERE row > 0 GROUP BY 1, 2""",
    ),
    "row_22_inline_rows": (
        ledger(lambda l: W.inline_rows(inline_lines(l))),
        f"WITH {LEDGER} SELECT doc_id, seq AS line_no, txn_date AS date, particulars, 'REF0' || lpad(seq::VARCHAR, 8, '0') AS ref, txn_date AS value_date FROM ledger WHERE txn_date IS NOT NULL",
    ),
    "row_25_claimed_spans": (
        ledger(lambda l: K.claimed_spans(draft_lines(l))),
        f"""WITH {LEDGER}, d AS (SELECT *, {BIG} AS b, coalesce(withdrawal, deposit) AS a, strftime(txn_date, '%d-%m-%Y') AS day, replace(particulars, ' / ref ', '/REF') AS said, lpad((seq % 10000)::VARCHAR, 7, '0') AS key, seq % 7 <> 5 AS has FROM ledger),
e AS (SELECT *, CASE WHEN seq % 7 = 3 THEN '5' || key WHEN has THEN 'S' || key END AS ref, has AND length(cheque_no) >= 5 AS numbered, CASE WHEN seq % 2 = 0 AND has THEN 'TFR' END AS type FROM d)
SELECT doc_id, seq AS line_no, txn_date AS date, txn_date AS value_date, type, ref AS tran_id, seq % 7 = 3 AS by_digits, CASE WHEN numbered THEN cheque_no END AS cheque_no, a AS amount, b AS balance, CASE WHEN seq % 3 = 0 THEN 'DR' ELSE 'CR' END AS side,
  concat_ws(' ', said_, CASE WHEN has AND NOT coalesce(numbered, true) THEN cheque_no END) AS particulars,
  concat_ws('; ', 'date:' || day, CASE WHEN seq % 3 = 0 THEN 'value date:' || day END, 'side:' || CASE WHEN seq % 3 = 0 THEN 'Dr' ELSE 'CR' END, 'amounts:' || concat_ws('+', a::VARCHAR, b::VARCHAR), CASE WHEN has AND seq % 7 <> 3 THEN 'id:' || ref END, CASE WHEN seq % 7 = 3 THEN 'id by digits:' || ref END,
    'type:' || type, CASE WHEN numbered THEN 'cheque:' || cheque_no END) AS claims FROM (SELECT *, said AS said_ FROM e) x""",
    ),
    "row_26_recovered_balance": (
        table("orders", lambda o: W.recovered_balance(balance_blocks(o))),
        f"SELECT o_custkey AS doc_id, o_orderkey AS block, CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 THEN o_totalprice::{M} END AS balance, CASE WHEN o_orderkey % 3 <> 0 THEN 'row_start' WHEN o_orderkey % 2 = 0 THEN 'continuation' END AS source FROM orders",
    ),
    "row_27_sub_tables": (
        ledger(lambda l: W.sub_tables(kinds(l))),
        f"""WITH {LEDGER}, k AS (SELECT doc_id, seq, CASE WHEN seq % 12 = 11 THEN 'heading' WHEN seq % 12 IN (0, 4, 5, 8) THEN 'date' WHEN seq % 12 IN (2, 6, 9) THEN 'balance' ELSE 'amount' END AS kind FROM ledger),
b AS (SELECT *, last_value(CASE WHEN kind <> 'amount' THEN kind END IGNORE NULLS) OVER w AS last, last_value(CASE WHEN kind = 'date' THEN seq END IGNORE NULLS) OVER w AS d, last_value(CASE WHEN kind = 'balance' THEN seq END IGNORE NULLS) OVER w AS v FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, sum((kind = 'heading' OR (kind = 'date' AND coalesce(last, '') = 'balance'))::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS tab FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tab ORDER BY seq) AS i FROM t)
SELECT doc_id, tab::BIGINT AS "table", count(*) AS n, max(d::VARCHAR) FILTER (i = 1) AS date_before, max(v::VARCHAR) FILTER (i = 1) AS balance_before FROM f GROUP BY 1, 2""",
    ),
    "join_02_nearest_band": (
        of("tokens", lambda t: W.nearest_band(t, [("a", 100.0), ("b", 300.0), ("c", 520.0)])),
        f"""WITH {TOKENS}, d AS (SELECT doc_id, token_id, abs(x + width - 100) AS a, abs(x + width - 300) AS b, abs(x + width - 520) AS c FROM tokens)
SELECT doc_id, token_id, CASE WHEN a <= b AND a <= c THEN 'a' WHEN b <= c THEN 'b' ELSE 'c' END AS "column", least(a, b, c) AS distance FROM d""",
    ),
    "join_16_history": (
        table("orders", lambda o: I.in_history(o.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("supplier_id"), F.concat(F.lit("00a "), (F.col("o_orderkey") % 50).cast("string")).alias("invoice_no")).where("invoice_id % 2 = 0"), o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("supplier_id"), F.concat(F.lit("A"), (F.col("o_orderkey") % 50 - 1).cast("string")).alias("invoice_no")))),
        "SELECT a.o_orderkey AS invoice_id, EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey % 2 = 1 AND b.o_custkey = a.o_custkey AND b.o_orderkey % 50 - 1 = a.o_orderkey % 50) AS in_history FROM orders a WHERE a.o_orderkey % 2 = 0",
    ),
    "win_05_change_notes": (ledger(H.corrections), f"WITH {FIXED} SELECT *, 'printed ' || before || ' ' || old || ' changed to ' || after || ' ' || new AS note FROM n"),
    "chk_07_corrections_by_kind": (
        ledger(H.corrections_by_kind),
        f"""WITH {FIXED} SELECT doc_id, CASE WHEN before = after THEN 'printed ' || before || ' amount changed' ELSE 'printed ' || before || ' changed to ' || after END AS kind, count(*) AS n, min(seq) AS first_seq, sum(CASE WHEN after = 'none' THEN old ELSE new END)::{M} AS total FROM n GROUP BY 1, 2""",
    ),
    "win_14_month_continuity": (
        ledger(lambda l: L.monthly(l).select("doc_id", "month", "opening", "closing")),
        f"WITH {LEDGER}, m AS (SELECT doc_id, date_trunc('month', txn_date)::DATE AS month, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing FROM ledger WHERE txn_date IS NOT NULL GROUP BY 1, 2) SELECT doc_id, month, lag(closing) OVER (PARTITION BY doc_id ORDER BY month) AS opening, closing FROM m",
    ),
    "chk_17_month_checks": (
        ledger(lambda l: L.monthly(l).select("doc_id", "month", F.col("check_").alias("verdict"))),
        f"""WITH {LEDGER}, m AS (SELECT doc_id, date_trunc('month', txn_date)::DATE AS month, sum(coalesce(withdrawal, 0)) AS w, sum(coalesce(deposit, 0)) AS d, arg_max(balance, seq) FILTER (balance IS NOT NULL) AS closing FROM ledger WHERE txn_date IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, abs(lag(closing) OVER (PARTITION BY doc_id ORDER BY month) + d - w - closing) AS gap FROM m) SELECT doc_id, month, CASE WHEN gap IS NULL THEN 'UNVERIFIED' WHEN gap <= 0.05 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM g""",
    ),
    "win_16_row_chain": (
        ledger(lambda l: L.balance_breaks(l, "0.02").select("doc_id", "seq", "difference")),
        f"WITH {ORDERED} SELECT doc_id, seq, (balance - expected)::{M} AS difference FROM c WHERE abs(expected - balance) > 0.02",
    ),
    "win_18_last_balance": (
        ledger(lambda l: l.select("doc_id", "seq", F.last("balance", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq")).alias("last_balance"))),
        f"WITH {LEDGER} SELECT doc_id, seq, last_value(balance IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS last_balance FROM ledger",
    ),
    "win_23_next_dated": (
        ledger(lambda l: P.looking_ahead(l).select("doc_id", "seq", "next_date")),
        f"WITH {LEDGER} SELECT doc_id, seq, coalesce(lead(txn_date, 1) OVER w, lead(txn_date, 2) OVER w, lead(txn_date, 3) OVER w) AS next_date FROM ledger WINDOW w AS (PARTITION BY doc_id ORDER BY seq)",
    ),
    "win_24_back_computed_opening": (
        ledger(lambda l: L.closing_balance(l).select("doc_id", "opening")),
        f"WITH {ORDERED}, s AS (SELECT doc_id, arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS o_ FROM o GROUP BY 1) SELECT doc_id, try_cast(o_ AS {M}) AS opening FROM s",
    ),
    "agg_02_chronological_closing": (
        ledger(lambda l: L.closing_balance(l).select("doc_id", "debits", "credits", "closing")),
        f"WITH {ORDERED} SELECT doc_id, sum(w0)::{M} AS debits, sum(d0)::{M} AS credits, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing FROM o GROUP BY 1",
    ),
    "agg_03_printed_first": (
        ledger(lambda l: V.against_printed(l, summaries(l).select("doc_id", "printed_debits", "printed_credits", "printed_closing")).select("doc_id", "debits", "credits", "closing")),
        f"WITH {SUMMARY} SELECT doc_id, printed_debits AS debits, printed_credits AS credits, coalesce(printed_closing, closing) AS closing FROM p",
    ),
    "agg_04_card_totals": (
        of("card", C.totals),
        f"WITH {CARD} SELECT doc_id, count(*) AS n_rows, coalesce(sum(amount) FILTER (type = 'debit'), 0)::{M} AS debits, coalesce(sum(amount) FILTER (type = 'credit'), 0)::{M} AS credits FROM card GROUP BY 1",
    ),
    "prj_05_card_columns": (
        of("card", lambda c: c.select("doc_id", "seq", F.when(F.col("type") == "debit", F.col("amount")).alias("debit"), F.when(F.col("type") == "credit", F.col("amount")).alias("credit"))),
        f"WITH {CARD} SELECT doc_id, seq, CASE WHEN type = 'debit' THEN amount END AS debit, CASE WHEN type = 'credit' THEN amount END AS credit FROM card",
    ),
    "prj_04_row_shapes": (
        of("card", lambda c: c.select("doc_id", "seq", F.col("txn_date").alias("date"), F.col("description").alias("particulars"), F.col("ref_no").alias("cheque_no"), F.when(F.col("type") == "debit", F.col("amount")).alias("withdrawal"), F.when(F.col("type") == "credit", F.col("amount")).alias("deposit"), "balance")),
        f"WITH {CARD} SELECT doc_id, seq, txn_date AS date, description AS particulars, ref_no AS cheque_no, CASE type WHEN 'debit' THEN amount END AS withdrawal, CASE type WHEN 'credit' THEN amount END AS deposit, balance FROM card",
    ),
    "prj_02_account_block": (
        table("customer", lambda c: D.label_values(c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Account Holder : "), "c_name").alias("text")), F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("  Segment:  "), "c_mktsegment").alias("text")), F.struct(F.lit(3).alias("line_no"), F.lit("SEGMENT: other").alias("text"))))).select("doc_id", "col.*"))),
        "SELECT c_custkey AS doc_id, 'account holder' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer",
    ),
    "agg_09_gst_rows": (
        of("invoice_lines", lambda x: H.gst_rows(x, invoice_totals(x).where("invoice_id % 2 = 0").select("invoice_id", F.col("taxable").alias("printed_taxable"), F.col("cgst").alias("printed_cgst")))),
        f"""WITH {TOTALS}, g AS (SELECT invoice_id, gst_rate, sum(value)::{M} AS taxable, min(line_no) AS f FROM invoice_lines GROUP BY 1, 2), n AS (SELECT g.*, count(*) OVER (PARTITION BY g.invoice_id) AS rates, t.cgst FROM g JOIN t USING (invoice_id))
SELECT invoice_id, gst_rate, taxable, CASE WHEN rates = 1 AND invoice_id % 2 = 0 THEN cgst ELSE (((taxable * 100)::BIGINT * gst_rate::BIGINT + 100) // 200 / 100)::{M} END AS cgst, gst_rate IS NULL AS yellow, row_number() OVER (PARTITION BY invoice_id ORDER BY gst_rate IS NULL, f)::INT AS place FROM n""",
    ),
    "agg_11_arithmetic_summary": (
        of("invoice_lines", lambda x: H.arithmetic_summary(invoice_totals(x))),
        f"WITH {TOTALS} SELECT invoice_id, taxable || ' + ' || cgst || ' + ' || sgst || ' = ' || (taxable + cgst + sgst)::{M} || CASE WHEN invoice_id % 4 = 0 THEN '' ELSE ', round-off ' || (grand_total - taxable - cgst - sgst)::{M} || ' = ' || grand_total END AS summary FROM t",
    ),
    "chk_12_reading_rules": (
        of("invoice_lines", lambda x: H.reading_rules(readings(x), invoice_totals(x))),
        f"""WITH {LINES}, k AS (SELECT *, (line_no + invoice_id) % 3 AS a, (line_no + invoice_id) % 2 = 0 AS has, CASE WHEN invoice_id % 3 = 0 THEN gst_rate END AS r FROM invoice_lines), n AS (SELECT *, count(r) OVER (PARTITION BY invoice_id) AS rated FROM k)
SELECT invoice_id, line_no, CASE WHEN has THEN qty WHEN a = 0 THEN line_no END::DECIMAL(18,4) AS qty, CASE WHEN has THEN 'NOS' WHEN a = 0 THEN 'KGS' END AS unit, NOT has AND a = 0 AS derived, coalesce(r, CASE WHEN rated = 0 AND invoice_id % 4 <> 1 THEN 18 END)::DECIMAL(5,2) AS gst_rate FROM n""",
    ),
    "chk_12_round_off": (
        of("invoice_lines", lambda x: H.round_off(invoice_totals(x))),
        f"""WITH {TOTALS} SELECT invoice_id, CASE invoice_id % 4 WHEN 0 THEN CASE WHEN invoice_id % 3 = 0 THEN 0 END WHEN 1 THEN 0.40 WHEN 2 THEN -0.03 ELSE CASE WHEN invoice_id % 3 = 0 THEN 0 END END::{M} AS round_off,
  CASE WHEN invoice_id % 2 <> 0 AND invoice_id % 5 > 1 THEN NULL WHEN invoice_id % 5 > 1 THEN 'paid' WHEN invoice_id % 5 = 0 OR taxable >= grand_total - 1 THEN 'paid' ELSE 'partial' END AS payment FROM t""",
    ),
    "chk_01_validation_report": (
        ledger(L.counts_of_faults),
        f"""WITH {FIXED.rsplit("n AS (SELECT", 1)[0]}d AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, {KEY}) AS first_ FROM f),
s AS (SELECT doc_id, count(*) FILTER (abs(expected - balance) > 0.05) AS breaks, sum(w0)::{M} AS debits, sum(d0)::{M} AS credits, try_cast(arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS {M}) AS opening, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing,
  count(*) FILTER (w0 <> nw OR d0 <> nd) AS corrections, count(*) FILTER (seq <> first_) AS duplicates, count(*) FILTER ((w0 <> 0 AND d0 <> 0) OR (NOT is_reversal AND (w0 < 0 OR d0 < 0))) AS side_faults,
  count(*) FILTER (100 - CASE WHEN txn_date IS NULL THEN 40 ELSE 0 END - CASE WHEN withdrawal IS NULL AND deposit IS NULL THEN 40 ELSE 0 END - CASE WHEN abs(expected - balance) > 0.05 THEN 30 ELSE 0 END - CASE WHEN ocr_corrected THEN 15 ELSE 0 END < 80) AS weak_rows, count(*) AS n_rows FROM d GROUP BY 1)
SELECT *, (opening + credits - debits - closing)::{M} AS difference FROM s""",
    ),
    "chk_08_unknown_layout": (
        ledger(lambda l: H.unknown_layout(checks(l))),
        f"""WITH {ORDERED}, s AS (SELECT doc_id, count(*) FILTER (abs(expected - balance) > 0.05) AS breaks, sum(w0) AS w, sum(d0) AS d, try_cast(arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS {M}) AS opening, arg_max(balance, ord) FILTER (balance IS NOT NULL) AS closing, count(balance) AS nb FROM c GROUP BY 1),
t AS (SELECT doc_id, coalesce(opening + d - w - closing IS NOT NULL AND (abs(opening + d - w - closing) > 0.05 OR breaks > 0), FALSE) AS bad, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE nb END AS nb FROM s)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN bad THEN 'not recognised and does not reconcile' WHEN nb = 0 THEN 'not recognised and no balances to verify by' ELSE 'not recognised, verified by balance chain only' END AS layout_note, CASE WHEN bad OR (doc_id % 2 <> 0 AND nb = 0) THEN 'needs_review' ELSE 'ok' END AS review FROM t""",
    ),
    "chk_10_fallback_status": (
        table("orders", lambda o: H.fallback_status(o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, "OK").when(F.col("o_orderkey") % 3 == 1, "MISMATCH").otherwise("UNVERIFIED").alias("status"), (F.col("o_orderkey") % 4).alias("n_unread")))),
        """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 4 > 0 THEN 'UNVERIFIED' ELSE 'OK' END WHEN 1 THEN 'MISMATCH' ELSE 'UNVERIFIED' END AS status,
CASE WHEN o_orderkey % 3 > 0 THEN 'does not reconcile' WHEN o_orderkey % 4 = 0 THEN 'verified by printed totals only' ELSE 'totals match, but ' || (o_orderkey % 4) || ' line(s) unread' END AS note FROM orders""",
    ),
    "chk_18_statement_issues": (
        ledger(lambda l: H.statement_issues(l, summaries(l))),
        f"""WITH {SUMMARY} SELECT doc_id, 'opening' AS issue, opening AS found, printed_opening AS printed FROM p WHERE doc_id % 5 = 0 AND opening IS NOT NULL UNION ALL SELECT doc_id, 'debits', debits, printed_debits FROM p WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'credits', credits, printed_credits FROM p WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'closing', closing, printed_closing FROM p WHERE doc_id % 6 = 0 AND closing IS NOT NULL UNION ALL SELECT doc_id, 'count', n_rows::{M}, printed_count FROM p WHERE doc_id % 7 = 0""",
    ),
    "snk_03_legacy_sheet": (
        ledger(H.legacy_sheet),
        f"""WITH {ORDERED} SELECT doc_id, seq AS place, txn_date AS date, particulars AS description, withdrawal AS debit, deposit AS credit, balance, CASE WHEN bool_or(ocr_corrected) OVER (PARTITION BY doc_id) THEN CASE WHEN ocr_corrected THEN 'Yes' ELSE '' END END AS corrected FROM ledger
UNION ALL SELECT doc_id, 4611686018427387904, NULL, 'GRAND TOTAL', sum(w0)::{M}, sum(d0)::{M}, arg_max(balance, ord) FILTER (balance IS NOT NULL), NULL FROM o GROUP BY 1""",
    ),
    "snk_04_account_checks": (
        ledger(lambda l: H.account_checks(l, summaries(l))),
        f"""WITH {SUMMARY}, u AS (SELECT doc_id, 'Transactions Extracted' AS "check", n_rows::{M} AS calculated, printed_count AS printed FROM p UNION ALL SELECT doc_id, 'Opening Balance', opening, printed_opening FROM p UNION ALL SELECT doc_id, 'Total Debits', debits, printed_debits FROM p
UNION ALL SELECT doc_id, 'Total Credits', credits, printed_credits FROM p UNION ALL SELECT doc_id, 'Closing Balance', closing, printed_closing FROM p) SELECT *, CASE WHEN calculated IS NULL OR printed IS NULL THEN '' WHEN calculated = printed THEN 'PASS' ELSE 'FAIL' END AS status FROM u""",
    ),
    "snk_05_review_sheet": (
        ledger(lambda l: H.review_sheet(l.where("balance IS NULL").select("doc_id", F.col("seq").alias("place"), F.concat(F.lit("no balance: "), "particulars").alias("reason")))),
        f"""WITH {LEDGER}, f AS (SELECT doc_id, 'no balance: ' || particulars AS reason, min(seq) AS place FROM ledger WHERE balance IS NULL GROUP BY 1, 2), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INT AS line, reason FROM f)
SELECT doc_id, line, line || '. ' || reason AS text FROM n UNION ALL SELECT DISTINCT doc_id, 0, 'NEEDS REVIEW' FROM f""",
    ),
    "snk_06_sheets_of": (
        ledger(H.sheets_of),
        f"""WITH {LEDGER} SELECT doc_id, concat_ws('; ', 'Statement of Account', CASE WHEN bool_or(balance IS NULL) THEN 'Review Required' END, CASE WHEN bool_or(ocr_corrected) THEN 'Logs' END, CASE WHEN count(DISTINCT date_trunc('month', txn_date)) > 1 THEN 'Monthly Check' END) AS sheets FROM ledger GROUP BY 1""",
    ),
    "snk_07_read_back": (
        ledger(lambda l: H.read_back(l, l.where("seq % 41 <> 0"))),
        f"""WITH {LEDGER}, a AS (SELECT doc_id, count(*) AS n_written, sum(coalesce(balance, 0))::{M} AS sum_written, nullif(count(*) FILTER (seq % 41 <> 0), 0) AS n_read, sum(coalesce(balance, 0)) FILTER (seq % 41 <> 0)::{M} AS sum_read FROM ledger GROUP BY 1)
SELECT doc_id, n_written, sum_written, n_read, sum_read FROM a WHERE n_written IS DISTINCT FROM n_read OR sum_written IS DISTINCT FROM sum_read""",
    ),
    "snk_02_opening_line": (
        ledger(lambda l: L.opening_row(l).join(l.where("seq % 23 = 0").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "balance")),
        f"WITH {ORDERED} SELECT doc_id, try_cast(arg_min(coalesce((balance + w0 - d0)::VARCHAR, 'x'), ord) AS {M}) AS balance FROM o GROUP BY 1 HAVING count(*) FILTER (seq % 23 = 0) = 0",
    ),
    "snk_10_total_row": (
        ledger(lambda l: H.with_total_row(l.groupBy(F.date_format("txn_date", "yyyy").alias("year")).agg(F.sum("withdrawal").alias("withdrawal"), F.sum("deposit").alias("deposit")), "year", "TOTAL", ["withdrawal", "deposit"])),
        f"WITH {LEDGER} SELECT strftime(txn_date, '%Y') AS year, sum(withdrawal)::{M} AS withdrawal, sum(deposit)::{M} AS deposit FROM ledger GROUP BY 1 UNION ALL SELECT 'TOTAL', sum(withdrawal)::{M}, sum(deposit)::{M} FROM ledger",
    ),
    "snk_11_register_sheet": (
        of("register", lambda r: H.register_sheet(r.withColumn("rate", F.lit("12.50").cast("decimal(10,2)")).withColumn("value", (F.col("net") * F.lit("12.50").cast("decimal(10,2)")).cast("decimal(18,2)")), F.concat(F.lit("Sales "), "product"))),
        f"WITH {REG} SELECT row_number() OVER (ORDER BY day, product)::INT AS sr, day, product AS item, net AS qty, 12.50::DECIMAL(10,2) AS rate, (net * 12.50)::{M} AS amount, 'Sales ' || product AS ledger FROM register",
    ),
    "snk_12_validation_sheet": (
        ledger(H.validation_sheet),
        f"""WITH {LEDGER}, p AS (SELECT doc_id, page, count(*) AS n_rows, sum(coalesce(withdrawal, 0))::{M} AS debits, sum(coalesce(deposit, 0))::{M} AS credits FROM ledger GROUP BY 1, 2)
SELECT *, sum(debits) OVER w::{M} AS debits_so_far, sum(credits) OVER w::{M} AS credits_so_far FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)""",
    ),
    "snk_13_file_names": (
        table("part", lambda p: p.select("p_partkey", writers.sheet_name(F.concat("p_brand", F.lit(" / "), "p_type", F.lit(".PDF"))).alias("name"))),
        "SELECT p_partkey, regexp_replace(p_brand || ' / ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM part",
    ),
    "flt_21_repeated_notes": (
        table("orders", lambda o: H.repeats_invoice(notes(o))),
        "SELECT o_orderkey AS note_id, o_orderkey % 9 <> 7 AS repeats FROM orders",
    ),
    "agg_15_most_read_date": (
        ledger(lambda l: l.where("txn_date IS NOT NULL").groupBy("doc_id", "page", "txn_date").agg(F.count("*").alias("n"), F.min("seq").alias("f")).groupBy("doc_id", "page").agg(F.max_by("txn_date", F.struct("n", -F.col("f"))).alias("date"))),
        f"WITH {LEDGER}, v AS (SELECT doc_id, page, txn_date, count(*) AS n, min(seq) AS f FROM ledger WHERE txn_date IS NOT NULL GROUP BY 1, 2, 3) SELECT doc_id, page, txn_date AS date FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, f) = 1",
    ),
    "agg_17_upper_median": (
        ledger(lambda l: l.where("balance IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list("balance")).alias("b")).select("doc_id", F.element_at("b", F.floor(F.size("b") / 2).cast("int") + 1).alias("median"))),
        f"WITH {LEDGER}, s AS (SELECT doc_id, balance, row_number() OVER (PARTITION BY doc_id ORDER BY balance) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ledger WHERE balance IS NOT NULL) SELECT doc_id, balance AS median FROM s WHERE i = n // 2 + 1",
    ),
    "agg_18_gap_clusters": (
        of("tokens", lambda t: T.cluster(t, 3).groupBy("doc_id", "line").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"))),
        f"""WITH {TOKENS}, g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, token_id) > 3 THEN 1 ELSE 0 END AS new FROM tokens), c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY y, token_id)::BIGINT AS line FROM g)
SELECT doc_id, line, min(y) AS low, max(y) AS high, count(*) AS n FROM c GROUP BY 1, 2""",
    ),
    "agg_21_shape_repetition": (
        ledger(lambda l: l.withColumn("shape", S.digit_shape(F.col("particulars"))).groupBy("doc_id", "shape").agg(F.count_distinct("page").alias("pages"))),
        f"WITH {LEDGER} SELECT doc_id, regexp_replace(lower(particulars), '[0-9]', '#', 'g') AS shape, count(DISTINCT page) AS pages FROM ledger GROUP BY 1, 2",
    ),
    "agg_22_usage_sums": (
        table("events", usage),
        "SELECT event_type, count(*) AS calls, sum(event_id % 100)::BIGINT AS tokens_in, sum(user_id % 50)::BIGINT AS tokens_out, CASE WHEN count(*) FILTER (event_id % 97 = 0) = 0 THEN sum(event_id % 100 * 3 + user_id % 50 * 12)::BIGINT END AS cost FROM events GROUP BY 1",
    ),
    "agg_23_printed_totals": (
        ledger(lambda l: V.printed_totals(l.select("doc_id", F.col("seq").alias("line_no"), F.concat(F.when(F.col("seq") % 3 == 0, "Total Debits : ").when(F.col("seq") % 3 == 1, "TOTAL CREDIT ").otherwise("Closing Balance: "), (F.col("balance") + 50000000).cast("decimal(18,2)").cast("string")).alias("text")).where("text IS NOT NULL"))),
        f"WITH {LEDGER}, b AS (SELECT doc_id, seq, seq % 3 AS k, {BIG} AS b FROM ledger WHERE balance IS NOT NULL) SELECT doc_id, arg_max(b, seq) FILTER (k = 0) AS printed_debits, arg_max(b, seq) FILTER (k = 1) AS printed_credits, arg_max(b, seq) FILTER (k = 2) AS printed_closing FROM b GROUP BY 1",
    ),
    "agg_24_deposits_less_opening": (
        ledger(lambda l: L.closing_balance(l).join(summaries(l), "doc_id").select("doc_id", (F.col("printed_credits") - F.col("opening")).cast("decimal(18,2)").alias("deposits"))),
        f"WITH {SUMMARY} SELECT doc_id, (printed_credits - opening)::{M} AS deposits FROM p",
    ),
    "dis_07_duplicate_days": (
        table("events", lambda e: e.select("event_id", F.col("event_type").alias("product"), F.day("ts").alias("day")).transform(G.duplicate_days, ["product", "day"], "event_id")),
        "SELECT event_type AS product, day(ts)::INT AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, day(ts) ORDER BY event_id) = 2",
    ),
    "srt_02_reading_order": (
        of("tokens", lambda t: t.select("doc_id", "token_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.floor(F.col("y") / 8), "x", "token_id")).alias("place"))),
        f"WITH {TOKENS} SELECT doc_id, token_id, row_number() OVER (PARTITION BY doc_id ORDER BY floor(y / 8), x, token_id)::INT AS place FROM tokens",
    ),
    "srt_03_by_severity": (
        ledger(lambda l: L.confidence(l).where("reasons <> ''").select("doc_id", "seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("reasons").contains("no_date"), 0).when(F.col("reasons").contains("chain"), 1).otherwise(2), "seq")).alias("place"))),
        f"""WITH {ORDERED}, r AS (SELECT doc_id, seq, txn_date IS NULL AS nd, coalesce(abs(expected - balance) > 0.05, FALSE) AS ch, withdrawal IS NULL AND deposit IS NULL AS na, ocr_corrected AS oc FROM c)
SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN nd THEN 0 WHEN ch THEN 1 ELSE 2 END, seq)::INT AS place FROM r WHERE nd OR ch OR na OR oc""",
    ),
    "srt_04_undated_first": (
        ledger(lambda l: l.select("doc_id", "seq", F.rank().over(Window.partitionBy("doc_id").orderBy(F.coalesce("txn_date", F.lit("1970-01-01").cast("date")))).alias("rank"))),
        f"WITH {LEDGER} SELECT doc_id, seq, rank() OVER (PARTITION BY doc_id ORDER BY coalesce(txn_date, DATE '1970-01-01'))::INT AS rank FROM ledger",
    ),
    "srt_05_configured_order": (
        of("register", lambda r: r.select("product", "day", F.row_number().over(Window.partitionBy("day").orderBy(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("purchase", "click", "error"))), F.col("product")), F.lit(0)), F.lit(99)), "product")).alias("place"))),
        f"WITH {REG} SELECT product, day, row_number() OVER (PARTITION BY day ORDER BY CASE product WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 99 END, product)::INT AS place FROM register",
    ),
    "lim_01_cheapest": (
        of("tokens", lambda t: t.groupBy("doc_id").agg(F.min_by("token_id", F.struct(F.abs(F.col("x") - 300), "token_id")).alias("token_id"))),
        f"WITH {TOKENS} SELECT doc_id, token_id FROM tokens QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(x - 300), token_id) = 1",
    ),
    "lim_02_first_five": (
        ledger(lambda l: D.first_few(l.where("balance IS NULL"), 5)),
        f"""WITH {LEDGER}, n AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ledger WHERE balance IS NULL)
SELECT doc_id, string_agg(seq::VARCHAR, ', ' ORDER BY seq) || CASE WHEN max(n) > 5 THEN ' +' || (max(n) - 5) || ' more' ELSE '' END AS shown FROM n WHERE i <= 5 GROUP BY 1""",
    ),
    "lim_03_history": (
        table("orders", lambda o: o.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey")),
        "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    ),
    "set_01_union_of_sources": (
        table("orders", lambda o: o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("source"), F.col("o_orderkey").alias("row")).where("row % 4 = 0").unionByName(o.select(F.col("o_custkey").alias("doc_id"), F.lit(2).alias("source"), F.col("o_orderkey").alias("row")).where("row % 4 <> 0")).withColumn("first", F.min("source").over(Window.partitionBy("doc_id"))).where("source = first").select("doc_id", "source", "row")),
        "WITH u AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS source, o_orderkey AS row FROM orders) SELECT doc_id, source, row FROM u QUALIFY source = min(source) OVER (PARTITION BY doc_id)",
    ),
    "set_02_shared_words": (
        table("orders", lambda o: o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b")).select("o_custkey", F.size(F.array_intersect("a", "b")).alias("shared"))),
        "SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')::INT AS shared FROM orders GROUP BY 1",
    ),
    "set_05_distinct_months": (
        ledger(lambda l: l.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("txn_date", "yyyy-MM"))), ",").alias("months"))),
        f"WITH {LEDGER} SELECT doc_id, coalesce(string_agg(DISTINCT strftime(txn_date, '%Y-%m'), ',' ORDER BY strftime(txn_date, '%Y-%m')), '') AS months FROM ledger GROUP BY 1",
    ),
    "src_02_password_errors": (
        table("orders", lambda o: o.select("o_orderkey", R.password_problem(F.element_at(F.array(F.lit("No password given"), F.lit("Incorrect Password"), F.lit("file is damaged"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("problem"))),
        "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'password_required' WHEN 1 THEN 'password_wrong' WHEN 2 THEN 'unreadable' END AS problem FROM orders",
    ),
    "src_06_word_tables": (
        table("orders", lambda o: R.parse_word_table(o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("level\tpage\n5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95\t"), "o_orderpriority", F.lit("\n4\t1\t1\t1\t1\t0\t1\t2\t3\t4\t-1\t\n5\t1\t1\t1\t1\t2\t50\t60\t7\t8\t90\t \n")).alias("tsv")))),
        "SELECT o_orderkey AS doc_id, 1 AS row_no, 10::DOUBLE AS \"left\", 20::DOUBLE AS top, 30::DOUBLE AS width, 40::DOUBLE AS height, o_orderpriority AS text FROM orders",
    ),
    "src_12_invoice_preparation": (
        table("documents", lambda d: d.select("doc_id", F.when(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")) >= 200, "text").otherwise("images").alias("route"))),
        r"SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g')) >= 200 THEN 'text' ELSE 'images' END AS route FROM documents",
    ),
    "src_14_json_in_replies": (
        table("events", lambda e: e.select("event_id", F.get_json_object(R.json_in_reply(F.concat(F.lit("Here it is:\n"), "props", F.lit("\nDone."))), "$.k").alias("k"))),
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    ),
    "src_18_known_files": (
        table("documents", lambda d: d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).join(d.where("doc_id % 2 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).distinct(), "h", "left_semi").select("doc_id")),
        "SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)",
    ),
    "src_21_typed_rows": (
        table("events", lambda e: R.typed_errors(e.select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit('{"k": "x"}')).when(F.col("event_id") % 5 == 1, F.lit("{}")).otherwise(F.col("props")).alias("reply")))),
        "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE event_id % 5 WHEN 0 THEN 'k: not a number' WHEN 1 THEN 'k: missing' ELSE '' END AS errors FROM events",
    ),
    "flt_12_good_text_layer": (
        lambda s, d: R.text_layer(pages(s, d)).select("doc_id", "good_layer"),
        f"WITH {PAGES} SELECT doc_id, count(*) FILTER (chars > 200) * 2 >= count(*) AS good_layer FROM pages_ GROUP BY 1",
    ),
    "flt_13_sparse_text_layer": (
        lambda s, d: R.text_layer(pages(s, d)).select("doc_id", "sparse"),
        f"WITH {PAGES} SELECT doc_id, count(*) FILTER (chars > 0) * 2 < count(*) AS sparse FROM pages_ GROUP BY 1",
    ),
    "src_04_word_boxes": (
        table("orders", lambda o: R.words_from_json(o.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("WordText"), F.lit(1.5).alias("Left"), F.lit(2.5).alias("Top")), F.struct(F.col("o_orderstatus").alias("WordText"), F.lit(3.5).alias("Left"), F.lit(2.5).alias("Top"))).alias("Words"))).alias("Lines")).alias("TextOverlay"))).alias("reply")))),
        "SELECT o_orderkey AS doc_id, 0 AS line_no, 0 AS word_no, o_orderpriority AS text, 1.5::DOUBLE AS \"left\", 2.5::DOUBLE AS top FROM orders UNION ALL SELECT o_orderkey, 0, 1, o_orderstatus, 3.5, 2.5 FROM orders",
    ),
    "src_08_hybrid_pages": (
        hybrid,
        f"WITH {PAGES} SELECT doc_id, page, CASE WHEN chars >= 100 OR page % 2 = 0 THEN 'text' ELSE 'recognised' END AS source FROM pages_",
    ),
    "src_09_routes": (
        table("orders", lambda o: R.route(o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 40).alias("pages"), (F.col("o_totalprice") * 10).cast("long").alias("bytes"), (F.col("o_orderkey") % 11 == 0).alias("cached"), (F.col("o_orderkey") % 13 != 0).alias("has_key")))),
        "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'cache' WHEN o_orderkey % 40 > 30 OR o_orderkey % 13 = 0 THEN 'local' WHEN o_orderkey % 40 > 3 OR o_totalprice * 10 >= 1200001 THEN 'split' ELSE 'remote' END AS route FROM orders",
    ),
    "src_13_recorded_lines": (
        of("invoice_lines", lambda x: R.recorded_lines(x.groupBy("invoice_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("line_no", F.col("value").cast("string").alias("value")))).alias("lineItems"))).alias("reply")), "lineItems array<struct<line_no:int,value:decimal(18,2)>>")),
        f"WITH {LINES} SELECT invoice_id, line_no - 1 AS line, line_no, value FROM invoice_lines",
    ),
    "src_17_latest_readings": (
        table("orders", lambda o: R.latest_readings(o.select(F.sha2("o_orderpriority", 256).alias("content"), F.col("o_orderdate").alias("saved_at"), F.col("o_orderkey").alias("reading_id"), F.col("o_orderkey").alias("reading")))),
        "SELECT sha256(o_orderpriority) AS content, arg_max(o_orderkey, o_orderdate::TIMESTAMP::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS reading, count(*) AS n_saved FROM orders GROUP BY 1",
    ),
    "src_16_disputed_pages": (
        of("register", lambda r: G.merge_reads(r, r.withColumn("net", F.when(F.col("day") % 6 == 2, F.col("net") + 9).otherwise(F.col("net")))).select(F.floor((F.col("day") - 1) / 10).alias("page"), "product").distinct()),
        f"WITH {REG} SELECT DISTINCT (day - 1) // 10 AS page, product FROM register WHERE day % 6 = 2",
    ),
    "snk_09_tally_sheets": (
        of("invoice_lines", tally),
        f"""WITH {TOTALS}, p AS (SELECT *, (qty * rate)::{M} AS product, count(gst_rate) OVER (PARTITION BY invoice_id) AS rated FROM invoice_lines), f AS (SELECT DISTINCT invoice_id FROM p WHERE abs(product - value) > 1 OR (gst_rate IS NULL AND rated > 0))
SELECT 'GST Entries' AS sheet, count(*) AS n_rows FROM (SELECT DISTINCT invoice_id, gst_rate FROM invoice_lines) UNION ALL SELECT 'Lines', count(*) FROM invoice_lines UNION ALL SELECT 'Stock Items', count(*) FROM invoice_lines UNION ALL SELECT 'Review', count(*) FROM f UNION ALL SELECT 'Party Settings', count(DISTINCT supplier_id) FROM invoice_lines""",
    ),
    "snk_14_counters": (
        table("events", lambda e: e.groupBy("event_type").agg(F.count("*").alias("conversions"), F.count_if(F.col("value") > 100).alias("large"), F.max("event_id").alias("last_id"))),
        "SELECT event_type, count(*) AS conversions, count(*) FILTER (value > 100) AS large, max(event_id) AS last_id FROM events GROUP BY 1",
    ),
    "row_17_summary_fields": (
        table("orders", lambda o: W.summary_fields(summary_lines(o))),
        f"""WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_totalprice::{M} AS p, lead(o_totalprice::{M}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS np FROM orders),
h AS (SELECT doc_id, 'due' AS key, 0 AS r, k, p AS v FROM s WHERE k % 5 = 0 UNION ALL SELECT doc_id, 'due', 2, k, p FROM s WHERE k % 5 = 1 UNION ALL SELECT doc_id, 'limit', 0, k, np FROM s WHERE k % 5 = 2 AND n % 5 = 3)
SELECT doc_id, key, arg_min(v, r * 100000000000 + k) AS amount FROM h GROUP BY 1, 2""",
    ),
    "row_18_right_edges": (
        of("tokens", lambda t: W.right_edges(t, 3)),
        f"""WITH {TOKENS}, e AS (SELECT doc_id, token_id, x + width AS edge FROM tokens), g AS (SELECT *, CASE WHEN edge - lag(edge) OVER (PARTITION BY doc_id ORDER BY edge, token_id) > 3 THEN 1 ELSE 0 END AS new FROM e),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY edge, token_id) AS c FROM g), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY edge, token_id) AS i, count(*) OVER (PARTITION BY doc_id, c) AS n FROM c),
b AS (SELECT doc_id, edge, n FROM m WHERE i = n // 2 + 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, edge) <= 3) SELECT doc_id, 'c' || row_number() OVER (PARTITION BY doc_id ORDER BY edge) AS "column", edge, n FROM b""",
    ),
    "row_24_fragments": (
        table("orders", lambda o: W.fragments_to_amounts(fragments(o))),
        f"SELECT o_orderkey AS row_id, o_totalprice::{M} AS amount, (o_totalprice::{M} + 7)::{M} AS balance FROM orders",
    ),
    "row_23_balance_trail": (ledger(lambda l: X.balance_trails(mixed_values(l))), None),
    "sol_02_passbooks": (ledger(lambda l: X.solve_passbooks(passbook_steps(l))), None),
    "sol_04_page_repair": (ledger(lambda l: X.repair_pages(passbook_steps(l).where("kind = 'row' AND balance IS NOT NULL").select("doc_id", "seq", "amount", "balance", "opening"))), None),
    "sol_05_dates": (ledger(lambda l: X.date_choices(l.select("doc_id", "seq", F.array_compact(F.array("txn_date", F.date_add("txn_date", 31))).alias("candidates")))), None),
}
