"""Card summaries printed from the orders as tables and equations, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import summaries as U

M = "DECIMAL(18,2)"


def summary_pages(o):
    """A page an order: a table whose labels wrap over two lines beside a notice, an equation, or a table of dates and points; places shift."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    d = F.date_format("o_orderdate", "dd/MM/yyyy")
    shift = (k % 7).cast("double")
    item = lambda x, text: F.struct((F.lit(float(x)) + shift).alias("x"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    line = lambda n, *items: F.struct(F.lit(n).alias("n"), F.array(*items).alias("items"))
    money = lambda c: F.concat(F.lit("₹"), F.format_number(c, 2))
    table = F.array(
        line(0, item(20, "Account summary")), line(1, item(50, "Total Payment"), item(150, "Minimum"), item(260, "Credit")), line(2, item(56, "Due"), item(147, "Payment Due"), item(268, "Limit"), item(500, "Register at the bank")),
        line(3, item(62, money(p)), item(140, F.concat(money(p + 1), F.lit(" CR"))), item(281, "3,52,000")), line(4, item(50, "Ask us"), item(150, "at any branch")),
    )
    amounts = F.concat_ws(" ", *(money(p + n) for n in range(5)))
    equation = F.array(line(0, item(40, "Previous Balance - Payments - Credits + Purchases =Total Payment Due")), line(1, item(40, "in rupees")), line(2, item(40, amounts)))
    dates = F.array(
        line(0, item(50, "Statement Date"), item(200, "+"), item(210, "Edge Reward Points"), item(380, "Statement Period")), line(1, item(53, d), item(230, F.format_number(k, 0)), item(371, F.concat(d, F.lit(" - "), d))),
        line(2, item(50, "Cash Limit"), item(120, "Purchases"), item(200, "Payments")), line(3, item(90, "stray words"), item(122, "of all")), line(4, item(50, "10.00"), item(120, "20.00"), item(200, "30.00")),
    )
    x = F.when(k % 3 == 0, table).when(k % 3 == 1, equation).otherwise(dates)
    rows = o.select(F.col("o_custkey").alias("doc_id"), k.alias("page"), F.inline(x))
    return rows.select("doc_id", "page", (F.col("page") * 10 + F.col("n")).alias("line_no"), F.array_join(F.transform("items", lambda i: i["text"]), " ").alias("text"), "items")


PAIRS = {
    "row_17_summary_tables": (
        lambda s, d: U.summary_tables(summary_pages(s.read.parquet(f"{d}/orders.parquet"))),
        f"""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_totalprice::{M} AS p, o_orderdate::DATE AS d FROM orders),
f AS (SELECT doc_id, k, 0 AS rank, unnest(['total_due', 'minimum_due', 'credit_limit']) AS key, unnest([p::VARCHAR, (-(p + 1)::{M})::VARCHAR, '352000.00']) AS value FROM o WHERE k % 3 = 0
  UNION ALL SELECT doc_id, k, 1, unnest(['previous_balance', 'payments', 'other_credits', 'purchases', 'total_due']), unnest([p::VARCHAR, (p + 1)::{M}::VARCHAR, (p + 2)::{M}::VARCHAR, (p + 3)::{M}::VARCHAR, (p + 4)::{M}::VARCHAR]) FROM o WHERE k % 3 = 1
  UNION ALL SELECT doc_id, k, 0, unnest(['statement_date', 'points_closing', 'period_from', 'period_to']), unnest([d::VARCHAR, k::VARCHAR, d::VARCHAR, d::VARCHAR]) FROM o WHERE k % 3 = 2)
SELECT doc_id, key, arg_min(value, rank * 1000000000000 + k) AS value, CASE WHEN min(rank) = 0 THEN 'table' ELSE 'equation' END AS source FROM f GROUP BY 1, 2""",
    ),
}
