"""Deterministic ledgers, cards, invoices, registers and lines over the driver's tables.

Each view is one SQL text that Spark and DuckDB read alike; tables stand in braces.
Nothing is random: rows are disturbed by arithmetic on their keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MONEY = "DECIMAL(18,2)"

VIEWS = {
    # an account's orders as its statement; twos leave room for repeated rows
    "ledger": f"""
WITH o AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS {MONEY}) AS amount, o_orderpriority AS p,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS s
  FROM {{orders}}),
b AS (
  SELECT o.*, CAST(CAST(c_acctbal AS {MONEY}) + sum(CASE WHEN k % 2 = 0 THEN amount ELSE -amount END) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {MONEY}) AS bal
  FROM o JOIN {{customer}} ON doc_id = c_custkey),
r AS (SELECT *, 0 AS again FROM b UNION ALL SELECT *, 1 AS again FROM b WHERE k % 101 = 0)
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 1000000 - s * 2 - again ELSE s * 2 + again END AS seq, CAST((s - 1 - (s - 1) % 4) / 4 AS INT) AS page,
  CASE WHEN k % 59 = 0 THEN NULL ELSE d END AS txn_date,
  p || ' / ref ' || CAST(k % 7 AS VARCHAR(9)) AS particulars,
  CASE WHEN k % 5 = 0 THEN CAST(100000 + k AS VARCHAR(12)) WHEN k % 31 = 0 THEN CAST(k % 100 AS VARCHAR(12)) END AS cheque_no,
  CASE WHEN (k % 2 = 1) = (k % 89 <> 0) THEN amount WHEN k % 97 = 1 THEN amount END AS withdrawal,
  CASE WHEN (k % 2 = 0) = (k % 89 <> 0) THEN amount END AS deposit,
  CASE WHEN k % 53 = 0 THEN NULL WHEN k % 97 = 0 THEN CAST(bal + 10 AS {MONEY}) ELSE bal END AS balance,
  k % 211 = 0 AS is_reversal, k % 13 = 0 AS ocr_corrected
FROM r""",
    "card": f"""
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, CAST(l_linenumber AS INT) - 1 - (CAST(l_linenumber AS INT) - 1) % 3 AS page, CAST(l_shipdate AS DATE) AS txn_date,
  CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS type, CAST(l_extendedprice AS {MONEY}) AS amount,
  'PART ' || CAST(l_partkey % 3 AS VARCHAR(9)) AS description, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 5 AS VARCHAR(9)) END AS ref_no,
  CASE WHEN l_suppkey % 2 = 0 THEN '4321' ELSE '8765' END AS card_last4,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(1000 + sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS {MONEY}) ELSE CAST(l_extendedprice AS {MONEY}) END)
    OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN l_partkey % 50 = 0 THEN 5 ELSE 0 END AS {MONEY}) END AS balance
FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_extendedprice FROM {{lineitem}}) l""",
    "invoice_lines": f"""
SELECT l_orderkey AS invoice_id, line_no, l_suppkey AS supplier_id, CAST(l_shipdate AS DATE) AS invoice_date,
  CAST(l_quantity AS DECIMAL(18,4)) AS qty, CAST(floor((CAST(CAST(l_extendedprice AS {MONEY}) * 100 AS BIGINT) * 2 + CAST(l_quantity AS BIGINT)) / (CAST(l_quantity AS BIGINT) * 2)) / 100 AS {MONEY}) AS rate,
  CAST(CASE WHEN l_partkey % 20 = 0 THEN NULL WHEN l_tax < 0.03 THEN 5 WHEN l_tax < 0.06 THEN 12 ELSE 18 END AS DECIMAL(5,2)) AS gst_rate,
  CAST(CAST(l_extendedprice AS {MONEY}) + CASE WHEN l_partkey % 37 = 0 THEN 7 ELSE 0 END AS {MONEY}) AS value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no FROM {{lineitem}}) l""",
    # what stands around an invoice's lines; faults of every kind come by the key
    "invoice_heads": f"""
SELECT invoice_id, CASE WHEN k % 2 = 0 THEN 'tax_invoice' ELSE 'receipt' END AS document_type, CASE WHEN k % 17 <> 0 THEN 'Supplier' END AS supplier_name,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '27ABCDE1234F1Z9' WHEN 2 THEN '29ABCDE1234F1ZW' ELSE '27ABCDE1234F1Z0' END AS supplier_gstin, CASE k % 6 WHEN 2 THEN '27ABCDE1234F1Z0' WHEN 3 THEN 'x' END AS buyer_gstin,
  CAST(NULL AS VARCHAR(2)) AS buyer_state, CASE k % 6 WHEN 0 THEN '29-Karnataka' WHEN 1 THEN '27' END AS place_of_supply, CASE WHEN k % 13 <> 0 THEN 'INV' END AS invoice_no,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '31/02/1995' ELSE lpad(CAST(extract(DAY FROM d) AS VARCHAR(2)), 2, '0') || '/' || lpad(CAST(extract(MONTH FROM d) AS VARCHAR(2)), 2, '0') || '/' || CAST(extract(YEAR FROM d) AS VARCHAR(4)) END AS invoice_date,
  CASE WHEN k % 29 = 0 THEN '99/99/9999' WHEN k % 31 = 0 THEN '01/01/2999' END AS payment_date, CAST(CASE k % 5 WHEN 0 THEN grand_total - 20 WHEN 1 THEN grand_total + 20 WHEN 2 THEN grand_total END AS {MONEY}) AS paid,
  subtotal, discount, taxable, cgst_rate, cgst, sgst_rate, sgst, igst_rate, igst, round_off, grand_total, CASE k % 12 WHEN 0 THEN 'nonsense' WHEN 1 THEN 'one hundred' END AS words, k % 14 = 0 AS overleaf,
  CASE WHEN k % 15 = 0 THEN 'totals.cgst' END AS crossed, CASE k % 16 WHEN 0 THEN 'invoiceNo' WHEN 1 THEN 'totals.cgst' END AS doubt, CASE k % 18 WHEN 0 THEN 'totals.igst' WHEN 1 THEN 'address' END AS unread
FROM (SELECT *, CASE WHEN k % 22 = 0 THEN NULL ELSE CAST(base + coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0) + coalesce(round_off, 0) + CASE WHEN k % 9 = 0 THEN 2 ELSE 0 END AS {MONEY}) END AS grand_total
  FROM (SELECT k AS invoice_id, k, d, base, CAST(CASE WHEN k % 8 = 3 THEN base END AS {MONEY}) AS subtotal, CAST(CASE WHEN k % 8 = 3 THEN 10 END AS {MONEY}) AS discount,
    CAST(CASE WHEN k % 11 = 0 OR k % 8 = 3 THEN NULL WHEN k % 7 = 0 THEN base + 5 ELSE base END AS {MONEY}) AS taxable, CAST(CASE WHEN k % 3 = 0 THEN 9 END AS DECIMAL(5,2)) AS cgst_rate, CAST(CASE WHEN k % 21 = 0 THEN 6 WHEN k % 3 = 0 THEN 9 END AS DECIMAL(5,2)) AS sgst_rate,
    CAST(CASE WHEN k % 3 = 1 THEN 18 END AS DECIMAL(5,2)) AS igst_rate, CAST(CASE WHEN k % 3 = 0 THEN floor(base * 9) / 100 + CASE WHEN k % 10 = 0 THEN 3 ELSE 0 END END AS {MONEY}) AS cgst, CAST(CASE WHEN k % 3 = 0 THEN floor(base * 9) / 100 END AS {MONEY}) AS sgst,
    CAST(CASE WHEN k % 3 = 1 THEN floor(base * 18) / 100 END AS {MONEY}) AS igst, CAST(CASE k % 4 WHEN 0 THEN 0.40 WHEN 1 THEN 1.50 END AS {MONEY}) AS round_off
    FROM (SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS d, CAST(sum(CAST(l_extendedprice AS {MONEY}) + CASE WHEN l_partkey % 37 = 0 THEN 7 ELSE 0 END) AS {MONEY}) AS base FROM {{lineitem}} GROUP BY l_orderkey) a) b) c""",
    "register": """
SELECT product, day, CAST(net AS BIGINT) AS net,
  CASE WHEN day % 9 = 4 THEN NULL ELSE CAST(sum(net) OVER (PARTITION BY product ORDER BY day) + CASE WHEN day % 11 = 7 THEN 10 ELSE 0 END AS BIGINT) END AS cumulative,
  CAST(net + 5 AS BIGINT) AS sales_by_meter, CAST(CASE WHEN day % 8 = 3 THEN 4 ELSE 5 END AS BIGINT) AS pump_test
FROM (SELECT event_type AS product, CAST(extract(DAY FROM ts) AS INT) AS day, count(*) AS net FROM {events} GROUP BY 1, 2) e""",
    "gstins": """
SELECT s_suppkey AS supplier_id, s_name AS name,
  lpad(CAST(s_suppkey % 40 AS VARCHAR(9)), 2, '0') || 'ABCDE' || lpad(CAST(s_suppkey % 10000 AS VARCHAR(9)), 4, '0') || 'F1Z' || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(s_suppkey % 36 AS INT) + 1, 1) AS gstin
FROM {supplier}""",
    "tokens": """
SELECT user_id AS doc_id, event_id AS token_id, CAST(event_id % 600 AS DOUBLE) AS x, CAST(event_id * 7 % 800 AS DOUBLE) AS y, CAST(event_id % 40 + 5 AS DOUBLE) AS width, event_type AS text
FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def duck(name: str) -> str:
    """The same view as a common table expression for DuckDB."""
    return f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[name])})"
