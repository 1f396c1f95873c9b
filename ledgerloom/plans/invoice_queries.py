"""Invoices with faults of every kind, made by arithmetic on the orders' keys, judged by all rules; and registers with all flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import judging as J
from ledgerloom.operators import register as G
from ledgerloom.plans.views import duck, view

M = "DECIMAL(18,2)"
HEADS, LINES = duck("invoice_heads"), duck("invoice_lines")
NOTES = ("crossed", "doubt", "unread")


def invoices(spark, d):
    heads = view(spark, d, "invoice_heads")
    lines = view(spark, d, "invoice_lines").withColumn("value", F.when((F.col("invoice_id") % 37 == 0) & (F.col("line_no") == 1), F.lit(None)).otherwise(F.col("value")))
    item = F.struct("line_no", "qty", "rate", F.lit(None).cast("decimal(18,2)").alias("discount"), "value", "gst_rate")
    nested = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    some = lambda c: F.array_compact(F.array(c))
    rows = heads.join(nested, "invoice_id")
    return rows.withColumns({
        "cross_check": some(F.when(F.col("crossed").isNotNull(), F.struct(F.col("crossed").alias("field"), F.lit("1").alias("first"), F.lit("2").alias("second")))),
        "doubts": some(F.col("doubt")), "unreadable": some(F.col("unread")), "derived": some(F.when(F.col("invoice_id") % 20 == 0, F.lit("unit"))),
    }).drop(*NOTES)


TODAY, YEAR = "2026-01-01", ("1995-04-01", "1996-03-31")


def dates():
    day = lambda t: F.lit(t).cast("date")
    return day(TODAY), (day(YEAR[0]), day(YEAR[1]))


#: Every rule as a condition on an invoice's facts: level, kind, field, condition, found, expected.
CONDITIONS = [
    ("review", "missing", "'supplier.name'", "supplier_name IS NULL", "NULL", "NULL"), ("review", "missing", "'invoiceNo'", "invoice_no IS NULL", "NULL", "NULL"),
    ("review", "missing on a tax invoice", "'supplier.gstin'", "document_type = 'tax_invoice' AND supplier_gstin IS NULL", "NULL", "NULL"),
    ("review", "wrong number", "'supplier.gstin'", "supplier_gstin LIKE '%Z9'", "NULL", "NULL"), ("review", "wrong number", "'buyer.gstin'", "buyer_gstin = 'x'", "NULL", "NULL"),
    ("review", "missing", "'invoiceDate'", "invoice_date IS NULL", "NULL", "NULL"), ("review", "no date", "'invoiceDate'", "invoice_date LIKE '31/02%'", "NULL", "NULL"),
    ("review", "outside the year", "'invoiceDate'", f"day NOT BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'", "NULL", "NULL"),
    ("review", "no date", "'payment.date'", "payment_date LIKE '99%'", "NULL", "NULL"), ("review", "in the future", "'payment.date'", "payment_date LIKE '%2999'", "NULL", "NULL"),
    ("review", "lines differ", "'totals.taxableAmount'", "abs(lines_sum - coalesce(subtotal, taxable)) > 1", "lines_sum", "coalesce(subtotal, taxable)"),
    ("incomplete", "totals blank", "'totals'", "base IS NULL AND grand_total IS NULL", "NULL", "NULL"), ("incomplete", "missing", "'totals.grandTotal'", "base IS NOT NULL AND grand_total IS NULL", "NULL", "NULL"),
    ("note", "complete though continued", "'continuedOverleaf'", "overleaf AND NOT (base IS NULL AND grand_total IS NULL)", "NULL", "NULL"),
    ("review", "tax between states", "'totals.igst'", "here = there AND coalesce(igst, 0) <> 0", "NULL", "NULL"), ("review", "tax within a state", "'totals.cgst'", "here <> there AND (coalesce(cgst, 0) <> 0 OR coalesce(sgst, 0) <> 0)", "NULL", "NULL"),
    ("review", "rates differ", "'totals.sgstRate'", "cgst_rate <> sgst_rate", "sgst_rate", "cgst_rate"),
    *((level, kind, f"'totals.{k}'", f"base IS NOT NULL AND tax IS NOT NULL AND {side} AND {when}", found, tax)
      for k, side, tax in (("cgst", "within IS NOT FALSE", "tax_half"), ("sgst", "within IS NOT FALSE", "tax_half"), ("igst", "within IS FALSE", "tax"))
      for level, kind, when, found in (("review", "tax missing", f"{k} IS NULL", "NULL"), ("review", "tax differs", f"abs({k} - {tax}) > 1", k))),
    ("review", "no rate", "'totals.cgstRate'", "base IS NOT NULL AND tax IS NULL AND (coalesce(cgst, 0) <> 0 OR coalesce(sgst, 0) <> 0 OR coalesce(igst, 0) <> 0)", "NULL", "NULL"),
    ("review", "large rounding", "'totals.roundOff'", "base IS NOT NULL AND abs(round_off) > 1", "round_off", "NULL"),
    ("review", "total differs", "'totals.grandTotal'", "CASE WHEN round_off IS NOT NULL THEN abs(grand_total - before_rounding - round_off) > 0.01 ELSE abs(grand_total - before_rounding) > 1 END", "grand_total", "before_rounding + coalesce(round_off, 0)"),
    ("note", "no number", "'totals.amountInWords'", "words = 'nonsense' AND grand_total IS NOT NULL", "NULL", "NULL"), ("review", "words differ", "'totals.amountInWords'", "words = 'one hundred' AND grand_total <> 100", "100", "grand_total"),
    ("note", "paid less", "'payment.amount'", "grand_total - paid > 1", "paid", "grand_total"), ("note", "paid more", "'payment.amount'", "paid - grand_total > 1", "paid", "grand_total"),
    ("note", "lines give", "'totals.computed'", "base IS NULL AND grand_total IS NULL", "lines_sum", "NULL"),
    ("note", "readers disagree", "crossed", "crossed IS NOT NULL", "NULL", "NULL"), ("note", "hard to read", "doubt", "doubt IS NOT NULL AND doubt IS DISTINCT FROM crossed", "NULL", "NULL"),
    ("note", "unreadable", "unread", "unread <> 'address'", "NULL", "NULL"), ("note", "derived", "'unit'", "invoice_id % 20 = 0", "NULL", "NULL"),
]
FACTS = f"""{HEADS}, {LINES},
v AS (SELECT * REPLACE (CASE WHEN invoice_id % 37 = 0 AND line_no = 1 THEN NULL ELSE value END AS value), (qty * rate)::{M} AS product, count(gst_rate) OVER (PARTITION BY invoice_id) AS rated FROM invoice_lines),
f0 AS (SELECT h.*, coalesce(taxable, subtotal - coalesce(discount, 0))::{M} AS base, CASE WHEN supplier_gstin NOT LIKE '%Z9' THEN left(supplier_gstin, 2) END AS here, coalesce(left(place_of_supply, 2), CASE WHEN buyer_gstin <> 'x' THEN left(buyer_gstin, 2) END) AS there,
  coalesce(igst_rate, cgst_rate * 2)::DECIMAL(7,2) AS total_rate, CASE WHEN invoice_date NOT LIKE '31/02%' THEN strptime(invoice_date, '%d/%m/%Y')::DATE END AS day FROM invoice_heads h),
r AS (SELECT invoice_id, coalesce(gst_rate, total_rate) AS rate, sum(value)::{M} AS b FROM v JOIN f0 USING (invoice_id) GROUP BY 1, 2),
whole AS (SELECT invoice_id, coalesce(sum(value), 0)::{M} AS lines_sum, bool_and(value IS NOT NULL AND coalesce(gst_rate, total_rate) IS NOT NULL) AS by_line FROM v JOIN f0 USING (invoice_id) GROUP BY 1),
g AS (SELECT invoice_id, rate, b FROM r JOIN whole USING (invoice_id) WHERE by_line UNION ALL SELECT invoice_id, total_rate, base FROM f0 JOIN whole USING (invoice_id) WHERE NOT by_line AND base IS NOT NULL AND total_rate IS NOT NULL),
c AS (SELECT invoice_id, ((b * 100)::BIGINT * rate::BIGINT + 50) // 100 AS cents FROM g),
t AS (SELECT invoice_id, (sum(cents)::DECIMAL(20,2) / 100)::{M} AS tax, (sum((cents + 1) // 2)::DECIMAL(20,2) / 100)::{M} AS tax_half FROM c GROUP BY 1),
f AS (SELECT f0.*, lines_sum, tax, tax_half, coalesce(here = there, CASE WHEN coalesce(igst, 0) <> 0 THEN false WHEN coalesce(cgst, 0) <> 0 OR coalesce(sgst, 0) <> 0 THEN true END) AS within,
  (base + coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0))::{M} AS before_rounding FROM f0 JOIN whole USING (invoice_id) LEFT JOIN t USING (invoice_id)),
i AS ({" UNION ALL ".join(f"SELECT invoice_id, '{level}' AS level, '{kind}' AS kind, {field} AS field, NULL::INT AS line, ({found})::{M} AS found, ({expected})::{M} AS expected FROM f WHERE {when}" for level, kind, field, when, found, expected in CONDITIONS)}
 UNION ALL SELECT invoice_id, 'review', 'no amount', 'lineItems[' || (line_no - 1) || '].amount', line_no, NULL, product FROM v WHERE value IS NULL
 UNION ALL SELECT invoice_id, 'review', 'arithmetic', 'lineItems[' || (line_no - 1) || '].amount', line_no, value, product FROM v WHERE abs(value - product) > 1
 UNION ALL SELECT invoice_id, 'review', 'no rate', 'lineItems[' || (line_no - 1) || '].gstRate', line_no, value, NULL FROM v WHERE gst_rate IS NULL AND rated > 0)"""

PAIRS = {
    "chk_11_invoice_issues": (lambda s, d: J.invoice_issues(invoices(s, d), *dates()).drop("place"), f"WITH {FACTS} SELECT * FROM i"),
    "chk_11_judged_invoices": (
        lambda s, d: J.judged(invoices(s, d), *dates()),
        f"""WITH {FACTS} SELECT invoice_id, CASE WHEN count(*) FILTER (level = 'incomplete') > 0 THEN 'INCOMPLETE' WHEN count(*) FILTER (level = 'review') > 0 THEN 'NEEDS REVIEW' ELSE 'OK' END AS status,
count(*) FILTER (level = 'incomplete') AS incomplete, count(*) FILTER (level = 'review') AS review, count(*) FILTER (level = 'note') AS note FROM f LEFT JOIN i USING (invoice_id) GROUP BY 1""",
    ),
}

#: Registers of seven stations: each row with its faults, the same text for both engines.
METER_ROWS = """meter_rows AS (
SELECT reg_id, item, page, row_no, CAST(CASE WHEN reg_id = 2 AND d = 28 THEN 58 WHEN reg_id = 3 AND d = 7 THEN 6 ELSE d END AS INT) AS day, CAST(net0 + 5 AS BIGINT) AS meter, CAST(CASE WHEN d % 8 = 3 THEN 4 ELSE 5 END AS BIGINT) AS pump,
  CAST(CASE WHEN (d + reg_id) % 13 <> 5 THEN net0 END AS BIGINT) AS net, CAST(CASE WHEN d % 9 <> 4 THEN total + CASE WHEN d >= 20 AND reg_id % 3 = 1 THEN 10 ELSE 0 END END AS BIGINT) AS cumulative,
  d % 11 = 2 AS faint, d % 10 = 6 AS otherwise
FROM (SELECT reg_id, item, d, d AS row_no, net0, sum(net0) OVER (PARTITION BY reg_id, item ORDER BY d) AS total, dense_rank() OVER (PARTITION BY reg_id ORDER BY item) AS page
  FROM (SELECT user_id % 7 AS reg_id, event_type AS item, CAST(extract(DAY FROM ts) AS INT) AS d, count(*) AS net0 FROM {events} GROUP BY 1, 2, 3) a) b)"""
METER_PAGES = """meter_pages AS (
SELECT reg_id, CAST(page AS INT) AS page, 'register' AS kind, item AS product, CASE WHEN reg_id = 1 AND page = 2 THEN 3 ELSE 4 END AS month, CASE WHEN reg_id = 2 AND page = 1 THEN 'rates' END AS other_class, CASE WHEN reg_id = 3 AND page = 2 THEN 'missing' END AS second_read
FROM (SELECT DISTINCT reg_id, page, item FROM meter_rows) a
UNION ALL SELECT DISTINCT reg_id, 90, 'register', 'click', 4, CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)) FROM meter_rows WHERE reg_id = 4
UNION ALL SELECT DISTINCT reg_id, 91, 'rates', CAST(NULL AS VARCHAR(9)), CAST(NULL AS INT), CAST(NULL AS VARCHAR(9)), CASE WHEN reg_id = 5 THEN 'missing' END FROM meter_rows WHERE reg_id <> 0)"""
METER_CONFIG = """meter_config AS (
SELECT reg_id, item, item AS register, 1 AS nth, CASE WHEN item = 'click' THEN 'R1' ELSE 'R2' END AS rate FROM (SELECT DISTINCT reg_id, item FROM meter_rows WHERE NOT (reg_id = 5 AND item = 'view')) a
UNION ALL SELECT DISTINCT reg_id, 'diesel', 'diesel', 1, 'R1' FROM meter_rows WHERE reg_id = 6)"""
METER_RATES = """meter_rates AS (SELECT DISTINCT reg_id, code, CAST(9.5 AS DECIMAL(9,2)) AS rate, CASE WHEN reg_id = 2 AND code = 'R1' THEN CAST(9.6 AS DECIMAL(9,2)) END AS alt FROM meter_rows CROSS JOIN (SELECT 'R1' AS code UNION ALL SELECT 'R2') c WHERE reg_id <> 0 AND NOT (reg_id = 1 AND code = 'R2'))"""
METERS = f"{METER_ROWS}, {METER_PAGES}, {METER_CONFIG}, {METER_RATES}"


def registers(spark, d):
    read = lambda name: spark.sql(f"WITH {METERS} SELECT * FROM {name}", events=spark.read.parquet(f"{d}/events.parquet"))
    rows = read("meter_rows").withColumns({
        "unreadable": F.when(F.col("faint"), F.array(F.lit("netSales"))).otherwise(F.array().cast("array<string>")),
        "alt": F.when(F.col("otherwise"), F.create_map(F.lit("salesByMeter"), F.col("meter") + 1)).otherwise(F.create_map().cast("map<string,bigint>")),
    })
    return G.register_flags(read("meter_pages"), rows, read("meter_rates"), read("meter_config"), 31)


FLAGS = f"""{METERS.replace("{events}", "events")}, slots AS (SELECT c.*, p.page, p.second_read FROM meter_config c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY reg_id, product ORDER BY page) AS i FROM meter_pages WHERE kind = 'register') p ON p.reg_id = c.reg_id AND p.product = c.register AND p.i = c.nth),
x AS (SELECT r.*, s.rate AS rate_key, coalesce(day BETWEEN 1 AND 31, false) AS whole, row_number() OVER (PARTITION BY r.reg_id, r.item, day ORDER BY row_no) > 1 AS again FROM meter_rows r JOIN slots s ON s.reg_id = r.reg_id AND s.item = r.item AND s.page = r.page),
g AS (SELECT *, sum(coalesce(net, 0)) OVER (PARTITION BY reg_id, item ORDER BY day) AS running, coalesce(last_value(cumulative IGNORE NULLS) OVER (PARTITION BY reg_id, item ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE whole AND NOT again),
f(reg_id, kind, product, day, col, rate_key) AS (
  SELECT reg_id, 'month', NULL, NULL, NULL, NULL FROM meter_pages WHERE kind = 'register' GROUP BY reg_id HAVING count(DISTINCT month) > 1
  UNION SELECT reg_id, 'page-class', NULL, NULL, NULL, NULL FROM meter_pages WHERE other_class IS NOT NULL UNION SELECT reg_id, 'single-read', NULL, NULL, NULL, NULL FROM meter_pages WHERE kind = 'rates' AND second_read = 'missing'
  UNION SELECT reg_id, 'single-read', item, NULL, NULL, NULL FROM slots WHERE second_read = 'missing' UNION SELECT reg_id, 'rate-disagree', NULL, NULL, NULL, code FROM meter_rates WHERE alt IS NOT NULL
  UNION SELECT p.reg_id, 'extra-page', NULL, NULL, NULL, NULL FROM (SELECT reg_id, product, count(*) AS n FROM meter_pages WHERE kind = 'register' GROUP BY 1, 2) p LEFT JOIN (SELECT reg_id, register, count(*) AS n FROM meter_config GROUP BY 1, 2) c ON c.reg_id = p.reg_id AND c.register = p.product WHERE p.n > coalesce(c.n, 0)
  UNION SELECT reg_id, 'no-page', item, NULL, NULL, NULL FROM slots WHERE page IS NULL UNION SELECT reg_id, 'bad-day', item, day, NULL, NULL FROM x WHERE NOT whole UNION SELECT reg_id, 'dup-day', item, day, NULL, NULL FROM x WHERE whole AND again
  UNION SELECT reg_id, 'unreadable', item, day, 'netSales', NULL FROM g WHERE faint UNION SELECT reg_id, 'disagree', item, day, 'salesByMeter', NULL FROM g WHERE otherwise UNION SELECT reg_id, 'meter-test', item, day, NULL, NULL FROM g WHERE meter - pump <> net
  UNION SELECT reg_id, 'blank-net', item, day, NULL, NULL FROM g WHERE coalesce(net, 0) = 0 AND NOT faint AND cumulative <> before UNION SELECT reg_id, 'chain', item, min(day), NULL, NULL FROM g WHERE cumulative <> running GROUP BY reg_id, item
  UNION SELECT s.reg_id, 'missing-day', s.item, d::INT, NULL, NULL FROM slots s, unnest(range(1, 32)) AS u(d) WHERE s.page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.reg_id = s.reg_id AND g.item = s.item AND g.day = d)
  UNION SELECT reg_id, 'no-rate', NULL, NULL, NULL, rate_key FROM g WHERE net <> 0 AND NOT EXISTS (SELECT 1 FROM meter_rates m WHERE m.reg_id = g.reg_id AND m.code = g.rate_key)
  UNION SELECT reg_id, 'no-rates-page', NULL, NULL, NULL, NULL FROM meter_pages GROUP BY reg_id HAVING count(*) FILTER (kind = 'rates') = 0),
i AS (SELECT reg_id, concat_ws('|', kind, coalesce(product, ''), coalesce(day::VARCHAR, ''), coalesce(col, ''), coalesce(rate_key, '')) AS id, kind, product, day, col, rate_key FROM f)"""

PAIRS |= {
    "chk_13_register_flags": (registers, f"WITH {FLAGS} SELECT * FROM i"),
    "chk_13_unresolved_flags": (
        lambda s, d: G.unresolved(flags := registers(s, d), flags.where("kind IN ('meter-test', 'missing-day')").select("reg_id", "id")),
        f"WITH {FLAGS} SELECT reg_id, count(*) FILTER (kind NOT IN ('meter-test', 'missing-day')) AS unresolved, count(*) AS flags FROM i GROUP BY 1",
    ),
}
