"""Card, register, invoice, line, token and scalar queries with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import card as C
from ledgerloom.operators import invoice as I
from ledgerloom.operators import lines as T
from ledgerloom.operators import register as R
from ledgerloom.plans.views import duck, view

M = "DECIMAL(18,2)"
CARD, REG, INV, GST, TOK = (duck(n) for n in ("card", "register", "invoice_lines", "gstins", "tokens"))
BANDS = [("date", 0.0, 80.0), ("narration", 90.0, 250.0), ("debit", 260.0, 340.0), ("credit", 350.0, 430.0)]
STARTS = r"^[A-Z][a-z]+ (the|of|and|de|la|der|und|que|y|et) "
LINES = """doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), lines AS (SELECT doc_id, ((i - 1) // 20)::INT AS page, (i - 1)::INT AS line_no, l[i] AS text FROM doc, unnest(range(1, len(l) + 1)) AS u(i))"""


def on(name, f):
    return lambda spark, sf_dir: f(view(spark, sf_dir, name))


def table(name, f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(f):
    return table("documents", lambda d: f(T.lines_of(d.select("doc_id", "text"))))


def card_summary(card):
    t = C.totals(card)
    return t.where("doc_id % 7 <> 0").select("doc_id", F.lit(100).cast("decimal(18,2)").alias("previous"), (F.col("debits") + F.when(F.col("doc_id") % 5 == 0, 3).otherwise(0)).cast("decimal(18,2)").alias("purchases"), F.col("credits").alias("payments"), (100 + F.col("debits") - F.col("credits")).cast("decimal(18,2)").alias("due"))


def second_read(reg):
    return reg.select("product", "day", F.when(F.col("day") % 10 == 5, F.col("net") + 1).otherwise(F.col("net")).alias("net"), F.when(F.col("day") % 9 == 5, None).otherwise(F.col("cumulative")).alias("cumulative"), "sales_by_meter", "pump_test")


def rates(spark):
    return (spark.createDataFrame([("click", "10.50"), ("view", "99.99"), ("purchase", "3.25")], "product string, rate string"), spark.createDataFrame([("view", "88.10")], "product string, rate string"))


def with_rates(spark, sf_dir):
    one, two = rates(spark)
    cast = lambda d: d.withColumn("rate", F.col("rate").cast("decimal(10,2)"))
    return R.with_rates(view(spark, sf_dir, "register"), cast(one), cast(two))


def fan_out(spark, sf_dir):
    reg = view(spark, sf_dir, "register")
    flags = spark.createDataFrame([("a", None, 3), ("b", "click", None), ("c", "view", 4), ("d", None, None)], "id string, product string, day int")
    return R.fan_out(flags, reg)


def printed(lines_):
    sums = lines_.groupBy("invoice_id").agg(F.sum("value").alias("v")).where("invoice_id % 11 <> 0")
    return sums.select("invoice_id", (F.col("v") + F.when(F.col("invoice_id") % 13 == 0, 9).otherwise(0)).cast("decimal(18,2)").alias("printed"))


def parties(spark, sf_dir):
    g = view(spark, sf_dir, "gstins")
    known = g.select(F.col("supplier_id").alias("party_id"), F.col("supplier_id").alias("ord"), F.concat(F.col("name"), F.lit(" Pvt Ltd")).alias("name"), "gstin")
    asked = g.select(F.col("supplier_id").alias("row_id"), F.when(F.col("supplier_id") % 3 == 0, F.replace("name", F.lit("u"), F.lit("v"))).otherwise(F.concat(F.lit("The "), F.col("name"))).alias("name"), F.when(F.col("supplier_id") % 4 == 0, F.col("gstin")).alias("gstin"))
    return I.match_parties(asked, known)


def dates_parsed(orders):
    d = F.col("o_orderdate").cast("date")
    dd, mm, yy, y4 = F.day(d).cast("string"), F.month(d).cast("string"), F.lpad((F.year(d) % 100).cast("string"), 2, "0"), F.year(d).cast("string")
    mon = F.substring(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.month(d) * 3 - 2, F.lit(3))
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.concat_ws("/", dd, mm, yy)).when(k == 1, F.concat_ws("-", dd, mon, y4)).when(k == 2, F.concat_ws("-", y4, mm, dd)).when(k == 3, F.concat_ws(".", dd, mm, y4)).otherwise(F.concat_ws("/", F.lit("31"), F.lit("02"), y4))
    return orders.select("o_orderkey", text.alias("text")).select("o_orderkey", S.parse_date(F.col("text")).alias("d"), S.parse_date(F.col("text"), None).alias("d2"))


def amounts_parsed(orders):
    a = F.col("o_totalprice").cast("decimal(18,2)")
    k = F.col("o_orderkey") % 4
    shown = S.indian_grouping(a)
    text = F.when(k == 0, F.concat(F.lit("₹ "), shown)).when(k == 1, F.concat(shown, F.lit(" Dr"))).when(k == 2, F.concat(F.lit("-"), shown)).otherwise(F.concat(shown, F.lit("Cr.")))
    return orders.select("o_orderkey", shown.alias("shown"), S.parse_amount(text).alias("amount"), S.parse_ocr_money(F.replace(shown, F.lit(","), F.lit("."))).alias("ocr"))


SGN = "CASE WHEN type = 'credit' THEN -amount ELSE amount END"
NEAR = "list_min([" + ", ".join(f"{{'d': least(abs(x - {a}), abs(x + width - {b})), 'k': {k}, 'name': '{n}'}}" for k, (n, a, b) in enumerate(BANDS)) + "])"
CLUST = f"{TOK}, g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, token_id) > 8 THEN 1 ELSE 0 END AS nw FROM tokens), cl AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY y, token_id)::BIGINT AS line FROM g)"

PAIRS = {
    "dis_03_card_dedupe": (
        on("card", lambda c: C.remove_duplicates(c).select("doc_id", "seq")),
        f"""WITH {CARD}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ref_no, txn_date, description, type, amount ORDER BY seq) AS n FROM card) WHERE ref_no IS NULL OR n = 1),
i AS (SELECT *, CASE WHEN ref_no IS NULL AND lag(ref_no) OVER w IS NULL AND lag(seq) OVER w IS NOT NULL AND (txn_date, description, type, amount) = (lag(txn_date) OVER w, lag(description) OVER w, lag(type) OVER w, lag(amount) OVER w) THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM i), p AS (SELECT *, first_value(page) OVER (PARTITION BY doc_id, run ORDER BY seq) AS p FROM r) SELECT doc_id, seq FROM p WHERE ref_no IS NOT NULL OR page = p""",
    ),
    "win_08_card_chain": (
        on("card", C.check_balance),
        f"""WITH {CARD}, b AS (SELECT *, {SGN} AS s, coalesce(lag(balance) OVER (PARTITION BY doc_id ORDER BY seq), balance - {SGN}) AS before, count(*) OVER (PARTITION BY doc_id) = count(balance) OVER (PARTITION BY doc_id) AS al FROM card)
SELECT doc_id, seq, type, amount, balance, CASE WHEN NOT al THEN NULL WHEN abs(before + s - balance) <= 0.01 THEN 'ok' WHEN abs(before - s - balance) <= 0.01 THEN 'flip' ELSE 'break' END AS verdict FROM b""",
    ),
    "win_09_card_running": (
        on("card", C.running_balance),
        f"""WITH {CARD}, i AS (SELECT *, {SGN} AS s, count(balance) OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM card)
SELECT doc_id, seq, (coalesce(first_value(balance) OVER w, 0) + sum(CASE WHEN balance IS NULL THEN s ELSE 0 END) OVER w)::{M} AS running FROM i WINDOW w AS (PARTITION BY doc_id, i ORDER BY seq)""",
    ),
    "agg_05_by_card": (
        on("card", C.by_card),
        f"WITH {CARD} SELECT doc_id, card_last4, count(*) AS n_rows, coalesce(sum(amount) FILTER (type = 'debit'), 0)::{M} AS debits, coalesce(sum(amount) FILTER (type = 'credit'), 0)::{M} AS credits FROM card GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2",
    ),
    "chk_09_card_reconcile": (
        on("card", lambda c: C.reconcile(c, card_summary(c))),
        f"""WITH {CARD}, t AS (SELECT doc_id, coalesce(sum(amount) FILTER (type = 'debit'), 0)::{M} AS debits, coalesce(sum(amount) FILTER (type = 'credit'), 0)::{M} AS credits FROM card GROUP BY 1)
SELECT doc_id, debits, credits, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 <> 0 END AS debits_ok, CASE WHEN doc_id % 7 <> 0 THEN TRUE END AS credits_ok, CASE WHEN doc_id % 7 <> 0 THEN TRUE END AS due_ok,
  CASE WHEN doc_id % 7 = 0 THEN 'UNVERIFIED' WHEN doc_id % 5 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status FROM t""",
    ),
    "snk_08_card_summary": (
        on("card", C.summary_rows),
        f"""WITH {CARD}, t AS (SELECT doc_id, coalesce(sum(amount) FILTER (type = 'debit'), 0)::{M} AS d, coalesce(sum(amount) FILTER (type = 'credit'), 0)::{M} AS c FROM card GROUP BY 1)
SELECT doc_id, unnest(['Total debits', 'Total credits', 'Net']) AS label, unnest([d, c, (d - c)::{M}]) AS value FROM t""",
    ),
    "win_10_register_mismatch": (
        on("register", R.first_mismatch),
        f"WITH {REG}, r AS (SELECT *, sum(net) OVER (PARTITION BY product ORDER BY day) AS run FROM register) SELECT product, min(day) FILTER (cumulative <> run) AS first_bad_day, sum(net)::BIGINT AS total FROM r GROUP BY 1",
    ),
    "win_11_previous_cumulative": (
        on("register", lambda r: R.with_previous(r).select("product", "day", "previous")),
        f"WITH {REG} SELECT product, day, coalesce(last_value(cumulative IGNORE NULLS) OVER (PARTITION BY product ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous FROM register",
    ),
    "win_12_suggestions": (
        on("register", R.suggestions),
        f"""WITH {REG}, p AS (SELECT *, cumulative - coalesce(last_value(cumulative IGNORE NULLS) OVER (PARTITION BY product ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM register)
SELECT product, day, net, s AS suggested, length(net::VARCHAR) = length(s::VARCHAR) AND hamming(rpad(net::VARCHAR, 12, ' '), rpad(s::VARCHAR, 12, ' ')) = 1 AS plausible FROM p WHERE s >= 0 AND s <> net""",
    ),
    "win_13_serials": (
        table("events", lambda e: R.serials(e.select((F.col("user_id") % 100).alias("register_id"), F.col("event_type").alias("product"), F.day("ts").alias("day")).distinct())),
        "WITH r AS (SELECT DISTINCT user_id % 100 AS register_id, event_type AS product, day(ts)::INT AS day FROM events) SELECT *, 'A' || row_number() OVER (PARTITION BY register_id ORDER BY day, product) AS serial FROM r",
    ),
    "set_03_missing_days": (on("register", lambda r: R.missing_days(r, S.days_in_month(F.lit("2024-01-15").cast("date")))), f"WITH {REG} SELECT p.product, d::INT AS day FROM (SELECT DISTINCT product FROM register) p, unnest(range(1, 32)) AS u(d) WHERE NOT EXISTS (SELECT 1 FROM register r WHERE r.product = p.product AND r.day = d)"),
    "chk_13_meter_flags": (
        on("register", R.meter_flags),
        f"""WITH {REG}, f AS (SELECT product, day, 'meter' AS kind FROM register WHERE sales_by_meter - pump_test <> net UNION ALL SELECT product, day, 'blank_cumulative' FROM register WHERE cumulative IS NULL)
SELECT kind || '|' || product || '|' || day AS id, kind, product, day FROM f""",
    ),
    "join_06_merge_reads": (
        on("register", lambda r: R.merge_reads(r.where("day % 13 <> 6"), second_read(r).where("day % 12 <> 4"))),
        f"""WITH {REG}, b AS (SELECT *, day % 13 <> 6 AS in1, day % 12 <> 4 AS in2, CASE WHEN day % 10 = 5 THEN net + 1 ELSE net END AS net2, CASE WHEN day % 9 = 5 THEN NULL ELSE cumulative END AS cumulative2 FROM register),
u AS (SELECT product, day, in1, in2, 'net' AS col, net AS a, net2 AS b FROM b UNION ALL SELECT product, day, in1, in2, 'cumulative', cumulative, cumulative2 FROM b UNION ALL SELECT product, day, in1, in2, 'sales_by_meter', sales_by_meter, sales_by_meter FROM b UNION ALL SELECT product, day, in1, in2, 'pump_test', pump_test, pump_test FROM b),
v AS (SELECT product, day, col, CASE WHEN in1 THEN a END AS read1, CASE WHEN in2 THEN b END AS read2 FROM u) SELECT * FROM v WHERE read1 IS DISTINCT FROM read2""",
    ),
    "join_10_rates": (
        with_rates,
        f"""WITH {REG}, q AS (SELECT *, CASE product WHEN 'click' THEN 10.50 WHEN 'view' THEN 88.10 WHEN 'purchase' THEN 3.25 END::DECIMAL(10,2) AS rate FROM register)
SELECT product, day, net, rate, (net * rate)::{M} AS value FROM q""",
    ),
    "join_14_flag_fan_out": (
        fan_out,
        f"""WITH {REG}, f(id, fp, fd) AS (VALUES ('a', NULL, 3), ('b', 'click', NULL), ('c', 'view', 4), ('d', NULL, NULL))
SELECT product, day, string_agg(id, ',' ORDER BY id) AS flags FROM register JOIN f ON (fp IS NULL OR fp = product) AND (fd IS NULL OR fd = day) GROUP BY 1, 2""",
    ),
    "agg_08_tax_by_rate": (
        on("invoice_lines", I.tax_by_rate),
        f"""WITH {INV}, g AS (SELECT invoice_id, gst_rate, sum(value)::{M} AS base, min(line_no) AS f FROM invoice_lines GROUP BY 1, 2), t AS (SELECT *, round(base * gst_rate / 100::DECIMAL(5,0), 2)::{M} AS x, ((base * gst_rate * 10000)::BIGINT) AS e4 FROM g),
u AS (SELECT *, ((e4 + 5000) // 10000)::BIGINT AS cents FROM t)
SELECT invoice_id, gst_rate, base, (cents::DECIMAL(18,0) / 100)::{M} AS tax, (((cents + 1) // 2)::DECIMAL(18,0) / 100)::{M} AS cgst, NULL::{M} AS igst, row_number() OVER (PARTITION BY invoice_id ORDER BY gst_rate IS NULL, f)::INT AS place FROM u""",
    ),
    "chk_11_line_problems": (
        on("invoice_lines", I.line_problems),
        f"""WITH {INV}, p AS (SELECT *, (qty * rate)::{M} AS product, count(gst_rate) OVER (PARTITION BY invoice_id) AS rated FROM invoice_lines)
SELECT invoice_id, line_no, product, value, 'arithmetic' AS kind FROM p WHERE abs(product - value) > 1 UNION ALL SELECT invoice_id, line_no, product, value, 'unrated' FROM p WHERE gst_rate IS NULL AND rated > 0""",
    ),
    "chk_11_invoice_status": (
        on("invoice_lines", lambda v: I.invoice_status(v, printed(v))),
        f"""WITH {INV}, p AS (SELECT *, (qty * rate)::{M} AS product, count(gst_rate) OVER (PARTITION BY invoice_id) AS rated FROM invoice_lines),
s AS (SELECT invoice_id, sum(value)::{M} AS lines_total, sum((CASE WHEN abs(product - value) > 1 THEN 1 ELSE 0 END) + (CASE WHEN gst_rate IS NULL AND rated > 0 THEN 1 ELSE 0 END))::BIGINT AS faults FROM p GROUP BY 1),
q AS (SELECT *, CASE WHEN invoice_id % 11 <> 0 THEN (lines_total + CASE WHEN invoice_id % 13 = 0 THEN 9 ELSE 0 END)::{M} END AS printed FROM s)
SELECT *, CASE WHEN printed IS NULL THEN 'INCOMPLETE' WHEN abs(lines_total - printed) > 1 OR faults > 0 THEN 'NEEDS REVIEW' ELSE 'OK' END AS status FROM q""",
    ),
    "agg_10_strict_sum": (on("invoice_lines", I.strict_sum), f"WITH {INV} SELECT invoice_id, (CASE WHEN count(*) = count(gst_rate) THEN sum(gst_rate) END)::{M} AS rate_sum FROM invoice_lines GROUP BY 1"),
    "dis_06_duplicate_invoices": (
        table("orders", lambda o: I.duplicates(o.select(F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("supplier_id"), F.concat(F.lit("00 in/"), (F.col("o_orderkey") % 9).cast("string")).alias("invoice_no")))),
        "WITH n AS (SELECT o_orderkey AS invoice_id, o_custkey AS supplier_id, 'IN/' || o_orderkey % 9 AS number FROM orders), f AS (SELECT *, min(invoice_id) OVER (PARTITION BY supplier_id, number) AS first_id FROM n) SELECT * FROM f WHERE invoice_id <> first_id",
    ),
    "join_07_match_parties": (
        parties,
        rf"""WITH {GST}, p AS (SELECT supplier_id AS party_id, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS pn, gstin AS pg FROM gstins),
r AS (SELECT supplier_id AS row_id, trim(regexp_replace(upper(CASE WHEN supplier_id % 3 = 0 THEN replace(name, 'u', 'v') ELSE name END), '[^A-Z0-9]+', ' ', 'g')) AS rn, CASE WHEN supplier_id % 4 = 0 THEN gstin END AS rg FROM gstins),
m AS (SELECT row_id, party_id, CASE WHEN rg = pg THEN 2.0 ELSE 1 - levenshtein(rn, pn)::DOUBLE / greatest(length(rn), length(pn)) END AS score FROM r, p),
b AS (SELECT * FROM m WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, party_id) = 1)
SELECT row_id, party_id, CASE WHEN score > 1 THEN 'gstin' WHEN score IS NOT NULL THEN 'name' END AS matched_by FROM r LEFT JOIN b USING (row_id)""",
    ),
    "str_13_gstin": (
        on("gstins", lambda g: g.select("supplier_id", "gstin", S.gstin_check(F.col("gstin")).alias("check_char"), S.gstin_problem(F.col("gstin")).alias("problem"))),
        rf"""WITH {GST}, v AS (SELECT *, list_transform(range(1, 15), lambda i: (strpos('{S.GSTIN_ALPHABET}', substr(gstin, i::INT, 1)) - 1) * (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS v FROM gstins),
c AS (SELECT *, substr('{S.GSTIN_ALPHABET}', ((36 - list_sum(list_transform(v, lambda x: x // 36 + x % 36)) % 36) % 36)::INT + 1, 1) AS check_char FROM v)
SELECT supplier_id, gstin, check_char, CASE WHEN length(gstin) <> 15 THEN 'length' WHEN NOT (left(gstin, 2)::INT BETWEEN 1 AND 38 OR left(gstin, 2)::INT IN (97, 99)) THEN 'state' WHEN check_char <> substr(gstin, 15, 1) THEN 'check' END AS problem FROM c""",
    ),
    "str_15_words_round_trip": (
        table("orders", lambda o: o.select("o_orderkey", F.floor(F.col("o_totalprice") * 37).alias("n")).select("o_orderkey", "n", S.words_amount(S.amount_words(F.col("n"))).alias("back"))),
        "SELECT o_orderkey, floor(o_totalprice * 37)::BIGINT AS n, floor(o_totalprice * 37)::BIGINT AS back FROM orders",
    ),
    "num_01_amounts": (
        table("orders", amounts_parsed),
        f"""WITH a AS (SELECT o_orderkey, o_totalprice::{M} AS a, split_part((o_totalprice::{M})::VARCHAR, '.', 1) AS w, split_part((o_totalprice::{M})::VARCHAR, '.', 2) AS c FROM orders)
SELECT o_orderkey, CASE WHEN length(w) <= 3 THEN w WHEN length(w) <= 5 THEN left(w, length(w) - 3) || ',' || right(w, 3) ELSE left(w, length(w) - 5) || ',' || left(right(w, 5), 2) || ',' || right(w, 3) END || '.' || c AS shown,
  CASE WHEN o_orderkey % 4 IN (1, 2) THEN -a ELSE a END AS amount, a AS ocr FROM a""",
    ),
    "dat_01_dates": (
        table("orders", dates_parsed),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS d, CASE WHEN o_orderkey % 5 = 0 AND year(o_orderdate) < 2000 THEN (o_orderdate + INTERVAL 100 YEAR)::DATE WHEN o_orderkey % 5 < 4 THEN o_orderdate::DATE END AS d2 FROM orders",
    ),
    "dat_06_fiscal": (
        table("orders", lambda o: o.select("o_orderkey", S.fiscal_year(F.col("o_orderdate")).alias("fy"), S.fiscal_letter(F.col("o_orderdate")).alias("letter"), S.days_in_month(F.col("o_orderdate")).alias("days"))),
        "SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END)::INT AS fy, chr((65 + (month(o_orderdate) + 8) % 12)::INT) AS letter, day(last_day(o_orderdate))::INT AS days FROM orders",
    ),
    "str_01_clean": (
        table("documents", lambda d: d.select("doc_id", F.md5(S.clean(F.col("text"))).alias("h"), F.md5(S.digit_shape(F.regexp_replace("text", "[^ -~]", ""))).alias("shape"))),
        r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')) AS h, md5(lower(regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '[0-9]', '#', 'g'))) AS shape FROM documents",
    ),
    "join_01_nearest_column": (on("tokens", lambda t: T.nearest_column(t, BANDS)), f"WITH {TOK}, n AS (SELECT doc_id, token_id, {NEAR} AS b FROM tokens) SELECT doc_id, token_id, CASE WHEN b.d <= 70 THEN b.name END AS \"column\", b.d::DOUBLE AS distance FROM n"),
    "join_03_interval_column": (
        on("tokens", lambda t: T.interval_column(t, BANDS)),
        f"WITH {TOK} SELECT doc_id, token_id, CASE {' '.join(f'''WHEN x >= {a} AND x < {b} THEN '{n}' ''' for n, a, b in BANDS)} END AS \"column\" FROM tokens",
    ),
    "row_01_line_texts": (on("tokens", T.line_texts), f"WITH {CLUST} SELECT doc_id, line, string_agg(text, ' ' ORDER BY x, token_id) AS text, count(*) AS n_tokens FROM cl GROUP BY 1, 2"),
    "agg_19_largest_clusters": (
        on("tokens", T.largest_clusters),
        f"""WITH {CLUST}, s AS (SELECT doc_id, line, count(*) AS n, min(y) AS y0 FROM cl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(y)) <= 3)
SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY y0)::INT AS place FROM s""",
    ),
    "agg_20_widest_gap": (
        on("tokens", T.widest_gap),
        f"""WITH {TOK}, g AS (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS b FROM (SELECT DISTINCT doc_id, x FROM tokens))
SELECT doc_id, (x + b) / 2 AS threshold FROM g WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x - b DESC, x) = 1""",
    ),
    "join_05_as_of": (
        on("tokens", lambda t: T.as_of(t.where("token_id % 3 <> 0"), t.where("token_id % 3 = 0"))),
        f"""WITH {TOK}, b AS (SELECT doc_id, y AS pos, 1 AS kind, token_id FROM tokens WHERE token_id % 3 <> 0 UNION ALL SELECT doc_id, y - 20, 0, token_id FROM tokens WHERE token_id % 3 = 0),
f AS (SELECT *, last_value(CASE WHEN kind = 0 THEN token_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, kind, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_id FROM b) SELECT doc_id, token_id, row_id FROM f WHERE kind = 1""",
    ),
    "join_04_midpoint_bands": (
        on("tokens", lambda t: T.midpoint_bands(t.where("token_id % 3 <> 0"), t.where("token_id % 3 = 0"))),
        f"""WITH {TOK}, r AS (SELECT doc_id, token_id, coalesce((y + lag(y) OVER (PARTITION BY doc_id ORDER BY y, token_id)) / 2, '-inf'::DOUBLE) AS pos FROM tokens WHERE token_id % 3 = 0),
b AS (SELECT doc_id, y AS pos, 1 AS kind, token_id FROM tokens WHERE token_id % 3 <> 0 UNION ALL SELECT doc_id, pos, 0, token_id FROM r),
f AS (SELECT *, last_value(CASE WHEN kind = 0 THEN token_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, kind, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS row_id FROM b) SELECT doc_id, token_id, row_id FROM f WHERE kind = 1""",
    ),
    "row_02_blocks": (
        lines(lambda t: T.blocks(t, lambda x: x.rlike(STARTS)).select("doc_id", "block", "first_line", "n_lines", F.md5("text").alias("h"))),
        f"""WITH {LINES}, b AS (SELECT *, sum(CASE WHEN regexp_matches(text, '{STARTS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM lines)
SELECT doc_id, block, min(line_no) AS first_line, count(*) AS n_lines, md5(string_agg(text, ' ' ORDER BY line_no)) AS h FROM b WHERE block > 0 GROUP BY 1, 2""",
    ),
    "row_05_blocks_before": (
        lines(lambda t: T.blocks_before(t, lambda x: x.rlike(STARTS))),
        f"""WITH {LINES}, b AS (SELECT *, sum(CASE WHEN regexp_matches(text, '{STARTS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no DESC)::BIGINT AS block FROM lines)
SELECT doc_id, block, max(line_no) AS last_line, count(*) AS n_lines FROM b WHERE block > 0 GROUP BY 1, 2""",
    ),
    "row_10_sections": (
        lines(lambda t: T.sections(t, lambda x: x.rlike(STARTS)).select("doc_id", "line_no", "header_line")),
        f"WITH {LINES} SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(text, '{STARTS}') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_line FROM lines",
    ),
    "row_14_two_columns": (
        on("tokens", lambda t: T.two_columns(t.select("doc_id", F.floor(F.col("y") / 200).alias("page"), F.col("token_id").alias("line_no"), "x"), 300)),
        f"WITH {TOK} SELECT doc_id, token_id AS line_no, row_number() OVER (PARTITION BY doc_id ORDER BY floor(y / 200), x >= 300, token_id)::INT AS place FROM tokens",
    ),
    "flt_09_page_furniture": (
        lines(lambda t: T.page_furniture(t).select("doc_id", "page", "line_no", F.md5("text").alias("h"))),
        f"""WITH {LINES}, s AS (SELECT *, lower(regexp_replace(text, '[0-9]', '#', 'g')) AS shape FROM lines), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM lines GROUP BY 1),
d AS (SELECT doc_id, shape FROM s JOIN p USING (doc_id) GROUP BY doc_id, shape, pages HAVING pages >= 3 AND count(DISTINCT page) >= greatest(3, ceil(pages * 0.6)))
SELECT doc_id, page, line_no, md5(text) AS h FROM s ANTI JOIN d USING (doc_id, shape)""",
    ),
    "flt_01_noise": (
        lines(lambda t: T.noise(t, [r"^\s*$", r"(?i)^page \d+", r"(?i)licen[sc]e", r"\|"]).select("doc_id", "line_no")),
        rf"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE NOT regexp_matches(text, '^\s*$') AND NOT regexp_matches(text, '(?i)^page [0-9]+') AND NOT regexp_matches(text, '(?i)licen[sc]e') AND NOT contains(text, '|')",
    ),
}
