"""Queries of predicates, texts, dates and numbers, each over whole tables, with their DuckDB texts.

Texts are put together from the tables' values, so most SQL texts know the answer
without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.functions import scalar as S
from ledgerloom.operators import details as D
from ledgerloom.operators import pages as P_
from ledgerloom.operators import rows as W

M = "DECIMAL(18,2)"

#: One line of each sort, for all sorts of predicates.
SORTS = (
    "Page 3 of 7", "DATE   PARTICULARS  CHQ", "Grand Total : 12.00", "UPI/123", "IFSC Code : ABCD0000123", "Charges for", "-------", "12/03/2024 SALE OF GOODS 1,200.00 9,900.00 Cr", "cheque received by post",
    "Closing Balance", "Statement Summary", "Tran Date  Value Date  Narration", "NEFT paid 100", "branch office rent", "Ebank:wib/42", "** End of statement **", "Products sold", "7 of 9", "5. terms apply", "nothing here",
)


def orders(columns):
    """Columns, made when the query runs, of every order."""
    return lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *columns())


def sorts(column, name):
    return orders(lambda: [column(choice(SORTS)).alias(name)])


def sorts_sql(name, yes):
    """Which of ``SORTS`` hold, by their place."""
    return f"SELECT o_orderkey, o_orderkey % {len(SORTS)} IN ({', '.join(str(SORTS.index(s)) for s in yes)}) AS {name} FROM orders"


def choice(values, by="o_orderkey"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def choice_sql(values, by="o_orderkey"):
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def quoted(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def K():
    return F.col("o_orderkey")


def P():
    return F.col("o_orderpriority")


def PRICE():
    return F.col("o_totalprice").cast("decimal(18,2)")


def DATE():
    return F.col("o_orderdate").cast("date")


def DAY():
    return F.lpad(F.day(DATE()).cast("string"), 2, "0")


def MONTH():
    return F.lpad(F.month(DATE()).cast("string"), 2, "0")


def YEAR():
    return F.year(DATE()).cast("string")


NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def NAME():
    return F.element_at(F.array(*map(F.lit, NAMES)), F.month(DATE()))


def CARD_DATES():
    short = F.right(YEAR(), F.lit(2))
    return [
        F.concat(DAY(), F.lit("/"), MONTH(), F.lit("/"), YEAR()), F.concat(DAY(), F.lit("-"), MONTH(), F.lit("-"), short, F.lit(" 10:15")), F.concat(DAY(), F.lit(" "), NAME(), F.lit(" "), YEAR()),
        F.concat(DAY(), F.lit(" "), NAME(), F.lit(" '"), short), F.concat(NAME(), F.lit(" "), DAY(), F.lit(", "), YEAR()), F.lit("31/02/2024"),
    ]


WHOLE = "(o_totalprice::DECIMAL(18,2))"


def labelled_path():
    return F.when(K() % 3 == 0, F.concat(F.lit("lineItems["), (K() % 9).cast("string"), F.lit("].hsnSac"))).when(K() % 3 == 1, F.lit("supplier.gstin")).otherwise(F.concat(F.lit("totals."), P()))


def spans(text):
    cut = F.array(F.struct(F.lit(1).alias("begin"), F.lit(3).alias("end")), F.struct(F.lit(4).alias("begin"), F.lit(6).alias("end")))
    return R.remove_spans(text, cut)


def misread_day():
    """Dates of 2024-08 with the month's 8 read as 6, so outside the period, and others as they are."""
    return F.concat(F.lpad((K() % 28 + 1).cast("string"), 2, "0"), F.when(K() % 2 == 0, F.lit("/06/2024")).otherwise(F.lit("/08/2024")))


def FOREIGN():
    return P_.foreign_amount(F.concat(F.lit("PAID "), choice(["USD ", "EUR", "RS "]), PRICE().cast("string"), F.lit(" AT SHOP")))


def confidence_maps(spark, d):
    """Scores of each customer's priorities as a map of buckets, of which those below high are listed."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey", "o_orderpriority").agg((F.min("o_orderkey") % 100 / F.lit(100)).alias("score"))
    maps = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", S.confidence_bucket(F.col("score"))))).alias("m"))
    weak = F.map_entries(F.map_filter("m", lambda k, v: v != "high"))
    return maps.select("o_custkey", F.array_join(F.array_sort(F.transform(weak, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",").alias("weak"))


def grouped_lines(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), "l_returnflag")).alias("x"))
    return l.select(
        "l_orderkey", F.size(F.filter("x", lambda t: t["l_returnflag"] == "R")).alias("returned"), F.exists("x", lambda t: t["v"] > 50000).alias("any_large"),
        F.aggregate(F.transform("x", lambda t: t["v"]), F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v).cast("decimal(28,2)")).cast("decimal(18,2)").alias("total"),
    )


WORDS_BELOW = "SELECT i, CASE WHEN i < 20 THEN u[i + 1] WHEN i % 10 = 0 THEN t[i // 10 + 1] ELSE t[i // 10 + 1] || ' ' || u[i % 10 + 1] END AS w FROM (SELECT unnest(range(100)) AS i, " + str(S.UNITS) + " AS u, " + str(S.TENS) + " AS t)"

PAIRS = {
    "flt_01_noise_lines": (sorts(R.noise_line, "noise"), sorts_sql("noise", ["Page 3 of 7", SORTS[1], SORTS[2], SORTS[4], "-------", "Closing Balance", "Statement Summary", "branch office rent", "** End of statement **", "7 of 9", "5. terms apply"])),
    "flt_02_heading_lines": (sorts(R.heading_line, "heading"), sorts_sql("heading", [SORTS[1], SORTS[11]])),
    "flt_03_terminal_lines": (sorts(R.terminal_line, "terminal"), sorts_sql("terminal", [SORTS[2], "Closing Balance", "Statement Summary", "** End of statement **"])),
    "flt_10_generic_particulars": (sorts(R.generic_particulars, "generic"), sorts_sql("generic", ["UPI/123", "Charges for", "Ebank:wib/42"])),
    "flt_22_payment_notes": (sorts(R.payment_note, "payment"), sorts_sql("payment", [SORTS[1], "UPI/123", "cheque received by post", "NEFT paid 100"])),
    "flt_04_amount_tokens": (
        orders(lambda: [D.amount_text(F.when(K() % 4 == 0, PRICE().cast("string")).when(K() % 4 == 1, F.concat(PRICE().cast("string"), F.lit(" Cr"))).when(K() % 4 == 2, F.concat(F.lit("x"), PRICE().cast("string"))).otherwise(K().cast("string"))).alias("amount")]),
        "SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS amount FROM orders",
    ),
    "flt_06_amount_items": (
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), D.amount_text)).alias("n_amounts")),
        r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: regexp_matches(x, '(?i)^-?₹?[0-9][0-9,]*\.[0-9]{2}( ?(cr|dr)\.?)?$')))::INT AS n_amounts FROM documents",
    ),
    "flt_17_column_names": (
        orders(lambda: [R.column_name(choice(["Txn Date", "Narration", "Chq No", "Debit (Rs)", "CREDIT", "Closing Balance", "Branch"])).alias("name")]),
        f"SELECT o_orderkey, {choice_sql([quoted(x) for x in ('date', 'particulars', 'cheque', 'withdrawal', 'deposit', 'balance', None)])} AS name FROM orders",
    ),
    "flt_18_side_by_words": (
        orders(lambda: [R.side_by_words(F.concat(P(), choice([" cr", " NEFT DR 5", " credit card", " drum", " Withdrawal x", ""]))).alias("side")]),
        f"SELECT o_orderkey, {choice_sql([quoted(x) for x in ('deposit', 'withdrawal', 'deposit', 'deposit', 'withdrawal', 'deposit')])} AS side FROM orders",
    ),
    "flt_19_word_edges": (
        orders(lambda: [D.kind_of(choice(["ATMOSPHERE LTD", "ATM WDL", "CASH WDL 9", "CHQ 12", "CHEQUERED FLAG", "UPI/1", "a fee"])).alias("kind")]),
        f"SELECT o_orderkey, {choice_sql([quoted(x) for x in ('MISC', 'ATM', 'ATM', 'CHEQUE', 'MISC', 'UPI', 'CHARGES')])} AS kind FROM orders",
    ),
    "flt_20_word_edges": (
        orders(lambda: [D.entry_type(F.array(choice(["STEEL DRUM", "Red wine 750 ml", "cement work", "CEMENT", "rum"])), F.array(F.when(K() % 2 == 0, "7214").otherwise(F.lit(None)))).alias("entry_type")]),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 4) THEN 'TCS' WHEN o_orderkey % 5 = 2 THEN 'NORMAL' WHEN o_orderkey % 2 = 0 THEN 'STOCK' ELSE 'NORMAL' END AS entry_type FROM orders",
    ),
    "flt_23_balance_side": (orders(lambda: [R.balance_side(choice(["Cr", "C0", "dr", " D.", ""])).alias("side")]), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'DR' ELSE 'CR' END AS side FROM orders"),
    "flt_25_balance_trail": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").where((PRICE() > 0) & (PRICE() < 400000)).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min_by(PRICE(), "o_orderkey").alias("start")),
        f"SELECT o_custkey, count(*) AS n, arg_min({WHOLE}, o_orderkey) AS start FROM orders WHERE {WHOLE} > 0 AND {WHOLE} < 400000 GROUP BY 1",
    ),
    "str_02_normal_text": (
        orders(lambda: [R.normal_text(F.concat(F.lit(" “"), P(), F.lit("”  ‘x’  "))).alias("t")]),
        "SELECT o_orderkey, '\"' || o_orderpriority || '\" ''x''' AS t FROM orders",
    ),
    "str_03_tighten": (orders(lambda: [S.tighten(F.concat(P(), F.lit(" / ref  - "), K().cast("string"), F.lit(" . "))).alias("t")]), "SELECT o_orderkey, o_orderpriority || '/ref-' || o_orderkey || ' .' AS t FROM orders"),
    "str_04_wrapped_lines": (orders(lambda: [S.join_wrapped(F.array(F.concat(P(), F.lit("/")), K().cast("string"), F.lit("end"))).alias("t")]), "SELECT o_orderkey, o_orderpriority || '/' || o_orderkey || ' end' AS t FROM orders"),
    "str_05_lookalikes": (
        orders(lambda: [S.ocr_digits(F.when(K() % 3 == 0, F.translate(PRICE().cast("string"), "015", "OlS")).when(K() % 3 == 1, F.lit("SOLID")).otherwise(F.lit("O5/l2/2O24"))).alias("t")]),
        f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {WHOLE}::VARCHAR WHEN 1 THEN 'SOLID' ELSE '05/12/2024' END AS t FROM orders",
    ),
    "str_07_removed_spans": (
        orders(lambda: [spans(F.concat(P(), F.lit("|"), K().cast("string"))).alias("t")]),
        "SELECT o_orderkey, trim(regexp_replace(left(o_orderpriority, 1) || ' ' || substr(o_orderpriority, 4, 1) || ' ' || substr(o_orderpriority || '|' || o_orderkey, 7), '\\s+', ' ', 'g')) AS t FROM orders",
    ),
    "str_08_edit_distance": (
        lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.levenshtein("c_name", F.concat(F.col("c_mktsegment"), F.lit("#"), F.col("c_custkey").cast("string"))).cast("long").alias("edits")),
        "SELECT c_custkey, levenshtein(c_name, c_mktsegment || '#' || c_custkey)::BIGINT AS edits FROM customer",
    ),
    "str_12_check_digits": (
        orders(lambda: [F.call_function("luhn_check", F.concat(F.lit("4111111"), F.lpad(K().cast("string"), 9, "0"))).alias("valid")]),
        """WITH d AS (SELECT o_orderkey, '4111111' || lpad(o_orderkey::VARCHAR, 9, '0') AS d FROM orders)
SELECT o_orderkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, i::INT, 1)::INT ELSE (substr(d, i::INT, 1)::INT * 2) // 10 + (substr(d, i::INT, 1)::INT * 2) % 10 END)) % 10 = 0 AS valid FROM d""",
    ),
    "str_14_amount_words": (
        orders(lambda: [S.amount_words((K() * 7919) % 1000000000).alias("w")]),
        f"""WITH b AS ({WORDS_BELOW}), n AS (SELECT o_orderkey, (o_orderkey * 7919) % 1000000000 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n = 0 THEN 'zero' ELSE concat_ws(' ', CASE WHEN n // 10000000 > 0 THEN a.w || ' crore' END, CASE WHEN n // 100000 % 100 > 0 THEN c.w || ' lakh' END, CASE WHEN n // 1000 % 100 > 0 THEN e.w || ' thousand' END,
  CASE WHEN n // 100 % 10 > 0 THEN f.w || ' hundred' END, CASE WHEN n % 100 > 0 THEN g.w END) END AS w
FROM n JOIN b a ON a.i = n // 10000000 JOIN b c ON c.i = n // 100000 % 100 JOIN b e ON e.i = n // 1000 % 100 JOIN b f ON f.i = n // 100 % 10 JOIN b g ON g.i = n % 100""",
    ),
    "str_16_quantity_in_text": (
        lambda s, d: orders(lambda: [R.quantity_in(F.concat(F.lit("total area "), (K() % 500).cast("string"), choice([".5 Sq. Ft", " KGS", " nos and 3 pcs", " words", " running ft of pipe"]))).alias("q")])(s, d).select("o_orderkey", "q.qty", "q.unit"),
        "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 500 + 0.5 WHEN 1 THEN o_orderkey % 500 WHEN 4 THEN o_orderkey % 500 END::DECIMAL(18,4) AS qty, CASE o_orderkey % 5 WHEN 0 THEN 'sqft' WHEN 1 THEN 'KGS' WHEN 4 THEN 'rft' END AS unit FROM orders",
    ),
    "str_16_units": (
        orders(lambda: [S.unit(choice(["pcs.", " Kgs", "litre", "BOXES", "m", "yard"])).alias("unit")]),
        f"SELECT o_orderkey, {choice_sql([quoted(x) for x in ('NOS', 'KGS', 'LTR', 'BOX', 'MTR', None)])} AS unit FROM orders",
    ),
    "str_18_digit_shapes": (orders(lambda: [S.digit_shape(F.concat(P(), F.lit(" "), PRICE().cast("string"))).alias("shape")]), rf"SELECT o_orderkey, regexp_replace(lower(o_orderpriority || ' ' || {WHOLE}), '[0-9]', '#', 'g') AS shape FROM orders"),
    "str_19_indian_commas": (
        orders(lambda: [S.indian_grouping(F.when(K() % 2 == 0, PRICE() * 100).otherwise(-PRICE()).cast("decimal(18,2)")).alias("t")]),
        f"""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '-' END AS sign, CASE WHEN o_orderkey % 2 = 0 THEN ({WHOLE} * 100)::{M} ELSE {WHOLE} END::VARCHAR AS t FROM orders), p AS (SELECT *, string_split(t, '.')[1] AS w, string_split(t, '.')[2] AS c FROM n)
SELECT o_orderkey, sign || CASE WHEN length(w) > 7 THEN left(w, length(w) - 7) || ',' || substr(w, length(w) - 6, 2) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3) WHEN length(w) > 5 THEN left(w, length(w) - 5) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3)
  WHEN length(w) > 3 THEN left(w, length(w) - 3) || ',' || right(w, 3) ELSE w END || '.' || c AS t FROM p""",
    ),
    "str_20_foreign_amounts": (
        orders(lambda: [FOREIGN()[0].alias("currency"), FOREIGN()[1].alias("amount")]),
        f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 3 < 2 THEN {WHOLE} END AS amount FROM orders",
    ),
    "str_22_field_labels": (
        orders(lambda: [R.field_label(labelled_path()).alias("label")]),
        "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'line ' || (o_orderkey % 9 + 1) || ' HSN/SAC' WHEN 1 THEN 'supplier GSTIN' ELSE 'totals ' || o_orderpriority END AS label FROM orders",
    ),
    "dat_02_bank_dates": (
        orders(lambda: [S.parse_date(F.concat(DAY(), F.lit("-"), MONTH(), F.lit("-"), F.right(YEAR(), F.lit(2))), None).alias("d")]),
        "SELECT o_orderkey, make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 AND NOT ((2000 + year(o_orderdate) % 100) % 4 = 0) THEN NULL ELSE day(o_orderdate) END) AS d FROM orders",
    ),
    "dat_03_card_dates": (
        orders(lambda: [R.card_date(F.element_at(F.array(*CARD_DATES()), (K() % 6 + 1).cast("int"))).alias("d")]),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 IN (1, 3) THEN try_cast((2000 + year(o_orderdate) % 100) || strftime(o_orderdate, '-%m-%d') AS DATE) ELSE o_orderdate::DATE END AS d FROM orders",
    ),
    "dat_04_strict_dates": (
        orders(lambda: [R.strict_date(F.when(K() % 2 == 0, CARD_DATES()[0]).otherwise(F.concat(F.day(DATE()).cast("string"), F.lit("-"), MONTH(), F.lit("-"), YEAR()))).alias("d")]),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS d FROM orders",
    ),
    "dat_07_repaired_dates": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", R.repaired_date(misread_day(), F.lit("2024-08-01").cast("date"), F.lit("2024-08-31").cast("date")).alias("r")).select("o_orderkey", "r.date", "r.corrected"),
        "SELECT o_orderkey, make_date(2024, 8, (o_orderkey % 28 + 1)::INT) AS date, o_orderkey % 2 = 0 AS corrected FROM orders",
    ),
    "dat_09_days_in_month": (orders(lambda: [S.days_in_month(DATE()).alias("days")]), "SELECT o_orderkey, day(last_day(o_orderdate::DATE()))::INT AS days FROM orders"),
    "num_02_scanned_money": (
        orders(lambda: [S.parse_ocr_money(F.concat(F.substring_index(PRICE().cast("string"), ".", 1), choice([".", ","]), F.substring_index(PRICE().cast("string"), ".", -1))).alias("v")]),
        f"SELECT o_orderkey, {WHOLE} AS v FROM orders",
    ),
    "num_04_round_half_away": (
        orders(lambda: [S.round_half_away(((K() % 2001 - 1000) / F.lit(200)).cast("decimal(18,3)")).alias("v")]),
        f"SELECT o_orderkey, (sign((o_orderkey % 2001 - 1000) * 5) * floor((abs((o_orderkey % 2001 - 1000) * 5) + 5) / 10) / 100)::{M} AS v FROM orders",
    ),
    "num_05_paise": (
        orders(lambda: [F.round((K() % 1000).cast("decimal(10,0)") * F.round((PRICE() / 1000).cast("decimal(18,4)"), 2), 2).cast("decimal(18,2)").alias("v")]),
        f"WITH p AS (SELECT o_orderkey, ({WHOLE} * 100)::BIGINT AS c FROM orders) SELECT o_orderkey, ((o_orderkey % 1000) * (((c + 5) // 10 + 50) // 100) / 100)::{M} AS v FROM p",
    ),
    "num_06_half_even": (
        orders(lambda: [R.half_even(((K() % 4001 - 2000) * F.lit(5) / F.lit(1000)).cast("decimal(18,3)")).alias("v")]),
        f"SELECT o_orderkey, (round_even((o_orderkey % 4001 - 2000) * 0.5::DOUBLE, 0) / 100)::{M} AS v FROM orders",
    ),
    "num_07_close_digits": (
        orders(lambda: [R.digits_close(K() + 100000, F.when(K() % 3 == 0, K() + 100011).when(K() % 3 == 1, (K() + 100000) % 100000 + 900000).otherwise(F.substring((K() + 100000).cast("string"), 1, 4).cast("long"))).alias("close")]),
        """WITH p AS (SELECT o_orderkey, (o_orderkey + 100000)::VARCHAR AS a, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey + 100011 WHEN 1 THEN (o_orderkey + 100000) % 100000 + 900000 ELSE left((o_orderkey + 100000)::VARCHAR, 4)::BIGINT END::VARCHAR AS b FROM orders)
SELECT o_orderkey, CASE WHEN length(a) = length(b) THEN list_sum(list_transform(range(1, length(a) + 1), lambda i: (substr(a, i::INT, 1) <> substr(b, i::INT, 1))::INT)) <= 2 ELSE TRUE END AS close FROM p""",
    ),
    "arr_01_over_items": (
        grouped_lines,
        f"SELECT l_orderkey, (count(*) FILTER (l_returnflag = 'R'))::INT AS returned, bool_or(l_extendedprice::{M} > 50000) AS any_large, sum(l_extendedprice::{M})::{M} AS total FROM lineitem GROUP BY 1",
    ),
    "arr_02_groups_in_order": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "o_orderpriority", "n"))), lambda g: F.concat(g["o_orderpriority"], F.lit("="), g["n"].cast("string"))), ";").alias("groups")),
        "WITH g AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(o_orderpriority || '=' || n, ';' ORDER BY f) AS groups FROM g GROUP BY 1",
    ),
    "map_01_confidence_maps": (
        confidence_maps,
        "WITH b AS (SELECT o_custkey, o_orderpriority AS k, CASE WHEN min(o_orderkey) % 100 < 60 THEN 'low' WHEN min(o_orderkey) % 100 < 85 THEN 'medium' ELSE 'high' END AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, coalesce(string_agg(k || ':' || v, ',' ORDER BY k) FILTER (v <> 'high'), '') AS weak FROM b GROUP BY 1",
    ),
    "jsn_01_coerced_leaves": (
        orders(lambda: [R.coerced_number(choice(["Rs. 1,54,624.00", "12/-", "-7.5", "about 5", ""])).alias("number"), R.coerced_flag(choice(["Yes", "FALSE", "maybe", ""])).alias("flag")]),
        f"SELECT o_orderkey, {choice_sql(['154624.00', '12.00', '-7.50', 'NULL', 'NULL'])}::{M} AS number, {choice_sql(['TRUE', 'FALSE', 'NULL', 'NULL'])} AS flag FROM orders",
    ),
    "jsn_02_flat_paths": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("status")).alias("head"), F.struct(P().alias("priority"), PRICE().cast("string").alias("total")).alias("body")).alias("n")).select("o_orderkey", F.inline(F.array(F.struct(F.lit("head.status").alias("path"), F.col("n.head.status").alias("value")), F.struct(F.lit("body.priority").alias("path"), F.col("n.body.priority").alias("value")), F.struct(F.lit("body.total").alias("path"), F.col("n.body.total").alias("value"))))),
        f"SELECT o_orderkey, 'head.status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'body.priority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'body.total', {WHOLE}::VARCHAR FROM orders",
    ),
    "join_08_code_by_prefix": (
        lambda s, d: W.code_by_prefix(s.read.parquet(f"{d}/orders.parquet").select(K().alias("row_id"), F.concat(choice(["NEFT INWARD", "NEFTINWARD", "CASH DEP", "C ASH DEP", "ZZZZZZZZ QQQQQQQQ", "NEFT INWRD", "SERVICE CHARGE"]), F.lit(" "), K().cast("string")).alias("text")), [("NEFT", "INWARD"), ("CASH", "DEP"), ("SERVICE", "CHARGE")]),
        """SELECT o_orderkey AS row_id, CASE o_orderkey % 7 WHEN 2 THEN 'CASH DEP' WHEN 3 THEN 'CASH DEP' WHEN 4 THEN NULL WHEN 6 THEN 'SERVICE CHARGE' ELSE 'NEFT INWARD' END AS code,
CASE o_orderkey % 7 WHEN 3 THEN 0 WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN length(o_orderkey::VARCHAR) <= 2 THEN 1 + length(o_orderkey::VARCHAR) ELSE 1 END ELSE CASE WHEN length(o_orderkey::VARCHAR) <= 3 THEN length(o_orderkey::VARCHAR) ELSE 0 END END::INT AS edits FROM orders""",
    ),
    "join_09_nearest_word": (
        orders(lambda: [W.nearest_word(choice(["NEFT", "NEFI", "RTG5", "1MPS", "cash", "XXXXXX", "TFR"]), ["NEFT", "RTGS", "IMPS", "CASH", "TFR"]).alias("word")]),
        f"SELECT o_orderkey, {choice_sql([quoted(x) for x in ('NEFT', 'NEFT', 'RTGS', 'IMPS', 'CASH', None, 'TFR')])} AS word FROM orders",
    ),
}
