"""Queries of statement details with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import details as T
from ledgerloom.operators.lines import lines_of
from ledgerloom.plans.document_queries import LINES, STARTS
from ledgerloom.plans.views import duck, view

M = "DECIMAL(18,2)"
LEDGER, CARD, REG = duck("ledger"), duck("card"), duck("register")


def ledger(f):
    return lambda spark, d: f(view(spark, d, "ledger"))


def lines(f):
    return lambda spark, d: f(lines_of(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")))


def orders(f):
    return lambda spark, d: f(spark.read.parquet(f"{d}/orders.parquet"))


def amount_line(o):
    a = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("05/03/2024 pay x"), a, F.lit(" to "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(a, F.lit(" and 1,234.50"))).otherwise(F.concat(F.lit("ref/"), a)))
    return o.select("o_orderkey", F.array_join(T.amounts_in(text), "|").alias("found"), T.data_like(text).alias("data"))


def references(df):
    body, ref = T.split_reference(F.concat_ws(" ", "particulars", "cheque_no"))
    return df.select("doc_id", "seq", body.alias("body"), ref.alias("ref"))


def ids(df):
    a, b = T.output_ids(F.lit(None).cast("string"), F.col("cheque_no"))
    return df.select("doc_id", "seq", a.alias("tran_id"), b.alias("cheque"))


def diff(spark, d):
    a = view(spark, d, "ledger")
    one = a.select("doc_id", F.concat(F.lit("rows."), F.col("seq").cast("string")).alias("path"), F.col("particulars").alias("value"))
    two = a.where("seq % 50 <> 0").select("doc_id", F.concat(F.lit("rows."), F.col("seq").cast("string")).alias("path"), F.when(F.col("seq") % 7 == 0, F.concat("particulars", F.lit("!"))).otherwise(F.upper("particulars")).alias("value"))
    return T.field_diff(one, two)


KEYED = ledger(lambda x: T.group_problems(x.where("withdrawal IS NOT NULL").select("doc_id", "seq", F.when(F.col("withdrawal") > 100000, "large").otherwise("small").alias("kind"), F.col("withdrawal").alias("amount"))))

PAIRS = {
    "prj_01_label_values": (
        orders(lambda o: T.label_values(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Status").when(F.col("o_orderkey") % 3 == 1, " STATUS ").otherwise("Branch Name"), F.lit(": "), "o_orderpriority", F.lit(" "), "o_orderstatus").alias("text")))),
        """WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 2 THEN 'branch name' ELSE 'status' END AS label, o_orderpriority || ' ' || o_orderstatus AS v FROM orders)
SELECT doc_id, label, arg_min(v, line_no) AS value FROM r GROUP BY 1, 2""",
    ),
    "prj_03_references": (
        ledger(references),
        rf"""WITH {LEDGER}, t AS (SELECT doc_id, seq, concat_ws(' ', particulars, cheque_no) AS t FROM ledger), l AS (SELECT *, string_split(t, ' ')[-1] AS l FROM t)
SELECT doc_id, seq, CASE WHEN regexp_matches(l, '[0-9]') AND length(t) > length(l) THEN trim(left(t, length(t) - length(l))) ELSE t END AS body, CASE WHEN regexp_matches(l, '[0-9]') AND length(t) > length(l) THEN l END AS ref FROM l""",
    ),
    "prj_06_output_ids": (ledger(ids), f"WITH {LEDGER} SELECT doc_id, seq, CASE WHEN NOT regexp_matches(cheque_no, '^[0-9]{{1,6}}$') THEN cheque_no END AS tran_id, CASE WHEN regexp_matches(cheque_no, '^[0-9]{{1,6}}$') THEN cheque_no END AS cheque FROM ledger"),
    "flt_05_amounts_in_lines": (
        orders(amount_line),
        f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_totalprice::{M})::VARCHAR || '|1,234.50' ELSE '' END AS found, TRUE AS data FROM orders",
    ),
    "flt_07_data_like": (
        lines(lambda x: x.select("doc_id", "line_no", T.data_like(F.col("text")).alias("data"))),
        rf"WITH {LINES} SELECT doc_id, line_no, regexp_matches(text, '^\s*[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{2,4}}\b') OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '(?i)^-?₹?[0-9][0-9,]*\.[0-9]{{2}}( ?(cr|dr)\.?)?$'))) > 0 AS data FROM lines",
    ),
    "flt_08_header_lines": (
        lines(lambda x: x.where(T.header_line(F.col("text"), ["the", "of", "and", "de", "la", "und", "der"])).select("doc_id", "line_no")),
        rf"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x IN ('the', 'of', 'and', 'de', 'la', 'und', 'der')))) >= 3",
    ),
    "flt_19_kinds": (
        ledger(lambda x: x.select("doc_id", "seq", T.kind_of(F.col("particulars"), kinds=(("URGENT", "URGENT"), ("LOW", "LOW"), ("REF1", "REF 1"))).alias("kind"))),
        f"WITH {LEDGER} SELECT doc_id, seq, CASE WHEN contains(upper(particulars), 'URGENT') THEN 'URGENT' WHEN contains(upper(particulars), 'LOW') THEN 'LOW' WHEN contains(upper(particulars), 'REF 1') THEN 'REF1' ELSE 'MISC' END AS kind FROM ledger",
    ),
    "flt_20_entry_types": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).select("p_brand", T.entry_type(F.col("t")).alias("entry_type")),
        "SELECT p_brand, CASE WHEN bool_or(regexp_matches(lower(p_type), '\\b(liquor|beer|whiske?y|wine|rum|vodka|gin|brandy|imfl|bar|pint|peg)\\b')) THEN 'TCS' WHEN bool_or(regexp_matches(lower(p_type), '\\b(works?|labou?r|services?|repair|transport|charges)\\b')) THEN 'NORMAL' ELSE 'STOCK' END AS entry_type FROM part GROUP BY 1",
    ),
    "flt_24_period": (ledger(lambda x: T.in_period(x, "1995-01-01", "1997-12-31")[1].select("doc_id", "seq")), f"WITH {LEDGER} SELECT doc_id, seq FROM ledger WHERE txn_date < DATE '1995-01-01' OR txn_date > DATE '1997-12-31'"),
    "agg_13_usual_heading": (
        ledger(lambda x: T.usual_heading(x.select("doc_id", "seq", F.col("particulars").alias("heading")))),
        f"WITH {LEDGER}, c AS (SELECT doc_id, particulars AS heading, count(*) AS n, min(seq) AS f FROM ledger GROUP BY 1, 2) SELECT doc_id, heading FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1",
    ),
    "agg_14_backfill": (
        ledger(lambda x: T.backfill(x, "cheque_no").select("doc_id", "seq", "filled")),
        f"WITH {LEDGER} SELECT doc_id, seq, coalesce(cheque_no, CASE WHEN min(cheque_no) OVER (PARTITION BY doc_id) = max(cheque_no) OVER (PARTITION BY doc_id) THEN min(cheque_no) OVER (PARTITION BY doc_id) END) AS filled FROM ledger",
    ),
    "agg_16_group_problems": (
        KEYED,
        f"""WITH {LEDGER}, p AS (SELECT doc_id, seq, CASE WHEN withdrawal > 100000 THEN 'large' ELSE 'small' END AS kind, withdrawal AS a FROM ledger WHERE withdrawal IS NOT NULL)
SELECT doc_id, kind, count(*) AS n, min(seq) AS first_seq, sum(abs(a))::{M} AS total, array_to_string(list_sort(list(seq))[1:5], ',') AS shown FROM p GROUP BY 1, 2""",
    ),
    "agg_25_serial_gap": (
        ledger(lambda x: T.serial_gap(x.select("doc_id", F.floor(F.col("seq") / 2).alias("serial")))),
        f"WITH {LEDGER} SELECT doc_id, max(seq // 2) AS max_serial, count(*) AS n_rows, max(seq // 2) - count(*) AS missing FROM ledger GROUP BY 1",
    ),
    "dis_04_merge_copies": (
        ledger(lambda x: T.merge_copies(x.withColumn("move", (F.coalesce("deposit", F.lit(0)) - F.coalesce("withdrawal", F.lit(0))).cast("decimal(18,2)")))),
        f"""WITH {LEDGER}, m AS (SELECT *, (coalesce(deposit, 0) - coalesce(withdrawal, 0))::{M} AS move FROM ledger)
SELECT doc_id, balance, move, arg_max(particulars, length(particulars) * 10000000 - seq) AS particulars, count(*) AS copies, min(seq) AS seq, arg_min(cheque_no, seq) FILTER (cheque_no IS NOT NULL) AS cheque_no, bool_and(ocr_corrected) AS ocr_corrected, count(DISTINCT txn_date)::INT AS n_dates FROM m GROUP BY 1, 2, 3""",
    ),
    "dis_05_distinct_lines": (lines(lambda x: T.distinct_lines(x).select("doc_id", "line_no")), f"WITH {LINES} SELECT doc_id, min(line_no) AS line_no FROM lines GROUP BY doc_id, text"),
    "srt_01_chronological": (ledger(T.chronological), f"WITH {LEDGER} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(txn_date, DATE '1970-01-01'), seq)::INT AS place FROM ledger"),
    "arr_03_chunks": (ledger(lambda x: T.chunks(x, 4)), f"WITH {LEDGER} SELECT doc_id, seq, ((row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) // 4)::INT AS chunk FROM ledger"),
    "join_11_nth_page": (
        lambda s, d: T.nth_page(view(s, d, "register").select("product", F.col("day").alias("page"), "net"), 3),
        f"WITH {REG} SELECT product, day AS page, net FROM register QUALIFY row_number() OVER (PARTITION BY product ORDER BY day) = 3",
    ),
    "join_12_zip": (
        ledger(lambda x: T.zip_columns(x.where("withdrawal IS NOT NULL").select("doc_id", "seq", F.col("withdrawal").alias("value")), x.where("deposit IS NOT NULL").select("doc_id", "seq", F.col("deposit").alias("value")))),
        f"""WITH {LEDGER}, a AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq)::INT AS i, withdrawal AS left_value FROM ledger WHERE withdrawal IS NOT NULL), b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq)::INT AS i, deposit AS right_value FROM ledger WHERE deposit IS NOT NULL)
SELECT * FROM a JOIN b USING (doc_id, i)""",
    ),
    "join_15_semi_anti": (
        lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey").join(view(s, d, "ledger").where("withdrawal > 300000").select(F.col("doc_id").alias("c_custkey")), "c_custkey", "left_semi"),
        f"WITH {LEDGER} SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT doc_id FROM ledger WHERE withdrawal > 300000)",
    ),
    "join_17_field_diff": (
        diff,
        f"""WITH {LEDGER}, a AS (SELECT doc_id, 'rows.' || seq AS path, particulars AS a FROM ledger), b AS (SELECT doc_id, 'rows.' || seq AS path, CASE WHEN seq % 7 = 0 THEN particulars || '!' ELSE upper(particulars) END AS b FROM ledger WHERE seq % 50 <> 0)
SELECT doc_id, path, a, b FROM a FULL JOIN b USING (doc_id, path) WHERE lower(replace(coalesce(a, ''), ' ', '')) <> lower(replace(coalesce(b, ''), ' ', ''))""",
    ),
    "row_04_attach_lines": (
        lines(lambda x: T.attach_lines(x, lambda t: t.rlike(STARTS))),
        f"""WITH {LINES}, s AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '{STARTS}') THEN line_no END AS o FROM lines),
n AS (SELECT doc_id, line_no, last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, first_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s)
SELECT doc_id, line_no, CASE WHEN b IS NULL OR line_no - a <= b - line_no THEN a ELSE b END AS row_line FROM n""",
    ),
    "row_16_continuation": (
        lines(lambda x: T.limited_continuation(x, lambda t: t.rlike(STARTS))),
        f"""WITH {LINES}, s AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '{STARTS}') THEN line_no END IGNORE NULLS) OVER w AS start, last_value(CASE WHEN regexp_matches(text, '{STARTS}') THEN page END IGNORE NULLS) OVER w AS sp FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc_id, line_no, start FROM s WHERE line_no > start AND line_no - start <= 2 AND page = sp""",
    ),
    "num_09_confidence_buckets": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", S.confidence_bucket((F.col("event_id") % 100 / F.lit(100)).cast("double")).alias("bucket")),
        "SELECT event_id, CASE WHEN event_id % 100 < 60 THEN 'low' WHEN event_id % 100 < 85 THEN 'medium' ELSE 'high' END AS bucket FROM events",
    ),
    "dat_05_period_dates": (
        orders(lambda o: o.select("o_orderkey", S.date_in_period(F.month("o_orderdate"), F.day("o_orderdate"), F.to_date(F.lit("2023-07-01"))).alias("d"))),
        "SELECT o_orderkey, try_cast(CASE WHEN month(o_orderdate) >= 7 THEN '2023' ELSE '2024' END || '-' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '-' || lpad(day(o_orderdate)::VARCHAR, 2, '0') AS DATE) AS d FROM orders",
    ),
    "str_17_invoice_numbers": (
        orders(lambda o: o.select("o_orderkey", S.invoice_number(F.concat(F.lit("00 a"), F.col("o_orderkey").cast("string"), F.lit(" /b"))).alias("number"))),
        "SELECT o_orderkey, 'A' || o_orderkey || '/B' AS number FROM orders",
    ),
}
