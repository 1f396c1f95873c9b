"""Fields of card summaries that stand in tables: labels over several lines with values below them, and equations of labels.

Lines: ``doc_id``, ``page``, ``line_no``, ``text``, ``items`` (``array<struct<x:double,text:string>>``; may be null).

*Column tables.*  A page is cut after each line that holds a value, so a piece is some lines of labels and one
of values.  Any of its label lines may be a table's heading: labels of the lines below that stand under a heading's
word go on with it (what stands beside the table is left out, what stands between columns ends the heading),
and each value belongs to the nearest heading word.  A piece is part of a page, and all within one row.

*Equations.*  A line that says ``a - b + c = d`` in labels takes the amounts of the next line that has any, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.functions import scalar as S

MONEY = "decimal(18,2)"
#: How far a wrapped label, and how far a value, may stand from its heading word.
LABEL_ALIGN, VALUE_ALIGN = 15.0, 40.0
#: Whole labels and the fields that they name, with the kind of value.
FIELDS = (
    ("opening balance|previous balance", "previous_balance", "amount"), ("purchase|purchases", "purchases", "amount"), ("other debit|other debits|other debit & charges|other debits & charges|other debit and charges", "other_debits", "amount"),
    ("cash advance|cash advances", "cash_advance", "amount"), ("payment|payments", "payments", "amount"), ("credit|credits|other credit|other credits", "other_credits", "amount"), ("total amount due|total payment due", "total_due", "amount"),
    ("minimum amount due|minimum payment due", "minimum_due", "amount"), ("payment due date", "due_date", "date"), ("statement date|statement generation date", "statement_date", "date"), ("statement period", "period", "period"),
    ("edge reward points|total reward points available", "points_closing", "points"), ("balance as on date", "points_as_of", "date"), ("credit limit", "credit_limit", "amount"), ("available credit limit", "available_credit_limit", "amount"),
    ("cash limit", "cash_limit", "amount"), ("available cash limit", "available_cash_limit", "amount"), ("reward points carried over|rewards points carried over", "points_opening", "points"), ("reward points earned", "points_earned", "points"),
    ("bonus reward points", "points_bonus", "points"), ("adjusted/redeemed|adjusted redeemed", "points_adjusted", "points"),
)
BY_LABEL = {label: f"{key}:{kind}" for labels, key, kind in FIELDS for label in labels.split("|")}
#: What stands alone as a number or a date, and an amount with its sign.
VALUE = r"(?<![\w,./:-])(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?(?![\w,/:])|\d{1,2}[/-](?:\d{1,2}|[A-Za-z]{3})[/-]\d{2,4}"
AMOUNT = r"(?i)^(?:₹|rs\.?|inr)?\s?(-)?([\d,]+(?:\.\d+)?)\s*(dr|cr)?$"
DATE = r"\d{1,2}[/-](?:\d{1,2}|[A-Za-z]{3,9})[/-]\d{2,4}"


def label_field(label: Column) -> Column:
    """``key:kind`` of a label; null if it names no field."""
    return F.try_element_at(S.lookup(BY_LABEL), F.lower(S.clean(F.regexp_replace(label, r"\s*/\s*", "/"))))


def signed_amount(text: Column) -> Column:
    """An amount of a summary; what is in credit is negative."""
    value = F.replace(F.regexp_extract(text, AMOUNT, 2), F.lit(","), F.lit("")).try_cast(MONEY)
    return F.when(text.rlike(AMOUNT), F.when((F.regexp_extract(text, AMOUNT, 1) != "") | (F.lower(F.regexp_extract(text, AMOUNT, 3)) == "cr"), -value).otherwise(value))


def _value(kind: Column, text: Column) -> Column:
    points = F.when(text.rlike(r"^[\d,]+$"), F.replace(text, F.lit(","), F.lit("")))
    return F.when(kind == "amount", signed_amount(text).cast("string")).when(kind == "points", points).when(kind == "date", R.card_date(text).cast("string"))


def has_value(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(VALUE)


def _nearest(columns: Column, x: Column) -> Column:
    """Distance to the nearest column, and its number; of equals the first."""
    return F.array_min(F.transform(columns, lambda c, k: F.struct(F.abs(c["x"] - x).alias("d"), k.alias("k"))))


def column_tables(lines: DataFrame) -> DataFrame:
    """ROW-17.  ``doc_id``, ``line_no`` (of the heading), ``label``, ``cell`` of every heading word that has a value below it."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    # a piece ends with a line of values
    piece = F.coalesce(F.sum(F.when(has_value(F.col("text")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    items = F.transform(F.coalesce("items", F.array().cast("array<struct<x:double,text:string>>")), lambda i: F.struct(i["x"].alias("x"), S.clean(i["text"]).alias("text")))
    rows = lines.withColumn("_piece", piece).groupBy("doc_id", "page", "_piece").agg(
        F.array_sort(F.collect_list(F.struct("line_no", items.alias("items")))).alias("l"), F.bool_or(has_value(F.col("text"))).alias("valued")
    ).where("valued AND size(l) >= 2")
    n = F.size("l")
    rows = rows.select("doc_id", "l", F.posexplode(F.slice("l", 1, n - 1)).alias("at", "head"))
    columns = F.transform(F.filter("head.items", lambda i: ~i["text"].rlike(r"^[+\-=]$")), lambda i: F.struct(i["x"].alias("x"), i["text"].alias("label")))
    rows = rows.withColumn("columns", columns).where("size(columns) >= 2")
    near = lambda columns, i: _nearest(columns, i["x"])

    def more(a, line):
        under = F.filter(line["items"], lambda i: near(a["columns"], i)["d"] <= VALUE_ALIGN)
        stray = F.exists(under, lambda i: near(a["columns"], i)["d"] > LABEL_ALIGN)
        wrapped = F.transform(a["columns"], lambda c, k: F.struct(c["x"].alias("x"), F.concat_ws(" ", F.concat(F.array(c["label"]), F.transform(F.filter(under, lambda i: near(a["columns"], i)["k"] == k), lambda i: i["text"]))).alias("label")))
        over = a["over"] | stray
        return F.struct(F.when(over, a["columns"]).otherwise(wrapped).alias("columns"), over.alias("over"))

    labels = F.slice("l", F.col("at") + 2, F.greatest(F.size("l") - F.col("at") - 2, F.lit(0)))
    done = F.aggregate(labels, F.struct(F.col("columns"), F.lit(False).alias("over")), more)
    rows = rows.withColumn("t", done).where("NOT t.over").withColumn("values", F.element_at("l", -1)["items"])
    held = F.filter("values", lambda i: near(F.col("t.columns"), i)["d"] <= VALUE_ALIGN)
    rows = rows.withColumn("held", held)
    cells = F.transform("t.columns", lambda c, k: F.struct(c["label"].alias("label"), F.array_join(F.transform(F.filter("held", lambda i: near(F.col("t.columns"), i)["k"] == k), lambda i: i["text"]), " ").alias("cell")))
    return rows.select("doc_id", F.col("head.line_no").alias("line_no"), F.inline(cells)).where("cell <> ''")


def equation_rows(lines: DataFrame, ahead: int = 3) -> DataFrame:
    """ROW-17.  ``doc_id``, ``line_no``, ``label``, ``cell`` of equations of at least four labels, all of which name amounts; values stand at most ``ahead`` lines below."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_no")
    head = S.clean(F.coalesce(F.get("items", F.lit(0))["text"], "text"))
    rows = lines.withColumns({"_head": head, "_below": F.coalesce(*(F.when(has_value(F.lead("text", k).over(w)), F.lead("text", k).over(w)) for k in range(1, ahead + 1)))}).where(F.col("_head").contains("="))
    parts = F.split("_head", r"\s*[-+=]\s*")
    rows = rows.withColumn("_parts", parts).where(F.size("_parts") >= 4).where(F.forall("_parts", lambda p: F.coalesce(label_field(p).endswith(":amount"), F.lit(False))))
    found = F.regexp_extract_all("_below", F.lit(r"(?i)(?:₹|rs\.?|inr)?\s?-?(?:\d{1,3}(?:,\d{2,3})+|\d+)\.\d{2}(?:\s?(?:cr|dr)\b)?"), F.lit(0))
    rows = rows.withColumn("_found", found).where(F.size("_found") >= F.size("_parts"))
    return rows.select("doc_id", "line_no", F.inline(F.zip_with("_parts", F.slice("_found", 1, F.size("_parts")), lambda p, v: F.struct(p.alias("label"), S.clean(v).alias("cell")))))


def summary_tables(lines: DataFrame) -> DataFrame:
    """ROW-17.  ``doc_id``, ``key``, ``value`` (text of an amount, a date or points), ``source``: a document's fields from its tables, then from its equations; the first of each field counts."""
    both = column_tables(lines).withColumn("rank", F.lit(0)).unionByName(equation_rows(lines).withColumn("rank", F.lit(1)))
    rows = both.withColumn("_field", label_field(F.col("label"))).where("_field IS NOT NULL").withColumns({"key": F.substring_index("_field", ":", 1), "kind": F.substring_index("_field", ":", -1)})
    period = f"^({DATE})\\s*(?:to|-|–)\\s*({DATE})$"
    # a period is two fields
    ends = F.array(*(F.struct(F.lit(k).alias("key"), R.card_date(F.regexp_extract("cell", period, g)).cast("string").alias("value")) for g, k in ((1, "period_from"), (2, "period_to"))))
    fields = F.when(F.col("kind") == "period", ends).otherwise(F.array(F.struct("key", _value(F.col("kind"), F.col("cell")).alias("value"))))
    found = rows.select("doc_id", "rank", "line_no", F.inline(fields)).where("value IS NOT NULL")
    best = found.groupBy("doc_id", "key").agg(F.min_by(F.struct("value", "rank"), F.struct("rank", "line_no")).alias("b"))
    return best.select("doc_id", "key", "b.value", F.when(F.col("b.rank") == 0, "table").otherwise("equation").alias("source"))
