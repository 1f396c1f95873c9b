"""Details of statements: account fields, narrations, kinds of rows, gaps, periods, sections, parties' types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def label_values(lines: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-02.  ``label: value`` lines; of labels that differ in case only the first of a document."""
    pattern = r"^\s*([A-Za-z][A-Za-z .]{1,30}?)\s*:\s*(\S.*?)\s*$"
    rows = lines.select("doc_id", "line_no", F.lower(F.regexp_extract("text", pattern, 1)).alias("label"), F.regexp_extract("text", pattern, 2).alias("value")).where("label <> ''")
    return rows.groupBy("doc_id", "label").agg(F.min_by("value", "line_no").alias("value"))


def split_reference(text: Column) -> tuple[Column, Column]:
    """PRJ-03.  A narration and the reference at its end (last word, with a digit); the reference is null if there is none."""
    last = F.element_at(F.split(F.trim(text), " "), -1)
    ref = F.when(last.rlike(r"\d") & (F.length(F.trim(text)) > F.length(last)), last)
    return F.trim(F.when(ref.isNotNull(), F.left(F.trim(text), F.length(F.trim(text)) - F.length(last))).otherwise(text)), ref


#: Words of narrations and what they tell, most specific first.
KINDS = (
    ("ATM", r"\b(ATM|CASH WDL)\b"), ("UPI", r"\bUPI\b"), ("NEFT", r"\bNEFT\b"), ("RTGS", r"\bRTGS\b"), ("IMPS", r"\bIMPS\b"), ("CHEQUE", r"\b(CHQ|CHEQUE)\b"), ("INTEREST", r"\bINT(EREST)?\b"),
    ("CHARGES", r"\b(CHARGES?|FEE)\b"), ("CASH", r"\bCASH\b"),
)


def kind_of(text: Column, default: str | None = "MISC", kinds=KINDS) -> Column:
    """FLT-19, FLT-18.  The first kind whose words a narration has."""
    out = F.lit(default)
    for name, pattern in reversed(kinds):
        out = F.when(F.upper(text).rlike(pattern), name).otherwise(out)
    return out


#: Words of bills for liquor and for services.
LIQUOR = r"(?i)\b(liquor|beer|whisk(?:e)?y|wine|rum|vodka|gin|brandy|imfl|bar|pint|peg)\b"
SERVICE = r"(?i)\b(work|works|labou?r|service|services|repair|construction|contractor|installation|fitting|cutting|levelling|transport|charges|consultancy)\b"


def entry_type(names: Column, codes: Column | None = None) -> Column:
    """FLT-20.  TCS for liquor, NORMAL for services (words, or a service code that begins with 99), STOCK for goods with a code, else NORMAL.

    ``names`` are the items' descriptions and the supplier's name, ``codes`` the items' codes; without codes all items are goods.
    """
    text = F.array_join(names, " ")
    service = text.rlike(SERVICE) if codes is None else text.rlike(SERVICE) | F.exists(codes, lambda c: c.startswith("99"))
    goods = F.size(names) > 0 if codes is None else F.exists(codes, lambda c: c.isNotNull() & (c != ""))
    return F.when(text.rlike(LIQUOR), "TCS").when(service, "NORMAL").when(goods, "STOCK").otherwise("NORMAL")


def amount_text(text: Column) -> Column:
    """FLT-04.  Whether a token is an amount: two decimals, perhaps Cr or Dr."""
    return text.rlike(r"(?i)^-?₹?\d[\d,]*\.\d{2}( ?(cr|dr)\.?)?$")


def amounts_in(text: Column) -> Column:
    """FLT-05, FLT-06.  Amounts inside a line: dates are masked first, digits glued to letters or signs don't count."""
    masked = F.regexp_replace(text, r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b", " ")
    return F.regexp_extract_all(masked, F.lit(r"(?<![A-Za-z0-9/:.,-])(\d[\d,]*\.\d{2})(?![\d/:A-Za-z-])"), 1)


def data_like(text: Column) -> Column:
    """FLT-07.  A date at the start, or an amount among the words."""
    return text.rlike(r"^\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b") | F.exists(F.split(text, r"\s+"), amount_text)


def header_line(text: Column, names: list[str]) -> Column:
    """FLT-08, FLT-17.  Whether at least three different column names stand in a line."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda w: w.isin(names)))
    return F.size(words) >= 3


def in_period(ledger: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """FLT-24.  Rows within the period (undated ones too), and those outside it."""
    inside = F.col("txn_date").isNull() | F.col("txn_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return ledger.where(inside), ledger.where(~inside)


def output_ids(tran_id: Column, cheque: Column) -> tuple[Column, Column]:
    """PRJ-06.  Transaction id and cheque number for output: short digits are a cheque, the rest an id."""
    value = F.coalesce(cheque, tran_id)
    short = value.rlike(r"^\d{1,6}$")
    return F.when(~short, value), F.when(short, value)


def usual_heading(headings: DataFrame) -> DataFrame:
    """AGG-13.  The most frequent heading of each document; of equals the first seen."""
    counts = headings.groupBy("doc_id", "heading").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("heading", F.struct("n", -F.col("first"))).alias("heading"))


def backfill(rows: DataFrame, column: str) -> DataFrame:
    """AGG-14.  Missing values of a column filled where a document has one value only."""
    w = Window.partitionBy("doc_id")
    only = F.when(F.min(column).over(w) == F.max(column).over(w), F.min(column).over(w))
    return rows.withColumn("filled", F.coalesce(F.col(column), only))


def group_problems(problems: DataFrame, most: int = 5) -> DataFrame:
    """AGG-16.  Problems by kind: count, first row, sum of sizes, and the first five rows; no group is collected."""
    place = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("seq"))
    rows = problems.withColumn("_i", place)
    return rows.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum(F.abs("amount")).cast(MONEY).alias("total"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_i") <= most, F.col("seq")))), lambda x: x.cast("string")), ",").alias("shown"),
    )


def first_few(rows: DataFrame, most: int = 5) -> DataFrame:
    """LIM-02.  The first few rows of each document, and how many more there are."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    numbered = rows.select("doc_id", "seq", F.row_number().over(w).alias("_i"))
    few = numbered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("_i") <= most, F.col("seq")))).alias("s"), F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return few.select("doc_id", F.concat(F.array_join(F.transform("s", lambda x: x.cast("string")), ", "), more).alias("shown"))


def serial_gap(rows: DataFrame) -> DataFrame:
    """AGG-25.  Largest serial number against the number of rows."""
    return rows.groupBy("doc_id").agg(F.max("serial").alias("max_serial"), F.count("*").alias("n_rows"), (F.max("serial") - F.count("*")).alias("missing"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """DIS-05.  The first occurrence of each text in a document."""
    n = F.row_number().over(Window.partitionBy("doc_id", F.md5("text"), "text").orderBy("line_no"))
    return lines.withColumn("_n", n).where("_n = 1").drop("_n")


def merge_copies(rows: DataFrame) -> DataFrame:
    """DIS-04.  Rows of equal balance and movement as one: longest narration, all dates, first cheque, corrected only if all are."""
    return rows.groupBy("doc_id", "balance", "move").agg(
        F.max_by("particulars", F.struct(F.length("particulars"), -F.col("seq"))).alias("particulars"), F.count("*").alias("copies"), F.min("seq").alias("seq"),
        F.min_by("cheque_no", F.when(F.col("cheque_no").isNotNull(), F.col("seq"))).alias("cheque_no"), F.bool_and("ocr_corrected").alias("ocr_corrected"), F.size(F.collect_set("txn_date")).alias("n_dates"),
    )


def chronological(ledger: DataFrame) -> DataFrame:
    """SRT-01, SRT-04.  Place of each row by date (missing ones first), then file order."""
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("txn_date", F.lit("1970-01-01").cast("date")), "seq")
    return ledger.select("doc_id", "seq", F.row_number().over(w).alias("place"))


def chunks(rows: DataFrame, size: int) -> DataFrame:
    """ARR-03.  Rows numbered into chunks of ``size`` within their document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return rows.select("doc_id", "seq", F.floor((n - 1) / size).cast("int").alias("chunk"))


def zip_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """JOIN-12.  The i-th row of the one with the i-th of the other, by document."""
    number = lambda d, c: d.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("i"), F.col("value").alias(c))
    return number(left, "left_value").join(number(right, "right_value"), ["doc_id", "i"])


def nth_page(pages: DataFrame, n: int) -> DataFrame:
    """JOIN-11.  The n-th page of each product."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("product").orderBy("page"))).where(F.col("_n") == n).drop("_n")


def field_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """JOIN-17, JSN-02.  Fields (``doc_id``, ``path``, ``value``) that two readers read differently; case and spaces don't count."""
    normal = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))
    a, b = first.select("doc_id", "path", F.col("value").alias("a")), second.select("doc_id", "path", F.col("value").alias("b"))
    return a.join(b, ["doc_id", "path"], "full").where(normal(F.col("a")) != normal(F.col("b")))


def mapping(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """CHK-13 (mapping).  Item names with overrides; blank overrides don't count."""
    o = overrides.select("item", F.nullif(F.trim("ledger"), F.lit("")).alias("_o"))
    return rows.join(o, "item", "left").withColumn("ledger", F.coalesce("_o", "ledger")).drop("_o")


def attach_lines(lines: DataFrame, dated) -> DataFrame:
    """ROW-04.  For each undated line the dated line, above or below, that is nearer (above of equals)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    own = F.when(dated(F.col("text")), F.col("line_no"))
    rows = lines.withColumns({"above": F.last(own, ignorenulls=True).over(w), "below": F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    near = F.when(F.col("below").isNull() | (F.col("line_no") - F.col("above") <= F.col("below") - F.col("line_no")), F.col("above")).otherwise(F.col("below"))
    return rows.select("doc_id", "line_no", near.alias("row_line"))


def limited_continuation(lines: DataFrame, dated, most: int = 2) -> DataFrame:
    """ROW-16.  Lines that continue a row: at most ``most`` after its first line, on its page."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumns({"start": F.last(F.when(dated(F.col("text")), F.col("line_no")), ignorenulls=True).over(w), "start_page": F.last(F.when(dated(F.col("text")), F.col("page")), ignorenulls=True).over(w)})
    return rows.where((F.col("line_no") > F.col("start")) & (F.col("line_no") - F.col("start") <= most) & (F.col("page") == F.col("start_page"))).select("doc_id", "line_no", "start")
