"""Geometry and continuity of pages and rows; trailing parts of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def trailing_amount(text: Column) -> tuple[Column, Column, Column]:
    """STR-21.  What stands before the amount at a line's end, the amount, and whether it is a credit."""
    p = r"(?i)^(.*?)\s*([-+]?)\s*((?:\d{1,3}(?:,\d{2,3})+|\d+)\.\d{2})\s*(cr|dr|c|d)?\.?\s*$"
    amount = F.nullif(F.replace(F.regexp_extract(text, p, 3), F.lit(","), F.lit("")), F.lit("")).try_cast(MONEY)
    mark = F.upper(F.regexp_extract(text, p, 4))
    return F.when(amount.isNotNull(), F.regexp_extract(text, p, 1)).otherwise(text), amount, amount.isNotNull() & (mark.startswith("C") | (F.regexp_extract(text, p, 2) == "-"))


def foreign_amount(text: Column) -> tuple[Column, Column]:
    """STR-20.  Currency code and amount of a foreign purchase."""
    p = r"\b(USD|EUR|GBP|AED|SGD|JPY|AUD|CAD|CHF)\s*([\d,]+(?:\.\d{1,2})?)"
    return F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.nullif(F.replace(F.regexp_extract(text, p, 2), F.lit(","), F.lit("")), F.lit("")).try_cast(MONEY)


def leading_date(text: Column) -> Column:
    """DAT-08.  The date text at a line's start, behind a serial number perhaps."""
    return F.nullif(F.regexp_extract(text, r"^\s*(?:\d{1,4}[.)]?\s+)?(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[- ][A-Za-z]{3}[- ,']+\d{2,4}|\d{4}-\d{2}-\d{2})\b", 1), F.lit(""))


def one_unreadable(rows: DataFrame) -> DataFrame:
    """WIN-15.  The one missing value of withdrawal, deposit or balance in a row, from the balance before it; rows with two missing stay.

    Balances that were derived don't serve later rows; those start from the next printed one.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.lag("balance").over(w)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    move = F.col("balance") - before
    none = F.col("withdrawal").isNull() & F.col("deposit").isNull()
    return rows.select(
        "doc_id", "seq",
        F.when(none & (move < 0), -move).otherwise(F.col("withdrawal")).cast(MONEY).alias("withdrawal"), F.when(none & (move > 0), move).otherwise(F.col("deposit")).cast(MONEY).alias("deposit"),
        F.when(F.col("balance").isNull() & ~none, before - zero("withdrawal") + zero("deposit")).otherwise(F.col("balance")).cast(MONEY).alias("balance"),
    )


def looking_ahead(rows: DataFrame, steps: int = 3) -> DataFrame:
    """WIN-19, WIN-23.  How many of the next rows carry a date, and the first of those dates."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    ahead = [F.lead("txn_date", k).over(w) for k in range(1, steps + 1)]
    return rows.select("doc_id", "seq", sum((a.isNotNull().cast("int") for a in ahead), F.lit(0)).alias("dated_ahead"), F.coalesce(*ahead).alias("next_date"))


def page_continuity(pages: DataFrame, unconfirmed: float = 0.4) -> DataFrame:
    """CHK-16.  Whether a page's brought-forward figure is the one carried forward before it, and whether too many of its rows are unconfirmed."""
    before = F.lag("carried").over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page", (F.abs(F.col("brought") - before) <= F.lit("0.05").cast(MONEY)).alias("continues"), (F.col("n_unconfirmed") > unconfirmed * F.col("n_rows")).alias("drop"))


def missing_pages(pages: DataFrame) -> DataFrame:
    """SET-04.  Page numbers between a document's first and last that it doesn't have."""
    have = pages.groupBy("doc_id").agg(F.collect_set("page").alias("have"), F.min("page").alias("a"), F.max("page").alias("b"))
    return have.select("doc_id", F.array_join(F.transform(F.array_sort(F.array_except(F.sequence("a", "b"), "have")), lambda x: x.cast("string")), ",").alias("missing"))


def unverifiable(ledger: DataFrame) -> DataFrame:
    """CHK-15.  Documents that nothing can be checked on, and how many rows have no date."""
    s = ledger.groupBy("doc_id").agg(F.count("balance").alias("balances"), F.count_if(F.col("txn_date").isNull()).alias("undated"))
    return s.select("doc_id", (F.col("balances") < 2).alias("unverifiable"), "undated")


def month_segments(ledger: DataFrame) -> DataFrame:
    """ROW-11.  Segments of rows in file order, a new one where the month changes; undated rows stay in the open segment."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    month = F.last(F.trunc("txn_date", "month"), ignorenulls=True).over(w)
    rows = ledger.withColumn("_m", month).withColumn("_new", F.when(F.col("_m").eqNullSafe(F.lag("_m").over(w)), 0).otherwise(1))
    return rows.withColumn("segment", F.sum("_new").over(w)).groupBy("doc_id", "segment").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("n_rows"))


def gap_rows(tokens: DataFrame, gap: float) -> DataFrame:
    """ROW-13, ROW-09.  Blocks of tokens split at gaps in ``y``, with their extent."""
    w = Window.partitionBy("doc_id").orderBy("y", "token_id")
    rows = tokens.withColumn("_n", F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)).withColumn("block", F.sum("_n").over(w))
    return rows.groupBy("doc_id", "block").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("n_tokens"))


def slope(tokens: DataFrame, low: float = -0.15, high: float = 0.15, step: float = 0.0125) -> DataFrame:
    """ROW-19.  Of a grid of slopes the one that makes neighbouring tokens' heights differ least; of equals the first."""
    grid = [round(low + k * step, 6) for k in range(round((high - low) / step) + 1)]
    rows = tokens.select("doc_id", "token_id", "x", "y", F.explode(F.array(*map(F.lit, grid))).alias("slope")).withColumn("h", F.col("y") - F.col("slope") * F.col("x"))
    w = Window.partitionBy("doc_id", "slope").orderBy("h", "token_id")
    # heights are counted in whole units so that sums are exact
    near = F.floor(F.col("h")) == F.floor(F.lag("h").over(w))
    score = rows.withColumn("near", near).groupBy("doc_id", "slope").agg(F.count_if("near").alias("n"))
    return score.groupBy("doc_id").agg(F.max_by("slope", F.struct("n", -F.col("slope"))).alias("slope"), F.max("n").alias("n"))


def column_sections(lines: DataFrame, header) -> DataFrame:
    """ROW-10, ROW-12.  Values of each column of column-major text: lines below a header line, in order."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("head", F.last(F.when(header(F.col("text")), F.col("line_no")), ignorenulls=True).over(w)).where("head IS NOT NULL AND head < line_no")
    return rows.groupBy("doc_id", "head").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
