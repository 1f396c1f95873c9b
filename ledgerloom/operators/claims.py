"""Draft rows from scanned lines by claiming spans in order: each step looks only at what earlier ones have left.

A claimed piece is replaced by a mark, so nothing is read twice and what is left in the end is the narration.
Every row says what was claimed, and by which step, in ``claims``; a line without a date is a row without one, and its
amounts are claimed all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S

MONEY = "decimal(18,2)"
#: Marks of claimed pieces: dates, the side, amounts, the row's id, others.
DATE, SIDE, FIGURE, ID, OTHER = "\x01", "\x02", "\x03", "\x04", "\x05"
#: What the parts of a line look like.  A border read as a sign may stick to an amount.
AMOUNT = r"(\d[\d,]*\.\d{2})[Il1|]?"
LETTER_ID, DIGIT_ID = r"(?<=[A-Za-z0-9/.-] )([A-Z]{1,2}\d{6,10})\b", r"(?<![\d.])\b(\d{7,10})\b"


def take(rows: DataFrame, name: str, before: str, piece: str, after: str, mark: str, when: Column | None = None) -> DataFrame:
    """Claim the first ``piece`` between ``before`` and ``after`` of what is left under a name; null if there is none, or ``when`` doesn't hold."""
    pattern = f"({before}){piece}({after})"
    asked = F.lit(True) if when is None else when
    found = F.when(asked, F.nullif(F.regexp_extract("left", pattern, 2), F.lit("")))
    rows = rows.withColumn(name, found)
    # only the first match is replaced: what stands before it is part of the pattern
    first = F.regexp_replace("left", f"^(?s)(.*?){pattern}", f"$1$2{mark}$4")
    return rows.withColumn("left", F.when(F.col(name).isNotNull(), first).otherwise(F.col("left")))


def claimed_spans(lines: DataFrame) -> DataFrame:
    """ROW-25.  ``date``, ``value_date``, ``type``, ``tran_id``, ``by_digits`` (the id's letter was read as a digit), ``cheque_no``, ``amount``, ``balance``, ``side``, ``particulars`` and ``claims`` of every line (``doc_id``, ``line_no``, ``text``).

    In order: the date and value date at the start, the side at the end, all amounts (the last of several is the balance; a
    single one is the amount), an id with text before it, the short word before the id, and a number between
    id and amounts.
    """
    rows = lines.select("doc_id", "line_no", F.regexp_replace(S.rejoin_dates(S.clean(F.coalesce("text", F.lit("")))), r"\.$", "").alias("left"))
    day = r"(\d{2}-\d{2}-\d{4})"
    rows = take(rows, "_date", "^", day, "", DATE)
    rows = take(rows, "_value", f"^{DATE} ", day, "", DATE)
    rows = take(rows, "_side", r"\s", "((?i:CR|DR|GR))", "$", SIDE)
    rows = rows.withColumn("_amounts", F.regexp_extract_all("left", F.lit(AMOUNT), F.lit(1))).withColumn("left", F.regexp_replace("left", AMOUNT, FIGURE))
    rows = take(rows, "_letter", "", LETTER_ID, "", ID)
    rows = take(rows, "_digits", "", DIGIT_ID, "", ID, F.col("_letter").isNull())
    rows = take(rows, "type", r"(?<![^\s])", r"([A-Za-z]{2,5})", rf"\s*{ID}", OTHER)
    rows = take(rows, "cheque_no", f"{ID}[^{FIGURE}]*?\\b", r"(\d{5,10})", r"\b", OTHER)
    money = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast(MONEY)
    n = F.size("_amounts")
    at = lambda k: money(F.get("_amounts", k))
    claim = lambda what, value: F.when(F.col(value).isNotNull(), F.concat(F.lit(f"{what}:"), F.col(value)))
    claims = F.array_compact(F.array(claim("date", "_date"), claim("value date", "_value"), claim("side", "_side"), F.when(n > 0, F.concat(F.lit("amounts:"), F.array_join("_amounts", "+"))), claim("id", "_letter"), claim("id by digits", "_digits"), claim("type", "type"), claim("cheque", "cheque_no")))
    left = S.clean(F.regexp_replace("left", f"[{DATE}-{OTHER}]", " "))
    return rows.select(
        "doc_id", "line_no", S.parse_date(F.col("_date")).alias("date"), S.parse_date(F.coalesce("_value", "_date")).alias("value_date"), F.upper("type").alias("type"), F.coalesce("_letter", "_digits").alias("tran_id"),
        F.col("_digits").isNotNull().alias("by_digits"), "cheque_no", F.when(n >= 2, at(n - 2)).when(n == 1, at(F.lit(0))).alias("amount"), F.when(n >= 2, at(n - 1)).alias("balance"),
        F.when(F.col("_side").isNotNull(), F.when(F.upper("_side").startswith("D"), "DR").otherwise("CR")).alias("side"), F.coalesce(F.nullif(left, F.lit("")), F.lit("TRANSACTION")).alias("particulars"), F.array_join(claims, "; ").alias("claims"),
    )
