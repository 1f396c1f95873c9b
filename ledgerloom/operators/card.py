"""Operators on card statements: ``doc_id``, ``seq``, ``page``, ``txn_date``, ``type`` (debit or credit), ``amount``, ``description``, ``ref_no``, ``card_last4``, ``balance``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def _signed():
    return F.when(F.col("type") == "credit", -F.col("amount")).otherwise(F.col("amount"))


def _order():
    return Window.partitionBy("doc_id").orderBy("seq")


def remove_duplicates(card: DataFrame) -> DataFrame:
    """DIS-03.  With a reference: the first row of each reference and key.  Without: a row goes if it equals the row kept before it and stands on another page.

    Among the rows that remain of the first step, a run of equal rows without
    references keeps those on its first row's page.
    """
    key = ["txn_date", "description", "type", "amount"]
    first = F.row_number().over(Window.partitionBy("doc_id", "ref_no", *key).orderBy("seq"))
    step1 = card.withColumn("_n", first).where("ref_no IS NULL OR _n = 1").drop("_n")
    same = F.col("ref_no").isNull() & F.lag("ref_no").over(_order()).isNull()
    for c in key:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(_order()))
    islands = step1.withColumn("_new", F.when(same & (F.lag("seq").over(_order()).isNotNull()), 0).otherwise(1))
    islands = islands.withColumn("_run", F.sum("_new").over(_order()))
    page = F.first("page").over(Window.partitionBy("doc_id", "_run").orderBy("seq"))
    return islands.withColumn("_page", page).where("ref_no IS NOT NULL OR page <=> _page").drop("_new", "_run", "_page")


def check_balance(card: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """WIN-08.  ``verdict`` of each row against the printed balance before it: ok, flip (the other type fits), break; null unless every row has a balance.

    Each row starts from what was printed, so one wrong row breaks one link only.
    """
    whole = Window.partitionBy("doc_id")
    before = F.coalesce(F.lag("balance").over(_order()), F.col("balance") - _signed())
    t = F.lit(tolerance).cast(MONEY)
    verdict = F.when(F.abs(before + _signed() - F.col("balance")) <= t, "ok").when(F.abs(before - _signed() - F.col("balance")) <= t, "flip").otherwise("break")
    all_ = F.count("*").over(whole) == F.count("balance").over(whole)
    return card.select("doc_id", "seq", "type", "amount", "balance", F.when(all_, verdict).alias("verdict"))


def running_balance(card: DataFrame) -> DataFrame:
    """WIN-09.  Computed balance: the last printed one plus what was spent since; from 0 where none is printed."""
    island = F.count("balance").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = card.withColumns({"_i": island, "_s": _signed()})
    inside = Window.partitionBy("doc_id", "_i").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.first("balance").over(inside), F.lit(0)) + F.sum(F.when(F.col("balance").isNull(), F.col("_s")).otherwise(0)).over(inside)
    return rows.select("doc_id", "seq", value.cast(MONEY).alias("running"))


def totals(card: DataFrame) -> DataFrame:
    """AGG-04, PRJ-05."""
    debit, credit = F.when(F.col("type") == "debit", F.col("amount")), F.when(F.col("type") == "credit", F.col("amount"))
    return card.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(debit), F.lit(0)).cast(MONEY).alias("debits"), F.coalesce(F.sum(credit), F.lit(0)).cast(MONEY).alias("credits"))


def by_card(card: DataFrame) -> DataFrame:
    """AGG-05.  Totals by card, for statements with two cards at least."""
    debit, credit = F.when(F.col("type") == "debit", F.col("amount")), F.when(F.col("type") == "credit", F.col("amount"))
    groups = card.groupBy("doc_id", "card_last4").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(debit), F.lit(0)).cast(MONEY).alias("debits"), F.coalesce(F.sum(credit), F.lit(0)).cast(MONEY).alias("credits"))
    return groups.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where("_n >= 2").drop("_n")


def reconcile(card: DataFrame, summary: DataFrame, tolerance: str = "1.00") -> DataFrame:
    """CHK-09.  Totals against a printed summary (``previous``, ``purchases``, ``payments``, ``due``): three checks and OK, MISMATCH or UNVERIFIED."""
    t = F.lit(tolerance).cast(MONEY)
    joined = totals(card).join(summary, "doc_id", "left")

    def near(a, b):
        return F.abs(a - b) <= t

    checks = {
        "debits_ok": near(F.col("debits"), F.col("purchases")), "credits_ok": near(F.col("credits"), F.col("payments")),
        "due_ok": near(F.col("previous") + F.col("debits") - F.col("credits"), F.col("due")),
    }
    rows = joined.select("doc_id", "debits", "credits", *(c.alias(n) for n, c in checks.items()))
    known = F.array_compact(F.array(*map(F.col, checks)))
    status = F.when(F.size(known) == 0, "UNVERIFIED").when(F.exists(known, lambda x: ~x), "MISMATCH").otherwise("OK")
    return rows.withColumn("status", status)


def summary_rows(card: DataFrame) -> DataFrame:
    """SNK-08, SNK-04.  Totals of each statement as label and value rows."""
    values = {"Total debits": F.col("debits"), "Total credits": F.col("credits"), "Net": (F.col("debits") - F.col("credits")).cast(MONEY)}
    return totals(card).select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in values.items()))))
