"""Operators on ordered account ledgers.

A ledger has ``doc_id``, ``seq`` (file order, unique in a document), ``txn_date``,
``particulars``, ``withdrawal``, ``deposit``, ``balance`` (DECIMAL(18,2)), and optionally
``page``, ``cheque_no``, ``is_reversal``, ``ocr_corrected``.  Every window is partitioned by
the document, and one ``repartition`` by document serves a chain of operators.  A
document's rows fit in a task (a statement has thousands); the number of documents is
what grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Differences above this break a balance chain; at most this is no movement.
BREAK, SAME, FAR = "0.05", "0.01", "1.00"

def _in_order():
    return Window.partitionBy("doc_id").orderBy("seq")


def _by_ord():
    return Window.partitionBy("doc_id").orderBy("ord")



def _money(x: Column | str) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast(MONEY)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast(MONEY)


def chronology(ledger: DataFrame) -> DataFrame:
    """WIN-01.  ``doc_id``, ``forward``, ``backward``, ``chronological``: steps between neighbouring dated rows; ties and under two dates count as forward."""
    before = F.last("txn_date", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    steps = ledger.select("doc_id", "txn_date", before.alias("before")).groupBy("doc_id").agg(
        F.count_if(F.col("txn_date") > F.col("before")).alias("forward"), F.count_if(F.col("txn_date") < F.col("before")).alias("backward")
    )
    return steps.withColumn("chronological", F.col("forward") >= F.col("backward"))


def statement_order(ledger: DataFrame) -> DataFrame:
    """WIN-02.  The ledger with ``ord``, which rises with time: file order, or its reverse where the statement is newest first.

    One window, so no second pass over the ledger and no join.
    """
    whole = Window.partitionBy("doc_id")
    last_dated = F.last("txn_date", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("txn_date") > F.col("_before"), 1).when(F.col("txn_date") < F.col("_before"), -1).otherwise(0)
    return (
        ledger.withColumn("_before", last_dated).withColumn("_net", F.sum(step).over(whole))
        .withColumn("ord", F.when(F.col("_net") >= 0, F.col("seq")).otherwise(-F.col("seq"))).drop("_before", "_net")
    )


def balance_breaks(ledger: DataFrame, tolerance: str = BREAK) -> DataFrame:
    """WIN-03.  Rows whose balance isn't the previous row's plus its movement; a null on either side skips the row."""
    expected = F.lag("balance").over(_by_ord()) - _zero("withdrawal") + _zero("deposit")
    rows = statement_order(ledger).withColumn("expected", _money(expected))
    return rows.where(F.abs(F.col("expected") - F.col("balance")) > F.lit(tolerance).cast(MONEY)).select(
        "doc_id", "seq", "expected", "balance", _money(F.col("balance") - F.col("expected")).alias("difference")
    )


def rebuild_amounts(ledger: DataFrame) -> DataFrame:
    """WIN-04, WIN-05.  Amounts and sides corrected from the balance movement, with the amounts that stood there.

    A movement up to 0.01 clears both sides.  Printed amounts stay where they differ
    from the movement by over 1.00 either way and the month changed or a date is
    missing: then rows are missing in between.  Balances are read and amounts are
    written, so nothing depends on an earlier correction.
    """
    return rebuilt(statement_order(ledger)).select("doc_id", "seq", "withdrawal", "deposit", "new_withdrawal", "new_deposit", "changed")


def rebuilt(ordered: DataFrame) -> DataFrame:
    """The columns that ``rebuild_amounts`` makes, for rows that have their ``ord``."""
    move = F.col("balance") - F.lag("balance").over(_by_ord())
    before = F.lag("txn_date").over(_by_ord())
    rows = ordered.withColumns({"move": _money(move), "before": before})
    size = F.abs("move")
    printed = F.col("withdrawal").isNotNull() | F.col("deposit").isNotNull()
    # a null side never is far from the movement
    off = F.greatest(_zero("withdrawal"), _zero("deposit"))
    far = printed & (F.abs(off - size) > F.lit(FAR).cast(MONEY))
    gap = F.col("txn_date").isNull() | F.col("before").isNull() | (F.trunc("txn_date", "month") != F.trunc("before", "month"))
    keep = F.col("move").isNull() | (far & gap)
    still = size <= F.lit(SAME).cast(MONEY)
    w = F.when(keep, F.col("withdrawal")).when(still, F.lit(None)).when(F.col("move") < 0, size)
    d = F.when(keep, F.col("deposit")).when(still, F.lit(None)).when(F.col("move") > 0, size)
    fixed = rows.select("*", _money(w).alias("new_withdrawal"), _money(d).alias("new_deposit"))
    changed = (_zero("withdrawal") != _zero("new_withdrawal")) | (_zero("deposit") != _zero("new_deposit"))
    return fixed.withColumn("changed", changed)


def classify_by_delta(ledger: DataFrame, tolerance: str = "0.02", newest_first: bool = False) -> DataFrame:
    """WIN-06, WIN-07.  ``side`` of each row by what the balance did from its neighbour: DR, CR, or null where it can't tell."""
    near = (F.lead if newest_first else F.lag)("balance").over(_in_order())
    amount = F.coalesce("withdrawal", "deposit")
    rows = ledger.withColumn("move", _money(F.col("balance") - near))
    side = F.when(F.abs(F.col("move") - amount) <= F.lit(tolerance).cast(MONEY), "CR").when(F.abs(F.col("move") + amount) <= F.lit(tolerance).cast(MONEY), "DR")
    return rows.select("doc_id", "seq", "move", side.alias("side"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """WIN-17, WIN-09.  Printed balance, or where it is missing the last printed one plus the movements since."""
    island = F.count("balance").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    move = _zero("deposit") - _zero("withdrawal")
    rows = ledger.withColumns({"island": island, "move": move})
    inside = Window.partitionBy("doc_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    value = F.first("balance").over(inside) + F.sum(F.when(F.col("balance").isNull(), F.col("move")).otherwise(0)).over(inside)
    return rows.select("doc_id", "seq", F.col("balance").isNull().alias("filled"), _money(value).alias("running"))


def closing_balance(ledger: DataFrame) -> DataFrame:
    """WIN-18, WIN-24, AGG-01, AGG-02.  Totals, opening back-computed from the first row in time, last printed balance in time."""
    rows = statement_order(ledger)
    opening = F.min_by(F.col("balance") + _zero("withdrawal") - _zero("deposit"), "ord")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), _money(F.sum(_zero("withdrawal"))).alias("debits"), _money(F.sum(_zero("deposit"))).alias("credits"),
        _money(opening).alias("opening"), _money(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("ord")))).alias("closing"),
    )


def closing_check(ledger: DataFrame, tolerance: str = BREAK) -> DataFrame:
    """CHK-02.  Opening + credits - debits against the closing balance, with the chain's breaks: one row a document."""
    rows = statement_order(ledger)
    expected = F.lag("balance").over(_by_ord()) - _zero("withdrawal") + _zero("deposit")
    marked = rows.withColumn("broken", F.abs(expected - F.col("balance")) > F.lit(tolerance).cast(MONEY))
    sums = marked.groupBy("doc_id").agg(
        F.count_if("broken").alias("breaks"), _money(F.sum(_zero("withdrawal"))).alias("debits"), _money(F.sum(_zero("deposit"))).alias("credits"),
        _money(F.min_by(F.col("balance") + _zero("withdrawal") - _zero("deposit"), "ord")).alias("opening"),
        _money(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("ord")))).alias("closing"),
    )
    difference = _money(F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing"))
    return sums.withColumn("difference", difference).withColumn(
        "status", F.when(F.col("difference").isNull(), "UNVERIFIED").when((F.abs("difference") > F.lit(tolerance).cast(MONEY)) | (F.col("breaks") > 0), "FAIL").otherwise("PASS")
    )


def dedupe_key() -> list[Column]:
    """What makes two rows the same: null and 0 count alike, case and spacing don't count."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("particulars", F.lit("")), r"(?U)\s+", " ")))
    return [F.col("txn_date"), text, _zero("withdrawal"), _zero("deposit"), _zero("balance")]


def mark_duplicates(ledger: DataFrame) -> DataFrame:
    """DIS-02.  ``duplicate_of``: the first row with the same key, for all rows but the first."""
    w = Window.partitionBy("doc_id", *dedupe_key())
    first = F.min("seq").over(w)
    return ledger.withColumn("duplicate_of", F.when(F.col("seq") != first, first))


def remove_duplicates(ledger: DataFrame) -> DataFrame:
    """DIS-01.  The first row of each key, in file order."""
    return mark_duplicates(ledger).where("duplicate_of IS NULL").drop("duplicate_of")


def insane_amounts(ledger: DataFrame, digits: int = 11, times: int = 100) -> DataFrame:
    """FLT-11.  Amounts of over ``digits`` integer digits, and movements over ``times`` the document's largest sane balance."""
    limit = F.lit(10**digits).cast("decimal(20,2)")
    largest = F.max(F.when(F.abs("balance") < limit, F.abs("balance"))).over(Window.partitionBy("doc_id"))
    cells = ledger.withColumn("largest", largest).select(
        "doc_id", "seq", "largest", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("amount")) for c in ("withdrawal", "deposit", "balance"))))
    )
    bad = (F.abs("amount") >= limit) | ((F.col("field") != "balance") & (F.col("largest") > 0) & (F.abs("amount") > F.col("largest") * times))
    return cells.where(bad).select("doc_id", "seq", "field", "amount")


def suspicious_references(ledger: DataFrame, least: int = 3) -> DataFrame:
    """AGG-12.  Cheque numbers whose length isn't the document's usual one (most frequent, first seen of equals; ``least`` numbers at least)."""
    refs = ledger.where("cheque_no IS NOT NULL").select("doc_id", "seq", "cheque_no", F.length("cheque_no").alias("len"))
    lengths = refs.groupBy("doc_id", "len").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    usual = lengths.groupBy("doc_id").agg(F.sum("n").alias("all"), F.max_by("len", F.struct("n", -F.col("first"))).alias("usual")).where(F.col("all") >= least)
    return refs.join(usual, "doc_id").where("len <> usual").select("doc_id", "seq", "cheque_no", "usual")


def monthly(ledger: DataFrame) -> DataFrame:
    """AGG-07, WIN-14, CHK-17.  Totals by month, opening from the month before, and whether they meet the month's last balance."""
    dated = ledger.where("txn_date IS NOT NULL").withColumn("month", F.trunc("txn_date", "month"))
    sums = dated.groupBy("doc_id", "month").agg(
        F.count("*").alias("n_rows"), F.count("withdrawal").alias("n_debits"), F.count("deposit").alias("n_credits"),
        _money(F.sum(_zero("withdrawal"))).alias("debits"), _money(F.sum(_zero("deposit"))).alias("credits"),
        _money(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("seq")))).alias("closing"),
    )
    opening = F.lag("closing").over(Window.partitionBy("doc_id").orderBy("month"))
    rows = sums.withColumn("opening", opening)
    gap = F.abs(F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing"))
    return rows.withColumn("check_", F.when(gap.isNull(), "UNVERIFIED").when(gap <= F.lit(BREAK).cast(MONEY), "MATCH").otherwise("MISMATCH"))


def page_totals(ledger: DataFrame) -> DataFrame:
    """AGG-06.  Sums by page."""
    return ledger.groupBy("doc_id", "page").agg(F.count("*").alias("n_rows"), _money(F.sum(_zero("withdrawal"))).alias("debits"), _money(F.sum(_zero("deposit"))).alias("credits"))


def _both() -> Column:
    return (_zero("withdrawal") != 0) & (_zero("deposit") != 0)


def _negative() -> Column:
    return ~F.coalesce("is_reversal", F.lit(False)) & ((_zero("withdrawal") < 0) | (_zero("deposit") < 0))


def both_sides(ledger: DataFrame) -> DataFrame:
    """CHK-03.  Rows with amounts on both sides, or a negative amount that is no reversal."""
    return ledger.where(_both() | _negative()).select("doc_id", "seq", F.when(_both(), "both_sides").otherwise("negative").alias("kind"))


def _faults() -> list:
    """What costs a row confidence: condition (on a row with ``broken``), how much, name."""
    return [
        (F.col("txn_date").isNull(), 40, "no_date"),
        (F.col("withdrawal").isNull() & F.col("deposit").isNull(), 40, "no_amount"),
        (F.col("broken"), 30, "chain"),
        (F.coalesce("ocr_corrected", F.lit(False)), 15, "ocr"),
    ]


def _score() -> Column:
    return F.greatest(F.lit(0), F.lit(100) - sum((F.when(c, n).otherwise(0) for c, n, _ in _faults()), F.lit(0)))


def _broken() -> Column:
    expected = F.lag("balance").over(_by_ord()) - _zero("withdrawal") + _zero("deposit")
    return F.coalesce(F.abs(expected - F.col("balance")) > F.lit(BREAK).cast(MONEY), F.lit(False))


def confidence(ledger: DataFrame, review_below: int = 80) -> DataFrame:
    """CHK-04.  100, less 40 without a date, 40 without an amount, 30 for a broken chain, 15 for a corrected reading; with reasons."""
    rows = statement_order(ledger).withColumn("broken", _broken())
    reasons = F.array_join(F.array_compact(F.array(*(F.when(c, name) for c, _, name in _faults()))), ",")
    return rows.select("doc_id", "seq", _score().cast("int").alias("score"), reasons.alias("reasons"), (_score() < review_below).alias("review"))


def counts_of_faults(ledger: DataFrame, review_below: int = 80) -> DataFrame:
    """CHK-01.  One row a document, in one pass over its rows: chain breaks, totals, opening, closing, corrections, duplicates, side faults and weak rows."""
    rows = rebuilt(statement_order(ledger).withColumn("broken", _broken()))
    sums = rows.groupBy("doc_id").agg(
        F.count_if("broken").alias("breaks"), _money(F.sum(_zero("withdrawal"))).alias("debits"), _money(F.sum(_zero("deposit"))).alias("credits"),
        _money(F.min_by(F.col("balance") + _zero("withdrawal") - _zero("deposit"), "ord")).alias("opening"),
        _money(F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("ord")))).alias("closing"),
        F.count_if("changed").alias("corrections"), (F.count("*") - F.size(F.collect_set(F.struct(*dedupe_key())))).alias("duplicates"),
        F.count_if(_both() | _negative()).alias("side_faults"), F.count_if(_score() < review_below).alias("weak_rows"), F.count("*").alias("n_rows"),
    )
    return sums.withColumn("difference", _money(F.col("opening") + F.col("credits") - F.col("debits") - F.col("closing")))


def fill_dates(ledger: DataFrame) -> DataFrame:
    """WIN-20.  Missing dates, where the dated rows before and after agree."""
    before = F.last("txn_date", ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("txn_date", ignorenulls=True).over(_in_order().rowsBetween(1, Window.unboundedFollowing))
    filled = F.coalesce("txn_date", F.when(before == after, before))
    return ledger.select("doc_id", "seq", filled.alias("txn_date"), (F.col("txn_date").isNull() & filled.isNotNull()).alias("filled"))


def opening_row(ledger: DataFrame) -> DataFrame:
    """WIN-25.  A row before each document's first in time, a day earlier, with the balance that the first row starts from."""
    rows = statement_order(ledger)
    return rows.groupBy("doc_id").agg(
        F.date_sub(F.min_by("txn_date", "ord"), 1).alias("txn_date"), F.min("seq").alias("first_seq"),
        _money(F.min_by(F.col("balance") + _zero("withdrawal") - _zero("deposit"), "ord")).alias("balance"),
    )


def page_order(ledger: DataFrame) -> DataFrame:
    """WIN-21, AGG-17.  Rank of each page by the upper median of its dates."""
    dates = ledger.where("txn_date IS NOT NULL").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("txn_date")).alias("d"))
    medians = dates.select("doc_id", "page", F.element_at("d", F.floor(F.size("d") / 2).cast("int") + 1).alias("median"))
    return medians.withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("median", "page")))


def statement_sheet(ledger: DataFrame) -> DataFrame:
    """SNK-01, SNK-02, SNK-10.  A statement in print order: opening, rows, grand total."""
    rows = statement_order(ledger).select(
        "doc_id", F.lit(1).alias("section"), F.col("ord").cast("long").alias("place"), "txn_date", "particulars",
        _money(F.col("withdrawal")).alias("withdrawal"), _money(F.col("deposit")).alias("deposit"), _money(F.col("balance")).alias("balance"),
    )
    none = F.lit(None)
    opening = opening_row(ledger).select("doc_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), "txn_date", F.lit("OPENING BALANCE").alias("particulars"), none.cast(MONEY).alias("withdrawal"), none.cast(MONEY).alias("deposit"), "balance")
    total = closing_balance(ledger).select("doc_id", F.lit(2).alias("section"), F.lit(0).cast("long").alias("place"), none.cast("date").alias("txn_date"), F.lit("GRAND TOTAL").alias("particulars"), F.col("debits").alias("withdrawal"), F.col("credits").alias("deposit"), F.col("closing").alias("balance"))
    return opening.unionByName(rows).unionByName(total)
