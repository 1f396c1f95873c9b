"""Statement-level verdicts: printed figures, reasons, review; document classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L

MONEY = L.MONEY


def printed_totals(lines: DataFrame) -> DataFrame:
    """AGG-23.  The last amount that each label of a document's lines stands before: debits, credits, closing."""
    label = F.lower(F.regexp_extract("text", r"(?i)\b(total debits?|total credits?|closing balance)\b[: ]*", 1))
    amount = F.regexp_replace(F.regexp_extract("text", r"(?i)\b(?:total debits?|total credits?|closing balance)\b[: ]*([\d,]+\.\d{2})", 1), ",", "")
    found = lines.select("doc_id", "line_no", F.regexp_replace(label, "s$", "").alias("label"), F.nullif(amount, F.lit("")).try_cast(MONEY).alias("amount")).where("amount IS NOT NULL")
    pick = lambda name: F.max_by("amount", F.when(F.col("label") == name, F.col("line_no")))
    return found.groupBy("doc_id").agg(pick("total debit").alias("printed_debits"), pick("total credit").alias("printed_credits"), pick("closing balance").alias("printed_closing"))


def against_printed(ledger: DataFrame, printed: DataFrame) -> DataFrame:
    """AGG-03, CHK-06.  Computed and printed totals, the printed ones taking precedence, and which differ."""
    rows = L.closing_balance(ledger).join(printed, "doc_id", "left")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > F.lit(L.BREAK).cast(MONEY)
    return rows.select(
        "doc_id", F.coalesce("printed_debits", "debits").alias("debits"), F.coalesce("printed_credits", "credits").alias("credits"), F.coalesce("printed_closing", "closing").alias("closing"),
        F.when(F.col("printed_closing").isNotNull(), "printed").otherwise("derived").alias("verified_against"),
        F.array_join(F.array_compact(F.array(F.when(off("debits", "printed_debits"), "debits"), F.when(off("credits", "printed_credits"), "credits"), F.when(off("closing", "printed_closing"), "closing"))), ",").alias("differs"),
    )


def verdict(ledger: DataFrame) -> DataFrame:
    """CHK-05.  One row a document: reasons for review, raw and after correction, and ok or needs_review.

    Chain breaks are counted on the rows as they stand, so corrections can't hide them.
    """
    rows = L.counts_of_faults(ledger)
    bad = F.abs(F.col("difference")) > F.lit(L.BREAK).cast(MONEY)
    rows = rows.withColumn("status", F.when(F.col("difference").isNotNull() & (bad | (F.col("breaks") > 0)), "FAIL").otherwise("PASS"))
    reason = lambda c, name: F.when(F.col(c) > 0, F.concat(F.lit(name + "="), F.col(c).cast("string")))
    reasons = F.array_compact(F.array(reason("breaks", "chain"), F.when(F.col("status") == "FAIL", "closing"), reason("corrections", "corrected"), reason("duplicates", "duplicates"), reason("side_faults", "sides"), reason("weak_rows", "weak")))
    return rows.select("doc_id", F.array_join(reasons, ";").alias("reasons"), F.when(F.size(reasons) == 0, "ok").otherwise("needs_review").alias("review"))


def failing_pages(ledger: DataFrame, printed_pages: DataFrame) -> DataFrame:
    """CHK-14, AGG-06.  Pages whose sums aren't the printed ones, and both pages at a chain break."""
    sums = L.page_totals(ledger).join(printed_pages, ["doc_id", "page"]).where((F.abs(F.col("debits") - F.col("printed")) > F.lit(L.BREAK).cast(MONEY))).select("doc_id", "page", F.lit("sum").alias("why"))
    ordered = L.statement_order(ledger)
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ord")
    expected = F.lag("balance").over(w) - F.coalesce("withdrawal", F.lit(0)) + F.coalesce("deposit", F.lit(0))
    broken = ordered.withColumns({"other": F.lag("page").over(w), "bad": F.abs(expected - F.col("balance")) > F.lit(L.BREAK).cast(MONEY)}).where("bad")
    chain = broken.select("doc_id", F.explode(F.array("page", "other")).alias("page"), F.lit("chain").alias("why")).where("page IS NOT NULL")
    return sums.unionByName(chain).distinct()


#: Ends of words in any script, whatever a pattern engine takes for one.
WORD_START, WORD_END = r"(?<![\p{L}\p{Nd}_])", r"(?![\p{L}\p{Nd}_])"

#: Words that tell statement kinds and issuers.
BANK_SIGNS = ("account number", "ifsc", "opening balance", "closing balance", "withdrawal", "deposit", "statement of account")
CARD_SIGNS = ("credit limit", "payment due date", "total amount due", "reward points", "available credit")


def classify(texts: DataFrame) -> DataFrame:
    """FLT-15.  card (minimum due and two other signs), bank (two signs) or unknown."""
    t = F.lower(F.coalesce("text", F.lit("")))
    count = lambda signs: sum((F.contains(t, F.lit(s)).cast("int") for s in signs), F.lit(0))
    card = F.contains(t, F.lit("minimum")) & F.contains(t, F.lit("due")) & (count(CARD_SIGNS) >= 2)
    return texts.select("doc_id", F.when(card, "card").when(count(BANK_SIGNS) >= 2, "bank").otherwise("unknown").alias("kind"))


def most_mentioned(texts: DataFrame, brands: list[str]) -> DataFrame:
    """FLT-16.  The brand that a text mentions most; of equals the first listed; null if none."""
    t = F.lower(F.coalesce("text", F.lit("")))
    counts = F.array(*(F.struct(F.regexp_count(t, F.lit(WORD_START + b + WORD_END)).alias("n"), F.lit(-k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate(brands)))
    best = F.array_max(counts)
    return texts.select("doc_id", F.when(best["n"] > 0, best["b"]).alias("brand"))


def detect_layout(texts: DataFrame, layouts: list[tuple[str, list[str]]]) -> DataFrame:
    """FLT-14.  The first layout all of whose patterns a text matches; generic if none."""
    out = F.lit("generic")
    for name, patterns in reversed(layouts):
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.coalesce("text", F.lit("")).rlike(p)
        out = F.when(hit, name).otherwise(out)
    return texts.select("doc_id", out.alias("layout"))


def word_overlap(a: DataFrame, share: float = 0.6) -> DataFrame:
    """SET-02, and of FLT-21 the last rule alone.  Notes (``doc_id``, ``note``, ``text``) whose words mostly stand in the text already."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""))
    rows = a.select("doc_id", words("note").alias("n"), words("text").alias("t"))
    return rows.select("doc_id", F.size("n").alias("n_words"), ((F.size("n") > 0) & (F.size(F.array_intersect("n", "t")) >= share * F.size("n"))).alias("repeats"))
