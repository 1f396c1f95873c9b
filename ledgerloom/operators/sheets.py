"""What is handed over: sheets, notes, corrections by kind, verdicts on layouts, totals as read and as printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.operators import ledger as L

MONEY = L.MONEY


def legacy_sheet(ledger: DataFrame) -> DataFrame:
    """SNK-03.  Five columns, and a correction column if any row of the document was corrected; grand total last."""
    whole = Window.partitionBy("doc_id")
    rows = ledger.withColumn("_any", F.bool_or(F.coalesce("ocr_corrected", F.lit(False))).over(whole))
    mark = F.when(F.col("_any"), F.when(F.col("ocr_corrected"), "Yes").otherwise(""))
    body = rows.select("doc_id", F.col("seq").alias("place"), F.col("txn_date").alias("date"), F.col("particulars").alias("description"), F.col("withdrawal").alias("debit"), F.col("deposit").alias("credit"), "balance", mark.alias("corrected"))
    t = L.closing_balance(ledger)
    total = t.select("doc_id", F.lit(2**62).cast("long").alias("place"), F.lit(None).cast("date").alias("date"), F.lit("GRAND TOTAL").alias("description"), F.col("debits").alias("debit"), F.col("credits").alias("credit"), F.col("closing").alias("balance"), F.lit(None).cast("string").alias("corrected"))
    return body.unionByName(total)


def account_checks(ledger: DataFrame, printed: DataFrame) -> DataFrame:
    """SNK-04.  Five checks of each account: computed, printed, and PASS or FAIL (under 0.01) where both are there."""
    rows = L.closing_balance(ledger).join(printed, "doc_id", "left")
    pairs = {
        "Transactions Extracted": (F.col("n_rows").cast(MONEY), F.col("printed_count").cast(MONEY)), "Opening Balance": (F.col("opening"), F.col("printed_opening")), "Total Debits": (F.col("debits"), F.col("printed_debits")),
        "Total Credits": (F.col("credits"), F.col("printed_credits")), "Closing Balance": (F.col("closing"), F.col("printed_closing")),
    }
    lines = F.array(*(F.struct(F.lit(k).alias("check"), a.cast(MONEY).alias("calculated"), b.cast(MONEY).alias("printed")) for k, (a, b) in pairs.items()))
    status = F.when(F.abs(F.col("calculated") - F.col("printed")) < F.lit("0.01").cast(MONEY), "PASS").when(F.col("calculated").isNotNull() & F.col("printed").isNotNull(), "FAIL").otherwise("")
    return rows.select("doc_id", F.inline(lines)).withColumn("status", status)


def review_sheet(reasons: DataFrame) -> DataFrame:
    """SNK-05.  Numbered reasons (``doc_id``, ``place``, ``reason``), each message once, below one title."""
    first = reasons.groupBy("doc_id", "reason").agg(F.min("place").alias("place"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    rows = first.select("doc_id", n.alias("line"), F.concat(n.cast("string"), F.lit(". "), "reason").alias("text"))
    return rows.unionByName(first.select("doc_id").distinct().select("doc_id", F.lit(0).alias("line"), F.lit("NEEDS REVIEW").alias("text")))


def sheets_of(ledger: DataFrame) -> DataFrame:
    """SNK-06.  Which sheets a document gets: its statement always, review and corrections where there is something, months if it has several."""
    months = F.count_distinct(F.trunc("txn_date", "month"))
    s = ledger.groupBy("doc_id").agg(F.count_if(F.col("balance").isNull()).alias("gaps"), F.count_if("ocr_corrected").alias("corrected"), months.alias("months"))
    names = F.array_compact(F.array(F.lit("Statement of Account"), F.when(F.col("gaps") > 0, "Review Required"), F.when(F.col("corrected") > 0, "Logs"), F.when(F.col("months") > 1, "Monthly Check")))
    return s.select("doc_id", F.array_join(names, "; ").alias("sheets"))


def read_back(written: DataFrame, read: DataFrame) -> DataFrame:
    """SNK-07.  Documents whose rows or sums are other in what was read back than in what was written."""
    sums = lambda d, x: d.groupBy("doc_id").agg(F.count("*").alias(f"n_{x}"), F.sum(F.coalesce("balance", F.lit(0))).cast(MONEY).alias(f"sum_{x}"))
    both = sums(written, "written").join(sums(read, "read"), "doc_id", "full")
    return both.where(~(F.col("n_written").eqNullSafe(F.col("n_read")) & F.col("sum_written").eqNullSafe(F.col("sum_read"))))


def gst_rows(lines: DataFrame, printed: DataFrame) -> DataFrame:
    """AGG-09, SNK-09.  One row a rate, in order of first appearance, unrated lines last.

    An invoice with one rate at most and a printed taxable amount keeps the printed
    figures; others get their tax from the lines, in halves.
    """
    groups = lines.groupBy("invoice_id", "gst_rate").agg(F.sum("value").cast(MONEY).alias("taxable"), F.min("line_no").alias("first_line"))
    groups = groups.withColumn("rates", F.count("*").over(Window.partitionBy("invoice_id"))).join(printed, "invoice_id", "left")
    keep = (F.col("rates") == 1) & F.col("printed_taxable").isNotNull()
    half = F.round(F.col("taxable") * F.col("gst_rate") / 200, 2).cast(MONEY)
    place = F.row_number().over(Window.partitionBy("invoice_id").orderBy(F.col("gst_rate").isNull(), "first_line"))
    return groups.select(
        "invoice_id", "gst_rate", F.when(keep, F.col("printed_taxable")).otherwise(F.col("taxable")).alias("taxable"), F.when(keep, F.col("printed_cgst")).otherwise(half).alias("cgst"),
        F.col("gst_rate").isNull().alias("yellow"), place.alias("place"),
    )


def with_total_row(rows: DataFrame, key: str, label: str, amounts: list[str]) -> DataFrame:
    """SNK-10.  Rows by key and a row ``TOTAL`` with the sums of their amounts."""
    sums = rows.agg(*(F.sum(a).cast(MONEY).alias(a) for a in amounts)).select(F.lit(label).alias(key), *amounts)
    return rows.select(F.col(key).cast("string").alias(key), *(F.col(a).cast(MONEY).alias(a) for a in amounts)).unionByName(sums)


def register_sheet(values: DataFrame, ledger_of: Column) -> DataFrame:
    """SNK-11.  The register's sheet: running number, product as item, quantity, rate, amount and ledger, by day and product."""
    n = F.row_number().over(Window.partitionBy(F.floor((F.col("day") - 1) / 31)).orderBy("day", "product"))  # a month's rows
    return values.select(n.alias("sr"), "day", F.col("product").alias("item"), F.col("net").alias("qty"), "rate", F.col("value").alias("amount"), ledger_of.alias("ledger"))


def validation_sheet(ledger: DataFrame) -> DataFrame:
    """SNK-12.  Each page's sums with running totals of all pages so far."""
    pages = L.page_totals(ledger)
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.select("doc_id", "page", "n_rows", "debits", "credits", F.sum("debits").over(w).cast(MONEY).alias("debits_so_far"), F.sum("credits").over(w).cast(MONEY).alias("credits_so_far"))


def _sides(w: Column, d: Column) -> Column:
    return F.when(F.coalesce(w, F.lit(0)) != 0, "debit").when(F.coalesce(d, F.lit(0)) != 0, "credit").otherwise("none")


def corrections(ledger: DataFrame) -> DataFrame:
    """WIN-05.  A note for each row whose amounts were corrected by the balance; 0 and null count alike."""
    rows = L.rebuild_amounts(ledger).where("changed")
    before, after = _sides(F.col("withdrawal"), F.col("deposit")), _sides(F.col("new_withdrawal"), F.col("new_deposit"))
    amount = lambda w, d: F.coalesce(F.nullif(F.col(w), F.lit(0)), F.nullif(F.col(d), F.lit(0)), F.lit(0)).cast(MONEY)
    rows = rows.withColumns({"before": before, "after": after, "old": amount("withdrawal", "deposit"), "new": amount("new_withdrawal", "new_deposit")})
    note = F.concat(F.lit("printed "), "before", F.lit(" "), F.col("old").cast("string"), F.lit(" changed to "), "after", F.lit(" "), F.col("new").cast("string"))
    return rows.select("doc_id", "seq", "before", "after", "old", "new", note.alias("note"))


def corrections_by_kind(ledger: DataFrame) -> DataFrame:
    """CHK-07.  Corrections by kind: how many, the first row, the amounts that they end at (or began at, if none is left)."""
    rows = corrections(ledger)
    kind = F.when(F.col("before") == F.col("after"), F.concat(F.lit("printed "), "before", F.lit(" amount changed"))).otherwise(F.concat(F.lit("printed "), "before", F.lit(" changed to "), "after"))
    amount = F.when(F.col("after") == "none", F.col("old")).otherwise(F.col("new"))
    return rows.withColumns({"kind": kind, "amount": amount}).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum("amount").cast(MONEY).alias("total"))


def unknown_layout(checks: DataFrame) -> DataFrame:
    """CHK-08.  Verdict on a layout that nobody knows (``known``, ``status``, ``n_balances``): never ok without a passing check."""
    bad = F.col("status") == "FAIL"
    text = (
        F.when(F.col("known"), None).when(bad, "not recognised and does not reconcile").when(F.col("n_balances") == 0, "not recognised and no balances to verify by").otherwise("not recognised, verified by balance chain only")
    )
    review = F.when(bad | (~F.col("known") & (F.col("n_balances") == 0)), "needs_review").otherwise("ok")
    return checks.select("doc_id", text.alias("layout_note"), review.alias("review"))


def fallback_status(cards: DataFrame) -> DataFrame:
    """CHK-10.  A card statement read by its headings only: OK stays OK with a note if every line was read, else it is UNVERIFIED; other states stay."""
    ok, unread = F.col("status") == "OK", F.col("n_unread") > 0
    return cards.select(
        "doc_id", F.when(ok & unread, "UNVERIFIED").otherwise(F.col("status")).alias("status"),
        F.when(ok & ~unread, "verified by printed totals only").when(ok, F.concat(F.lit("totals match, but "), F.col("n_unread").cast("string"), F.lit(" line(s) unread"))).otherwise("does not reconcile").alias("note"),
    )


def reading_rules(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """CHK-12.  Lines with quantity and unit from the description where none is written, and the invoice's rate on all lines where no line has one."""
    q = R.quantity_in(F.col("description"))
    rated = F.count("gst_rate").over(Window.partitionBy("invoice_id"))
    t = totals.select("invoice_id", F.when(F.col("igst_rate") > 0, F.col("igst_rate")).when(F.col("cgst_rate") == F.col("sgst_rate"), F.col("cgst_rate") + F.col("sgst_rate")).alias("_rate"))
    rows = lines.withColumns({"_q": q, "_rated": rated}).join(t, "invoice_id", "left")
    return rows.select(
        "invoice_id", "line_no", F.coalesce("qty", "_q.qty").alias("qty"), F.coalesce("unit", F.when(F.col("qty").isNull(), F.col("_q.unit"))).alias("unit"), (F.col("qty").isNull() & F.col("_q.qty").isNotNull()).alias("derived"),
        F.coalesce("gst_rate", F.when(F.col("_rated") == 0, F.col("_rate"))).cast("decimal(5,2)").alias("gst_rate"),
    )


def round_off(totals: DataFrame) -> DataFrame:
    """CHK-12.  Round-off from the totals, where it is one (1.00 at most), and payment: paid, partial, or null without a note."""
    gap = (F.col("grand_total") - F.col("taxable") - F.coalesce("cgst", F.lit(0)) - F.coalesce("sgst", F.lit(0)) - F.coalesce("igst", F.lit(0))).cast(MONEY)
    real = (F.abs(gap) <= 1) & ((gap != 0) | F.col("round_off").isNotNull())
    status = F.when(F.col("payment_note").isNull() & F.col("paid").isNull(), None).when(F.col("paid").isNull() | F.col("grand_total").isNull(), "paid").when(F.col("paid") >= F.col("grand_total") - 1, "paid").otherwise("partial")
    return totals.select("invoice_id", F.when(real, gap).otherwise(F.col("round_off")).cast(MONEY).alias("round_off"), status.alias("payment"))


def arithmetic_summary(totals: DataFrame) -> DataFrame:
    """AGG-11.  "a + b + c = d" of the parts that aren't 0, with the round-off to the printed total."""
    parts = F.filter(F.array("taxable", "cgst", "sgst", "igst"), lambda v: v.isNotNull() & (v != 0))
    before = F.aggregate(parts, F.lit(0).cast(MONEY), lambda a, v: (a + v).cast(MONEY))
    off = (F.col("grand_total") - before).cast(MONEY)
    text = F.concat(F.array_join(F.transform(parts, lambda v: v.cast("string")), " + "), F.lit(" = "), before.cast("string"), F.when(off != 0, F.concat(F.lit(", round-off "), off.cast("string"), F.lit(" = "), F.col("grand_total").cast("string"))).otherwise(""))
    return totals.select("invoice_id", F.when((F.size(parts) > 0) & F.col("grand_total").isNotNull(), text).otherwise("All amounts check.").alias("summary"))


def statement_issues(ledger: DataFrame, printed: DataFrame, tolerance: str = L.BREAK) -> DataFrame:
    """CHK-18.  Issues of a statement against its own summary, one row each: opening, debits, credits, closing, row count."""
    rows = L.closing_balance(ledger).join(printed, "doc_id")
    pairs = (("opening", "opening", "printed_opening"), ("debits", "debits", "printed_debits"), ("credits", "credits", "printed_credits"), ("closing", "closing", "printed_closing"), ("count", "n_rows", "printed_count"))
    items = F.array(*(F.struct(F.lit(name).alias("issue"), F.col(a).cast(MONEY).alias("found"), F.col(b).cast(MONEY).alias("printed")) for name, a, b in pairs))
    return rows.select("doc_id", F.inline(items)).where(F.abs(F.col("found") - F.col("printed")) > F.lit(tolerance).cast(MONEY))


def repeats_invoice(notes: DataFrame) -> DataFrame:
    """FLT-21.  Whether a handwritten note (``note``) only repeats what its invoice has: ``amounts`` (strings), ``gstins``, ``invoice_no``, ``invoice_date`` (dd/mm/yyyy), ``sources`` (texts).

    Blank notes, "P.T.O.", an amount or a rate of the invoice, a tax number, the invoice's
    number or date, or 60 % of the words of one source.
    """
    t = F.trim("note")
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), 0)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    plain = F.forall(words, lambda w: w.rlike(r"^\d+$") | w.isin("w", "rs", "inr", "per", "sqft", "sft", "nos", "kg", "kgs")) & (digits(t) != "")
    amount = plain & (F.exists("amounts", lambda a: (digits(a) == digits(t)) | (digits(F.round(a.cast(MONEY), 0).cast("decimal(18,0)").cast("string")) == digits(t))) | t.rlike("%$"))
    date = r"^(\d{1,2})\D(\d{1,2})\D(\d{2,4})\.?$"
    part = lambda k: F.regexp_extract(t, date, k).try_cast("int")
    own = lambda a, n: F.substring("invoice_date", a, n).try_cast("int")
    dated = t.rlike(date) & (part(1) == own(1, 2)) & (part(2) == own(4, 2)) & (part(3) % 100 == own(9, 2))
    known = lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0))
    overlap = F.exists("sources", lambda s: F.size(F.filter(words, lambda w: F.array_contains(known(s), w))) >= 0.6 * F.size(words)) & (F.size(words) > 0)
    number = (digits(F.col("invoice_no")) != "") & (digits(F.col("invoice_no")) == digits(t)) & (F.size(words) <= 2)
    gstin = F.array_contains(F.transform("gstins", F.upper), F.upper(F.regexp_replace(t, r"\s", "")))
    yes = (t == "") | t.rlike(r"(?i)^p\.?\s*t\.?\s*o\.?$") | amount | F.coalesce(gstin, F.lit(False)) | F.coalesce(number, F.lit(False)) | F.coalesce(dated, F.lit(False)) | overlap
    return notes.select("note_id", F.coalesce(yes, F.lit(False)).alias("repeats"))


def tally_sheets(lines: DataFrame, totals: DataFrame) -> dict[str, DataFrame]:
    """SNK-09.  The sheets of an export of invoices, by name: GST Entries, Lines, Stock Items, Review, Party Settings."""
    from ledgerloom.operators import invoice as I

    rows = gst_rows(lines, totals.select("invoice_id", F.col("taxable").alias("printed_taxable"), F.col("cgst").alias("printed_cgst")))
    printed = totals.select("invoice_id", F.col("taxable").alias("printed"))
    return {
        "GST Entries": rows,
        "Lines": lines.select("invoice_id", "line_no", "qty", "rate", "gst_rate", "value"),
        "Stock Items": lines.where("qty IS NOT NULL AND rate IS NOT NULL").select("invoice_id", "line_no", "qty", "rate", F.round(F.col("qty") * F.col("rate"), 2).cast(MONEY).alias("amount")),
        "Review": I.invoice_status(lines, printed).where("status <> 'OK'"),
        "Party Settings": lines.select("supplier_id").distinct(),
    }
