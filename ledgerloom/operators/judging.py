"""Invoices judged by rules that are data: each says when it holds, how grave it is, which field it is about and what was found and expected.

One row an invoice: ``invoice_id``, ``document_type``, ``supplier_name``, ``supplier_gstin``, ``buyer_gstin``, ``buyer_state``, ``place_of_supply``,
``invoice_no``, ``invoice_date`` and ``payment_date`` (dd/mm/yyyy), ``paid``, ``subtotal``, ``discount``, ``taxable``, ``cgst_rate``, ``cgst``, ``sgst_rate``,
``sgst``, ``igst_rate``, ``igst``, ``round_off``, ``grand_total``, ``words``, ``overleaf``, ``lines`` (array of ``line_no``, ``qty``, ``rate``, ``discount``, ``value``,
``gst_rate``), ``cross_check`` (array of ``field``, ``first``, ``second``), ``doubts`` and ``unreadable`` (arrays of fields) and ``derived`` (array of texts).

Facts that several rules read (sums, the tax that the rates give, whether a sale stays within a state) are columns of
their own; then one array of issues is made a row and laid out.  No rule needs another row, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S

MONEY = "decimal(18,2)"
#: How far lines and taxes may be off, and how large a rounding may be.
LINE_TOLERANCE, TAX_TOLERANCE, ROUND_OFF_LIMIT, EXACT = 1, 1, 1, "0.01"
#: Levels, gravest first, and the status that each gives; notes give none.
STATUS = {"incomplete": "INCOMPLETE", "review": "NEEDS REVIEW"}
LEVELS = ("incomplete", "review", "note")
#: Fields whose doubtful readings are told.
TOLD_FIELDS = ("supplier.gstin", "buyer.gstin", "invoiceNo", "invoiceDate", "totals.taxableAmount", "totals.cgst", "totals.sgst", "totals.igst", "totals.roundOff", "totals.grandTotal", "payment.amount", "payment.reference", "payment.date")

ISSUE = "struct<level:string,kind:string,field:string,line:int,found:decimal(18,2),expected:decimal(18,2)>"


@dataclass(frozen=True)
class Rule:
    """``when`` it holds (null: it doesn't), and what it says."""

    level: str
    kind: str
    field: str | Column
    when: Column
    found: Column | None = None
    expected: Column | None = None

    def issue(self, line: Column | None = None) -> Column:
        money = lambda c: (F.lit(None) if c is None else c).cast(MONEY)
        parts = (
            F.lit(self.level).alias("level"), F.lit(self.kind).alias("kind"), (F.lit(self.field) if isinstance(self.field, str) else self.field).alias("field"),
            (F.lit(None) if line is None else line).cast("int").alias("line"), money(self.found).alias("found"), money(self.expected).alias("expected"),
        )
        return F.when(self.when, F.struct(*parts)).cast(ISSUE)


def state_of(text: Column) -> Column:
    """The state code that a tax number or a place of supply begins with."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(\d{2})", 1), F.lit(""))


def _round(x: Column) -> Column:
    return F.round(x, 2).cast(MONEY)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(28,2)")).cast(MONEY)


def with_facts(invoices: DataFrame) -> DataFrame:
    """The invoice with what its rules need: computed lines, sums, base, state, rates and the taxes that they give."""
    c, none = F.col, F.lit(None)
    charged = lambda k: F.coalesce(c(k) != 0, F.lit(False))
    here = state_of(F.when(S.gstin_problem(c("supplier_gstin")).isNull(), c("supplier_gstin")))
    there = F.coalesce(state_of(c("place_of_supply")), state_of(c("buyer_state")), state_of(F.when(S.gstin_problem(c("buyer_gstin")).isNull(), c("buyer_gstin"))))
    rows = invoices.withColumns({
        "computed": F.transform("lines", lambda x: _round(x["qty"] * x["rate"] - F.coalesce(x["discount"], F.lit(0)))),
        "lines_sum": _sum(F.transform("lines", lambda x: x["value"])),
        "base": F.coalesce("taxable", (c("subtotal") - F.coalesce("discount", F.lit(0))).cast(MONEY)),
        "here": here, "there": there,
        "total_rate": F.coalesce("igst_rate", c("cgst_rate") * 2).cast("decimal(7,2)"),
        "day": S.parse_date(F.when(c("invoice_date").rlike(r"^\d{2}/\d{2}/\d{4}$"), c("invoice_date"))), "paid_day": S.parse_date(F.when(c("payment_date").rlike(r"^\d{2}/\d{2}/\d{4}$"), c("payment_date"))),
    })
    told = c("here") == c("there")
    rows = rows.withColumns({
        "told_within": told,
        "within": F.coalesce(told, F.when(charged("igst"), False).when(charged("cgst") | charged("sgst"), True)),
        "rated": F.transform("lines", lambda x: F.struct(F.coalesce(x["gst_rate"], c("total_rate")).cast("decimal(7,2)").alias("rate"), x["value"].alias("value"))),
    })
    by_line = (F.size("rated") > 0) & F.forall("rated", lambda x: x["rate"].isNotNull() & x["value"].isNotNull())
    by_rate = F.transform(F.array_distinct(F.transform("rated", lambda x: x["rate"])), lambda r: F.struct(r.alias("rate"), _sum(F.transform(F.filter("rated", lambda x: x["rate"] == r), lambda x: x["value"])).alias("base")))
    alone = F.array(F.struct(c("total_rate").alias("rate"), c("base").alias("base")))
    rows = rows.withColumn("groups", F.when(by_line, by_rate).when(c("base").isNotNull() & c("total_rate").isNotNull(), alone))
    taxes = F.transform("groups", lambda g: _round(g["base"] * g["rate"] / 100))
    between = F.coalesce(~c("within"), F.lit(False))
    rows = rows.withColumn("taxes", taxes).withColumns({
        "tax_half": F.when(~between, _sum(F.transform("taxes", lambda t: _round(t / 2)))), "tax_whole": F.when(between, _sum(c("taxes"))),
        "before_rounding": (c("base") + F.coalesce("cgst", F.lit(0)) + F.coalesce("sgst", F.lit(0)) + F.coalesce("igst", F.lit(0))).cast(MONEY),
    })
    words = S.words_amount(c("words"))
    return rows.withColumns({"in_words": F.when(c("words").isNotNull(), words).otherwise(none), "difference": (c("grand_total") - c("before_rounding")).cast(MONEY)})


def rules(today: Column, year: tuple[Column, Column]) -> list[Rule]:
    """All rules of an invoice as a whole; ``year`` are the first and last day that its date may have."""
    c = F.col
    charged = lambda k: F.coalesce(c(k) != 0, F.lit(False))
    over = lambda a, b, by: F.abs(a - b) > F.lit(by).cast(MONEY)
    blank = c("base").isNull() & c("grand_total").isNull()
    stated = F.coalesce("subtotal", "taxable")
    some = F.size("lines") > 0
    wrong = lambda k: S.gstin_problem(c(k)).isNotNull()
    taxed = c("base").isNotNull() & c("groups").isNotNull()
    between = F.coalesce(~c("within"), F.lit(False))
    each = []
    for key, expected, ok in (("cgst", c("tax_half"), ~between), ("sgst", c("tax_half"), ~between), ("igst", c("tax_whole"), between)):
        each += [Rule("review", "tax missing", f"totals.{key}", taxed & ok & c(key).isNull(), None, expected), Rule("review", "tax differs", f"totals.{key}", taxed & ok & over(c(key), expected, TAX_TOLERANCE), c(key), expected)]
    short = c("grand_total") - c("paid")
    return [
        Rule("review", "missing", "supplier.name", c("supplier_name").isNull()), Rule("review", "missing", "invoiceNo", c("invoice_no").isNull()),
        Rule("review", "missing on a tax invoice", "supplier.gstin", (c("document_type") == "tax_invoice") & c("supplier_gstin").isNull()),
        Rule("review", "wrong number", "supplier.gstin", c("supplier_gstin").isNotNull() & wrong("supplier_gstin")), Rule("review", "wrong number", "buyer.gstin", c("buyer_gstin").isNotNull() & wrong("buyer_gstin")),
        Rule("review", "missing", "invoiceDate", c("invoice_date").isNull()), Rule("review", "no date", "invoiceDate", c("invoice_date").isNotNull() & c("day").isNull()),
        Rule("review", "in the future", "invoiceDate", c("day") > today), Rule("review", "outside the year", "invoiceDate", ~c("day").between(*year)),
        Rule("review", "no date", "payment.date", c("payment_date").isNotNull() & c("paid_day").isNull()), Rule("review", "in the future", "payment.date", c("paid_day") > today),
        Rule("review", "lines differ", "totals.taxableAmount", some & over(c("lines_sum"), stated, LINE_TOLERANCE), c("lines_sum"), stated),
        Rule("incomplete", "totals blank", "totals", blank), Rule("incomplete", "missing", "totals.grandTotal", ~blank & c("grand_total").isNull()),
        Rule("note", "complete though continued", "continuedOverleaf", F.coalesce("overleaf", F.lit(False)) & ~blank),
        Rule("review", "tax between states", "totals.igst", c("told_within") & charged("igst")), Rule("review", "tax within a state", "totals.cgst", ~c("told_within") & (charged("cgst") | charged("sgst"))),
        Rule("review", "rates differ", "totals.sgstRate", c("cgst_rate") != c("sgst_rate"), c("sgst_rate"), c("cgst_rate")), *each,
        Rule("review", "no rate", "totals.cgstRate", c("base").isNotNull() & c("groups").isNull() & (charged("cgst") | charged("sgst") | charged("igst"))),
        Rule("review", "large rounding", "totals.roundOff", c("base").isNotNull() & (F.abs("round_off") > ROUND_OFF_LIMIT), c("round_off")),
        Rule("review", "total differs", "totals.grandTotal", F.when(c("round_off").isNotNull(), over(c("difference"), c("round_off"), EXACT)).otherwise(F.abs("difference") > ROUND_OFF_LIMIT), c("grand_total"), c("before_rounding") + F.coalesce("round_off", F.lit(0))),
        Rule("note", "no number", "totals.amountInWords", c("words").isNotNull() & c("grand_total").isNotNull() & c("in_words").isNull()), Rule("review", "words differ", "totals.amountInWords", over(c("in_words"), c("grand_total"), "0.005"), c("in_words"), c("grand_total")),
        Rule("note", "paid less", "payment.amount", short > LINE_TOLERANCE, c("paid"), c("grand_total")), Rule("note", "paid more", "payment.amount", short < -LINE_TOLERANCE, c("paid"), c("grand_total")),
        Rule("note", "lines give", "totals.computed", blank & some, c("lines_sum")),
    ]


def line_rules(x: Column, computed: Column) -> list[Rule]:
    field = lambda name: F.concat(F.lit("lineItems["), (x["line_no"] - 1).cast("string"), F.lit(f"].{name}"))
    any_rate = F.exists("lines", lambda y: y["gst_rate"].isNotNull())
    return [
        Rule("review", "no amount", field("amount"), x["value"].isNull(), None, computed), Rule("review", "arithmetic", field("amount"), F.abs(x["value"] - computed) > LINE_TOLERANCE, x["value"], computed),
        Rule("review", "no rate", field("gstRate"), any_rate & x["gst_rate"].isNull(), x["value"]),
    ]


def invoice_issues(invoices: DataFrame, today: Column, year: tuple[Column, Column]) -> DataFrame:
    """CHK-11.  All issues: ``invoice_id``, ``place`` (gravest first, then as the rules stand), ``level``, ``kind``, ``field``, ``line``, ``found``, ``expected``."""
    facts = with_facts(invoices)
    whole = F.array(*(r.issue() for r in rules(today, year)))
    lines = F.flatten(F.transform(F.arrays_zip("lines", "computed"), lambda z: F.array(*(r.issue(z["lines"]["line_no"]) for r in line_rules(z["lines"], z["computed"])))))
    note = lambda kind, field: Rule("note", kind, field, F.lit(True)).issue()
    told = lambda f: f.isin(*TOLD_FIELDS)
    crossed = F.transform("cross_check", lambda x: note("readers disagree", x["field"]))
    fields = F.transform("cross_check", lambda x: x["field"])
    doubts = F.transform(F.filter("doubts", lambda f: told(f) & ~F.array_contains(fields, f)), lambda f: note("hard to read", f))
    unread = F.transform(F.filter("unreadable", told), lambda f: note("unreadable", f))
    derived = F.transform("derived", lambda t: note("derived", t))
    issues = F.array_distinct(F.array_compact(F.concat(whole, lines, crossed, doubts, unread, derived)))
    of = lambda level: F.filter(issues, lambda i: i["level"] == level)
    ranked = F.flatten(F.array(*map(of, LEVELS)))
    return facts.select("invoice_id", F.posexplode(ranked).alias("place", "i")).select("invoice_id", "place", "i.*")


def judged(invoices: DataFrame, today: Column, year: tuple[Column, Column]) -> DataFrame:
    """CHK-11.  ``status`` by the gravest issue, and how many of each level; invoices without any are OK."""
    found = invoice_issues(invoices, today, year).groupBy("invoice_id").agg(*(F.count_if(F.col("level") == level).alias(level) for level in LEVELS))
    rows = invoices.select("invoice_id").join(found, "invoice_id", "left").fillna(0, list(LEVELS))
    status = F.lit("OK")
    for level, name in reversed(STATUS.items()):
        status = F.when(F.col(level) > 0, name).otherwise(status)
    return rows.select("invoice_id", status.alias("status"), *LEVELS)
