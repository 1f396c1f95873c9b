"""Statement readers, claims, rules, summaries and geometry on small invented rows: odd lines, empty tables, and what a wrong reading would show."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import claims, dispatch, geometry, judging, statements, summaries

LINES = "doc_id long, line_no long, page int, y double, text string, items array<struct<x:double,text:string>>, source string"
N, D = Decimal, dt.date


def lines(spark, texts, source="pdf", doc=1):
    return spark.createDataFrame([(doc, k, 0, None, t, None if not isinstance(t, list) else t, source) if not isinstance(t, list) else (doc, k, 0, None, " ".join(x for _, x in t), t, source) for k, t in enumerate(texts)], LINES)


def read(df):
    return [(r.line_no, r.date, r.particulars, r.cheque_no, r.withdrawal, r.deposit, r.balance) for r in statements.read_lines(df).orderBy("line_no").collect()]


def test_a_statement_of_odd_lines(spark):
    texts = [
        "SOME BANK", None, "Opening Balance : 1,000.00", "Date Narration Chq Details", "01/04/2024 GOODS AB12345 200.00 1,200.00", "goes on", "", "Page 1 of 2", "12 '02/04/2024 05/04/2024 RENT 150.00 50.00 1,300.00", "03 Apr 2024 MB-998494379184 CREDIT 7.5 9,999.00",
        "31/02/2024 NO DAY 1.00 2.00", "04/04/2024 UPI/77 5.00 9,994.00", "told below", "TOTAL DEBITS : 5.00", "after the end", "2024-04-06 again 6.00 Dr 10,000.00 Cr", "07/04/2024 only words",
    ]
    got = read(lines(spark, texts))
    assert got == [
        (4, D(2024, 4, 1), "GOODS goes on", "AB12345", None, N("200.00"), N("1200.00")), (8, D(2024, 4, 2), "RENT", None, N("150.00"), N("50.00"), N("1300.00")),
        (9, D(2024, 4, 3), "MB-998494379184 CREDIT 31/02/2024 NO DAY 1.00 2.00", None, None, N("7.50"), N("9999.00")), (11, D(2024, 4, 4), "told below", None, N("5.00"), None, N("9994.00")),
        (15, D(2024, 4, 6), "again", None, None, N("6.00"), N("10000.00")),
    ]
    assert read(lines(spark, texts).limit(0)) == []


def test_columns_by_place(spark):
    head = [(10.0, "Date"), (60.0, "Narration"), (200.0, "Debit"), (300.0, "Credit"), (400.0, "Balance")]
    rows = [head, [(10.0, "01/04/2024"), (60.0, "A"), (205.0, "10.00"), (400.0, "90.00")], [(10.0, "02/04/2024"), (60.0, "B"), (301.0, "5.00"), (400.0, "1.00")]]
    assert [(w, d) for *_, w, d, _ in read(lines(spark, rows))] == [(N("10.00"), None), (None, N("5.00"))]
    signed = ["Date Narration Debit / Credit Balance".replace("Date Narration ", ""), "01/04/2024 A -3.00 1.00", "02/04/2024 B 4.00 1.00"]
    found = read(lines(spark, ["Date Narration Amount", *signed]))
    assert len(found) == 2


def test_detection_order_source_and_fallback(spark):
    pnb = ["IFSC: PUNB0000001", "Date Instrument ID Amount(INR) Type Balance Remarks"]
    row = [(43.0, "01/04/2024"), (181.0, "5.00"), (230.0, "DR"), (283.0, "95.00"), (352.0, "RENT")]
    csb = ["CSB Bank", "TRANS VALUE DETAILS REF NO. DEBITS CREDITS BALANCE", "01/04/2024 RENT 5.00 95.00"]
    both = lines(spark, [*pnb, row]).unionByName(lines(spark, csb, "ocr", 2)).unionByName(lines(spark, [*pnb, "01/04/2024 RENT 5.00 95.00"], "pdf", 3))
    got = {(r.doc_id, r.format): (r.date, r.particulars, r.withdrawal, r.balance) for r in dispatch.read_statements(both).collect()}
    # an ocr document isn't csb; a document without rows of its layout is read as a generic one
    assert got[1, "pnb"] == (D(2024, 4, 1), "RENT", N("5.00"), N("95.00")) and set(got) == {(1, "pnb"), (2, "generic"), (3, "generic")}
    assert dispatch.read_statements(both.limit(0)).count() == 0


SHORT = [
    ("axis-report", [(25.0, "01/04/2024"), (130.0, "RENT"), (300.0, "5.00"), (380.0, "DR")]), ("csb", [(14.0, "01-Apr-2024"), (121.0, "RENT"), (255.0, "100005"), (330.0, "5.00")]), ("hdfc-statement", [(31.0, "01/04/24"), (68.0, "RENT"), (412.0, "5.00")]),
    ("axis", "01-04-2024 RENT CQ100005 5.00 BR"), ("union-bank", "01-04-2024 RENT 100005 5.00"), ("sbi", "01/04/2024 01/04/2024 RENT CQ100005 5.00 - -"),
]


@pytest.mark.parametrize("name, row", SHORT)
def test_a_movement_without_a_balance_is_a_row_of_no_reader(spark, name, row):
    from ledgerloom.plans.layout_queries import HEADINGS, TITLES

    head = [[(float(x), w) for w, x in HEADINGS[name]]] if name in HEADINGS else []
    # what the layout can't read at all still goes to the generic reader
    other = "03/04/2024 SALARY 7.00 102.00"
    source = next(y.source for y in dispatch.LAYOUTS if y.name == name) or "pdf"
    both = lines(spark, [*TITLES[name], *head, row], source).unionByName(lines(spark, [*TITLES[name], *head, row, other], source, 2))
    assert [(r.doc_id, r.format, r.date, r.particulars, r.balance) for r in dispatch.read_statements(both).collect()] == [(2, "generic", D(2024, 4, 3), "SALARY", N("102.00"))]


def test_lines_are_cut_at_matches_that_do_not_overlap(spark):
    from ledgerloom.operators.lines import split_merged

    rows = spark.createDataFrame([(1, 0, 0, " The The The x"), (1, 0, 1, "a The b The "), (1, 0, 2, ""), (1, 0, 3, "plain" * 9000)], "doc_id long, page int, line_no int, text string")
    got = [(r.line_no, r.text) for r in split_merged(rows, " The ").orderBy("line_no", "part").collect()]
    assert got == [(0, " The The"), (0, " The x"), (1, "a"), (1, " The b"), (1, " The "), (3, "plain" * 9000)]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, (None, None, None, None, None, None, "TRANSACTION")), ("02-04-2024 RENT 5.00", (D(2024, 4, 2), None, None, N("5.00"), None, None, "RENT")),
        ("02 - 04 - 2024 03-04-2024 PAID TO X TFR S1234567 123456 5.00 1,095.001 GR", (D(2024, 4, 2), "TFR", "S1234567", N("5.00"), N("1095.00"), "CR", "PAID TO X")),
        ("02-04-2024 FB1854266 5.00 95.00 Dr.", (D(2024, 4, 2), None, None, N("5.00"), N("95.00"), "DR", "FB1854266")),
    ],
)
def test_claims(spark, text, want):
    r = claims.claimed_spans(spark.createDataFrame([(1, 1, text)], "doc_id long, line_no long, text string")).first()
    assert (r.date, r.type, r.tran_id, r.amount, r.balance, r.side, r.particulars) == want


def test_rules_without_facts(spark):
    line = "array<struct<line_no:int,qty:decimal(18,4),rate:decimal(18,2),discount:decimal(18,2),value:decimal(18,2),gst_rate:decimal(5,2)>>"
    money = "paid subtotal discount taxable cgst sgst igst round_off grand_total".split()
    schema = "invoice_id long, document_type string, supplier_name string, supplier_gstin string, buyer_gstin string, buyer_state string, place_of_supply string, invoice_no string, invoice_date string, payment_date string, " + ", ".join(f"{c} decimal(18,2)" for c in money)
    schema += f", cgst_rate decimal(5,2), sgst_rate decimal(5,2), igst_rate decimal(5,2), words string, overleaf boolean, lines {line}, cross_check array<struct<field:string,first:string,second:string>>, doubts array<string>, unreadable array<string>, derived array<string>"
    names = [f.split()[0] for f in schema.split(", ") if not f.startswith(("rate:", "discount:", "value:", "gst_rate:"))]
    blank = dict.fromkeys([n for n in names if "<" not in n])
    empty = blank | {"invoice_id": 1, "lines": [], "cross_check": [], "doubts": [], "unreadable": [], "derived": []}
    good = empty | {"invoice_id": 2, "supplier_name": "S", "invoice_no": "1", "document_type": "receipt", "invoice_date": "02/04/2024", "taxable": N("100.00"), "grand_total": N("118.00"), "cgst_rate": N("9.00"), "sgst_rate": N("9.00"), "cgst": N("9.00"), "sgst": N("9.00"),
                    "lines": [(1, N("2.0000"), N("50.00"), None, N("100.00"), N("18.00"))], "words": "one hundred eighteen"}
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    df = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in (empty, good)], schema)
    day = lambda t: F.lit(t).cast("date")
    got = {r.invoice_id: r.status for r in judging.judged(df, day("2025-01-01"), (day("2024-04-01"), day("2025-03-31"))).collect()}
    assert got == {1: "INCOMPLETE", 2: "OK"}
    late = {r.kind for r in judging.invoice_issues(df.where("invoice_id = 2"), day("2024-04-01"), (day("2024-04-01"), day("2025-03-31"))).collect()}
    assert late == {"in the future"} and judging.judged(df.limit(0), day("2025-01-01"), (day("2024-04-01"), day("2025-03-31"))).count() == 0


def test_tables_without_items_and_short_segments(spark):
    cards = spark.createDataFrame([(1, 0, 0, "Credit Limit", None), (1, 0, 1, "5,000.00", None)], "doc_id long, page int, line_no long, text string, items array<struct<x:double,text:string>>")
    assert summaries.summary_tables(cards).count() == 0 and summaries.summary_tables(cards.limit(0)).count() == 0
    words = spark.createDataFrame([(1, 0, 1, 40.0, 60.0, "01/04/2024"), (1, 0, 1, 300.0, 30.0, "5.00")], "doc_id long, segment int, row long, left double, width double, text string")
    assert geometry.split_rows(words).count() == 0 and geometry.split_rows(words.limit(0)).count() == 0
