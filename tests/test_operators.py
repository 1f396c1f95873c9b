"""Edge cases on invented rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators import invoice, ledger, solvers
from ledgerloom.sources import readers, writers

SCHEMA = "doc_id long, seq long, page int, txn_date date, particulars string, cheque_no string, withdrawal decimal(18,2), deposit decimal(18,2), balance decimal(18,2), is_reversal boolean, ocr_corrected boolean"


def make(spark, rows):
    return spark.createDataFrame([(1, k, 0, d, p, None, w, c, b, False, False) for k, (d, p, w, c, b) in enumerate(rows)], SCHEMA)


D = lambda k: dt.date(2024, 1, k)
N = Decimal


def test_breaks_tolerance_nulls_and_order(spark):
    rows = [(D(1), "a", None, N(10), N(100)), (D(2), "b", N(10), None, N("90.05")), (D(3), "c", None, None, N("90.11")), (D(4), "d", N(1), None, None), (D(5), "e", N(1), None, N(3))]
    assert [r.seq for r in ledger.balance_breaks(make(spark, rows)).collect()] == [2]  # 0.05 is none, 0.06 is one, a null skips both sides
    back = make(spark, rows[::-1])
    assert {r.seq for r in ledger.balance_breaks(back).collect()} == {2}  # newest first
    assert ledger.chronology(make(spark, [(None, "a", None, None, None)])).first().chronological


def test_one_injected_break_is_found(spark):
    rng, rows, balance = random.Random(3), [], N(1000)
    for k in range(40):
        w = N(rng.randint(1, 500)) if rng.random() < 0.5 else None
        c = None if w else N(rng.randint(1, 500))
        balance += (c or 0) - (w or 0)
        rows.append((D(1 + k // 2), str(k), w, c, balance + (5 if k >= 20 else 0)))
    assert [r.seq for r in ledger.balance_breaks(make(spark, rows)).collect()] == [20]
    assert ledger.closing_check(make(spark, rows)).first().status == "FAIL"
    assert ledger.closing_check(make(spark, rows[:20])).first().status == "PASS"


def test_dedupe_null_is_zero_and_spacing(spark):
    rows = [(D(1), "A  b", None, N(1), N(1)), (D(1), "a b", N(0), N(1), N(1)), (D(1), "a c", None, N(1), N(1))]
    assert [r.seq for r in ledger.remove_duplicates(make(spark, rows)).orderBy("seq").collect()] == [0, 2]


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (ledger.chronology, ledger.balance_breaks, ledger.closing_check, ledger.remove_duplicates, ledger.confidence, ledger.monthly, ledger.statement_sheet):
        assert f(empty).count() == 0


@pytest.mark.parametrize(
    "text, pivot, want",
    [("31/02/2024", 69, None), ("1/2/69", 69, dt.date(2069, 2, 1)), ("1/2/70", 69, dt.date(1970, 2, 1)), ("1/2/70", None, dt.date(2070, 2, 1)), ("2024-3-9", 69, dt.date(2024, 3, 9)), ("5 Mar '24", 69, dt.date(2024, 3, 5)), ("x", 69, None), (None, 69, None)],
)
def test_dates(spark, text, pivot, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_date(F.col("t"), pivot)).first()[0] == want


def test_text_and_numbers(spark):
    row = spark.range(1).select(
        S.clean(F.lit(" a   b ")), S.parse_amount(F.lit("₹ 1,23,456.70 Dr")), S.parse_amount(F.lit("n/a")), S.ocr_digits(F.lit("l2/O3/2024")), S.ocr_digits(F.lit("Ill")), S.indian_grouping(F.lit("-1234567.5").cast("decimal(18,2)")),
        S.amount_words(F.lit(10_000_000)), S.amount_words(F.lit(0)), S.words_amount(F.lit("Rupees One Lakh Two Hundred and Five only")), S.words_amount(F.lit("two banana")), S.words_amount(F.lit("three million four")),
        S.mask_card(F.lit("4111 1111 1111 1111")), S.mask_card(F.lit("4111 1111 1111 1112")), S.unit(F.lit("pcs.")), S.invoice_number(F.lit(" 00in 7")), S.round_up_ties(F.lit("-2.505").cast("decimal(10,3)")),
        S.join_wrapped(F.array(F.lit("UPI/"), F.lit("X"), F.lit("Y"))), S.confidence_bucket(F.lit(0.85)), S.party_name(F.lit("M&N Traders Pvt. Ltd")), S.rejoin_dates(F.lit("12 / 03 / 2024 x")),
    ).first()
    assert list(row) == ["a b", N("-123456.70"), None, "12/03/2024", "Ill", "-12,34,567.50", "one crore", "zero", 100_205, None, 3_000_004, "XXXXXXXXXXXX1111", "4111 1111 1111 1112", "NOS", "IN7", N("-2.50"), "UPI/X Y", "high", "N TRADERS", "12/03/2024 x"]


def test_party_blocks_lose_no_similar_pair(spark):
    rng, letters = random.Random(5), "ABCDE"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 20))) for _ in range(30)]
    changed = []
    for n in names:
        s = list(n)
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice(letters)
        changed.append("".join(s))
    parties = spark.createDataFrame([(k, k, n, None) for k, n in enumerate(names)], "party_id long, ord long, name string, gstin string")
    asked = spark.createDataFrame([(k, n, None) for k, n in enumerate(changed)], "row_id long, name string, gstin string")
    lev = lambda a, b: spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0]
    got = {r.row_id: r.party_id for r in invoice.match_parties(asked, parties).collect()}
    for k, c in enumerate(changed[:12]):
        best = max(((1 - lev(c, n) / max(len(c), len(n)), -i) for i, n in enumerate(names)), default=None)
        assert got[k] == (-best[1] if best[0] >= 0.85 else None)


def test_party_names_are_compared_once_however_often_they_come(spark):
    known = spark.createDataFrame([(f"SUPPLIER 00000{k}", 10 * k, k) for k in range(3)], "pn string, party_id long, ord long")
    found = invoice.similar_names(spark.createDataFrame([("SVPPLIER 000001",)], "rn string"), known, 0.85)
    assert {(r.pn, r.party_id) for r in found.collect()} == {("SUPPLIER 000000", 0), ("SUPPLIER 000001", 10), ("SUPPLIER 000002", 20)}
    parties = spark.createDataFrame([(100 * c + k, 1000 - 100 * c + k, f"Supplier 00000{k} Ltd", "X" if k == 2 else None) for c in range(9) for k in range(3)], "party_id long, ord long, name string, gstin string")
    rows = spark.createDataFrame([(n, f"Svpplier 00000{n % 3}", None) for n in range(30)] + [(30, "Supplier 000001", None), (31, "Supplier 000001", "X"), (32, "", None), (33, None, None)], "row_id long, name string, gstin string")
    got = {r.row_id: (r.party_id, r.matched_by) for r in invoice.match_parties(rows, parties).collect()}
    assert got == {n: (800 + n % 3, "name") for n in range(30)} | {30: (801, "name"), 31: (802, "gstin"), 32: (None, None), 33: (None, None)}


def test_solvers():
    assert solvers.signs(100, [10, 20], 90) == [1, -1]
    assert solvers.signs(100, [1] * 9, 109) is None
    assert solvers.chain(100.0, [([10.0], [110.0]), ([5.0], [105.0])])[1] == [(10.0, 110.0), (-5.0, 105.0)]
    assert solvers.chain(100.0, [([10.0, 16.0], [116.0])])[1] == [(16.0, 116.0)]
    assert solvers.align([1, 50], [2, 20, 51]) == [(0, 0), (1, 2)]
    assert solvers.chain_order([10, 30, 20], [20, 40, 30]) == [0, 2, 1]
    assert solvers.bands([0, 2, 4, 20]) == [0, 0, 0, 1]
    assert solvers.scan_distance("47", "17") == 0.1 and solvers.scan_distance("30.00", "0230.00") == 1.0 and solvers.scan_distance("14", "44") == 0.8
    assert {"48", "78", "16", "13"} <= set(solvers.variants("18")) and "4747" in solvers.variants("1111")


def test_signs_of_long_runs(spark):
    from itertools import product

    rng = random.Random(7)
    for n in [1, 2, 5, 9, 11]:
        amounts = [rng.randint(1, 3000) / 100 for _ in range(n)]
        for target in [sum(rng.choice((1, -1)) * a for a in amounts) + rng.choice((0, 0.3)), 1e6]:
            off = lambda c: abs(round(100 * target) - sum(s * round(100 * a) for s, a in zip(c, amounts)))  # noqa: B023, E731
            best = min(product((1, -1), repeat=n), key=off)
            assert solvers.nearest_signs(0, amounts, target) == (list(best) if off(best) <= 50 else None)
    assert solvers.nearest_signs(100, [0.2, 0.1], 99.9) == [-1, 1]  # not the first within 0.5
    rows = [(1, 0, 5.0, 100.0)] + [(1, k, float(2**k), None) for k in range(1, 10)] + [(1, 10, 1024.0, 100.0 + 1024 - sum(2**k for k in range(1, 10))), (1, 11, 3.0, None)]
    got = solvers.sign_runs(spark.createDataFrame(rows, "doc_id long, seq long, amount double, balance double")).orderBy("seq").collect()
    assert [(r.sign, r.flagged) for r in got] == [(1, True)] + [(-1, False)] * 9 + [(1, False), (1, True)]


def test_word_overlap_reads_whole_texts(spark):
    from ledgerloom.plans.check_queries import notes_of_next

    filler = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(1, filler + " paid in cash"), (2, "Paid in cash"), (3, filler), (4, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.repeats) for r in notes_of_next(docs).collect()} == {1: (3, True), 2: (200, False), 3: (0, False), 4: (0, False)}


def test_boxes_hold_all_lines_and_words(spark):
    from ledgerloom.plans.check_queries import whole_replies

    text = "a b c d e f g h\n\ni j\r\nk"
    docs = spark.createDataFrame([(2, text), (4, None)], "doc_id long, text string")
    got = readers.lines_from_json(whole_replies(docs)).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no, r.text) for r in got] == [(2, 0, "a b c d e f g h"), (2, 1, ""), (2, 2, "i j"), (2, 3, "k"), (4, 0, "")]


def test_readers_and_writers(spark, tmp_path):
    tsv = "level\tp\n" + "\t".join("5 1 1 1 1 1 10 20 30 40 90".split()) + "\tWord\n" + "\t".join("4 1 1 1 1 1 10 20 30 40 90".split()) + "\tno"
    got = readers.parse_word_table(spark.createDataFrame([(1, tsv)], "doc_id long, tsv string")).collect()
    assert [(r.left, r.text) for r in got] == [(10.0, "Word")]
    assert spark.range(1).select(readers.json_in_reply(F.lit('ok {"a": {"b": 1}} bye'))).first()[0] == '{"a": {"b": 1}}'
    sheets = {"a": spark.range(3), "empty": spark.range(0)}
    assert writers.write_sheets(sheets, str(tmp_path)) == {"a": 3}


# -- solvers against brute force -----------------------------------------------------


def plain_scan_distance(printed, read, i=0, j=0):
    """The same costs by plain recursion over both ends."""
    if i == len(printed):
        return (len(read) - j) * (0.5 if i == 0 else 1.0)
    options = [plain_scan_distance(printed, read, i + 1, j) + 1.0]
    if j < len(read):
        same = printed[i] == read[j]
        options.append(plain_scan_distance(printed, read, i + 1, j + 1) + (0.0 if same else solvers.CONFUSABLE.get(printed[i] + read[j], 1.0)))
        options.append(plain_scan_distance(printed, read, i, j + 1) + (0.5 if i == 0 else 1.0))
    return min(options)


def test_scan_distance_against_recursion():
    rng = random.Random(21)
    for _ in range(150):
        a, b = ("".join(rng.choice("14780.") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert solvers.scan_distance(a, b) == pytest.approx(plain_scan_distance(a, b)), (a, b)


def cheapest_passbook(opening, steps):
    """Every reading of every step, by recursion."""
    def best(k, balance):
        if k == len(steps):
            return 0.0
        step = steps[k]
        if step[0] == "checkpoint":
            mark = round(step[1] * 100)
            return (0.0 if abs(balance - mark) <= 1 else solvers.CHECKPOINT_RESET) + best(k + 1, mark)
        found = (solvers.DROP_WITHOUT if step[2] is None else solvers.DROP_WITH_BALANCE) + best(k + 1, balance)
        for v in solvers.variants(step[1]):
            for sign in (1, -1):
                to = balance + sign * round(float(v) * 100)
                cost = solvers.scan_distance(v, step[1])
                if step[2] is not None:
                    fits = [solvers.scan_distance(t, step[2]) for t in solvers.variants(step[2]) if round(float(t) * 100) == to]
                    if not fits:
                        continue
                    cost += min(fits)
                found = min(found, cost + best(k + 1, to))
        return found

    return best(0, round(opening * 100))


def test_passbooks_against_every_reading():
    rng = random.Random(22)
    for _ in range(25):
        balance, steps = 500, []
        for _ in range(4):
            amount = rng.randint(1, 99)
            balance += rng.choice([1, -1]) * amount
            read = f"{amount}.00".replace("4", "1") if rng.random() < 0.4 else f"{amount}.00"
            printed = None if rng.random() < 0.2 else f"{balance}.00"
            if printed and rng.random() < 0.2:
                printed = printed.replace("4", "1")
            steps.append(("checkpoint", float(balance + rng.choice([0, 0, 7]))) if rng.random() < 0.2 else ("row", read, printed))
        assert solvers.passbook(500.0, steps, width=10**6)[0] == pytest.approx(cheapest_passbook(500.0, steps)), steps
    assert solvers.passbook(100.0, [("row", "10.00", "110.00"), ("row", "5.00", "105.00")]) == (0.0, [(10.0, 110.0), (-5.0, 105.0)])
    assert solvers.passbook(100.0, [("row", "10.00", "110.00"), ("row", "99.00", "555.00"), ("checkpoint", 110.0)])[1] == [(10.0, 110.0), None, None]


def test_page_repair():
    assert solvers.repair_page(100.0, [("10.00", "110.00"), ("5.00", "105.00")]) == [(10.0, 110.0, "read"), (-5.0, 105.0, "read")]
    # 47 read as 17: the next row confirms 147
    assert solvers.repair_page(100.0, [("17.00", "147.00"), ("3.00", "150.00")]) == [(47.0, 147.0, "confirmed"), (3.0, 150.0, "read")]
    # nothing near fits: the printed balance is trusted
    assert solvers.repair_page(100.0, [("5.00", "222.00"), ("3.00", "225.00")]) == [(122.0, 222.0, "trusted"), (3.0, 225.0, "read")]


def test_balance_trail_and_dates():
    assert solvers.balance_trail([10, 110, 20, 30, 140, 120], 100) == [False, True, False, False, True, True]
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    assert solvers.resolve_dates([[days[3]], [days[1], days[4]], [], [days[2]], [days[5]]]) == [days[3], days[4], None, None, days[5]]
    rng = random.Random(23)
    for _ in range(50):  # greedy by hand
        rows, last = [[rng.choice(days) for _ in range(rng.randint(0, 3))] for _ in range(6)], None
        got = solvers.resolve_dates(rows)
        for row, pick in zip(rows, got):
            can = [d for d in row if last is None or d >= last]
            assert pick == (can[0] if can else None)
            last = pick or last


def test_alignment_against_every_pairing():
    rng = random.Random(24)

    def best(a, b):
        if not a or not b:
            return 10.0 * (len(a) + len(b))
        return min(best(a[1:], b[1:]) + abs(a[0] - b[0]), best(a[1:], b) + 10.0, best(a, b[1:]) + 10.0)

    for _ in range(60):
        a, b = (sorted(rng.randint(0, 60) for _ in range(rng.randint(0, 5))) for _ in range(2))
        pairs = solvers.align(a, b)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))
        cost = sum(abs(a[i] - b[j]) for i, j in pairs) + 10.0 * (len(a) + len(b) - 2 * len(pairs))
        assert cost == best(a, b)


def test_bands_against_all_lines():
    rng = random.Random(25)
    for _ in range(60):
        ys = sorted(rng.uniform(0, 40) for _ in range(30))
        lines = []
        for y in ys:  # the first line whose mean is near, of all lines
            k = next((k for k, line in enumerate(lines) if abs(y - sum(line) / len(line)) <= 3.0), None)
            lines.append([y]) if k is None else lines[k].append(y)
        assert solvers.bands(ys) == [k for k, line in enumerate(lines) for _ in line]


def test_sheets_are_written_once_and_read_back(spark, tmp_path):
    from ledgerloom.sources import writers

    sheets = {"a": spark.range(3), "empty": spark.range(0)}
    assert writers.write_sheets(sheets, str(tmp_path)) == {"a": 3} and not (tmp_path / "empty").exists()
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_sheets(sheets, str(tmp_path))


def all_paths(tokens, balance):
    """The cost and number of rows of every reading of a page, by trying every next row."""
    from ledgerloom.operators import passbooks

    split = passbooks.side_split(tokens)

    def go(at, balance, cost, rows):
        yield round(cost + passbooks.SKIP * (len(tokens) - at), 6), -rows
        for to, after, _, more, *_ in passbooks.steps(tokens, at, balance, split):
            yield from go(to, after, cost + more, rows + 1)

    return go(0, balance, 0.0, 0)


def test_passbook_pages_against_every_reading():
    from ledgerloom.operators import passbooks

    rng = random.Random(61)
    for k in range(150):
        balance, tokens = rng.choice((None, 5_000_00)), []
        now = balance or 5_000_00
        for _ in range(rng.randint(1, 3)):
            a, side = rng.randrange(100, 900_00), rng.choice((1, -1))
            now += side * a
            if rng.random() < 0.9:
                tokens.append((400.0 if side < 0 else 520.0, a, False))
            if rng.random() < 0.8:
                tokens.append((650.0, now + rng.choice((0, 0, 0, 3)), False) if rng.random() < 0.8 else (650.0, now - now % 100, True))
        cost, rows = passbooks.solve_page(tokens, balance)
        assert (cost, -len(rows)) == min(all_paths(tokens, balance)), (k, tokens)


def test_passbook_pages_read_clean_pages_exactly(spark):
    from ledgerloom.operators import passbooks

    rng, rows, want, balance = random.Random(62), [], [], 1000_00
    for page in range(3):
        rows.append((1, page, 0.0, 600.0, f"{balance / 100:.2f}"))
        rows.append((1, page, 0.0, 100.0, "Brought Forward"))
        for k in range(8):
            a = rng.randrange(100, 50_000)
            debit = balance > a and rng.random() < 0.5
            balance += -a if debit else a
            y = 100.0 * (k + 1)
            rows += [(1, page, y, 50.0, "01/02/2024"), (1, page, y, 100.0, "WORDS"), (1, page, y, 300.0 if debit else 450.0, f"{a / 100:.2f}"), (1, page, y, 600.0, f"{balance / 100:,.2f}")]
            want.append((page, k, f"{a / 100:.2f}" if debit else "None", "None" if debit else f"{a / 100:.2f}", f"{balance / 100:.2f}", True))
        rows += [(1, page, 900.0, 100.0, "Carried Forward"), (1, page, 900.0, 600.0, f"{balance / 100:.2f}")]
    df = spark.createDataFrame(rows, "doc_id long, page int, y double, x double, text string")
    got = [(r.page, r.place, str(r.withdrawal), str(r.deposit), str(r.balance), r.confirmed) for r in passbooks.solve_passbook_pages(df).orderBy("page", "place").collect()]
    assert got == want
    blurred = df.where("NOT (page = 1 AND x = 600.0 AND y BETWEEN 100 AND 800)")
    notes = {(r.page, r.note) for r in passbooks.solve_passbook_pages(blurred).where("place IS NULL").collect()}
    assert notes == {(1, "too blurred")}


@pytest.mark.parametrize("name", ["sol_01_solve_chains", "sol_04_page_repair", "sol_02_passbooks", "sol_01_page_tokens"])
def test_searches_are_handed_many_documents_at_once(spark, name):
    from compare import SF
    from ledgerloom.plans import catalog

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_plain_chains_are_what_the_whole_search_finds():
    rng, plain = random.Random(4), 0
    for _ in range(300):
        now, amounts, balances = rng.randint(0, 10**6), [], []
        opening = now / 100
        for _ in range(rng.randint(1, 12)):
            amounts.append(rng.choice([0, 1, rng.randint(1, 300), rng.randint(1, 10**7)]))
            now += rng.choice([1, -1]) * amounts[-1]
            balances.append(None if rng.random() < 0.2 else now + rng.choice([0] * 30 + [1, 1000]))
        read = [([a / 100], [] if b is None else [float(v) for v in solvers.single_swaps(f"{b / 100:.2f}")] if b >= 0 else [b / 100]) for a, b in zip(amounts, balances)]
        found = solvers.plain_chain(opening, amounts, balances)
        plain += found is not None
        assert found is None or found == solvers.chain(opening, read)[1]
    assert plain > 100


def test_readings_are_variants_with_their_distances():
    rng = random.Random(6)
    for text in ["1111.11", "111.4", "1471.17", "-31.14", *(f"{rng.randint(0, 10 ** rng.randint(1, 9)) / 100:.2f}" for _ in range(300))]:
        assert list(solvers.readings(text).items()) == [(v, solvers.scan_distance(v, text)) for v in solvers.variants(text)]


def test_bounded_page_search_is_the_whole_one():
    from ledgerloom.operators import passbooks as P

    rng = random.Random(8)
    for _ in range(60):
        now, tokens, opening = rng.randint(10**5, 10**7), [], None
        if rng.random() < 0.5:
            opening = now
        for _ in range(rng.randint(1, 5)):
            move = rng.randint(1, 10**5)
            now += move if rng.random() < 0.5 else -move
            tokens += [(rng.choice([400.0, 520.0]), move, False), (650.0, now + rng.choice([0, 0, 0, 100, 54321]), rng.random() < 0.1)]
        tokens = [t for t in tokens if rng.random() < 0.9]
        (cost, rows), (least, whole) = P.solve_page(tokens, opening), P._search(tokens, opening, P.side_split(tokens), P.BEAM, float("inf"))
        assert (cost, len(rows)) == (least, len(whole))
