"""Passbook pages read as a chain of numbers: which of a page's number tokens are amounts and which are balances.

Pages are photographed, so columns can't be trusted: numbers are taken in reading order, and a row is an amount with the
balance that it makes of the one before, next to it.  A page is solved by a shortest path over
(token, balance): each step of a path explains some tokens as a row and leaves others out at a cost, so the
cheapest path explains most of the page.  Steps only go forward, so states are settled token by token.

A narrow search comes first: what it costs bounds the whole search, which then leaves out dearer states.

Pages of a document depend on each other by their last balance; a document is one call,
and its number of tokens is what that call holds.
"""

from __future__ import annotations

import math
from itertools import groupby
from operator import itemgetter, ne

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S
from ledgerloom.operators.solvers import by_document

#: Costs of a token left out, and of readings that aren't plain; how far amounts and balances are looked for; states kept a token.
SKIP, UNREAD_BALANCE, UNREAD_AMOUNT, CLOSE, ROUGH, CENTS_LOST, WRONG_SIDE, FIRST = 1.0, 0.8, 0.9, 0.8, 0.3, 0.4, 0.6, 0.5
AMOUNT_REACH, BALANCE_REACH, BEAM = 6, 4, 80
#: States a token of the search that bounds the costs.
NARROW = 3
#: A gap of so much between amounts' places parts debits from credits; amounts this large are balances.
SIDE_GAP, LARGE = 100, 10_000_000
#: A page with a larger share of unconfirmed rows isn't read; an unread balance needs an amount of at most this share of the one before.
MOST_UNCONFIRMED, MOST_MOVE = 0.4, 0.8


def digits_close(a: int, b: int, most: int = 2) -> bool:
    """Whether two amounts in cents are the same but for at most ``most`` digits, or one is the other with its start or end cut off."""
    x, y = str(a), str(b)
    if len(x) == len(y):
        return sum(map(ne, x, y)) <= most
    short, long = (x, y) if len(x) < len(y) else (y, x)
    return len(short) >= 3 and (long.startswith(short) or long.endswith(short))


def side_split(tokens: list[tuple[float, int, bool]]) -> float | None:
    """Where the page's amounts part: the middle of their widest gap; None if none is wide."""
    xs = sorted(x for x, cents, rough in tokens if not rough and cents < LARGE * 100)
    gaps = [(b - a, (a + b) / 2) for a, b in zip(xs, xs[1:]) if b - a >= SIDE_GAP]
    return max(gaps, key=lambda g: g[0])[1] if gaps else None


def steps(tokens: list[tuple[float, int, bool]], at: int, balance: int | None, split: float | None, most: float = math.inf):
    """What a row from token ``at`` on can be: (next token, balance, movement, cost, confirmed, note); rows that cost more than ``most`` may be missing."""
    n = len(tokens)
    debit = lambda i: None if split is None else tokens[i][0] < split
    between = lambda i, j: min(i, j) - at + abs(i - j) - 1

    for i in range(at, min(n, at + AMOUNT_REACH)):
        if SKIP * (i - at - 1) > most:
            break
        _, cents, rough = tokens[i]
        if rough or cents <= 0:
            continue
        balances = [j for j in range(at, min(n, i + BALANCE_REACH)) if j != i]
        if balance is None:
            # the first amount and its balance begin the chain; without a side it is a credit
            move = -cents if debit(i) else cents
            for j in balances:
                if not tokens[j][2]:
                    yield max(i, j) + 1, tokens[j][1], move, FIRST + SKIP * between(i, j), True, ""
            continue
        whole = cents - cents % 100
        readings = [(cents, 0.0)] + ([(whole, CENTS_LOST)] if cents % 100 and cents >= 10_000 else [])
        for amount, amount_cost in readings:
            for sign in (1, -1):
                expected = balance + sign * amount
                if expected < 0:
                    continue
                wrong = WRONG_SIDE if split is not None and debit(i) == (sign > 0) else 0.0
                found = False
                unread = SKIP * (i - at) + UNREAD_BALANCE + wrong
                for j in balances:
                    if unread > most and amount_cost + wrong / 2 + SKIP * between(i, j) > most:
                        continue
                    _, seen, seen_rough = tokens[j]
                    if seen_rough:
                        cost = ROUGH if expected // 100 == seen // 100 else None
                    else:
                        cost = 0.0 if seen == expected else CLOSE if digits_close(expected, seen) else None
                    if cost is None:
                        continue
                    found = True
                    sure = cost <= ROUGH or amount_cost > 0
                    yield max(i, j) + 1, expected, sign * amount, cost + amount_cost + wrong / 2 + SKIP * between(i, j), sure, "" if cost <= ROUGH else "balance misread"
                if not found and not amount_cost and amount <= MOST_MOVE * balance:
                    yield i + 1, expected, sign * amount, unread, False, "balance unreadable"
    if balance is not None:
        for j in range(at, min(n, at + BALANCE_REACH)):
            _, seen, rough = tokens[j]
            if not rough and seen != balance:
                yield j + 1, seen, seen - balance, SKIP * (j - at) + UNREAD_AMOUNT, False, "amount unreadable"


def solve_page(tokens: list[tuple[float, int, bool]], opening: int | None, width: int = BEAM) -> tuple[float, list[tuple]]:
    """SOL-01.  Cost and rows (first token after it, balance, movement, confirmed, note) of the cheapest reading; of equal ones that with more rows, then the one found first.

    ``tokens`` are (x, cents, whether the cents are missing) in reading order.
    """
    split = side_split(tokens)
    bound = _search(tokens, opening, split, NARROW, math.inf)[0]
    found = _search(tokens, opening, split, width, bound)
    return found if found[0] <= bound else _search(tokens, opening, split, width, math.inf)


def _search(tokens: list[tuple[float, int, bool]], opening: int | None, split: float | None, width: int, most: float) -> tuple[float, list[tuple]]:
    """``solve_page`` by states that cost ``most`` at most: costs only grow, so none of the others leads to a reading as cheap."""
    n = len(tokens)
    settled: list[dict] = [{} for _ in range(n + 1)]
    settled[0][opening] = (0.0, 0, None)  # cost, rows (negative), (token, balance before, row)
    best = None
    for at in range(n + 1):
        states = sorted(settled[at].items(), key=lambda s: s[1][:2])[:width]
        settled[at] = dict(states)
        for balance, (cost, rows, _) in states:
            end = (round(cost + SKIP * (n - at), 6), rows)
            if best is None or end < best[0]:
                best = end, at, balance
            for to, after, move, more, sure, note in steps(tokens, at, balance, split, most - cost + 1e-3):
                reach = (round(cost + more, 6), rows - 1)
                if reach[0] > most:
                    continue
                old = settled[to].get(after)
                if old is None or reach < old[:2]:
                    settled[to][after] = (*reach, (at, balance, (to, after, move, sure, note)))
    (cost, _), at, balance = best
    path = []
    while (link := settled[at][balance][2]) is not None:
        at, balance, row = link
        path.append(row)
    return cost, path[::-1]


def solve_document(pages: list[tuple[int, list, int | None, int | None]]) -> tuple[list[tuple], list[tuple]]:
    """Rows (page, place, movement, balance, confirmed, note) and findings (page, what) of a document's pages (page, tokens, brought forward, carried forward)."""
    rows, findings, balance = [], [], None
    for page, tokens, brought, carried in pages:
        if brought is not None and balance is not None and brought != balance:
            findings.append((page, "brought forward differs"))
        if not tokens:
            findings.append((page, "no readable amounts"))
            continue
        _, found = solve_page(tokens, balance if balance is not None else brought)
        if not found:
            findings.append((page, "no rows"))
            continue
        if sum(not sure for *_, sure, _ in found) > MOST_UNCONFIRMED * len(found):
            findings.append((page, "too blurred"))
            balance = carried
            continue
        rows += [(page, k, move, after, sure, note) for k, (_, after, move, sure, note) in enumerate(found)]
        balance = found[-1][1]
        if carried is not None and carried != balance:
            findings.append((page, "carried forward differs"))
    return rows, findings


def number_tokens(tokens: DataFrame) -> DataFrame:
    """SOL-01's input: of all tokens (``doc_id``, ``page``, ``y``, ``x``, ``text``) the numbers, with ``cents``, ``rough`` (a balance whose cents are missing) and ``mark`` of their line (brought or carried forward)."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ")
    lines = tokens.groupBy("doc_id", "page", "y").agg(line.alias("line"), F.collect_list(F.struct("x", "text")).alias("items"))
    mark = F.when(F.col("line").rlike(r"(?i)brough|balance\s*b\s*/"), "brought").when(F.col("line").rlike(r"(?i)carried|balance\s*c\s*/"), "carried")
    each = lines.select("doc_id", "page", "y", mark.alias("mark"), F.inline("items"))
    plain = F.regexp_replace("text", r"[,\s]", "")
    dated = plain.rlike(r"^\d{2}[./-]\d{2}[./-](\d{4}|\d{2})$")
    exact, rough = plain.rlike(r"^\d+\.\d{2}$") & ~dated, plain.rlike(r"^\d{5,7}$")
    return each.where(exact | rough).select("doc_id", "page", "y", "x", "mark", (plain.cast("decimal(20,2)") * 100).cast("long").alias("cents"), rough.alias("rough"))


def _money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast(S.MONEY)


def solve_passbook_pages(tokens: DataFrame) -> DataFrame:
    """SOL-01 over pages' raw tokens: ``doc_id``, ``page``, ``place``, ``withdrawal``, ``deposit``, ``balance``, ``confirmed``, ``note``; findings are rows without amounts, whose note says what was found."""
    schema = "doc_id long, page int, place int, move long, after long, confirmed boolean, note string"

    def one(page_of, _, x, marks, cents, rough):
        pages = []
        for page, own in groupby(zip(page_of, x, marks, cents, rough), key=itemgetter(0)):
            own = [t[1:] for t in own]
            numbers = [(x, c, r) for x, mark, c, r in own if mark is None]
            exact = sorted(x for x, _, r in numbers if not r)
            # whole numbers count only where amounts stand: others are cheques, years and references
            middle = exact[len(exact) // 2] if exact else math.inf
            at = lambda m: next((c for _, mark, c, r in reversed(own) if mark == m and not r), None)  # noqa: B023, E731
            pages.append((page, [t for t in numbers if not t[2] or t[0] > middle - 100], at("brought"), at("carried")))
        found, findings = solve_document(pages)
        made = found + [(page, None, None, None, False, what) for page, what in findings]
        return [list(c) for c in zip(*made)] or [[] for _ in range(6)]

    numbers = number_tokens(tokens)
    solved = by_document(numbers, ("page", "y", "x"), {c: F.col(c) for c in ("mark", "cents", "rough")}, one, schema)
    move = F.col("move")
    return solved.select("doc_id", "page", "place", _money(F.when(move < 0, -move)).alias("withdrawal"), _money(F.when(move > 0, move)).alias("deposit"), _money(F.col("after")).alias("balance"), "confirmed", "note")
