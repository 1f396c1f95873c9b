"""Operators that are sequential by nature: one call a document (or page), never the whole table.

A pandas call a document costs more than most searches, so ``by_document`` hands over many documents at once, each as a row of lists.
All keep the first of equal solutions, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Widths and costs of the searches.
BEAM, SKIP, MISREAD = 80, 1.0, 2.0
#: What it costs to read a printed digit as another one, by both digits, printed first.
CONFUSABLE = {
    "41": 0.1, "14": 0.8, "17": 0.5, "71": 0.5, "38": 0.4, "83": 0.4, "68": 0.4, "86": 0.4, "08": 0.4, "80": 0.4, "56": 0.4, "65": 0.4, "98": 0.4, "89": 0.4, "06": 0.4, "60": 0.4,
    "27": 0.5, "72": 0.5,
}
#: What a read 1 may stand for, all ones of a number at once, and in how many ones that is tried.
ONES, MOST_ONES = "147", 4


MISREADINGS: dict[str, list[tuple[str, float]]] = {}
for _pair, _cost in CONFUSABLE.items():
    MISREADINGS.setdefault(_pair[1], []).append((_pair[0], _cost))
ONE_COSTS = {p: CONFUSABLE.get(p + "1", 0.0) for p in ONES}


def by_document(rows: DataFrame, order: tuple[str, ...], columns: dict, solve: Callable, schema: str) -> DataFrame:
    """``solve`` of each document's ``order`` and ``columns`` (name to expression), as lists in order; it gives lists for the columns of ``schema`` after the first, ``doc_id``."""
    own = F.struct(*order, *(c.alias(name) for name, c in columns.items()))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("_rows")).select("doc_id", *(F.col("_rows")[c].alias(c) for c in (*order, *columns)))
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*((n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                found = solve(*lists)
                out[0] += [doc] * len(found[0])
                for x, y in zip(out[1:], found):
                    x += y
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=list(names))

    return docs.mapInArrow(run, schema)


def _text(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def single_swaps(number: str) -> list[str]:
    """A number as read, itself first, and what may have been printed if one digit is misread."""
    out = [number]
    for i, d in enumerate(number):
        out += [number[:i] + pair[0] + number[i + 1 :] for pair in CONFUSABLE if pair[1] == d]
    return list(dict.fromkeys(out))


def variants(number: str) -> list[str]:
    """NUM-08.  ``single_swaps``, and every choice of 1, 4 and 7 for the ones of a number that has few."""
    ones = [i for i, d in enumerate(number) if d == "1"]
    out = single_swaps(number)
    if len(ones) <= MOST_ONES:
        for choice in product(ONES, repeat=len(ones)):
            digits = list(number)
            for i, d in zip(ones, choice):
                digits[i] = d
            out.append("".join(digits))
    return list(dict.fromkeys(out))


def scan_distance(printed: str, read: str) -> float:
    """STR-09.  Edit distance from a printed number to what was read: a confusable digit costs what ``CONFUSABLE`` says, another edit 1, junk read in front of the number 0.5 a sign."""
    if len(printed) == len(read):
        # sign by sign; another way leaves out and puts in a sign at least, at 1.5 and more
        swaps = sum(CONFUSABLE.get(p + r, 1.0) for p, r in zip(printed, read) if p != r)
        if swaps <= 1.5:
            return float(swaps)
    costs = [0.5 * j for j in range(len(read) + 1)]
    for i, p in enumerate(printed, 1):
        above, costs = costs, [float(i)]
        for j, r in enumerate(read, 1):
            swap = 0.0 if p == r else CONFUSABLE.get(p + r, 1.0)
            costs.append(min(above[j] + 1, costs[j - 1] + 1, above[j - 1] + swap))
    return costs[-1]


def readings(number: str) -> dict[str, float]:
    """``variants`` of a number and the scan distance of each: their digits' costs, as ``scan_distance`` finds if these are 1.5 at most."""
    out = {number: 0.0}
    for i, d in enumerate(number):
        for p, cost in MISREADINGS.get(d, ()):
            out.setdefault(number[:i] + p + number[i + 1 :], cost)
    ones = number.split("1")
    if 1 < len(ones) <= MOST_ONES + 1:
        made = [(ones[0], 0.0)]
        for rest in ones[1:]:
            made = [(text + p + rest, cost + ONE_COSTS[p]) for text, cost in made for p in ONES]
        for text, cost in made:
            if text not in out:
                out[text] = cost if cost <= 1.5 else scan_distance(text, number)
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def align(a: list[float], b: list[float], gap: float = 10.0) -> list[tuple[int, int]]:
    """JOIN-13.  Pairs of two ordered lists at least total distance, in order, where leaving one out costs ``gap``."""
    n, m = len(a), len(b)
    cost = [[(i + j) * gap if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + abs(a[i - 1] - b[j - 1]), cost[i - 1][j] + gap, cost[i][j - 1] + gap)
    out, i, j = [], n, m
    while i and j:
        if cost[i][j] == cost[i - 1][j - 1] + abs(a[i - 1] - b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_frame(tokens: DataFrame) -> DataFrame:
    """JOIN-13 over ``doc_id``, ``side`` (0 or 1), ``place``, ``y``: matched places of both sides."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows.side == s].sort_values(["y", "place"]) for s in (0, 1))
        pairs = align(left.y.tolist(), right.y.tolist())
        return pd.DataFrame({"doc_id": [rows.doc_id.iloc[0]] * len(pairs), "left_place": [left.place.iloc[i] for i, _ in pairs], "right_place": [right.place.iloc[j] for _, j in pairs]})

    return tokens.groupBy("doc_id").applyInPandas(one, "doc_id long, left_place long, right_place long")


def signs(opening: float, amounts: list[float], closing: float, near: float = 0.5, most: int = 8) -> list[int] | None:
    """SOL-03.  Signs of at most ``most`` amounts that lead from one balance to another; the first found, credits first."""
    if len(amounts) > most:
        return None
    for choice in product((1, -1), repeat=len(amounts)):
        if abs(opening + sum(s * a for s, a in zip(choice, amounts)) - closing) <= near:
            return list(choice)
    return None


def nearest_signs(opening: float, amounts: list[float], closing: float, near: float = 0.5, most: int = 40) -> list[int] | None:
    """SOL-03.  Signs of all amounts that lead nearest to ``closing``, within ``near``; of equals the one with the earlier credits.

    Both halves' sums meet in the middle, in cents, so ``most`` amounts cost 2^(most/2).
    """
    if len(amounts) > most:
        return None
    cents, target = [round(a * 100) for a in amounts], round(closing * 100) - round(opening * 100)

    def sums(part: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for a in part:
            out = (out[:, None] + np.array([a, -a], np.int64)).ravel()
        return out

    def choice(k: int, n: int) -> list[int]:
        return [-1 if k >> (n - 1 - i) & 1 else 1 for i in range(n)]

    half = len(cents) // 2
    left = sums(cents[:half])
    right, first = np.unique(sums(cents[half:]), return_index=True)
    at = np.searchsorted(right, target - left)
    low, high = np.maximum(at - 1, 0), np.minimum(at, len(right) - 1)
    off = np.stack([np.abs(target - left - right[low]), np.abs(target - left - right[high])])
    places = np.stack([first[low], first[high]])
    best = off.min()
    if best > round(near * 100):
        return None
    i = int(np.flatnonzero((off == best).any(axis=0))[0])
    j = int(places[:, i][off[:, i] == best].min())
    return choice(i, half) + choice(j, len(cents) - half)


def sign_runs(ledger: DataFrame) -> DataFrame:
    """SOL-03 over a ledger: rows between two printed balances get the signs that explain the second.

    Runs that no signs explain, or that have no printed balance on a side, get a best
    effort and are ``flagged``: amounts are credits unless the row's balance says otherwise.
    """
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, run, last = rows.sort_values("seq"), [], [], None
        for r in rows.itertuples():
            run.append((r.seq, float(r.amount)))
            if pd.notna(r.balance):
                balance = float(r.balance)
                found = nearest_signs(last, [a for _, a in run], balance) if last is not None else None
                guess = [1] * len(run)
                if found is None and last is not None:
                    before = last + sum(a for _, a in run[:-1])
                    if edit_distance(f"{balance:.2f}", f"{before + run[-1][1]:.2f}") > 2:  # the balance is trusted, not the amount
                        guess[-1] = 1 if balance >= before else -1
                out += [(r.doc_id, s, a, k, found is None) for (s, a), k in zip(run, found or guess)]
                run, last = [], balance
        out += [(rows.doc_id.iloc[0], s, a, 1, True) for s, a in run]
        return pd.DataFrame(out, columns=["doc_id", "seq", "amount", "sign", "flagged"])

    return ledger.groupBy("doc_id").applyInPandas(one, "doc_id long, seq long, amount double, sign int, flagged boolean")


def plain_chain(opening: float, amounts: list[int], balances: list[int | None], width: int = BEAM) -> list[tuple[float, float]] | None:
    """The result of ``chain`` where every printed balance is explained by the figures as read; None where one isn't.

    No path can be cheaper than one that pays for missing balances only, and such paths stand before all others in the beam, so no others are needed.
    ``amounts`` and ``balances`` are in cents; offers are made in the order of ``chain``.
    """
    beam: list[tuple] = [(round(opening * 100), None)]
    for a, printed in zip(amounts, balances):
        grown: dict[int, tuple | None] = {}  # what is reached otherwise keeps its place
        for now, path in beam:
            for step in (a, -a):
                to = now + step
                if printed is not None and 0 < abs(to - printed) <= 1:
                    return None  # a variant may be a cent off
                if printed is None or to == printed:
                    if grown.get(to) is None:
                        grown[to] = ((step, to), path)
                else:
                    grown.setdefault(to, None)
            if printed is not None:
                grown.setdefault(printed, None)
        beam = [(to, path) for to, path in grown.items() if path is not None]
        if not 0 < len(beam) <= width:
            return None
    steps, path = [], beam[0][1]
    while path:
        steps.append((path[0][0] / 100, path[0][1] / 100))
        path = path[1]
    return steps[::-1]


def chain(opening: float, rows: list[tuple[list[float], list[float]]], width: int = BEAM) -> tuple[float, list[tuple[float, float]]]:
    """A beam search after SOL-01, on rows that have their one amount and balance already.  The cheapest reading of rows as (signed amount, balance) chains.

    Each row has candidate amounts and balances, likeliest first; a later candidate
    costs ``MISREAD`` times its place, a balance that the chain doesn't explain ``SKIP`` more.
    """
    # the beam: costs, balances in cents and (step, what came before), cheapest first
    costs, at, paths = np.zeros(1), np.array([round(opening * 100)], np.int64), [None]
    for amounts, balances in rows:
        amounts, balances = [round(a * 100) for a in amounts], [round(b * 100) for b in balances]
        place = {b: MISREAD * k for k, b in reversed(list(enumerate(balances)))}
        # what reaching a balance costs: as it stands, else a cent below or above a candidate
        near = {b + 1: c for b, c in place.items()} | {b - 1: c for b, c in place.items()} | place
        known = np.array(sorted(near), np.int64)
        price = np.array([near[x] for x in known.tolist()])

        def grow(tried: list[tuple[int, int]]) -> tuple:
            """Every state with every movement, then the printed balance as it stands, whatever the amount says: cost, balance, movement and state."""
            moves, more = np.array([m for _, a in tried for m in (a, -a)], np.int64), np.array([MISREAD * i for i, _ in tried for _ in "+-"])
            to = at[:, None] + moves
            c = costs[:, None] + more + 3 * MISREAD
            if len(known):
                k = np.minimum(np.searchsorted(known, to), len(known) - 1)
                c = costs[:, None] + more + np.where(known[k] == to, price[k], 3 * MISREAD)
            moves = np.broadcast_to(moves, to.shape)
            if balances:
                c = np.column_stack([c, costs + MISREAD + 4 * SKIP])
                to, moves = np.column_stack([to, np.full(len(at), balances[0])]), np.column_stack([moves, balances[0] - at])
            return c.ravel(), to.ravel(), moves.ravel(), np.repeat(np.arange(len(at)), to.shape[1])

        grown = grow(list(enumerate(amounts[:1])))
        if balances and grown[0].min() > costs[0]:  # only what isn't explained as it stands can be misread
            grown = [np.concatenate(x) for x in zip(grown, grow(list(enumerate(amounts))[1:]))]
        c, to, moves, state = grown
        if not len(c):
            continue
        # of each balance the cheapest, of equals the first; balances of equal cost in the order in which they were reached
        order = np.lexsort((c, to))
        heads = np.flatnonzero(np.diff(to[order], prepend=to[order[0]] - 1))
        best, first = order[heads], np.minimum.reduceat(order, heads)
        best = best[np.lexsort((first, c[best]))[:width]]
        costs, at = c[best], to[best]
        paths = [((m, b), paths[k]) for m, b, k in zip(moves[best].tolist(), at.tolist(), state[best].tolist())]
    steps, path = [], paths[0]
    while path:
        steps.append((path[0][0] / 100, path[0][1] / 100))
        path = path[1]
    return float(costs[0]), steps[::-1]


def solve_chains(ledger: DataFrame) -> DataFrame:
    """The search of ``chain`` over ``doc_id``, ``seq``, ``amount``, ``balance``, ``opening``: each row's amount and balance in the cheapest chain."""
    def cents(text: str | None) -> int | None:
        return None if text is None else round(float(text) * 100)

    def one(seq, amounts, balances, opening):
        path = None if None in amounts else plain_chain(opening[0], [cents(a) for a in amounts], [cents(b) for b in balances])
        if path is None:
            read = [[float(v) for v in single_swaps(a)] if a is not None else [] for a in amounts]
            seen = [[] if b is None else [float(b)] if b.startswith("-") else [float(v) for v in single_swaps(b)] for b in balances]
            _, path = chain(opening[0], list(zip(read, seen)))
        path += [(None, None)] * (len(seq) - len(path))
        return seq, [p[0] for p in path], [p[1] for p in path]

    columns = {"amount": _text("amount"), "balance": _text("balance"), "opening": F.col("opening").cast("double")}
    return by_document(ledger, ("seq",), columns, one, "doc_id long, seq long, signed double, balance double")


CHECKPOINT_RESET, DROP_WITH_BALANCE, DROP_WITHOUT = 8.0, 6.0, 2.0


def passbook(opening: float, steps: list[tuple], width: int = 60) -> tuple[float, list[tuple]]:
    """SOL-02.  The cheapest reading of a whole passbook: a beam over its balances.

    Steps: ("row", amount read, balance read or None) and ("checkpoint", balance): figures
    brought or carried forward.  A row moves the balance by a variant of its amount, up or down,
    to a variant of its printed balance (any balance if none is printed), at the scan
    distances of both; or it is dropped, which costs more where it has a balance.  At a
    checkpoint the balance stands, or is reset at a price.  Returns the cost and, by step, the
    signed amount and the balance after it (None for dropped rows and checkpoints).
    """
    beam = {round(opening * 100): (0.0, None)}  # balance in cents: cost, path
    for step in steps:
        grown: dict[int, tuple] = {}

        def offer(balance: int, cost: float, path: tuple) -> None:
            if balance not in grown or cost < grown[balance][0]:
                grown[balance] = (cost, path)  # noqa: B023

        if step[0] == "checkpoint":
            mark = round(step[1] * 100)
            for balance, (cost, path) in beam.items():
                offer(mark, cost + (0.0 if abs(balance - mark) <= 1 else CHECKPOINT_RESET), (None, path))
        else:
            amount, printed = step[1], step[2]
            moves = [(round(float(v) * 100), d) for v, d in readings(amount).items()]
            targets = None if printed is None else {round(float(v) * 100): d for v, d in reversed(readings(printed).items())}
            signed = [(step, d) for cents, d in moves for step in (cents, -cents)]
            by_step: dict[int, list] = {}
            for k, (step, d) in enumerate(signed):
                by_step.setdefault(step, []).append((k, step, d))
            for balance, (cost, path) in beam.items():
                offer(balance, cost + (DROP_WITHOUT if printed is None else DROP_WITH_BALANCE), (None, path))
                if targets is None:
                    for step, d in signed:
                        offer(balance + step, cost + d, ((step, balance + step), path))
                else:  # few movements lead to a variant of the balance; they are offered in their order
                    hits = by_step.keys() & {to - balance for to in targets}
                    for _, step, d in sorted(x for h in hits for x in by_step[h]):
                        offer(balance + step, cost + d + targets[balance + step], ((step, balance + step), path))
        beam = dict(sorted(grown.items(), key=lambda x: x[1][0])[:width])
    cost, path = min(beam.values(), key=lambda x: x[0])
    out = []
    while path:
        out.append(None if path[0] is None else (path[0][0] / 100, path[0][1] / 100))
        path = path[1]
    return cost, out[::-1]


def solve_passbooks(rows: DataFrame) -> DataFrame:
    """SOL-02 over ``doc_id``, ``seq``, ``kind`` (row or checkpoint), ``amount``, ``balance`` (text) and ``opening``: one call a document."""
    def one(seq, kinds, amounts, balances, opening):
        steps = [("checkpoint", float(b)) if k == "checkpoint" else ("row", a, b) for k, a, b in zip(kinds, amounts, balances)]
        _, found = passbook(opening[0], steps)
        return seq, [f[0] if f else None for f in found], [f[1] if f else None for f in found], [f is None and k == "row" for f, k in zip(found, kinds)]

    columns = {"kind": F.col("kind"), "amount": F.col("amount"), "balance": F.col("balance"), "opening": F.col("opening").cast("double")}
    return by_document(rows, ("seq",), columns, one, "doc_id long, seq long, signed double, balance double, dropped boolean")


def repair_page(opening: float, rows: list[tuple[str, str]]) -> list[tuple[float, float, str]]:
    """SOL-04.  Rows of a page (amount, balance as read) with the readings that fit: signed amount, balance, and how it was settled.

    A row that fits the balance before it stands ("read").  Else the cheapest variants of
    amount and balance that fit are taken if the next row as read confirms the balance
    ("confirmed"), else the printed balance is trusted and the amount is what it moved ("trusted").
    """
    def fits(before: int, amount: str, balance: str):
        for sign in (1, -1):
            if abs(before + sign * round(float(amount) * 100) - round(float(balance) * 100)) <= 1:
                return sign * round(float(amount) * 100), round(float(balance) * 100)
        return None

    out, now = [], round(opening * 100)
    for k, (amount, balance) in enumerate(rows):
        found, how = fits(now, amount, balance), "read"
        if found is None:
            printed = {round(float(b) * 100): (d, j) for j, (b, d) in reversed(list(enumerate(readings(balance).items())))}
            tries = []
            for i, (a, cost) in enumerate(readings(amount).items()):
                for signed in (round(float(a) * 100), -round(float(a) * 100)):
                    tries += [(cost + printed[to][0], i, printed[to][1], signed, to) for to in (now + signed - 1, now + signed, now + signed + 1) if to in printed]
            for *_, signed, to in sorted(tries):
                if k + 1 == len(rows) or fits(to, *rows[k + 1]):
                    found, how = (signed, to), "confirmed"
                    break
        if found is None:
            to = round(float(balance) * 100)
            found, how = (to - now, to), "trusted"
        now = found[1]
        out.append((found[0] / 100, now / 100, how))
    return out


def repair_pages(rows: DataFrame) -> DataFrame:
    """SOL-04 over ``doc_id``, ``seq``, ``amount``, ``balance`` (text) and ``opening``."""
    def one(seq, amounts, balances, opening):
        found = repair_page(opening[0], list(zip(amounts, balances)))
        return seq, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    columns = {"amount": F.col("amount"), "balance": F.col("balance"), "opening": F.col("opening").cast("double")}
    return by_document(rows, ("seq",), columns, one, "doc_id long, seq long, signed double, balance double, how string")


def balance_trail(values: list[float], opening: float, near: int = 5) -> list[bool]:
    """ROW-23.  Which of a mixed list of amounts are balances: those that the balance before and one waiting amount make up, within 0.05."""
    now, waiting, out = round(opening * 100), Counter(), []
    for v in values:
        cents = round(v * 100)
        hit = next((p for off in range(-near, near + 1) for p in (cents - now + off, now - cents + off) if p > 0 and waiting[p] > 0), None)
        out.append(hit is not None)
        if hit is None:
            waiting[cents] += 1
        else:
            waiting[hit] -= 1
            now = cents
    return out


def balance_trails(rows: DataFrame) -> DataFrame:
    """ROW-23 over ``doc_id``, ``seq``, ``value`` and ``opening``."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"doc_id": rows.doc_id, "seq": rows.seq, "is_balance": balance_trail(rows.value.astype(float).tolist(), float(rows.opening.iloc[0]))})

    return rows.groupBy("doc_id").applyInPandas(one, "doc_id long, seq long, is_balance boolean")


def date_choices(rows: DataFrame) -> DataFrame:
    """SOL-05 over ``doc_id``, ``seq`` and ``candidates`` (dates, likeliest first)."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"doc_id": rows.doc_id, "seq": rows.seq, "chosen": resolve_dates([list(c) for c in rows.candidates])})

    return rows.groupBy("doc_id").applyInPandas(one, "doc_id long, seq long, chosen date")


def chain_order(before: list[float], after: list[float]) -> list[int]:
    """WIN-22.  Rows in the order in which each one's balance is the next one's previous balance; rows that don't link follow in file order.

    Linear: a waiting row is looked at once.
    """
    start, end = [round(b * 100) for b in before], [round(a * 100) for a in after]
    waiting: dict[int, deque] = {}
    for i, b in enumerate(start):
        waiting.setdefault(b, deque()).append(i)
    ends, out, seen = set(end), [], set()
    for i in [*(i for i, b in enumerate(start) if b not in ends), *range(len(start))]:
        while i is not None and i not in seen:
            out.append(i)
            seen.add(i)
            queue = waiting.get(end[i], ())
            while queue and queue[0] in seen:
                queue.popleft()
            i = queue[0] if queue else None
    return out


def order_chains(ledger: DataFrame) -> DataFrame:
    """WIN-22 over ``doc_id``, ``seq``, ``before``, ``after``."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        order = chain_order(rows.before.astype(float).tolist(), rows.after.astype(float).tolist())
        return pd.DataFrame({"doc_id": rows.doc_id.iloc[order].tolist(), "seq": rows.seq.iloc[order].tolist(), "place": range(1, len(order) + 1)})

    return ledger.groupBy("doc_id").applyInPandas(one, "doc_id long, seq long, place long")


@F.pandas_udf(ArrayType(StringType()))
def variants_of(numbers: pd.Series) -> pd.Series:
    """NUM-08 over a column of amounts as text."""
    return numbers.map(variants)


@F.pandas_udf(DoubleType())
def scan_distances(printed: pd.Series, read: pd.Series) -> pd.Series:
    """STR-09 over two columns."""
    return pd.Series([scan_distance(a, b) for a, b in zip(printed, read)], dtype="float64")


def resolve_dates(candidates: list[list], start=None) -> list:
    """SOL-05.  The first candidate of each row that isn't before the last date chosen; else none."""
    out, last = [], start
    for row in candidates:
        pick = next((d for d in row if last is None or d >= last), None)
        out.append(pick)
        last = pick or last
    return out


def bands(ys: list[float], tolerance: float = 3.0) -> list[int]:
    """ROW-01 (exact).  Line of each of the sorted positions: the first band whose running mean is near, else a new one.

    Positions rise, so a band that one position is too far below is too far for all
    later ones, and only the newest is looked at.
    """
    out, line, total, n = [], -1, 0.0, 0
    for y in ys:
        if n and abs(y - total / n) <= tolerance:
            total, n = total + y, n + 1
        else:
            line, total, n = line + 1, y, 1
        out.append(line)
    return out


def lines_exact(tokens: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """ROW-01 with running means, over ``doc_id``, ``token_id``, ``y``."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "token_id"])
        return pd.DataFrame({"doc_id": rows.doc_id, "token_id": rows.token_id, "line": bands(rows.y.tolist(), tolerance)})

    return tokens.groupBy("doc_id").applyInPandas(one, "doc_id long, token_id long, line long")
