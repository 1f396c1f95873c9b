"""How five corpus filters interact, in all 120 orders, by the multilinear extension of what they remove.

A document fails a set of the filters (its mask).  For one part of the corpus (a language)
let ``n[m]`` be the number of documents with mask ``m``.  A document with mask ``m`` is
removed with probability ``1 - prod(1 - x_i, i in m)`` if filter ``i`` runs with probability
``x_i``; summed over all documents that is one multilinear polynomial, the *removal
polynomial* of the part.

* At a corner (every ``x_i`` 0 or 1) it counts what that set of filters removes, so
  survivors, and what a step removes, are differences of corner values.
* The integral over the diagonal of its derivative by ``x_i`` is filter ``i``'s Shapley value.
  It is taken with exact rationals and scaled by 120, which makes it the sum over all orders.

Good documents lost and toxic documents lost are corner differences of the polynomials
that only good or only toxic documents form.

How it is spread: masks are native expressions over whole texts, one pass.  What leaves
that pass is one narrow row a document.  Copies meet by 128 bits of their SHA-256; rows of
equal text, part and labels are counted before they meet the text's first document, so
a text that a third of all rows have is a few rows there.  A part has at most 128 counts
when its polynomials are formed, each part in a task of its own.

Defined results: a null text is an empty one, a null part the empty string; an empty text
fails A and, if it isn't the first, E; a text without words doesn't fail B.  A null key is
smaller and larger than none: such a row never fails E, nor makes another fail it.  Repeated
rows are documents each and, as their keys are equal, not each other's copies.  Of several
labels for a key any that says good or toxic counts; labels with null keys are left out.
An empty table gives no rows.  Texts of any length are read whole.  Only the named columns
are read, so others may have any names.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_ids

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
ALL = range(1 << len(FILTERS))
ORDERS = 120

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A, B, C and D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT_PERCENT * F.size(words).cast("long"),
        100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
        text.rlike(SIGNS),
    )
    bits = [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def marked(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``part``, ``own`` (bits A to D), ``good``, ``toxic``, ``key``, ``t1``, ``t2`` (the text's class) of every document."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    t1, t2 = text_ids(whole)
    narrow = docs.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{key}`").alias("key"), own_failures(whole).alias("own"), t1.alias("t1"), t2.alias("t2"))
    said = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return narrow.join(said, "key", "left").select(*narrow.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def mask_counts(rows: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``good``, ``toxic``, ``n``: documents by what they fail, copies (E) found by the first key of each text."""
    kind, text = ["part", "own", "good", "toxic"], ["t1", "t2"]
    same_key = rows.groupBy(*text, *kind, "key").agg(F.count("*").alias("n"))
    alike = same_key.groupBy(*text, *kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("nulls"), F.min("key").alias("least"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("at_least")
    )
    first = alike.groupBy(*text).agg(F.min("least").alias("first"))
    # rows that aren't copies: those of the text's least key, and those without a key
    fresh = F.coalesce(F.when(F.col("least") == F.col("first"), F.col("at_least.n")), F.lit(0)) + F.coalesce("nulls", F.lit(0))
    both = alike.join(first, text).select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), fresh.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - fresh).alias("n")))).alias("x"))
    counted = both.groupBy("part", (F.col("own") + F.col("x.e")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))
    return counted.where("n > 0")


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients by set of variables, of the sum over masks of ``n[m] * (1 - prod(1 - x_i, i in m))``."""
    out: dict[int, int] = {}
    for s in ALL[1:]:
        holding = sum(n for m, n in counts.items() if m & s == s)
        if holding:
            out[s] = holding if s.bit_count() % 2 else -holding
    return out


def at_corner(polynomial: dict[int, int], chosen: int) -> int:
    """The polynomial's value where the chosen variables are 1 and the others 0."""
    return sum(a for s, a in polynomial.items() if s & ~chosen == 0)


def shapley_value(polynomial: dict[int, int], variable: int) -> Fraction:
    """The integral, over the diagonal from 0 to 1, of the derivative by a variable: a term with ``k`` variables gives ``a * t ** (k - 1)``."""
    return sum((Fraction(a, s.bit_count()) for s, a in polynomial.items() if s & variable), Fraction(0))


def part_report(counts: list[tuple[int, bool, bool, int]]) -> list[tuple]:
    """All orders and steps of one part from its ``(mask, good, toxic, n)``: ``RESULT`` without ``part``."""
    kinds: list[dict[int, int]] = [{}, {}, {}]
    for mask, good, toxic, n in counts:
        for kind, counts_in in zip(kinds, (True, good, toxic)):
            if counts_in:
                kind[mask] = kind.get(mask, 0) + n
    total = sum(kinds[0].values())
    removal, of_good, of_toxic = map(removal_polynomial, kinds)
    gone, gone_good, gone_toxic = ([at_corner(p, s) for s in ALL] for p in (removal, of_good, of_toxic))
    scaled = [ORDERS * shapley_value(removal, 1 << k) for k in range(len(FILTERS))]
    alone = [kinds[0].get(1 << k, 0) for k in range(len(FILTERS))]
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            removed = gone[after] - gone[before]
            out.append((
                "".join(FILTERS[x] for x in order), step, total - gone[after], removed, gone[1 << k] - removed, alone[k],
                gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], int(scaled[k]),
            ))
            before = after
    return out


def audit(counts: DataFrame) -> DataFrame:
    """``RESULT``: 600 rows for each part of ``mask_counts``."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def report(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = part_report([tuple(x) for x in rows[["mask", "good", "toxic", "n"]].itertuples(index=False)])
        return pd.DataFrame(made, columns=names[1:]).assign(part=part[0])[names]

    return counts.groupBy("part").applyInPandas(report, RESULT)
