"""Quality rules under weak supervision, in native expressions only.

Six rules look at a document's counts and each votes "good", "bad" or abstains.
Expectation-maximisation learns, from nothing but how often each combination of
votes occurs, how each rule votes on good and on bad documents and how common good
documents are; a document's posterior probability of being good then replaces
"all rules must pass".

Shape of the job: one pass over the texts makes the counts (no shuffle; all of it
is array expressions inside a row); the combinations of votes are counted with
partial aggregation, at most 3 ** 6 rows whatever the input; the estimates are
made from those rows on the driver and go back as literals.

Defined results: a null text has no words, so it fails the base rules and is not
kept; rows with a null or repeated key are scored like any other; an empty table
gives no rows (the estimates then are the starting values).  Columns of the input
are only read by the names given, others never clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, words_of

#: Base rules (fixed by the caller's contract): least words, most repeated share.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Rounds of expectation-maximisation, and the pseudo-count behind each estimate.
ROUNDS, PSEUDO = 40, 1.0
#: Start: what is believed of a document without and with a vote against it.
START_CLEAN, START_BAD = 0.95, 0.1
#: Kept from this posterior probability on.
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_plain", "n_shouts")

#: name: (SQL for a vote against, SQL for a vote in favour).  Integers only, so that any engine votes alike.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "plain": ("10 * n_plain < 7 * n_words", "10 * n_plain >= 8 * n_words"),
    "upper": ("10 * n_upper > 3 * n_letters", "20 * n_upper <= 3 * n_letters"),
    "shouts": ("5 * n_shouts > n_words", "100 * n_shouts <= n_words"),
    "repeats": ("5 * n_repeat_words > n_words", "10 * n_repeat_words <= n_words"),
    "dup_lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0"),
}


def with_counts(df: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``df`` (all by default) and ``COUNTS`` of each text, under names with the prefix ``_q_``."""
    carry = df.columns if carry is None else carry
    kept = [F.col(f"`{c}`") for c in carry]
    base = df.select(*kept, F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("_q_text"))
    words = base.select(*kept, "_q_text", words_of(F.col("_q_text")).alias("_q_w"), F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_q_l"))
    grams = words.select(
        *kept, "_q_text", "_q_w", "_q_l",
        F.expr("CASE WHEN size(_q_w) >= 3 THEN transform(sequence(0, size(_q_w) - 3), i -> xxhash64(_q_w[i], _q_w[i + 1], _q_w[i + 2])) ELSE array() END").alias("_q_h"),
    )
    some = grams.select(
        *kept,
        F.size("_q_w").cast("long").alias("_q_n_words"),
        F.length(F.concat_ws("", "_q_w")).cast("long").alias("_q_word_chars"),
        F.regexp_count("_q_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("_q_n_symbols"),
        F.size("_q_l").cast("long").alias("_q_n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("_q_n_dup_lines"),
        F.regexp_count("_q_text", F.lit(r"[A-Z]")).cast("long").alias("_q_n_upper"),
        F.regexp_count("_q_text", F.lit(r"[A-Za-z]")).cast("long").alias("_q_n_letters"),
        F.regexp_count("_q_text", F.lit(r"(?<![^\x20\x09-\x0D])\p{L}+[.,]?(?![^\x20\x09-\x0D])")).cast("long").alias("_q_n_plain"),
        F.regexp_count("_q_text", F.lit("!")).cast("long").alias("_q_n_shouts"),
        # sorted (hash, place) pairs, only where some window occurs twice
        F.expr("CASE WHEN size(array_distinct(_q_h)) < size(_q_h) THEN sort_array(transform(_q_h, (h, i) -> struct(h, i))) END").alias("_q_s"),
    )
    places = some.withColumn(
        "_q_p",
        F.expr("sort_array(filter(transform(_q_s, (e, k) -> CASE WHEN e.h = get(_q_s, k - 1).h OR e.h = get(_q_s, k + 1).h THEN e.i END), i -> i IS NOT NULL))"),
    )
    covered = F.expr("CASE WHEN _q_s IS NULL THEN 0L ELSE aggregate(transform(_q_p, (x, k) -> CAST(least(3, coalesce(get(_q_p, k + 1) - x, 3)) AS BIGINT)), 0L, (a, x) -> a + x) END")
    return places.select(*kept, *(f"_q_{c}" for c in COUNTS if c != "n_repeat_words"), covered.alias("_q_n_repeat_words"))


def base_failed(prefix: str = "_q_") -> Column:
    return F.expr(f"{prefix}n_words < {MIN_WORDS} OR 100 * {prefix}n_repeat_words > {MAX_REPEATED_PERCENT} * {prefix}n_words")


def votes(prefix: str = "_q_") -> list[Column]:
    """One integer a rule: 1 in favour, -1 against, 0 to abstain."""
    def named(sql: str) -> str:
        return re.sub("|".join(rf"\b{c}\b" for c in COUNTS), lambda m: prefix + m[0], sql)

    return [F.expr(named(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")).alias(f"_v_{name}") for name, (bad, good) in RULES.items()]


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Share of good documents, and for each rule and vote the odds in favour that the vote stands for.

    ``patterns``: combinations of votes with their counts.  A rule's accuracy is
    estimated on each kind of document apart, as a rule that knows one kind of
    junk says little about the others.  No rule is taken for worse than chance:
    a vote against never speaks for a document.  Abstaining is no evidence.
    """
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    good = [START_BAD if -1 in v else START_CLEAN for v, _ in patterns]
    share, tables = 0.5, [{-1: 1.0, 1: 1.0} for _ in RULES]
    for _ in range(ROUNDS if total else 0):
        share = (sum(g * n for g, (_, n) in zip(good, patterns)) + PSEUDO) / (total + 2 * PSEUDO)
        tables = []
        for j in range(len(RULES)):
            mass = {v: [sum((g, 1 - g)[y] * n for g, (p, n) in zip(good, patterns) if p[j] == v) + PSEUDO for y in (0, 1)] for v in (-1, 1)}
            ratio = {v: mass[v][0] / (mass[-1][0] + mass[1][0]) / (mass[v][1] / (mass[-1][1] + mass[1][1])) for v in (-1, 1)}
            tables.append({-1: min(1.0, ratio[-1]), 1: max(1.0, ratio[1])})
        good = [posterior(share, tables, p) for p, _ in patterns]
    return share, tables


def posterior(share: float, tables: list[dict[int, float]], votes_: tuple[int, ...]) -> float:
    odds = share / (1 - share)
    for table, v in zip(tables, votes_):
        odds *= table[v] if v else 1.0
    return odds / (1 + odds)


def posterior_column(share: float, tables: list[dict[int, float]], columns: list[str]) -> Column:
    """The same in one native expression: a logistic function of summed evidence."""
    score = F.lit(math.log(share / (1 - share)))
    for table, c in zip(tables, columns):
        weight = {v: math.log(odds) for v, odds in table.items()}
        score = score + F.when(F.col(c) == 1, weight[1]).when(F.col(c) == -1, weight[-1]).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def judge(df: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and, with the prefix ``_q_``, counts, ``base_failed``, ``probability`` and ``kept`` of each row."""
    counted = with_counts(df, text_column, carry)
    voted = staged(counted.select("*", *votes(), base_failed().alias("_q_base_failed")), "quality-votes")
    names = [f"_v_{r}" for r in RULES]
    patterns = [(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect()]  # at most 3 ** 6 rows
    share, tables = estimate(patterns)
    scored = voted.withColumn("_q_probability", posterior_column(share, tables, names)).drop(*names)
    return scored.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_probability") >= THRESHOLD))


def keep_good(df: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    return judge(df, text_column).where("_q_kept").select(*(f"`{c}`" for c in df.columns))
