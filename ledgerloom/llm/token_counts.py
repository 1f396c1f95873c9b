"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded where they are read and only counts by length are shuffled
(with partial aggregation), so that what moves is bounded by the number of
different lengths.  Suffix sums are taken in two levels, blocks of lengths and
lengths within a block, so that no task sees all lengths; the blocks' own sums are one
task's, of at most (longest text's length / ``BLOCK``) rows: 4 million for a text of a
billion tokens.

Defined results: a null or empty text has length 0; repeated rows and rows with null
keys count each time; an empty table gives an empty histogram; a text of any length
is counted whole; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.tokens import encode_frame

#: Lengths in a block of the two-level suffix sums.
BLOCK = 256


def length_histogram(df: DataFrame, path: str) -> DataFrame:
    """``n_tokens``, ``n_docs``: how many texts have each encoded length."""
    lengths = encode_frame(df, path, lambda keys, texts, ids: {"n_tokens": list(map(len, ids))}, "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row a length, with everything that a context limit of that length needs.

    ``docs_ge`` and ``tokens_ge`` count texts of at least the length and their
    tokens; ``docs_le`` those of at most the length (its share of all texts is
    the quantile that the length is); ``truncated_tokens`` is what remains when
    every text is cut at the length.
    """
    h = staged(histogram, "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    docs, tokens = F.col("n_docs"), F.col("n_docs") * F.col("n_tokens")
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum(docs).alias("d"), F.sum(tokens).alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("docs_all"),
        F.sum("t").over(whole).alias("tokens_all"),
    )
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "docs_all", "tokens_all",
        (F.col("docs_above") + F.sum(docs).over(here)).alias("docs_ge"),
        (F.col("tokens_above") + F.sum(tokens).over(here)).alias("tokens_ge"),
    )
    return sums.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("docs_all") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("tokens_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        "docs_all", "tokens_all",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``context``, ``docs_over``, ``truncated_tokens`` for any limits, also those that no text's length equals; one scan for all."""
    zero = F.lit(0).cast("long")

    def over(name: str, c: int):
        return F.coalesce(F.max(F.when(F.col("n_tokens") > c, F.col(name))), zero)

    answers = [
        F.struct(
            F.lit(int(c)).cast("long").alias("context"), over("docs_ge", c).alias("docs_over"),
            (F.coalesce(F.max("tokens_all"), zero) - over("tokens_ge", c) + c * over("docs_ge", c)).alias("truncated_tokens"),
        )
        for c in limits
    ]
    return sums.agg(F.array(*answers).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share``, ``n_tokens``: the least length that at least that share of the texts doesn't exceed; one scan for all."""
    answers = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_le") >= F.lit(q) * F.col("docs_all"), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*answers).alias("a")).select(F.inline("a"))
