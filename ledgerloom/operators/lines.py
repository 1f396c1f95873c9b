"""Operators on lines and positioned tokens of documents.

Lines: ``doc_id``, ``page``, ``line_no``, ``text``.  Tokens: ``doc_id``, ``token_id``, ``x``, ``y``, ``width``, ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar as S


def lines_of(documents: DataFrame, page_lines: int = 20) -> DataFrame:
    """SRC-05.  Lines of whole texts, in pages of ``page_lines``."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    return rows.select("doc_id", F.floor(F.col("line_no") / page_lines).cast("int").alias("page"), "line_no", "text")


def _in_doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def page_furniture(lines: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """FLT-09, AGG-21, STR-18.  Lines without those whose shape (digits as ``#``) stands on 60 % of at least 3 pages."""
    shaped = lines.withColumn("shape", S.digit_shape(F.col("text")))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = shaped.groupBy("doc_id", "shape").agg(F.count_distinct("page").alias("on_pages")).join(pages, "doc_id")
    drop = often.where((F.col("pages") >= least) & (F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share)))).select("doc_id", "shape")
    return shaped.join(drop, ["doc_id", "shape"], "left_anti").select("doc_id", "page", "line_no", "text")


def blocks(lines: DataFrame, starts) -> DataFrame:
    """ROW-02.  Rows from lines: each line for which ``starts`` holds opens one, the others are appended to it; lines before the first are dropped."""
    marked = lines.withColumn("block", F.sum(F.when(starts(F.col("text")), 1).otherwise(0)).over(_in_doc()))
    return marked.where("block > 0").groupBy("doc_id", "block").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


def blocks_before(lines: DataFrame, starts) -> DataFrame:
    """ROW-05, ROW-06.  As ``blocks`` where text precedes the line that dates it: a block ends with such a line."""
    back = Window.partitionBy("doc_id").orderBy(F.desc("line_no"))
    marked = lines.withColumn("block", F.sum(F.when(starts(F.col("text")), 1).otherwise(0)).over(back))
    return marked.where("block > 0").groupBy("doc_id", "block").agg(F.max("line_no").alias("last_line"), F.count("*").alias("n_lines"))


def sections(lines: DataFrame, header) -> DataFrame:
    """ROW-10, ROW-12, ROW-15.  Each line with the last header line above it (null before the first)."""
    h = F.last(F.when(header(F.col("text")), F.col("line_no")), ignorenulls=True).over(_in_doc())
    return lines.withColumn("header_line", h)


def split_merged(lines: DataFrame, marker: str) -> DataFrame:
    """ROW-08.  Lines cut before each match of ``marker`` (a pattern that takes some text); matches follow each other from the line's start and don't overlap."""
    found, gaps = F.regexp_extract_all("text", F.lit(marker), F.lit(0)), F.split("text", marker, -1)
    parts = F.concat(F.slice(gaps, 1, 1), F.transform(found, lambda m, k: F.concat(m, F.get(gaps, k + 1))))
    return lines.select("doc_id", "page", "line_no", F.posexplode(F.filter(parts, lambda t: t != "")).alias("part", "text"))


def two_columns(lines: DataFrame, middle: float) -> DataFrame:
    """ROW-14.  Reading order of two-column pages: a page's lines left of ``middle``, then the others."""
    w = Window.partitionBy("doc_id").orderBy("page", F.col("x") >= middle, "line_no")
    return lines.select("doc_id", "line_no", F.row_number().over(w).alias("place"))


def noise(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """FLT-01, FLT-02, FLT-03.  Lines that match none of the patterns, as one alternation."""
    return lines.where(~F.col("text").rlike("|".join(f"(?:{p})" for p in patterns)))


def nearest_column(tokens: DataFrame, bands: list[tuple[str, float, float]], tolerance: float = 70) -> DataFrame:
    """JOIN-01, JOIN-02.  Each token's column: the band whose left or right edge is nearest, within the tolerance; of equals the first.

    Bands are a literal of the caller's (a table's columns), so there is no join.
    """
    left, right = F.col("x"), F.col("x") + F.col("width")
    near = F.array(*(F.struct(F.least(F.abs(left - a), F.abs(right - b)).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, a, b) in enumerate(bands)))
    best = F.array_min(near)
    return tokens.select("doc_id", "token_id", F.when(best["d"] <= tolerance, best["name"]).alias("column"), best["d"].alias("distance"))


def interval_column(tokens: DataFrame, bands: list[tuple[str, float, float]]) -> DataFrame:
    """JOIN-03.  Each token's column by the interval ``[low, high)`` that holds its left edge; null outside all."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        out = F.when((F.col("x") >= low) & (F.col("x") < high), name).otherwise(out)
    return tokens.select("doc_id", "token_id", out.alias("column"))


def cluster(tokens: DataFrame, gap: float = 8) -> DataFrame:
    """ROW-01 (by gaps), AGG-18.  Lines of tokens: a new line where ``y`` leaps by over ``gap`` from the token before."""
    w = Window.partitionBy("doc_id").orderBy("y", "token_id")
    new = F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)
    return tokens.withColumn("_new", new).select("doc_id", "token_id", "x", "y", "text", F.sum("_new").over(w).alias("line"))


def line_texts(tokens: DataFrame, gap: float = 8) -> DataFrame:
    """ROW-01, SRT-02.  Text of each clustered line, left to right."""
    rows = cluster(tokens, gap)
    return rows.groupBy("doc_id", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "token_id", "text"))), lambda t: t["text"]), " ").alias("text"), F.count("*").alias("n_tokens")
    )


def largest_clusters(tokens: DataFrame, gap: float = 8, top: int = 3) -> DataFrame:
    """AGG-19.  The ``top`` clusters by size (then position), numbered from top to bottom."""
    sizes = cluster(tokens, gap).groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("y").alias("y0"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "y0"))
    return sizes.withColumn("_r", rank).where(F.col("_r") <= top).select("doc_id", "line", "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("y0")).alias("place"))


def widest_gap(tokens: DataFrame) -> DataFrame:
    """AGG-20.  The middle of the widest gap between neighbouring ``x``; of equals the leftmost."""
    xs = tokens.select("doc_id", "x").distinct().withColumn("before", F.lag("x").over(Window.partitionBy("doc_id").orderBy("x"))).where("before IS NOT NULL")
    return xs.groupBy("doc_id").agg(F.max_by((F.col("x") + F.col("before")) / 2, F.struct(F.col("x") - F.col("before"), -F.col("x"))).alias("threshold"))


def as_of(words: DataFrame, rows: DataFrame, slack: float = 20) -> DataFrame:
    """JOIN-05.  For each word the last row that begins at most ``slack`` below it: both on one line, the last row carried down."""
    both = words.select("doc_id", F.col("y").alias("at"), F.lit(1).alias("kind"), F.col("token_id").alias("id")).unionByName(
        rows.select("doc_id", (F.col("y") - slack).alias("at"), F.lit(0).alias("kind"), F.col("token_id").alias("id"))
    )
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("row_id", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(w)).where("kind = 1").select("doc_id", F.col("id").alias("token_id"), "row_id")


def midpoint_bands(words: DataFrame, rows: DataFrame) -> DataFrame:
    """JOIN-04.  For each word the row in whose band it lies; bands meet halfway between neighbouring rows."""
    w = Window.partitionBy("doc_id").orderBy("y", "token_id")
    low = rows.select("doc_id", F.coalesce((F.col("y") + F.lag("y").over(w)) / 2, F.lit(float("-inf"))).alias("y"), "token_id")
    return as_of(words, low, 0)
