"""Rows from lines: parsing, splitting, carrying; fuzzy codes; what is left over for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.functions import scalar as S
from ledgerloom.operators import details as D
from ledgerloom.operators import pages as P

MONEY = "decimal(18,2)"


def _order():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _money(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast(MONEY)


def split_by_amounts(lines: DataFrame) -> DataFrame:
    """ROW-07.  Lines of a block (``block``, ``line_no``, ``n_amounts``) with the part they belong to: a line with an amount begins a new one once a part holds two.

    A block is a handful of lines, so its parts are counted inside one row.  ``whole``
    tells whether each part has one or two amounts; if not, the block isn't to be split.
    """
    block = lines.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("line_no", "n_amounts"))).alias("x"))
    start = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<line_no:bigint,part:int,n_amounts:bigint>>").alias("out"))

    def step(a, x):
        new = (a["held"] >= 2) & (x["n_amounts"] > 0)
        part = a["part"] + F.when(new, 1).otherwise(0)
        held = F.when(new, F.lit(0).cast("long")).otherwise(a["held"]) + x["n_amounts"]
        return F.struct(part.alias("part"), held.alias("held"), F.concat(a["out"], F.array(F.struct(x["line_no"].alias("line_no"), part.alias("part"), x["n_amounts"].alias("n_amounts")))).alias("out"))

    items = F.transform("x", lambda x: F.struct(x["line_no"].cast("long").alias("line_no"), x["n_amounts"].cast("long").alias("n_amounts")))
    rows = block.select("block", F.inline(F.aggregate(items, start, step, lambda a: a["out"])))
    inside = F.sum("n_amounts").over(Window.partitionBy("block", "part"))
    rows = rows.withColumn("_n", inside)
    return rows.select("block", "line_no", "part", F.bool_and(F.col("_n").between(1, 2)).over(Window.partitionBy("block")).alias("whole"))


def pending_narration(lines: DataFrame) -> DataFrame:
    """ROW-06.  Lines without a date between dated ones: text that a dated line without narration of its own is still waiting for goes to it, else to the line before."""
    dated = P.leading_date(F.col("text")).isNotNull()
    bare = dated & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike("[A-Za-z]{2}"))) == 0)
    w, back = _order(), Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({"_dated": dated, "_above": F.last(F.when(dated, F.col("line_no")), ignorenulls=True).over(w), "_below": F.last(F.when(dated, F.struct("line_no", bare.alias("bare"))), ignorenulls=True).over(back)})
    return rows.where("NOT _dated").select("doc_id", "line_no", F.when(F.col("_below.bare"), F.col("_below.line_no")).otherwise(F.col("_above")).alias("row_line"))


def glued_fragments(tokens: DataFrame, gap: float = 4) -> DataFrame:
    """ROW-09.  Tokens of a line (``doc_id``, ``line``, ``x``, ``width``, ``text``) that lie less than ``gap`` apart as one."""
    w = Window.partitionBy("doc_id", "line").orderBy("x", "token_id")
    new = F.when(F.col("x") - F.lag(F.col("x") + F.col("width")).over(w) < gap, 0).otherwise(1)
    rows = tokens.withColumn("_new", new).withColumn("piece", F.sum("_new").over(w))
    return rows.groupBy("doc_id", "line", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "token_id", "text"))), lambda t: t["text"]), "").alias("text"), F.count("*").alias("n_tokens"))


def card_sections(lines: DataFrame, section: Column, card: Column) -> DataFrame:
    """ROW-15.  Each line's section, carried down its page, and card, carried down the document."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    return lines.select("doc_id", "line_no", F.last(section, ignorenulls=True).over(page).alias("section"), F.last(card, ignorenulls=True).over(_order()).alias("card"))


def outside_furniture(lines: DataFrame) -> DataFrame:
    """ROW-20.  Lines between a page's heading and the first line that ends its rows; pages without a heading keep all lines up to that end."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heading, terminal = R.heading_line(F.col("text")), R.terminal_line(F.col("text"))
    head = F.max(F.when(heading, F.col("line_no"))).over(whole)
    end = F.min(F.when(terminal & (F.col("line_no") > F.coalesce(F.col("_head"), F.lit(-1))), F.col("line_no"))).over(whole)
    rows = lines.withColumn("_head", head).withColumn("_end", end)
    return rows.where("(_head IS NULL OR line_no > _head) AND (_end IS NULL OR line_no < _end)").select("doc_id", "page", "line_no", "text")


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """ROW-21.  Rows from a stream of cells (``doc_id``, ``seq``, ``column``, ``text``): a cell of the date column opens one, the others go to their column."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = cells.withColumn("row", F.sum(F.when(F.col("column") == "date", 1).otherwise(0)).over(w)).where("row > 0")
    pick = lambda c: F.min_by("text", F.when(F.col("column") == c, F.col("seq"))).alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == "particulars", F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("particulars")
    return rows.groupBy("doc_id", "row").agg(pick("date"), text, pick("amount"), pick("balance"))


def inline_rows(lines: DataFrame) -> DataFrame:
    """ROW-22.  Rows told by a reference and the value date behind it; a leading date that can't be read becomes the value date."""
    p = r"^\s*(\S+)\s+(.*?)\s*\b([A-Z0-9]{8,})\s+(\d{1,2}/\d{1,2}/\d{2,4})\b"
    rows = lines.select("doc_id", "line_no", *(F.regexp_extract("text", p, k).alias(n) for k, n in enumerate(("a", "particulars", "ref", "v"), 1))).where("ref <> ''")
    # bound by a lambda, the text that a date is read from stays one value wherever the filter is moved to
    read = lambda c: F.get(F.transform(F.array(c), lambda t: S.parse_date(t)), F.lit(0))
    rows = rows.withColumn("value_date", read("v")).where("value_date IS NOT NULL").withColumn("lead_date", read("a"))
    return rows.select("doc_id", "line_no", F.coalesce("lead_date", "value_date").alias("date"), "particulars", "ref", "value_date")


def recovered_balance(blocks: DataFrame) -> DataFrame:
    """ROW-26.  A block's balance from its first line, else its second, and where it came from."""
    p = r"([\d,]+\.\d{2})\s*(?i:cr|dr)\b"
    of = lambda c: _money(F.nullif(F.regexp_extract(c, p, 1), F.lit("")))
    rows = blocks.withColumns({"_1": of("line1"), "_2": of("line2")})
    return rows.select("doc_id", "block", F.coalesce("_1", "_2").alias("balance"), F.when(F.col("_1").isNotNull(), "row_start").when(F.col("_2").isNotNull(), "continuation").alias("source"))


def sub_tables(rows: DataFrame) -> DataFrame:
    """ROW-27.  Tables of a page: a new one at a heading, or at a date once balances were seen; the last date and balance carried in from the table before."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # whether the nearest earlier row that is a date or a balance is a balance
    last = F.last(F.when(F.col("kind").isin("date", "balance", "heading"), F.col("kind")), ignorenulls=True).over(before)
    new = (F.col("kind") == "heading") | ((F.col("kind") == "date") & (last == "balance"))
    marked = rows.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("table", F.sum("_new").over(w))
    marked = marked.withColumns({f"_{k}": F.last(F.when(F.col("kind") == k, F.col("value")), ignorenulls=True).over(before) for k in ("date", "balance")})
    return marked.groupBy("doc_id", "table").agg(F.count("*").alias("n"), F.min_by("_date", "seq").alias("date_before"), F.min_by("_balance", "seq").alias("balance_before"))


def code_by_prefix(rows: DataFrame, codes: list[tuple[str, ...]], most: int = 3) -> DataFrame:
    """JOIN-08.  The code whose words, put together, are within ``most`` edits of the first words of a text: one word fewer than the code's, as many, or one more.

    The longest text wins, then the fewest edits, then the first code.  Codes are the caller's short list.
    """
    words = F.split(F.upper(F.trim("text")), r"\s+")
    choices = []
    for k, code in enumerate(codes):
        for n in sorted({max(1, len(code) - 1), len(code), len(code) + 1}):
            compact = F.array_join(F.slice(words, 1, n), "")
            d = F.levenshtein(compact, F.lit("".join(code)))
            length = F.length(F.array_join(F.slice(words, 1, n), " "))
            choices.append(F.when((F.size(words) >= n) & (d <= most), F.struct((-length).alias("a"), d.alias("d"), F.lit(k).alias("k"), F.lit(" ".join(code)).alias("code"))))
    best = F.array_min(F.array_compact(F.array(*choices)))
    return rows.select("row_id", best["code"].alias("code"), best["d"].alias("edits"))


def nearest_word(token: Column, words: list[str], most: int = 2) -> Column:
    """JOIN-09.  The word within ``most`` edits of a token, the nearest, of equals the first; null if none."""
    t = F.upper(token)
    best = F.array_min(F.array(*(F.struct(F.levenshtein(t, F.lit(w)).alias("d"), F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(words))))
    return F.when(best["d"] <= most, best["w"])


def nearest_band(tokens: DataFrame, centres: list[tuple[str, float]]) -> DataFrame:
    """JOIN-02.  Each token's column: the one whose centre is nearest to its right edge, however far; of equals the first."""
    right = F.col("x") + F.col("width")
    best = F.array_min(F.array(*(F.struct(F.abs(right - c).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, c) in enumerate(centres))))
    return tokens.select("doc_id", "token_id", best["name"].alias("column"), best["d"].alias("distance"))


def fragments_to_amounts(fragments: DataFrame) -> DataFrame:
    """ROW-24.  Amount and balance of each row (``row_id``) from fragments in order: they are put together until an amount is whole, then the balance is; what follows is left."""
    parts = fragments.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"))
    start = F.struct(F.lit("").alias("amount"), F.lit("").alias("balance"))
    whole = lambda t: t.rlike(r"^[\d,]+\.\d{2}$")

    def step(a, x):
        first = ~whole(a["amount"])
        second = whole(a["amount"]) & ~whole(a["balance"])
        return F.struct(F.when(first, F.concat(a["amount"], x["text"])).otherwise(a["amount"]).alias("amount"), F.when(second, F.concat(a["balance"], x["text"])).otherwise(a["balance"]).alias("balance"))

    rows = parts.select("row_id", F.aggregate("x", start, step).alias("r"))
    return rows.select("row_id", _money(F.nullif(F.col("r.amount"), F.lit(""))).alias("amount"), _money(F.nullif(F.col("r.balance"), F.lit(""))).alias("balance"))


#: Labels of card summaries and the keys they stand for, likeliest first.
SUMMARY_LABELS = (("due", "total amount due|total dues|new balance"), ("minimum", "minimum amount due|minimum due"), ("limit", "credit limit"), ("previous", "previous balance|opening balance"), ("purchases", "purchases"), ("payments", "payments"))


def summary_fields(lines: DataFrame) -> DataFrame:
    """ROW-17.  Summary fields of card statements (``doc_id``, ``line_no``, ``text``): label and amount on a line, else the amount on the next line; the first hit of a key, labels by priority."""
    w = _order()
    rows = lines.withColumn("_next", F.lead("text").over(w))
    money = r"((?:\d{1,3}(?:,\d{2,3})+|\d+)\.\d{2})"
    hits = []
    for key, labels in SUMMARY_LABELS:
        for rank, label in enumerate(labels.split("|")):
            here = F.regexp_extract("text", rf"(?i)\b{label}\b\D*?{money}", 1)
            below = F.when(F.col("text").rlike(rf"(?i)\b{label}\s*:?\s*$"), F.regexp_extract(F.coalesce("_next", F.lit("")), rf"^\s*{money}", 1)).otherwise("")
            value = F.coalesce(F.nullif(here, F.lit("")), F.nullif(below, F.lit("")))
            hits.append(F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.lit(rank).alias("rank"), F.col("line_no"), value.alias("value"))))
    found = rows.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("doc_id", "h.*")
    return found.groupBy("doc_id", "key").agg(_money(F.min_by("value", F.struct("rank", "line_no"))).alias("amount"))


def right_edges(tokens: DataFrame, gap: float = 8, top: int = 3) -> DataFrame:
    """ROW-18.  Columns of a document: its largest clusters of right edges, named c1, c2, … from the left, each at its upper median."""
    w = Window.partitionBy("doc_id").orderBy("edge", "token_id")
    rows = tokens.select("doc_id", "token_id", (F.col("x") + F.col("width")).alias("edge"))
    rows = rows.withColumn("_n", F.when(F.col("edge") - F.lag("edge").over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_n").over(w))
    place, size = F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy("edge", "token_id")), F.count("*").over(Window.partitionBy("doc_id", "cluster"))
    rows = rows.withColumns({"_i": place, "n": size})
    medians = rows.where(F.col("_i") == F.floor(F.col("n") / 2) + 1).select("doc_id", "cluster", "n", "edge")
    best = medians.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "edge"))).where(F.col("_r") <= top)
    name = F.concat(F.lit("c"), F.row_number().over(Window.partitionBy("doc_id").orderBy("edge")).cast("string"))
    return best.select("doc_id", name.alias("column"), "edge", "n")
