"""Readers of what recognisers and extractors write: word tables, word JSON, replies, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a recogniser's tab-separated word table.
WORD_TABLE = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
#: Line and word boxes as a remote recogniser's JSON has them.
WORD_JSON = "struct<ParsedText:string,TextOverlay:struct<Lines:array<struct<LineText:string,Words:array<struct<WordText:string,Left:double,Top:double,Height:double,Width:double>>>>>>"


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06.  Words (level 5, not blank) of tab-separated files."""
    rows = spark.read.schema(WORD_TABLE).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.where("level = 5 AND trim(text) <> ''").select("page_num", "left", "top", "width", "height", "text")


def parse_word_table(texts: DataFrame) -> DataFrame:
    """SRC-06 on whole texts (``doc_id``, ``tsv``)."""
    cells = texts.select("doc_id", F.posexplode(F.split("tsv", r"\r?\n")).alias("row_no", "row")).select("doc_id", "row_no", F.split("row", "\t").alias("c"))
    number = lambda k: F.get("c", F.lit(k)).try_cast("double")
    return cells.where((F.size("c") >= 12) & (F.get("c", F.lit(0)) == "5") & (F.trim(F.get("c", F.lit(11))) != "")).select(
        "doc_id", "row_no", number(6).alias("left"), number(7).alias("top"), number(8).alias("width"), number(9).alias("height"), F.get("c", F.lit(11)).alias("text")
    )


def lines_from_json(replies: DataFrame) -> DataFrame:
    """SRC-04, SRC-05.  Lines of recogniser replies (``doc_id``, ``reply``): from the boxes, else from the text."""
    r = F.from_json("reply", WORD_JSON)
    rows = replies.select("doc_id", r.alias("r"))
    boxed = F.transform("r.TextOverlay.Lines", lambda x: F.array_join(F.transform(x["Words"], lambda w: w["WordText"]), " "))
    plain = F.filter(F.split("r.ParsedText", r"\r?\n"), lambda x: F.trim(x) != "")
    lines = F.when(F.size("r.TextOverlay.Lines") > 0, boxed).otherwise(plain)
    return rows.select("doc_id", F.posexplode(lines).alias("line_no", "text"))


def json_in_reply(text: Column) -> Column:
    """SRC-14.  From the first ``{`` to the last ``}``."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def sniff(content: Column) -> Column:
    """SRC-11.  Kind of a file by its first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("504B0304"), "zip")
    )


def page_preflight(pages: DataFrame, least: int = 8, empty_share: float = 0.75) -> DataFrame:
    """SRC-03.  Of each document: pages, pages with text, whether it is empty, sparse, and how to read it."""
    sums = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if((F.col("chars") == 0) & ~F.col("has_image")).alias("empty"), F.count_if(F.col("chars") > 200).alias("texty"))
    sampled = F.least("pages", F.lit(least))
    return sums.select(
        "doc_id", "pages", "empty", (F.col("empty") >= empty_share * F.greatest(sampled, F.col("pages"))).alias("is_empty"), (F.col("texty") * 2 < F.col("pages")).alias("sparse"),
        F.when(F.col("texty") * 2 >= F.col("pages"), "text").when(F.col("pages") > 30, "local").when(F.col("pages") > 3, "split").otherwise("remote").alias("route"),
    )


def words_from_json(replies: DataFrame) -> DataFrame:
    """SRC-04.  Word boxes of recorded recogniser replies, in order."""
    r = F.from_json("reply", WORD_JSON)
    lines = replies.select("doc_id", F.posexplode(r["TextOverlay"]["Lines"]).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.posexplode("line.Words").alias("word_no", "w"))
    return words.select("doc_id", "line_no", "word_no", F.col("w.WordText").alias("text"), F.col("w.Left").alias("left"), F.col("w.Top").alias("top"))


def text_layer(pages: DataFrame, good: int = 200) -> DataFrame:
    """FLT-12, FLT-13.  Whether over ``good`` characters stand on half of a document's pages, and whether under half of them have any text."""
    s = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("chars") > good).alias("good"), F.count_if(F.col("chars") > 0).alias("some"))
    return s.select("doc_id", (F.col("good") * 2 >= F.col("pages")).alias("good_layer"), (F.col("some") * 2 < F.col("pages")).alias("sparse"))


def hybrid_pages(pages: DataFrame, recognised: DataFrame, least: int = 100) -> DataFrame:
    """SRC-08.  A page's own text if it has ``least`` characters, else what a recogniser read there, else its own again."""
    rows = pages.join(recognised.select("doc_id", "page", F.col("text").alias("_r")), ["doc_id", "page"], "left")
    own = F.length("text") >= least
    return rows.select("doc_id", "page", F.when(own | F.col("_r").isNull(), F.col("text")).otherwise(F.col("_r")).alias("text"), F.when(own | F.col("_r").isNull(), "text").otherwise("recognised").alias("source"))


def route(files: DataFrame) -> DataFrame:
    """SRC-09.  How a scanned file is read (``pages``, ``bytes``, ``cached``, ``has_key``): from the cache, locally, in parts, or remotely."""
    way = F.when(F.col("cached"), "cache").when((F.col("pages") > 30) | ~F.col("has_key"), "local").when((F.col("pages") > 3) | (F.col("bytes") > 1_200_000), "split").otherwise("remote")
    return files.select("doc_id", way.alias("route"))


def recorded_lines(replies: DataFrame, schema: str) -> DataFrame:
    """SRC-13.  Line items of recorded readings (``invoice_id``, ``reply``), typed by a schema with an array ``lineItems``."""
    rows = replies.select("invoice_id", F.from_json("reply", schema).alias("r"))
    return rows.select("invoice_id", F.posexplode("r.lineItems").alias("line", "i")).select("invoice_id", "line", "i.*")


def latest_readings(readings: DataFrame) -> DataFrame:
    """SRC-17.  The latest saved reading of each content, whoever saved it."""
    return readings.groupBy("content").agg(F.max_by("reading", F.struct("saved_at", "reading_id")).alias("reading"), F.count("*").alias("n_saved"))


def password_problem(message: Column) -> Column:
    """SRC-02.  What a reader's error message means for the caller; null without one."""
    m = F.lower(message)
    return F.when(m.contains("no password"), "password_required").when(m.contains("password"), "password_wrong").when(message.isNotNull(), "unreadable")


def typed_errors(replies: DataFrame) -> DataFrame:
    """SRC-21.  Typed values of recorded replies, and why one is missing."""
    raw = F.get_json_object("reply", "$.k")
    value = raw.try_cast("long")
    errors = F.when(raw.isNull(), "k: missing").when(value.isNull(), "k: not a number").otherwise("")
    return replies.select("event_id", value.alias("k"), errors.alias("errors"))


def invoices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recorded readings of files as typed rows; what doesn't fit stands in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
