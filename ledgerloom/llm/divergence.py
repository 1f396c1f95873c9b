"""How the sources of a language differ in their words: exact divergences of pairs of sources, and each source's own terms.

Plain relational work: texts' terms are exploded and counted; each language keeps the terms
of at least ``LEAST_DOCS`` of its documents; every source of a language is crossed with the
language's kept terms, so that a term which a source lacks has a count of 0 there; from
counts ``c`` of a total ``N`` over ``V`` kept terms come shares of a thousand million,
``p = 1 + floor(SCALE * (c + 1) / (N + V))``; and the dense table is joined with
itself on language and term.  ``floor((p - q) ** 2 / q)``, ``p`` a source's share and
``q`` another's, summed over all kept terms, is how far the source is from the other;
``q`` the language's, it is how much a term tells the source from its language.

How it is spread
* A text's terms are read once and give one row an occurrence and one a different term,
  both counted before they are shuffled; what is shuffled is a row a task, source and term.
* Counts and kept terms are staged, so a lost executor costs no reading of texts.
* Kept terms lie by (language, term), each with the few counts of its sources; the cross
  with the sources and the self-join stay in these partitions, so a language that has most
  of all terms is spread like any other, and no dense row is shuffled.  A pair of
  sources meets once (``i < j``) for both directions, and sums are partial ones there.
* Ranks up to ``TOP`` are cut in each task before the rows of a source meet.
The dense table has (sources x kept terms) rows a language, which is what the audit asks
for; sources of one language are thought to be at most some thousands.

Defined results: null texts, languages and sources are empty strings, and empty strings
are a language and a source; a text without a term counts nothing, its source still takes part;
a language without kept terms has pairs of value 0 and no terms; a language of one source
has no pairs; repeated rows are documents each; null and repeated keys don't matter, as
no key is read; an empty table gives no rows; texts of any length are read whole; only the
named columns are read, so others may have any names.  Ties are ranked by the item's UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

#: What lies between terms; a term is a run of letters A to Z of either case and of anything beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """A text's terms in order; only A to Z are made lower case.  Splitting finds them at a fraction of what extracting each costs."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents that have it)."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    read = docs.select(*named, terms(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("all"))
    both = read.select("lang", "source", F.inline(F.array(F.struct(F.lit(0).alias("once"), F.col("all").alias("found")), F.struct(F.lit(1).alias("once"), F.array_distinct("all").alias("found")))))
    each = both.select("lang", "source", "once", F.explode("found").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(F.lit(1) - F.col("once")).cast("long").alias("n"), F.sum("once").cast("long").alias("docs"))


def kept_terms(counts: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``n``, ``by_source`` (source to count): the terms of at least ``LEAST_DOCS`` documents of a language."""
    found = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return found.where(F.col("docs") >= LEAST_DOCS).drop("docs")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)``, exact whatever the counts."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", up, total.cast("decimal(20,0)")) + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, counts: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``i`` (its number in the language), ``total`` and ``all_total`` (what counts of the source and of the language are shares of)."""
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    there = docs.select(*named).distinct()
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("v"))
    sums = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    out = there.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return out.select("lang", "source", number.alias("i"), (F.coalesce("n", F.lit(0)) + v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + v).alias("all_total"))


def dense_shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``i``, ``n``, ``p``, ``q``: every source of a language with every kept term, counts of 0 included."""
    count = F.coalesce(F.element_at("by_source", F.col("source")), F.lit(0))
    crossed = kept.withColumnRenamed("n", "lang_n").join(groups, "lang").select("lang", "term", "i", "lang_n", "total", "all_total", count.alias("n"))
    return crossed.select("lang", "term", "i", "n", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("all_total")).alias("q"))


def pair_values(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` of all ordered pairs of sources of a language."""
    one, other = dense.select("lang", "term", "i", "p"), dense.select("lang", "term", F.col("i").alias("j"), F.col("p").alias("q"))
    met = one.join(other, ["lang", "term"]).where("i < j")
    sums = met.groupBy("lang", "i", "j").agg(F.sum(excess(F.col("p"), F.col("q"))).alias("there"), F.sum(excess(F.col("q"), F.col("p"))).alias("back"))
    ways = F.array(F.struct("i", "j", F.col("there").alias("value")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("value")))
    both = sums.select("lang", F.inline(ways))
    a, b = groups.select("lang", "source", "i"), groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = a.join(b, "lang").where("i <> j").join(both, ["lang", "i", "j"], "left")
    return pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def term_values(dense: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` of the terms that a source has more often than its language."""
    over = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "i", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    return over.join(groups.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: all pairs of a language's sources, and each source's ``top`` terms."""
    counts = staged(term_counts(docs, text, lang, source), "term-counts")
    kept = staged(kept_terms(counts), "kept-terms")
    groups = staged(groups_of(docs, counts, kept, lang, source), "source-groups")
    dense = dense_shares(kept.repartition("lang", "term"), groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(dense, groups).withColumn("rank", rank)
    own = term_values(dense, groups).withColumn("rank", rank).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(own, "term"))
