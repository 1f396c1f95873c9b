"""A corpus pipeline: score, judge, drop near copies, cut repeats, pack.

Each stage is a function of the session, the documents that the stage before kept, and
the folder of the tables; its result is written as Parquet and read as the next stage's
documents.  All but the last return the columns of ``documents``.

Defined results: null texts are empty texts to every stage (the quality rules drop them,
as they have no words); rows with null or repeated keys are rows like any others; an
empty table stays empty; texts of any length are read whole; columns that ``documents`` doesn't
have by default are kept by all stages but the last, whatever their names (but ``_q_``,
``_c_``, ``_s_`` and ``_d_...``, which the operators use).

What a stage stages in the shared folder is deleted when a later stage begins, if no
table that somebody still holds can read it; so results may be lazy, used twice and in any
order, and runs don't disturb each other.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import near_copies, packing, quality_classifier, quality_rules, suffix_dedup
from ledgerloom.llm.common import documents, staged, sweep
from ledgerloom.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from labels outside fold 1, takes for good."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more (5-word shingles) connect."""
    return near_copies.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur elsewhere too."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of one length."""
    return packing.pack(docs, vocabulary())


def _stage(work):
    """The stage; what earlier ones have staged is deleted first, where no table that somebody holds can read it."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark)
        return work(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _stage(classify)),
    ("quality rules", _stage(apply_rules)),
    ("simhash near-dedup", _stage(drop_near_copies)),
    ("suffix-array dedup", _stage(cut_repeats)),
    ("packing", _stage(pack)),
]

#: Near-copy components, suffix sorts and trained networks are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
