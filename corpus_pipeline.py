"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadloom.llm import common, mixing, near, packing, quality, suffixes

#: op10 has 85; the stage links from 80 % on.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts are rejected; null ids and repeated rows are judged like others; an empty table stays
    empty; further columns are kept, whatever their names."""
    return quality.judge(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id: 5-word shingles, a similarity of 0.8
    or more.

    Texts without words are like nothing and stay; a null id counts as the largest; of repeated rows one stays; an empty
    table stays empty; further columns are kept."""
    return near.deduplicated(docs, NEAR_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of `suffixes.PASSAGE` bytes that occur more than once go, and so do documents without text left.

    Null and empty texts go; null ids and repeated rows are documents like others (their texts repeat each other); an
    empty table stays empty; n_chars follows the text, further columns are kept."""
    return suffixes.cleaned(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that tokens of the domains have their target weights.

    Texts without words have no tokens and the rate of an empty text; null ids and repeated rows are rows like others;
    without labels of two domains all rates are 1; an empty table stays empty; further columns are kept."""
    return mixing.mixed(docs, common.table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: the columns of `packing.pack`.

    A null or empty text is the end id alone; null ids and repeated rows are pieces like others; an empty table packs to
    an empty one; further columns don't reach the result."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("mixing", mixing_to_targets),
    ("best_fit_packing", best_fit_packing),
]
#: No stage but the first can be written in SQL; the tests hold all of them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next one."""
    root, docs = common.shared_dir(spark), common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.store(stage(spark, docs, sf_dir), f"{k}_{name}", root)
    return docs
