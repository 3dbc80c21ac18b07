"""The corpus pipeline: quality rules, toxicity, near-duplicates, benchmark passages, packing.

``STAGES`` lists (name, function) pairs; each function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which is written as Parquet and read again as the next one's documents.

Rows out of the ordinary have these results: quality rules drop null, empty and wordless texts, as they are too
short; given any, toxicity scores them like a text without toxic words, near-duplicates keep every null text and one of
equal others, decontamination keeps them, and packing makes them the one token that ends a document. Null languages are
held against the nearest reference. Repeated rows fall together among near-duplicates and are kept each elsewhere.
Empty tables give empty results. Columns come out as they came in, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, neardup, packing, quality, toxicity
from tidelog.llm.common import WRITTEN, materialise, table, tidy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or diverge from their language."""
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the field learns from labelled rows of its input."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]
#: No stage's model or hash can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    When a stage is written, what it and the one before have left in the shared folder is removed.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES:
        mark = len(WRITTEN)
        docs = materialise(stage(spark, docs, sf_dir))
        tidy(spark, [*before, *WRITTEN[mark:-1]])
        before = WRITTEN[-1:]
    return docs
