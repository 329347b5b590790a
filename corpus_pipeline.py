"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir).  A stage's result is written
as Parquet and read again as the next one's docs; all but the last return the
columns of ``documents``.

In every stage texts of any length are worked on whole, an empty table gives no
rows, and columns besides doc_id, text, lang and source pass through, whatever
their names (but for names that begin with two underscores).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veiltrack.llm import decontaminate, exact_dedup, jaccard_join, language_id, mixing
from veiltrack.llm.shared import shared_folder, stored
from veiltrack.session import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, go.

    Null text has no letter; null lang and null doc_id don't matter; repeated
    rows stay or go together.
    """
    ship_package(spark)
    return language_id.drop_unknown(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text is the empty text; a null doc_id is smaller than any other; of
    rows that repeat doc_id and text one stays.
    """
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one with the smallest doc_id stays.

    Documents without words, or of null text, are linked with nothing and stay;
    a null doc_id is larger than any other; rows that repeat the doc_id and
    text that stay do so as well.
    """
    ship_package(spark)
    return jaccard_join.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows over one in twenty of their words go.

    Null text has no words, so it stays; rows are judged one by one.
    """
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with size, source_size, target, copy and taken.

    Documents of size 0, and so those of null text, are never taken; null
    sources are one source; rows that agree share their copies; a column by the
    name of one that is added gives way to it.
    """
    ship_package(spark)
    return mixing.take_mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix),
]

#: SQL expresses neither the language model nor the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage{number}")
    return docs
