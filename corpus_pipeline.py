"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
adds ``copy_no``. What a stage doesn't reject stays as it is, null ids and null texts included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import common, decontam, minhash, mixing, suffix, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier of ``labels`` rejects. Null, empty and blank texts stay, as do all where a class has fewer than three labels."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Null, empty and wordless texts and rows with a null id stay; rows that repeat an id stay or go together."""
    return minhash.drop_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that occur before. Rows stay, also those of which nothing is left; null ids are left alone."""
    return suffix.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item, exact or edited. Null and empty texts and rows with a null id stay."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out towards the square roots of the sources' sizes, with ``copy_no``. Null sources are one source; null ids come first."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage returns is written to the shared folder and read again by the next, and deleted when that is written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the trained classifier nor the approximate stages; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
