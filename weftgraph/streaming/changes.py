"""Incremental analysis: a stream of changed files keeps a table of facts up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import extract
from weftgraph.operators.relational import first_wins
from weftgraph.sources import tree

CHANGES = "path string, content string, changed timestamp"


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of changed sources (path, content, changed) as they arrive; a null content is a deletion."""
    return spark.readStream.schema(CHANGES).parquet(folder)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path; ties: the larger content."""
    return first_wins(changes.where("path IS NOT NULL"), ["path"], [F.desc("changed"), F.desc_nulls_last("content")])


def keep_facts(changes: DataFrame, store: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Appends the facts of each batch's changed files to ``store`` as a version; ``current`` reads the latest of each path.

    A batch that is run again replaces its own version, so a restart changes nothing. Without ``every``
    all that is there is taken and the query ends.
    """

    def apply(batch: DataFrame, number: int) -> None:
        new = latest(batch).withColumn("lang", tree.language_column("path"))
        facts = extract.facts(new.where(F.col("content").isNotNull())).drop("lang")
        rows = new.select("path", "lang", "changed", F.col("content").isNull().alias("deleted")).join(facts, "path", "left")
        rows.write.mode("overwrite").parquet(f"{store}/batch={number:010d}")

    w = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The facts of every path as of the last batch, deleted ones left out."""
    rows = spark.read.parquet(store)
    return first_wins(rows, ["path"], [F.desc("batch"), F.desc("changed")]).where("NOT deleted").drop("batch", "deleted", "changed")


def language_rates(changes: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, lang, n): changes per window and language; what is later than ``late`` is left out."""
    langs = changes.withColumn("lang", tree.language_column("path")).withWatermark("changed", late)
    return langs.groupBy(F.window("changed", window), "lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "lang", "n")
