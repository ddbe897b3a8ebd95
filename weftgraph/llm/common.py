"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is unset, as in
    tests, a folder of this machine is made and named there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and drops its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again; ``release`` deletes it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # nothing reads the shuffles of a written table again
    df.write.option("compression", "zstd").parquet(path)
    spark.conf.set(_CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(kept: DataFrame, *settled: DataFrame) -> None:
    """Deletes the files of ``settled`` tables but for those that ``kept`` reads, and lets Spark drop shuffles that nothing refers to."""
    spark = kept.sparkSession
    still = set(kept.inputFiles())
    for df in settled:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()} - {f.rpartition("/")[0] for f in still}:
            delete(spark, folder)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder within the shared one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that would clash with ``names`` (Spark ignores their case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
