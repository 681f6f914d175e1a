"""Cutting long lineages where executors may be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only in local mode, as in tests, where none is set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there.

    Spark plans what follows with the table's true size; the estimate that a checkpoint
    carries along would be squared by every join of an iteration. The files go when the
    driver ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``checkpointed`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(name)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
