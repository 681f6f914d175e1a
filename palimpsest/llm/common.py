"""Shared plumbing: inputs, durable intermediates, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = re.compile(SPACE.encode())
#: Rows that may be broadcast; beyond it the operators join by shuffle.
BROADCAST_ROWS = 200_000
#: Bits of a sieve, 8 MB.
SIEVE = 1 << 26


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in local mode, where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors and cuts the lineage; Spark writes it by
    its commit protocol, so that retried tasks leave no partial rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    # Its shuffle files go once it is written, so that they do not add up over the steps of an operator.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` made and nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, name)


def drop_path(spark: SparkSession, name: str) -> None:
    """Delete a folder of the shared file system with all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Let Arrow batches of this session hold fewer rows and bytes than by default: texts may be very long.

    Settings that are already below these stay as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; stops counting just beyond."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its checked row count allows it, else as it is."""
    return F.broadcast(df) if at_most(df, rows) else df


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A UTF-8 text cut at ASCII white space into parts of ``most`` bytes or less, or of one longer word."""
    at = 0
    while len(text) - at > most:
        # The last white space within reach, else the next one beyond it.
        cut = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t"))
        if cut <= at:
            found = SPACES.search(text, at + most)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    # Plain replacements and a split at one character are far cheaper than a split by a pattern.
    spaced = F.coalesce(c, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " ", -1), "")


def text_partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the width of every keyed exchange here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
