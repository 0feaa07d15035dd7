"""What the library needs from a session: a shared folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local temporary one only for a local session without it."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kappaframe-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that is written once and read back."""
    return f"{shared_folder(spark).rstrip('/')}/kappaframe/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame) -> DataFrame:
    """The same table under new column identities, so that it can meet another table grown from the same rows."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def cut_lineage(df: DataFrame) -> DataFrame:
    """`written` under a common name. Spark takes the size from the files, so its own limit decides on a broadcast."""
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet below the shared folder and reads it back: no lineage, sizes known from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by `written` that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch while tables with heavy rows are written; the setting before comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of a query that begins meanwhile go when it ends, not when the driver happens to collect its garbage.
    For code that writes its tables and reads them back, so that no query reads shuffles of another."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


TEXT_ROWS, TEXT_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by TEXT_ROWS rows and TEXT_BYTES bytes for queries on whole texts: a batch stands in
    the JVM and in Python at once. A longer text is a batch of its own. Plans are made when results are read, so this stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before work that is heavy per byte.

    A small table is often one row group and so one task. Up to SPREAD_BYTES (by the size Spark expects) its
    rows are dealt out; a larger table has partitions enough and is not shuffled.
    """
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if expected <= SPREAD_BYTES else df
