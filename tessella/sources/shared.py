"""Tables that outlive an executor, in the folder that the cluster shares."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the session's checkpoint folder. One of its own is made only where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_LEAVING: set[str] = set()


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the application's part of the shared folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}"
    if own not in _LEAVING:
        _LEAVING.add(own)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what is there can be marked
        files.deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"


#: Bytes of its input that a task should have where there is enough for all cores, and tasks that each core should get if
#: each has so many bytes at least.
TASK_BYTES, WAVES, LEAST_BYTES = 32 << 20, 2, 1 << 20


def sized(df: DataFrame) -> DataFrame:
    """df in no more tasks than its input's bytes call for, so that small tables are not written as many tiny files.

    Partitions are put together without a shuffle; a plan with fewer tasks stays as it is."""
    leaves, read = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        read += int(str(leaves.apply(k).stats().sizeInBytes()))
    cores = WAVES * df.sparkSession.sparkContext.defaultParallelism
    # where Spark knows no size it says 2^63 bytes, and the plan's own tasks stay
    return df.coalesce(min(2**31 - 1, max(1, math.ceil(read / TASK_BYTES), min(cores, math.ceil(read / LEAST_BYTES)))))


#: Rows that a task should have which parses a text for each.
TASK_ROWS = 20_000


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows that stand for much work each, dealt evenly: bytes don't tell how many tasks they call for. They are counted first."""
    spark = rows.sparkSession
    cores = WAVES * spark.sparkContext.defaultParallelism
    n = rows.count()
    return rows.repartition(max(1, math.ceil(n / TASK_ROWS), min(cores, math.ceil(n / 1_000))), *rows.columns)


#: Bytes and rows of a batch that goes to Python, where the session has no smaller ones.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what an executor and its Python workers hold of a batch, each more than once: by default that is 10,000 rows of whatever size."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def written(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    sized(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; its results can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
