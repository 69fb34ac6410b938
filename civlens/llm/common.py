"""Helpers shared by the operators: shared scratch folder, written tables, ordered chains.

Everything that cuts lineage is a Parquet table below ``spark.checkpoint.dir``, so a lost
executor costs only the tasks that were running, and every branch of a plan reads the same rows.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that part words: space and tab to carriage return (as a Java pattern class body).
WORD_SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{WORD_SPACE}]+"

#: The scratch folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """Qualified URI of the folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only a local master may do without it (tests); there a
    temporary folder of this machine is shared by definition. Elsewhere a missing setting raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="civlens-shared-")
        base = _LOCAL[app]
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return as_uri(fs.makeQualified(path).toString())


def as_uri(path: str) -> str:
    """Hadoop writes local paths as ``file:/x``; pyarrow wants ``file:///x``."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder URI below the shared folder, deleted when the driver's file system closes."""
    uri = f"{shared_base(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it."""
    uri = scratch(df.sparkSession, tag)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so once the driver's JVM has
    collected the plans that owned them, which a large driver may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int) -> None:
    """Let Spark pass at most ``rows`` rows at once to Python from now on, for this session. With whole
    texts, Spark's usual 10,000 rows take far more memory, in the JVM and in each Python worker, than
    the work on them. A smaller number that the session already has stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def words(text):
    """Column: the words of a text as an array (null text: empty array), in native expressions."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), lambda w: w != "")


def with_global_index(df: DataFrame, order: list, tag: str, index: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the global order ``order`` without a one-task window.

    Rows are range-partitioned and sorted; the sorted rows are written with (partition, position)
    so that a retry cannot renumber them; the row counts of the partitions, one row each, give the
    partitions' offsets. Ties in ``order`` must be indistinguishable to the caller.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(
        ranged.withColumn("__p", F.spark_partition_id()).withColumn(
            "__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        tag,
    )
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    # one row per range partition: bounded by the number of shuffle partitions
    return (
        local.join(F.broadcast(offsets), "__p")
        .withColumn(index, F.col("__o") + F.col("__i"))
        .drop("__p", "__i", "__o")
    )
