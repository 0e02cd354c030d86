"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cpus: int | str = "*", **more: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("quern")
    for k, v in {**SETTINGS, "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or (tests only) a temporary one set where none is."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "quern-shared-" + uuid.uuid4().hex)
        sc.setCheckpointDir(at)
    return at


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and a lost executor costs no recomputation.

    Written as Parquet rather than with checkpoint(), as it is compressed and columns can be pruned on the way back.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_ROWS = 10_000  # of a table that is made on the driver
MOST_SENT = 100_000  # rows of a table that is sent to all tasks


def gathered(df: DataFrame, most: int = MOST_ROWS) -> list:
    """All rows of a small table; raises if there are more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def sent(df: DataFrame, groups: DataFrame | None = None, most: int = MOST_SENT) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows, which is counted, else as it is, for a join by shuffle. groups: what is counted instead, if cheaper and not fewer rows."""
    return F.broadcast(df) if (df if groups is None else groups).limit(most + 1).count() <= most else df


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, if it has fewer partitions than there are cores, as a table of one small file has. Large inputs are left as they are: they cost no shuffle.

    The one place where a plan depends on the size of the input: a small one gains a shuffle by it, its rows and their results are the same.
    """
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan
