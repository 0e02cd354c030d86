"""Streaming: shards appended to the table of generations as they arrive, with running metrics on top. An extension beside the batch operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.config import KEYS
from quern.functions import text as X


def stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """New Parquet shards of a folder. Times without zone are read as of the session's, as event time needs one."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)})


def there(spark: SparkSession, pattern: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def append_new(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet table once each: rows merged twice (equal but for their id) are dropped, however late or far apart they come. Ends when all that is there is read.

    Each micro-batch is held against the table itself, so no row is dropped for its time, no state grows with the input, and a batch that is
    run again after a failure adds only what is missing. Every batch after the first reads the table's keys: larger batches, fewer reads.
    Only one query may append to a table at a time.
    """
    keys = [*KEYS, "prompt_0_shot", "relation", "generated_relation", "written_at"]
    if there(df.sparkSession, f"{table}/_spark_metadata"):
        raise ValueError(f"{table} was written by a file sink, whose readers see only the files of its own log; append to another table")

    def put(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if there(s, f"{table}/*.parquet"):
            old = s.read.schema(batch.schema).parquet(table).select(*[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(old, reduce(lambda a, b: a & b, same), "left_anti")
        new.write.mode("append").parquet(table)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accuracy_by_window(df: DataFrame, size: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Rows and hits by time window, dataset and model; a window is final when no later row may come."""
    hit = (X.normalize_relation(F.col("relation")) == X.normalize_relation(F.col("generated_relation"))).cast("long")
    d = df.withWatermark("written_at", late).groupBy(F.window("written_at", size), "eval_dataset_name", "model_id")
    return d.agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).select(F.col("window.start").alias("start"), "eval_dataset_name", "model_id", "n", "hits")
