"""Reading tables: a registry of sources, CSV with and without typing, shards and datasets found by their folders."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import NA_VALUES

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


GENERATION = schema(eval_dataset_name=S, prompt_0_shot=S, prompt_2_shot=S, relation=S, gen_type=S, model_id=S, tuned_dataset_name=S, model_shot=I, prompt_shot=I, generated_relation=S)
FRONTIER = schema(eval_dataset_name=S, prompt_hash=S, relation=S, gen_type=S, model_id=S, tuned_dataset_name=S, model_shot=S, prompt_shot=I, generated_relation=S, input_tokens=L, output_tokens=L)


@dataclass(frozen=True)
class Source:
    """Where the rows of a named source lie: a table, and the split and dataset columns that pick them."""

    name: str
    domain: str
    table: str = "source_example"
    splits: tuple[tuple[str, str], ...] = (("train", "train"), ("eval", "validation"), ("test", "test"))


def read_split(spark: SparkSession, root: str, source: Source, split: str) -> DataFrame:
    """Rows of one source and split; both predicates reach the Parquet scan."""
    names = dict(source.splits)
    if split not in names:
        raise ValueError(f"split {split!r} is none of {sorted(names)}")
    return spark.read.parquet(f"{root}/{source.table}.parquet").where((F.col("dataset") == source.name) & (F.col("split") == names[split]))


def nulls(df: DataFrame, values: list[str] = NA_VALUES, columns: list[str] | None = None) -> DataFrame:
    """Text that a data-frame reader would take for missing becomes null ("none" in lower case does not)."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c)) for c in names}) if names else df


def read_csv(spark: SparkSession, path: str | list[str], columns: T.StructType, use: list[str] | None = None, na: bool = True) -> DataFrame:
    """Typed CSV with quoted line breaks and doubled quotes. use: the columns kept, which the parser alone converts. na: missing-value texts become null."""
    df = spark.read.csv(path, schema=columns, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    df = df.select(*use) if use else df
    return nulls(df) if na else df


def read_csv_text(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV as text only: malformed rows are left out, undecodable bytes replaced; empty fields are empty texts."""
    df = spark.read.csv(path, schema=schema(**{c: S for c in columns}), header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED", encoding="UTF-8")
    return df.fillna("")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose header names the columns, all of them text; a byte order mark before the first name is ignored."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


def number(c: Column, digits: int = 4) -> Column:
    """Text as a rounded number; null for empty text, dashes and anything else that is none."""
    return F.round(F.nullif(F.trim(c), F.lit("--")).try_cast("double"), digits)


def folders(spark: SparkSession, root: str, file: str = "generations.csv") -> list[str]:
    """Names of the folders under root that hold the file, sorted: a listing by the file system that the session uses."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/*/{file}")) or []
    return sorted(s.getPath().getParent().getName() for s in found)


def shards(spark: SparkSession, folder: str, fmt: str = "csv", merged: str = "generations_merged") -> list[str]:
    """The merged file if there is one, else the shards in the order of their names."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    glob = lambda p: sorted(s.getPath().toString() for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")) or []))
    return glob(f"{merged}.{fmt}") or glob(f"generations_shard_*.{fmt}")


def with_folder(df: DataFrame, column: str = "eval_dataset_name") -> DataFrame:
    """The name of the folder that each row's file lies in."""
    return df.withColumn(column, F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def shard_number(c: Column) -> Column:
    """Worker and job numbers of a shard's file name, null if it is named otherwise."""
    return F.nullif(F.regexp_extract(c, r"generations_shard_(\d+)", 1), F.lit("")).try_cast("int")


def safe_name(x: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.=-]+", "_", x)
