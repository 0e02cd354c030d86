"""Assembling the table of generations: merging shards, resuming, splicing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.mixing import require
from quern.operators.tables import is_config


def merge_shards(parts: list[DataFrame], required: list[str], strict: bool = False, missing: bool = False) -> DataFrame:
    """Union of shards. strict: all must have the same columns in the same order; missing: columns that some lack are null there."""
    if not parts:
        raise ValueError("no shards")
    for p in parts:
        require(p, required, "shard")
        if strict and p.columns != parts[0].columns:
            raise ValueError(f"columns {p.columns} are not {parts[0].columns}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=missing)
    return out


def merged(df: DataFrame, columns: list[str], dedup: bool = False, sort: bool = False) -> DataFrame:
    """The named columns, without repeated rows and sorted by all of them if asked for."""
    d = df.select(*columns)
    d = d.distinct() if dedup else d
    return d.orderBy(*columns) if sort else d


def check_single(df: DataFrame, name: str, column: str = "eval_dataset_name") -> DataFrame:
    """Rows that name another dataset than the folder they lie in; merging must find none."""
    return df.where(T.strip(F.col(column)) != name)


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those done. The keys done are made distinct first, so a hot key is one row."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def splice(table: DataFrame, replacement: DataFrame, config: tuple[str, str, int]) -> DataFrame:
    """The table with its rows of one configuration replaced by those of the replacement; doing it again changes nothing. A null key matches nothing and stays."""
    own = F.coalesce(is_config([config]), F.lit(False))
    return table.where(~own).unionByName(replacement.where(own).select(*table.columns))
