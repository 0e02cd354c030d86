"""Token sequences: windows, blocks, label masks, padding and length statistics. The tokenizer is a Column function (white space unless given) or a batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


def words(c: Column) -> Column:
    """White-space tokens; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{T.WS}+"), lambda x: x != "")


def windows(df: DataFrame, tokens: Column, length: int, stride: int, keep: list[str]) -> DataFrame:
    """(keep, window, tokens): each sequence in windows of at most `length`, `stride` tokens of which repeat the window before. An empty sequence gives one empty window."""
    if not 0 <= stride < length:
        raise ValueError("stride must be less than length")
    d = df.select(*keep, tokens.alias("_t"))
    n = F.size("_t")
    count = F.when(n <= length, 1).otherwise(F.ceil((n - length) / (length - stride)) + 1).cast("int")
    d = d.select(*keep, "_t", F.posexplode(F.sequence(F.lit(0), count - 1)).alias("window", "_k"))
    return d.select(*keep, "window", F.slice("_t", F.col("_k") * (length - stride) + 1, length).alias("tokens"))


def blocks(df: DataFrame, tokens: Column, batch: Column, order: str, size: int) -> DataFrame:
    """(batch, block, tokens, labels): the sequences of a batch one after another, cut into blocks; the rest is dropped if there is a whole block, and kept as one otherwise. A batch is what the caller bounds it to."""
    d = df.select(batch.alias("batch"), F.col(order).alias("_o"), tokens.alias("_t"))
    d = d.groupBy("batch").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"])).alias("_t"))
    n = F.size("_t")
    d = d.where(n > 0).select("batch", "_t", F.posexplode(F.sequence(F.lit(0), F.greatest(F.floor(n / size), F.lit(1)).cast("int") - 1)).alias("block", "_k"))
    d = d.select("batch", "block", F.slice("_t", F.col("_k") * size + 1, size).alias("tokens"))
    return d.withColumn("labels", F.col("tokens"))


def label_mask(ids: Column, prompt_length: Column, length: int, ignore: int = -100) -> Column:
    """Labels of a sequence: `ignore` for the prompt, then its ids, cut to `length`."""
    n = F.least(prompt_length, F.size(ids))
    rest = F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0)))
    return F.slice(F.concat(F.array_repeat(F.lit(ignore), n), rest), 1, length)


def pad(df: DataFrame, ids: str, batch: str, value: int) -> DataFrame:
    """Sequences of a batch filled up to its longest."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("_m", longest).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(value), F.col("_m") - F.size(ids)))).drop("_m")


def first_per_prompt(rows: DataFrame, order: str = "gen_id") -> DataFrame:
    """(eval_dataset_name, prompt_0_shot, prompt_2_shot, relation): the first row of each distinct prompt; a missing second prompt is the first. By an aggregate, so a hot prompt is combined map-side."""
    d = rows.where(F.col("prompt_0_shot").isNotNull()).groupBy("eval_dataset_name", "prompt_0_shot").agg(F.min_by(F.struct("prompt_2_shot", "relation"), order).alias("x"))
    return d.select("eval_dataset_name", "prompt_0_shot", F.coalesce("x.prompt_2_shot", "prompt_0_shot").alias("prompt_2_shot"), F.coalesce("x.relation", F.lit("")).alias("relation"))


def truncation(examples: DataFrame, limit: int, size: Callable[[Column], Column] = lambda c: F.size(words(c))) -> DataFrame:
    """By dataset and prompt: median, 95th percentile and maximum of the lengths with and without the label, and the percentage over the limit or without any of the label."""
    conditions = F.explode(F.array(*[F.struct(F.lit(f"{s}-shot").alias("condition"), F.col(f"prompt_{s}_shot").alias("prompt")) for s in (0, 2)])).alias("c")
    d = examples.select(F.col("eval_dataset_name").alias("dataset"), "relation", conditions).select("dataset", F.col("c.condition").alias("condition"), size(F.col("c.prompt")).alias("p"), (size(F.col("c.prompt")) + size(F.col("relation"))).alias("t"))
    pct = lambda x: F.round(100 * F.avg(x.cast("double")), 3)
    q = lambda c, x: F.percentile(c, F.lit(x)).cast("int")
    over = F.col("t") > limit
    return d.groupBy("dataset", "condition").agg(F.count("*").alias("n_examples"), q("p", 0.5).alias("infer_median"), q("p", 0.95).alias("infer_p95"), F.max("p").alias("infer_max"), q("t", 0.5).alias("train_median"), q("t", 0.95).alias("train_p95"), F.max("t").alias("train_max"), pct(over).alias("pct_train_trunc"), pct((F.col("p") >= limit) & over).alias("pct_train_label_cut"))


def worst_case(stats: DataFrame) -> DataFrame:
    return stats.groupBy("dataset").agg(F.max("train_max").alias("train_max"), F.max("pct_train_trunc").alias("pct_train_trunc"), F.max("infer_max").alias("infer_max"))


def tokenise(df: DataFrame, column: str, key: str, encode: Callable[[list[str]], list[list[int]]]) -> DataFrame:
    """(key, ids) by an injected batch tokenizer, in Arrow batches where the rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": encode([x or "" for x in pdf[column]])})

    return df.select(key, column).mapInPandas(run, f"{key} long, ids array<int>")


def score(df: DataFrame, prompt: str, key: str, scorer: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, generated_relation): labels of prompts by an injected batch scorer, be it a model or a service."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "generated_relation": scorer([x or "" for x in pdf[prompt]])})

    return df.select(key, prompt).mapInPandas(run, f"{key} long, generated_relation string")


def length_scorer(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model."""
    return [("short", "medium", "long")[min(2, len(p) // 300)] for p in prompts]
