"""Training mixtures: reshaping sources, caps, balance, shuffles, samples and shards.

Order comes from the MD5 of seed and key: the same on any number of partitions and on any engine. The first n rows of a group by that order
are found without sorting the group: counts by the hash's first four digits tell in which of 65,536 slices row n lies, slices before it are
kept whole, and only that slice is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DATASETS, MixSpec
from quern.functions import text as T
from quern.session import MOST_SENT, sent

SPLITS = {"train": "train", "eval": "validation", "test": "test"}


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what}: missing columns {missing}; there are {df.columns}")
    return df


def reshape(source: DataFrame, prompt: str, label: str = "relation", name: Column | None = None, key: str = "example_id") -> DataFrame:
    """(key, prompt, relation, dataset): one prompt column and the label of a source; prompts without demonstrations end in an answer line. Null prompts stay null."""
    require(source, [prompt, label], "source")
    p = T.zero_shot_suffix(F.col(prompt)) if prompt.endswith("0_shot") else F.col(prompt)
    return source.select(F.col(key), p.alias("prompt"), F.col(label).alias("relation"), (F.col("dataset") if name is None else name).alias("dataset"))


def order_key(seed: int, key: str = "example_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffle(df: DataFrame, seed: int, key: str = "example_id") -> DataFrame:
    """All rows in a seeded order (a range-partitioned sort)."""
    return df.orderBy(order_key(seed, key), key)


def places(df: DataFrame, seed: int, key: str = "example_id") -> DataFrame:
    """All rows in the order of shuffle(), with the place of each, from 1 on.

    Rows are range-partitioned by the first four digits of their hash and ranked within these 65,536 slices only; a slice's offset is the
    number of rows in the slices before it. A null key comes first.
    """
    d = df.withColumn("_order", order_key(seed, key)).withColumn("_slice", F.coalesce(F.substring("_order", 1, 4), F.lit("")))
    slices = d.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = slices.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))  # at most 65,537 rows
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_order", key))  # one slice in 65,536
    ranked = d.repartitionByRange("_slice").withColumn("_rank", rank).join(F.broadcast(before), "_slice")
    return ranked.select(*df.columns, (F.col("_before") + F.col("_rank")).alias("place"))


def first_n(df: DataFrame, by: list[str], n: Column, seed: int | Column, key: str = "example_id") -> DataFrame:
    """Of each group the n rows that come first in the seeded order, all of them if it has fewer.

    n: an expression over the row's group; null keeps all. Groups with a null key are groups of their own. Rows of one key are kept or left
    out together. Two passes over the keys find each group's last row; the rows themselves are read once, against one row for each group.
    """
    h = order_key(seed, key) if isinstance(seed, int) else F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(key).cast("string")))
    names = [f"_by{k}" for k in range(len(by))]
    d = df.withColumns({x: F.coalesce(F.col(b).cast("string"), F.lit("\x00")) for x, b in zip(names, by)}).withColumn("_order", h)
    narrow = d.select(*names, "_order", n.cast("long").alias("_n"), F.substring("_order", 1, 4).alias("_slice"))
    few = narrow.select(*names).distinct()
    send = F.broadcast if few.limit(MOST_SENT + 1).count() <= MOST_SENT else lambda x: x  # a row for each group, counted
    slices = narrow.groupBy(*names, "_slice", "_n").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*names).orderBy("_slice"))  # at most 65,536 rows for each group
    edge = slices.withColumn("upto", upto).where(F.col("upto") > F.col("_n"))
    edge = edge.groupBy(*names).agg(F.min("_slice").alias("_slice"), F.min_by(F.col("_n") - (F.col("upto") - F.col("k")), "_slice").alias("_left"))
    inside = narrow.drop("_n").join(send(edge), [*names, "_slice"])
    ranked = inside.withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy("_order")))  # of one slice in 65,536
    last = ranked.groupBy(*names).agg(F.coalesce(F.max(F.when(F.col("_k") <= F.col("_left"), F.col("_order"))), F.min("_slice")).alias("_last"))
    return d.join(send(last), names, "left").where("_last is null or _order <= _last").select(*df.columns)


def cap(df: DataFrame, most: int | None, seed: int, by: list[str] = ("dataset",), key: str = "example_id") -> DataFrame:
    """At most `most` rows of each source; no limit if null."""
    return df if most is None else first_n(df, list(by), F.lit(most), seed, key)


def sizes(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("size"))


def with_least(df: DataFrame, sizes_of: DataFrame, least: Column, split: str | None) -> DataFrame:
    """df with _least: the size that each group may have, of each split by itself or, without splits, one number for all."""
    if split:
        return df.join(sent(sizes_of.groupBy(split).agg(least.alias("_least")), df.select(split).distinct()), split)
    return df.withColumn("_least", F.lit(sizes_of.agg(least).first()[0] or 0))


def domain_balanced(df: DataFrame, literary: list[str], seed: int, key: str = "example_id", split: str | None = None) -> DataFrame:
    """As many rows of either domain as the smaller one has, of each split by itself."""
    extra = [split] if split else []
    d = df.withColumn("_domain", F.col("dataset").isin(literary))
    d = with_least(d, sizes(d, ["_domain", *extra]), F.when(F.count("*") == 2, F.min("size")).otherwise(0), split)
    seeds = F.when(F.col("_domain"), F.lit(seed + 1)).otherwise(F.lit(seed))
    return first_n(d, ["_domain", *extra], F.col("_least"), seeds, key).select(*df.columns)


def dataset_balanced(df: DataFrame, seed: int, key: str = "example_id", split: str | None = None) -> DataFrame:
    """As many rows of each source as the smallest one has, of each split by itself."""
    extra = [split] if split else []
    d = with_least(df, sizes(df, ["dataset", *extra]), F.min("size"), split)
    return first_n(d, ["dataset", *extra], F.col("_least"), seed, key).select(*df.columns)


def mixture(source: DataFrame, spec: MixSpec, shots: int | list[int], known: list[str] = DATASETS) -> DataFrame:
    """(example_id, prompt, relation, dataset, split, shot) of one mixture, all three splits; split is named like train_2.

    Which rows are in it depends on their ids only, so they are chosen once, whatever the number of shots. Rows of other splits are left out.
    """
    spec.check(known)
    shots = [shots] if isinstance(shots, int) else shots
    require(source, ["example_id", "dataset", "split", "relation", *[f"prompt_{s}_shot" for s in shots]], "source")
    name = F.create_map(*[F.lit(x) for a, b in SPLITS.items() for x in (b, a)])[F.col("split")]
    d = source.where(F.col("dataset").isin(spec.general + spec.literary)).withColumn("split", name).where(F.col("split").isNotNull())
    d = d.select("example_id", "dataset", "split", "relation", *[f"prompt_{s}_shot" for s in shots])
    if spec.cap is not None:
        d = first_n(d, ["dataset", "split"], F.lit(spec.cap), spec.seed)
    if spec.balance == "domain":
        d = domain_balanced(d, spec.literary, spec.seed, split="split")
    elif spec.balance == "dataset":
        d = dataset_balanced(d, spec.seed, split="split")
    prompt = lambda s: T.zero_shot_suffix(F.col("prompt_0_shot")) if s == 0 else F.col(f"prompt_{s}_shot")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("shot"), prompt(s).alias("prompt")) for s in shots])).alias("x")
    d = d.select("example_id", "relation", "dataset", "split", each)
    return d.select("example_id", "x.prompt", "relation", "dataset", F.concat("split", F.lit("_"), F.col("x.shot").cast("string")).alias("split"), "x.shot")


MOST_SPLITS = 10_000  # of one table


def merge_splits(parts: list[DataFrame]) -> DataFrame:
    """Union of tables with a split column; raises if two have a split of the same name, or if one has more than MOST_SPLITS."""
    names = [{r[0] for r in p.select("split").distinct().limit(MOST_SPLITS + 1).collect()} for p in parts]
    if any(len(n) > MOST_SPLITS for n in names):
        raise ValueError(f"a table has more than {MOST_SPLITS} splits")
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a & b:
                raise ValueError(f"split {sorted(a & b)} is in two of the tables")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement, in the order of their keys."""
    return df.orderBy(order_key(seed, key), key).limit(k).orderBy(key)


def head(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)


def shard(df: DataFrame, count: int, key: str) -> DataFrame:
    """All rows with the worker that each is assigned to."""
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(count)).cast("int"))


def batches(df: DataFrame, size: int, key: str) -> DataFrame:
    """All rows with the number of the fixed-size range of keys that each is in."""
    return df.withColumn("batch", F.floor(F.col(key) / size).cast("long"))
