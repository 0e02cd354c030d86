"""The confusion cube: one aggregation of the rows, from which all counts, rates and strata follow.

A cube row is (keys, gold, pred, gold_null, n). It holds a row for each distinct pair of labels of a configuration, so all that follows works on
data that doesn't grow with the rows. The labels are normalised by expressions in the scan's stage and pre-aggregated before the one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import CONSTRAINED, KEYS
from quern.functions import text as T
from quern.session import gathered


def labelled(rows: DataFrame, normalizer: str = "n1", keys: list[str] = KEYS) -> DataFrame:
    """Rows with gold and pred normalised; rows with a null key are left out, as a group-by of data frames leaves them out."""
    norm = T.NORMALIZERS[normalizer]
    for k in keys:  # as predicates that reach the scan, the same that joins on the keys infer: else branches of one plan would scan anew
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(*keys, norm(F.col("relation")).alias("gold"), norm(F.col("generated_relation")).alias("pred"), F.col("relation").isNull().alias("gold_null"))


def cube(rows: DataFrame, normalizer: str = "n1", keys: list[str] = KEYS) -> DataFrame:
    """Null labels are labels of the normaliser's kind; an empty table gives no rows; repeated rows count each time; further columns are ignored."""
    return labelled(rows, normalizer, keys).groupBy(*keys, "gold", "pred", "gold_null").agg(F.count("*").alias("n"))


def negative(c: Column, labels: list[str]) -> Column:
    return c.isin(labels) if labels else F.lit(False)


def primary(df: DataFrame, gen_type: str = CONSTRAINED, policy: str = "matched") -> DataFrame:
    """Rows of the main prompt condition; with the policy "matched" those prompted with as many shots as the model was tuned with."""
    if policy not in ("matched", "all"):
        raise ValueError(f"unknown policy {policy!r}")
    df = df.where(F.col("gen_type") == gen_type)
    return df.where(F.col("model_shot") == F.col("prompt_shot")) if policy == "matched" else df


def group_sizes(rows: DataFrame) -> DataFrame:
    """Rows of each configuration and dataset, the most usual number among those of a prompt condition (of ties the least) and whether it is a multiple of that."""
    sizes = rows.dropna(subset=KEYS).groupBy(*KEYS).agg(F.count("*").alias("size"))
    usual = sizes.groupBy("eval_dataset_name", "gen_type", "size").agg(F.count("*").alias("k"))
    usual = usual.groupBy("eval_dataset_name", "gen_type").agg(F.min_by("size", F.struct(-F.col("k"), F.col("size"))).alias("mode"))
    out = sizes.join(usual, ["eval_dataset_name", "gen_type"])
    return out.withColumn("flagged", (F.col("size") > F.col("mode")) & (F.col("size") % F.col("mode") == 0)).select(*KEYS, "size", "mode", "flagged")


def drop_duplicates(rows: DataFrame, subset: list[str], order: str) -> DataFrame:
    """The first row, by `order`, of those equal in `subset` (nulls are equal). By an aggregate with map-side combining: a value with a third of all rows is no hot group."""
    rest = [c for c in rows.columns if c not in subset]
    first = rows.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in subset else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def deduplicated(rows: DataFrame, mode: str = "if_multiple", order: str = "gen_id") -> DataFrame:
    """Rows merged twice taken out. mode: none, always, or if_multiple (of those datasets that have a configuration with a multiple of the usual number of rows).

    The needed columns only (keys, labels, prompt hash, order) are kept, the prompt as its hash.
    """
    if mode not in ("none", "always", "if_multiple"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows.select(*KEYS, "relation", "generated_relation", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"), order)
    if mode == "none":
        return rows
    same = [*KEYS, "prompt_hash", "relation"]
    if mode == "always":
        return drop_duplicates(rows, same, order)
    # the names of the datasets, counted by an action of its own: what is not flagged is then not shuffled, and clean or wholly repeated tables are scanned once more only
    names = [r[0] for r in gathered(group_sizes(rows).where("flagged").select("eval_dataset_name").distinct())]
    if not names:
        return rows
    own = F.coalesce(F.col("eval_dataset_name").isin(names), F.lit(False))
    return drop_duplicates(rows.where(own), same, order).unionByName(rows.where(~own))
