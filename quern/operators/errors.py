"""Strata of errors, samples of them and disagreements between regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import CONSTRAINED, NEGATIVES, PARAMS, REGIMES, SCALE
from quern.functions import text as T
from quern.operators.cube import cube, negative, primary
from quern.operators.metrics import MALFORMED, in_schema

CATEGORIES = ["correct", "near_neighbor", "default_negative", "hallucinated", "false_positive", "other_error"]


def lookup(c: Column, table: dict, default: Column) -> Column:
    """table[c], or the default for what isn't in it and for null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], default)


def classify(gold: Column, pred: Column, valid: Column, negatives: list[str] = NEGATIVES["n4"]) -> Column:
    """The kind of error of a pair of normalised labels; valid: whether the prediction is an allowed label."""
    g, p = negative(gold, negatives), negative(pred, negatives)
    return (
        F.when(gold == pred, "correct")
        .when(~g & p, "default_negative")
        .when(~valid & ~p, "hallucinated")
        .when(valid & ~p & ~g, "near_neighbor")
        .when(g & ~p, "false_positive")
        .otherwise("other_error")
    )


def categorise(gold: Column, pred: Column, valid: Column) -> Column:
    """The kind of a wrong answer: empty, too long, out of the schema or another label of it."""
    return F.when(pred == "", "malformed_empty").when(F.length(pred) > MALFORMED, "malformed_verbose").when(~valid, "hallucinated_relation").when(pred != gold, "schema_valid_wrong").otherwise("other")


def strata(rows: DataFrame, gen_type: str = CONSTRAINED) -> DataFrame:
    """Counts of each category by dataset and configuration of the main condition; the allowed labels are the gold labels of these rows, null ones as "none"."""
    c = cube(primary(rows, gen_type))
    labels = c.select("eval_dataset_name", F.col("gold").alias("label")).distinct()
    c = in_schema(c, labels).withColumn("kind", classify(F.col("gold"), F.col("pred"), F.col("valid")))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in CATEGORIES]
    by = c.groupBy("eval_dataset_name", "model_id", "tuned_dataset_name", "model_shot").agg(F.sum("n").alias("total"), *sums)
    return by.select(F.col("eval_dataset_name").alias("dataset"), "model_id", "tuned_dataset_name", "model_shot", lookup(F.col("model_id"), SCALE, F.lit("unknown")).alias("scale_group"), lookup(F.col("model_id"), PARAMS, F.lit(0.0)).alias("params_b"), "total", *CATEGORIES)


def percentages(counts: DataFrame) -> DataFrame:
    """The counts with each category's percentage of the total, to two digits."""
    return counts.select("*", *[F.round(F.col(k) / F.col("total") * 100, 2).alias(f"{k}_pct") for k in CATEGORIES])


def summary(counts: DataFrame, by: str) -> DataFrame:
    """Percentages of the summed counts, by scale_group or regime."""
    if by == "regime":
        counts = counts.withColumn("regime", lookup(F.col("tuned_dataset_name"), REGIMES, F.col("tuned_dataset_name")))
    sums = counts.groupBy(by).agg(*[F.sum(k).alias(k) for k in ["total", *CATEGORIES]])
    return percentages(sums).select(by, "total", *[f"{k}_pct" for k in CATEGORIES])


ANALYSED = ["eval_dataset_name", "prompt_0_shot", "relation", "gen_type", "model_id", "tuned_dataset_name", "model_shot", "prompt_shot", "generated_relation"]


def analysed(rows: DataFrame, gen_type: str = CONSTRAINED, prompts: bool = True) -> DataFrame:
    """Distinct rows of the main condition with normalised labels; rows with a null dataset are left out. Without prompts, these are compared and shuffled as their MD5."""
    d = primary(rows.select(*ANALYSED), gen_type).where(F.col("eval_dataset_name").isNotNull())
    d = (d if prompts else d.withColumn("prompt_0_shot", F.md5("prompt_0_shot"))).distinct()
    return d.withColumns({"gold": T.normalize_relation(F.col("relation")), "pred": T.normalize_relation(F.col("generated_relation"))})


def wrong(rows: DataFrame, prompts: bool = True) -> DataFrame:
    """The wrong answers among the analysed rows with their category."""
    d = analysed(rows, prompts=prompts)
    labels = d.where(F.col("relation").isNotNull()).select("eval_dataset_name", F.col("gold").alias("label")).distinct()
    w = in_schema(d.where("gold <> pred"), labels)
    return w.withColumn("error_category", categorise(F.col("gold"), F.col("pred"), F.col("valid"))).drop("valid")


def category_shares(rows: DataFrame) -> DataFrame:
    """How many errors of each dataset are of each category, and their share."""
    n = wrong(rows, prompts=False).groupBy("eval_dataset_name", "error_category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("eval_dataset_name"))  # at most one row for each category
    return n.withColumn("share", F.round(F.col("n") / total, 4))


def error_rates(rows: DataFrame) -> DataFrame:
    """Errors of each configuration among the analysed rows."""
    d = analysed(rows, prompts=False).dropna(subset=["model_id", "tuned_dataset_name", "model_shot"])
    hit = F.sum((F.col("gold") == F.col("pred")).cast("long"))
    d = d.groupBy("eval_dataset_name", "model_id", "tuned_dataset_name", "model_shot").agg(F.count("*").alias("total"), hit.alias("correct"))
    return d.withColumn("error_rate", F.round(1 - F.col("correct") / F.col("total"), 4))


def examples(rows: DataFrame, per_model: int = 3, per_category: int = 20, seed: int = 42) -> DataFrame:
    """A sample of wrong answers: of each dataset and category at most per_model of a model and per_category in all, chosen by a seeded hash of the row.

    The windows rank groups of up to a dataset's errors; Spark keeps only the first rows of a group while it sorts (window group limit).
    """
    w = wrong(rows)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ANALYSED]))
    w = w.select("eval_dataset_name", "error_category", "relation", "generated_relation", "model_id", "tuned_dataset_name", "model_shot", "prompt_0_shot", order.alias("h"))
    a = F.row_number().over(Window.partitionBy("eval_dataset_name", "error_category", "model_id").orderBy("h"))
    w = w.withColumn("k", a).where(F.col("k") <= per_model)
    b = F.row_number().over(Window.partitionBy("eval_dataset_name", "error_category").orderBy("h"))
    w = w.withColumn("k", b).where(F.col("k") <= per_category)
    regime = lookup(F.col("tuned_dataset_name"), REGIMES, F.col("tuned_dataset_name"))
    snippet = F.left(T.extract_sentence(F.coalesce("prompt_0_shot", F.lit("nan"))), F.lit(300))
    return w.select(F.col("eval_dataset_name").alias("dataset"), "error_category", F.col("relation").alias("gold_relation"), F.col("generated_relation").alias("predicted_relation"), "model_id", regime.alias("tuning_regime"), F.concat(F.col("model_shot").cast("string"), F.lit("-shot")).alias("prompt_style"), snippet.alias("text_snippet"))


def disagreements(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Examples that some regime gets right and another wrong: the first `limit` of each dataset in the order of prompt opening and gold label.

    A regime is right if any of its rows is. Its prediction is that of its smallest row (by configuration, then answer). Counted by an
    aggregate over (example, regime), so a prompt with a third of all rows is no hot group.
    """
    d = analysed(rows).where(F.col("relation").isNotNull() & F.col("prompt_0_shot").isNotNull() & F.col("tuned_dataset_name").isNotNull())
    key = ["eval_dataset_name", "opening", "relation"]
    d = d.withColumn("opening", F.left("prompt_0_shot", F.lit(100)))
    by = d.groupBy(*key, "tuned_dataset_name").agg(F.bool_or(F.col("gold") == F.col("pred")).alias("right"), F.min_by("generated_relation", F.struct("model_id", "model_shot", F.coalesce("generated_relation", F.lit("")))).alias("said"), F.min("prompt_0_shot").alias("prompt"))
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, lookup(F.col("tuned_dataset_name"), REGIMES, F.col("tuned_dataset_name"))))), ", ")
    said = [F.max(F.when(F.col("tuned_dataset_name") == r, F.col("said"))).alias(f"pred_{n}") for r, n in REGIMES.items()]
    ex = by.groupBy(*key).agg(F.bool_or("right").alias("a"), F.bool_or(~F.col("right")).alias("b"), names(F.col("right")).alias("correct_regimes"), names(~F.col("right")).alias("wrong_regimes"), F.min("prompt").alias("prompt"), *said)
    rank = F.row_number().over(Window.partitionBy("eval_dataset_name").orderBy("opening", "relation"))
    ex = ex.where("a and b").withColumn("k", rank).where(F.col("k") <= limit)
    return ex.select(F.col("eval_dataset_name").alias("dataset"), F.left(T.extract_sentence(F.col("prompt")), F.lit(300)).alias("text_snippet"), F.col("relation").alias("gold_relation"), "correct_regimes", "wrong_regimes", *[f"pred_{n}" for n in REGIMES.values()])


