"""Derived tables over the metrics: summaries, transfer, deltas, pivots, the results matrix. Their input has a row for each configuration and dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import ANOMALIES, CONSTRAINED, CROSS, DATASETS, FAMILY, FAMILY_PAIRS, GENERAL, LITERARY, MODELS, OPEN, PARAMS, REGIMES, REPORTED_ZERO, SCALE, SHORT, SHOTS
from quern.operators.cube import primary
from quern.operators.errors import lookup


def is_config(configs: list[tuple[str, str, int]]) -> Column:
    """Whether (model_id, tuned_dataset_name, model_shot) is one of a few."""
    out = F.lit(False)
    for m, r, s in configs:
        out = out | ((F.col("model_id") == m) & (F.col("tuned_dataset_name") == r) & (F.col("model_shot") == s))
    return out


def keep_configs(df: DataFrame, configs: list[tuple[str, str, int]], inside: bool = True) -> DataFrame:
    """Rows of the listed configurations, or the others."""
    return df.where(is_config(configs) if inside else ~is_config(configs))


def reported_zero(df: DataFrame, configs: list[tuple[str, str, int]] = REPORTED_ZERO) -> DataFrame:
    """micro_f1 as 0 for the configurations that are reported so; precision and recall stay."""
    return df.withColumn("micro_f1", F.when(is_config(configs), 0.0).otherwise(F.col("micro_f1")))


def domain(c: Column) -> Column:
    return F.when(c.isin(GENERAL), "general").when(c.isin(LITERARY), "literary").otherwise("unknown")


def regime(c: Column = None) -> Column:
    c = F.col("tuned_dataset_name") if c is None else c
    return lookup(c, REGIMES, c)


def mean_in(names: list[str], x: str = "micro_f1", where: Column | None = None) -> Column:
    cond = F.col("eval_dataset_name").isin(names)
    return F.avg(F.when(cond if where is None else cond & where, F.col(x)))


def main_summary(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """Mean F1 over general, literary and all datasets of each configuration; a domain without datasets is null."""
    d = reported_zero(primary(metrics)).groupBy("model_id", "model_shot", "tuned_dataset_name")
    d = d.agg(F.round(mean_in(GENERAL), 4).alias("general_avg_f1"), F.round(mean_in(LITERARY), 4).alias("literature_avg_f1"), F.round(F.avg("micro_f1"), 4).alias("overall_avg_f1"))
    d = d.join(meta.select("model_id", "param_label"), "model_id", "left")
    d = d.select(F.col("model_id").alias("base_model"), F.coalesce("param_label", F.lit("")).alias("params"), F.concat(F.col("model_shot").cast("string"), F.lit("-shot")).alias("prompt_style"), regime().alias("tuning_regime"), "general_avg_f1", "literature_avg_f1", "overall_avg_f1")
    order = lambda c, values: lookup(F.col(c), {v: k for k, v in enumerate(values)}, F.lit(99))
    return d.orderBy("base_model", order("params", ["360M", "0.5B", "3B"]), order("prompt_style", ["0-shot", "2-shot"]), order("tuning_regime", list(REGIMES.values())))


def transfer_by_regime(metrics: DataFrame) -> DataFrame:
    """Domain means of configurations, averaged for each regime, and the gap between the domains: own less other, or its size for the mixed regime."""
    per = primary(metrics).where(F.col("tuned_dataset_name").isin(list(REGIMES))).groupBy("tuned_dataset_name", "model_id", "model_shot").agg(mean_in(GENERAL).alias("g"), mean_in(LITERARY).alias("l"))
    a = per.groupBy("tuned_dataset_name").agg(F.avg("g").alias("g"), F.avg("l").alias("l"))
    g, lit = F.col("g"), F.col("l")
    gap = F.when(F.col("tuned_dataset_name") == "re_gentune", g - lit).when(F.col("tuned_dataset_name") == "re_littune", lit - g).otherwise(F.abs(g - lit))
    both = F.when(g.isNull(), lit).when(lit.isNull(), g).otherwise((g + lit) / 2)
    return a.select(regime().alias("tuning_regime"), *[F.round(x, 4).alias(n) for x, n in ((g, "avg_on_general"), (lit, "avg_on_literature"), (gap, "cross_domain_gap"), (both, "overall_avg"))])


def prompt_delta(metrics: DataFrame) -> DataFrame:
    """Two shots less none, by model and regime: F1 by domain, precision and recall. One aggregation, no join; models without one of the two have no row."""
    two, none = F.col("model_shot") == 2, F.col("model_shot") == 0
    some = {"general_avg_f1": (GENERAL, "micro_f1"), "literature_avg_f1": (LITERARY, "micro_f1"), "overall_avg_f1": (None, "micro_f1"), "precision": (None, "micro_precision"), "recall": (None, "micro_recall")}
    mean = lambda ds, x, w: F.avg(F.when(w, F.col(x))) if ds is None else mean_in(ds, x, w)
    aggs = [F.round(mean(ds, x, two) - mean(ds, x, none), 4).alias(f"delta_{k}") for k, (ds, x) in some.items()]
    d = reported_zero(primary(metrics)).groupBy("model_id", "tuned_dataset_name").agg(F.bool_or(two).alias("a"), F.bool_or(none).alias("b"), *aggs)
    return d.where("a and b").select(F.col("model_id").alias("base_model"), regime().alias("tuning_regime"), *[f"delta_{k}" for k in some])


def efficiency(metrics: DataFrame, meta: DataFrame) -> DataFrame:
    """F1 for a billion parameters and for a gigabyte of each configuration; null where the size is unknown or 0."""
    d = primary(metrics).groupBy("model_id", "model_shot", "tuned_dataset_name").agg(F.round(mean_in(LITERARY), 4).alias("literature_avg_f1"), F.round(F.avg("micro_f1"), 4).alias("overall_avg_f1"))
    d = d.join(meta.select("model_id", "params_b", "checkpoint_gb", "avg_inference_latency_ms"), "model_id", "left")
    name = F.concat("model_id", F.lit(" ("), regime(), F.lit(", "), F.col("model_shot").cast("string"), F.lit("-shot)"))
    per_gb = F.when(F.col("checkpoint_gb") > 0, F.round(F.col("overall_avg_f1") / F.col("checkpoint_gb"), 4))
    return d.select(name.alias("model"), "model_id", "params_b", "checkpoint_gb", "avg_inference_latency_ms", "literature_avg_f1", "overall_avg_f1", F.round(F.col("overall_avg_f1") / F.col("params_b"), 4).alias("f1_per_b_params"), per_gb.alias("f1_per_gb")).orderBy(F.desc("overall_avg_f1"), "model")


def config_name() -> Column:
    return F.concat_ws(" | ", F.col("model_id"), regime(), F.concat(F.col("model_shot").cast("string"), F.lit("-shot")))


def full_grid(metrics: DataFrame) -> DataFrame:
    """F1 of each configuration (row) on each dataset (column, general before literary); null where it was not run."""
    d = reported_zero(primary(metrics)).withColumn("model_config", config_name())
    return d.groupBy("model_config").pivot("eval_dataset_name", DATASETS).agg(F.round(F.first("micro_f1"), 4))


def row_mean(names: list[str]) -> Column:
    """Mean of some columns of four digits, nulls left out, rounded half up to four digits in whole units, so that ties don't depend on the order of the sum."""
    units = sum((F.coalesce(F.round(F.col(n) * 10000).cast("long"), F.lit(0)) for n in names), F.lit(0))
    k = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return F.when(k > 0, F.floor((2 * units + k) / (2 * k)) / 10000)


def heatmap(metrics: DataFrame) -> DataFrame:
    """The full grid with the mean of each row, best first."""
    return full_grid(metrics).withColumn("row_mean", row_mean(DATASETS)).orderBy(F.desc_nulls_last("row_mean"), "model_config")


def grid(spark: SparkSession) -> DataFrame:
    """All models x regimes x shots: thirty rows, made without reading data."""
    return spark.createDataFrame([(m, r, s) for m in MODELS for r in REGIMES for s in SHOTS], "model_id string, tuned_dataset_name string, model_shot int")


def results_matrix(metrics: DataFrame) -> DataFrame:
    """The fixed grid with F1 by dataset and the means of the rounded cells; null where a configuration was not run."""
    d = reported_zero(primary(metrics)).groupBy("model_id", "tuned_dataset_name", "model_shot").pivot("eval_dataset_name", DATASETS).agg(F.round(F.first("micro_f1"), 4))
    d = F.broadcast(grid(metrics.sparkSession)).join(d, ["model_id", "tuned_dataset_name", "model_shot"], "left")
    shot = F.concat(F.col("model_shot").cast("string"), F.lit("s"))
    short = lookup(F.col("model_id"), SHORT, F.col("model_id"))
    return d.select(short.alias("model"), regime().alias("regime"), shot.alias("shot"), F.concat_ws(" ", short, regime(), shot).alias("config"), *DATASETS, row_mean(GENERAL).alias("general_avg"), row_mean(LITERARY).alias("literary_avg"), row_mean(DATASETS).alias("overall_avg"))


def scaling_points(metrics: DataFrame) -> DataFrame:
    """Mean F1 by model, regime and shot with the size and family of the model, without the anomalies."""
    d = keep_configs(primary(metrics), ANOMALIES, False).groupBy("model_id", "tuned_dataset_name", "model_shot").agg(F.round(F.avg("micro_f1"), 4).alias("mean_f1"))
    return d.select("model_id", "tuned_dataset_name", "model_shot", "mean_f1", lookup(F.col("model_id"), FAMILY, F.lit("unknown")).alias("family"), lookup(F.col("model_id"), PARAMS, F.lit(0.0)).alias("params_b"))


def open_pairs(metrics: DataFrame) -> DataFrame:
    """F1 of both prompt conditions side by side, of the cells that have both, without the anomalies."""
    d = keep_configs(metrics.where("model_shot = prompt_shot"), ANOMALIES, False)
    d = d.groupBy("eval_dataset_name", "model_id", "tuned_dataset_name", "model_shot").pivot("gen_type", [OPEN, CONSTRAINED]).agg(F.avg("micro_f1"))
    return d.dropna(subset=[OPEN, CONSTRAINED]).withColumn("delta", F.col(OPEN) - F.col(CONSTRAINED))


def mean_sem(x: Column) -> list[Column]:
    """Mean and its standard error in percentage points; no error for a single value."""
    n = F.count(x)
    return [F.round(100 * F.avg(x), 4).alias("mean_pp"), F.round(100 * F.when(n > 1, F.stddev_samp(x) / F.sqrt(n)).otherwise(0.0), 4).alias("sem_pp"), n.alias("n")]


def open_minus_constrained(metrics: DataFrame) -> DataFrame:
    """What the generic prompt gains, by dataset, by scale and overall."""
    scale = lookup(F.col("model_id"), SCALE, F.lit("unknown"))
    levels = F.explode(F.array(F.struct(F.lit("dataset").alias("level"), F.col("eval_dataset_name").alias("name")), F.struct(F.lit("scale").alias("level"), scale.alias("name")), F.struct(F.lit("overall").alias("level"), F.lit("all").alias("name")))).alias("x")
    return open_pairs(metrics).select("delta", levels).select("delta", "x.*").groupBy("level", "name").agg(*mean_sem(F.col("delta")))


def frontier_table(metrics: DataFrame) -> DataFrame:
    """Domain means of served models: F1, valid answers in percent, numbers of datasets."""
    n = lambda ds: F.count(F.when(F.col("eval_dataset_name").isin(ds), 1))
    pct = lambda ds: F.round(mean_in(ds, "schema_valid_rate") * 100, 1)
    return metrics.groupBy("model_id").agg(F.round(mean_in(GENERAL), 4).alias("general_avg_f1"), F.round(mean_in(LITERARY), 4).alias("literary_avg_f1"), F.round(F.avg("micro_f1"), 4).alias("overall_avg_f1"), pct(GENERAL).alias("gen_schema_valid_pct"), pct(LITERARY).alias("lit_schema_valid_pct"), n(GENERAL).alias("n_general"), n(LITERARY).alias("n_literary"))


def frontier_pivot(metrics: DataFrame, models: list[str]) -> DataFrame:
    """F1 by dataset (row, in fixed order) and model (column)."""
    d = metrics.groupBy("eval_dataset_name").pivot("model_id", models).agg(F.round(F.first("micro_f1"), 4))
    return d.orderBy(lookup(F.col("eval_dataset_name"), {x: k for k, x in enumerate(DATASETS)}, F.lit(99)))


def is_cross() -> Column:
    out = F.lit(False)
    for r, ds in CROSS.items():
        out = out | ((F.col("tuned_dataset_name") == r) & F.col("eval_dataset_name").isin(ds))
    return out


def cross_only(df: DataFrame) -> DataFrame:
    """Rows of a regime on the datasets of the other domain."""
    return df.where(is_cross())


def transfer_table(cross: DataFrame, own: DataFrame) -> DataFrame:
    """Means off and in the domain of each configuration that has any off it, and their difference."""
    key = ["model_id", "tuned_dataset_name", "model_shot", "prompt_shot"]
    a = cross_only(cross.where(F.col("gen_type") == CONSTRAINED)).groupBy(*key).agg(F.avg("micro_f1").alias("c"))
    inside = F.col("tuned_dataset_name").isin(list(CROSS)) & ~is_cross() & F.col("eval_dataset_name").isin(DATASETS)
    b = own.where((F.col("gen_type") == CONSTRAINED) & inside).groupBy(*key).agg(F.avg("micro_f1").alias("i"))
    general = F.col("tuned_dataset_name") == "re_gentune"
    return a.join(b, key, "left").select(*key, F.when(general, "General").otherwise("Literary").alias("in_domain"), F.round("i", 4).alias("in_domain_avg_f1"), F.when(general, "Literary").otherwise("General").alias("cross_domain"), F.round("c", 4).alias("cross_domain_avg_f1"), F.round(F.col("c") - F.col("i"), 4).alias("delta_f1"))


def in_and_cross(metrics: DataFrame) -> DataFrame:
    """Means in the domain of each configuration that has any there, with those off it, null if there are none. One aggregate for both sides."""
    key = ["model_id", "tuned_dataset_name", "model_shot", "prompt_shot"]
    own = F.col("tuned_dataset_name").isin(list(CROSS)) & ~is_cross() & F.col("eval_dataset_name").isin(DATASETS)
    mean = lambda cond: F.round(F.avg(F.when(cond, F.col("micro_f1"))), 4)
    d = metrics.where(F.col("gen_type") == CONSTRAINED).groupBy(*key)
    return d.agg(mean(own).alias("in_domain_avg_f1"), F.count_if(own).alias("n_in_domain"), mean(is_cross()).alias("cross_domain_avg_f1")).where("n_in_domain > 0").select(*key, "in_domain_avg_f1", "n_in_domain", "cross_domain_avg_f1")


def transfer_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("tuned_dataset_name").agg(F.round(F.avg("in_domain_avg_f1"), 4).alias("avg_in_domain_f1"), F.round(F.avg("cross_domain_avg_f1"), 4).alias("avg_cross_domain_f1"), F.round(F.avg("delta_f1"), 4).alias("avg_delta"))


def direction(delta: Column, margin: float = 0.01) -> Column:
    return F.when(delta > margin, "IMPROVED").when(delta < -margin, "DEGRADED").when(delta.isNotNull(), "~same")


def adapted_or_base(adapted: DataFrame, base: DataFrame) -> DataFrame:
    """F1 of an adapted model beside its base by regime and dataset, with means by domain; one side may be missing."""
    key = ["tuned_dataset_name", "eval_dataset_name"]
    a = adapted.select(*key, F.col("micro_f1").alias("adapted_f1"))
    b = base.select(*key, F.col("micro_f1").alias("base_f1"))
    d = a.join(b, key, "full_outer")
    means = d.withColumn("d", domain(F.col("eval_dataset_name"))).where("d <> 'unknown'").groupBy("tuned_dataset_name", F.concat(F.lit("avg:"), "d").alias("eval_dataset_name")).agg(F.avg("adapted_f1").alias("adapted_f1"), F.avg("base_f1").alias("base_f1"))
    delta = F.col("adapted_f1") - F.col("base_f1")
    return d.unionByName(means).select(*key, F.round("base_f1", 4).alias("base_f1"), F.round("adapted_f1", 4).alias("adapted_f1"), F.round(delta, 4).alias("delta"), direction(delta).alias("direction"))


def label_complexity(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Spread of F1 over configurations by dataset beside the number of labels; groups: (dataset, domain, n_labels)."""
    d = primary(metrics).groupBy(F.col("eval_dataset_name").alias("dataset")).agg(F.round(F.avg("micro_f1"), 4).alias("mean_micro_f1"), F.round(F.stddev_samp("micro_f1"), 4).alias("std_micro_f1"), F.round(F.min("micro_f1"), 4).alias("min_micro_f1"), F.round(F.max("micro_f1"), 4).alias("max_micro_f1"), F.count("micro_f1").alias("n_configs"))
    d = d.join(groups.select("dataset", "n_labels"), "dataset", "left")
    return d.select("dataset", F.coalesce("n_labels", F.lit(-1)).alias("n_labels"), "mean_micro_f1", "std_micro_f1", "min_micro_f1", "max_micro_f1", "n_configs", F.when(F.col("dataset").isin(LITERARY), "literary").otherwise("general").alias("domain")).orderBy("n_labels", "dataset")


def correlations(complexity: DataFrame) -> DataFrame:
    """Pearson and rank correlation of labels and F1 over the datasets; ranks of ties in the order of names, as no ties are averaged."""
    from pyspark.sql import Window

    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c, "dataset"))  # noqa: E731  a row for each dataset
    d = complexity.select("dataset", F.col("n_labels").cast("double").alias("x"), F.col("mean_micro_f1").alias("y"))
    d = d.withColumns({"rx": rank("x").cast("double"), "ry": rank("y").cast("double")})
    return d.agg(F.round(F.corr("x", "y"), 4).alias("pearson"), F.round(F.corr("rx", "ry"), 4).alias("spearman"))


def family_pairs(metrics: DataFrame) -> DataFrame:
    """Large less small model of a family by regime, shot and dataset, without the anomalies."""
    d = keep_configs(primary(metrics), ANOMALIES, False)
    key = ["tuned_dataset_name", "model_shot", "eval_dataset_name"]
    size = F.lit(None).cast("string")
    for small, big in FAMILY_PAIRS.values():
        size = F.when(F.col("model_id") == small, "s").when(F.col("model_id") == big, "b").otherwise(size)
    d = d.withColumns({"family": lookup(F.col("model_id"), FAMILY, F.lit("unknown")), "size": size}).where("size is not null")
    s = d.where("size = 's'").select("family", *key, F.col("micro_f1").alias("micro_f1_s"))
    b = d.where("size = 'b'").select("family", *key, F.col("micro_f1").alias("micro_f1_b"))
    return s.join(b, ["family", *key]).withColumn("delta", F.col("micro_f1_b") - F.col("micro_f1_s"))


def best_by_scale(metrics: DataFrame) -> DataFrame:
    """The best mean F1 of small and of large models by regime and shot, and the gap."""
    d = keep_configs(primary(metrics), ANOMALIES, False).groupBy("tuned_dataset_name", "model_shot", "model_id").agg(F.avg("micro_f1").alias("f"))
    small = F.col("model_id").isin([m for m, s in SCALE.items() if s == "sub-billion"])
    d = d.groupBy("tuned_dataset_name", "model_shot").agg(F.max(F.when(small, F.col("f"))).alias("s"), F.max(F.when(~small, F.col("f"))).alias("b"))
    return d.where(F.col("tuned_dataset_name").isin(list(REGIMES))).select("tuned_dataset_name", "model_shot", F.round("s", 4).alias("best_small"), F.round("b", 4).alias("best_large"), F.round(F.col("b") - F.col("s"), 4).alias("gap"))


def schema_rates(metrics: DataFrame) -> DataFrame:
    """Mean rate of valid answers by model, a column for each prompt condition."""
    return metrics.groupBy("model_id").pivot("gen_type", [OPEN, CONSTRAINED]).agg(F.round(F.avg("schema_valid_rate"), 4))


def means(metrics: DataFrame) -> DataFrame:
    """Means of four metrics over the main condition."""
    return primary(metrics).agg(*[F.round(F.avg(m), 4).alias(m) for m in ("micro_f1", "macro_f1", "schema_valid_rate", "malformed_rate")])


def explorer(matrix: DataFrame, model: str | None = None, regime_name: str | None = None, shot: str | None = None, by: str = "overall_avg", descending: bool = True) -> DataFrame:
    """The matrix filtered by what is given and sorted by any column, nulls as -1."""
    for c, v in (("model", model), ("regime", regime_name), ("shot", shot)):
        matrix = matrix if v is None else matrix.where(F.col(c) == v)
    key = F.coalesce(F.col(by), F.lit(-1.0)) if by in [*DATASETS, "general_avg", "literary_avg", "overall_avg"] else F.col(by)
    return matrix.orderBy(key.desc() if descending else key.asc(), "config")


def dashboard(metrics: DataFrame) -> DataFrame:
    """One row of JSON: the matrix, deltas and difficulty. Thirty rows of the matrix at most are gathered."""
    m = results_matrix(metrics).agg(F.to_json(F.sort_array(F.collect_list(F.struct("config", *DATASETS, "general_avg", "literary_avg", "overall_avg")))).alias("matrix"))
    p = prompt_delta(metrics).agg(F.to_json(F.sort_array(F.collect_list(F.struct("base_model", "tuning_regime", "delta_overall_avg_f1")))).alias("deltas"))
    o = open_minus_constrained(metrics).agg(F.to_json(F.sort_array(F.collect_list(F.struct("level", "name", "mean_pp", "n")))).alias("conditions"))
    part = lambda df, name: df.select(F.lit(name).alias("part"), F.col(name).alias("json"))
    rows = part(m, "matrix").unionAll(part(p, "deltas")).unionAll(part(o, "conditions"))  # three rows
    return rows.agg(*[F.max(F.when(F.col("part") == n, F.col("json"))).alias(n) for n in ("matrix", "deltas", "conditions")])
