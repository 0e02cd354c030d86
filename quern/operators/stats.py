"""Resampling, paired tests and regressions on sufficient statistics.

Drawing n rows with replacement and summing indicators is a multinomial draw over the distinct joint states of the indicators, so Spark counts
the states (the work that grows with the rows, with map-side combining) and numpy draws replicates for a few rows of counts. Each group's
generator is seeded by its own name: the results don't depend on partitions or on the order of groups.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import COMPARISONS, CONFIG, DATASETS, GENERAL, LITERARY, NEGATIVES, REGIMES, Comparison
from quern.functions import text as T
from quern.operators.cube import drop_duplicates, primary
from quern.operators.tables import family_pairs, keep_configs, regime

REPLICATES, SEED, LEVEL = 10_000, 42, 0.95


def generator(name: str, seed: int = SEED) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(name.encode())])


def interval(x: np.ndarray, level: float = LEVEL) -> tuple[float, float]:
    a = 100 * (1 - level) / 2
    lo, hi = np.percentile(x, [a, 100 - a])
    return float(lo), float(hi)


def two_sided(x: np.ndarray, clip: bool = True) -> float:
    p = 2 * min(float(np.mean(x <= 0)), float(np.mean(x >= 0)))
    return min(p, 1.0) if clip else p


def accuracy_ci(counts: DataFrame, keys: list[str], replicates: int = REPLICATES) -> DataFrame:
    """counts (keys, hits, support) -> keys, point_f1, ci_lower, ci_upper, ci_width, std. Groups without rows have zeros."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, k = int(row.support), int(row.hits)
                if not n:
                    out.append((0.0,) * 5)
                    continue
                x = generator("|".join(map(str, row[: len(keys)]))).binomial(n, k / n, replicates) / n
                lo, hi = interval(x)
                out.append((round(k / n, 6), round(lo, 6), round(hi, 6), round(hi - lo, 6), round(float(x.std()), 6)))
            yield pd.concat([pdf[keys], pd.DataFrame(out, columns=["point_f1", "ci_lower", "ci_upper", "ci_width", "std"], index=pdf.index)], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keys).schema)
    return counts.select(*keys, "hits", "support").mapInPandas(draw, schema + ", point_f1 double, ci_lower double, ci_upper double, ci_width double, std double")


def domain_ci(counts: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """counts (eval_dataset_name, model_id, tuned_dataset_name, model_shot, hits, support) -> intervals of the mean accuracy over a domain's datasets."""
    both = F.explode(F.array(F.when(F.col("eval_dataset_name").isin(GENERAL), "general").otherwise("literary"), F.lit("overall"))).alias("domain")
    d = counts.where(F.col("eval_dataset_name").isin(DATASETS) & (F.col("support") > 0)).select("*", both)
    d = d.groupBy("model_id", "tuned_dataset_name", "model_shot", "domain").agg(F.sort_array(F.collect_list(F.struct("eval_dataset_name", "hits", "support"))).alias("parts"))  # a part for each dataset

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, r, s, dom, parts in pdf.itertuples(index=False):
                g = generator(f"{m}|{r}|{s}|{dom}")
                x = np.mean([g.binomial(p["support"], p["hits"] / p["support"], replicates) / p["support"] for p in parts], axis=0)
                lo, hi = interval(x)
                out.append((m, r, REGIMES.get(r, r), s, dom, len(parts), round(float(np.mean([p["hits"] / p["support"] for p in parts])), 4), round(lo, 4), round(hi, 4), round(hi - lo, 4)))
            yield pd.DataFrame(out, columns=["model_id", "tuned_dataset_name", "tuning_display", "model_shot", "domain", "n_datasets", "point_avg_f1", "ci_lower", "ci_upper", "ci_width"])

    return d.mapInPandas(draw, "model_id string, tuned_dataset_name string, tuning_display string, model_shot int, domain string, n_datasets int, point_avg_f1 double, ci_lower double, ci_upper double, ci_width double")


def datasets_of(domain: str) -> list[str]:
    return {"general": GENERAL, "literary": LITERARY}.get(domain, DATASETS)


def sides(comparisons: list[Comparison] = COMPARISONS) -> Column:
    """Array of struct<comparison, side>: where a row of a configuration takes part."""
    takes = []
    for c in comparisons:
        for side, (m, r, s) in (("a", c.a), ("b", c.b)):
            own = (F.col("model_id") == m) & (F.col("tuned_dataset_name") == r) & (F.col("model_shot") == s) & F.col("eval_dataset_name").isin(datasets_of(c.domain))
            takes.append(F.when(own, F.struct(F.lit(c.name).alias("comparison"), F.lit(side).alias("side"))))
    return F.filter(F.array(*takes), lambda x: x.isNotNull())


def aligned(rows: DataFrame, comparisons: list[Comparison] = COMPARISONS, normalizer: str = "n1") -> DataFrame:
    """Rows of both sides of each comparison brought together by (dataset, prompt hash, occurrence): comparison, eval_dataset_name, gold_a, pred_a, gold_b, pred_b.

    Duplicates (all but the answer equal) are taken out first, so the occurrences of a prompt are its distinct gold labels, in their order.
    A group-by brings the sides together: there is no join, and a prompt with a third of all rows is combined map-side.
    """
    d = primary(rows.select("gen_id", "eval_dataset_name", *CONFIG, "relation", "generated_relation", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash")))
    d = keep_configs(d, [x for c in comparisons for x in (c.a, c.b)])
    d = drop_duplicates(d, ["eval_dataset_name", *CONFIG, "prompt_hash", "relation"], "gen_id")
    occ = F.row_number().over(Window.partitionBy("eval_dataset_name", *CONFIG, "prompt_hash").orderBy("relation"))
    norm = T.NORMALIZERS[normalizer]
    d = d.withColumn("occ", occ)  # before the rows are multiplied by comparison
    d = d.select("eval_dataset_name", "prompt_hash", "occ", norm(F.col("relation")).alias("gold"), norm(F.col("generated_relation")).alias("pred"), F.explode(sides(comparisons)).alias("x"))
    of = lambda side, c: F.max(F.when(F.col("x.side") == side, F.col(c))).alias(f"{c}_{side}")
    d = d.groupBy(F.col("x.comparison").alias("comparison"), "eval_dataset_name", "prompt_hash", "occ").agg(*[of(s, c) for s in "ab" for c in ("gold", "pred")])
    return d.where("gold_a is not null and gold_b is not null")


def contingency(pairs: DataFrame) -> DataFrame:
    """How often both, one or none of a comparison's sides is right, the gold label being that of the first side."""
    a, b = F.col("gold_a") == F.col("pred_a"), F.col("gold_a") == F.col("pred_b")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return pairs.groupBy("comparison").agg(F.count("*").alias("n_examples"), n(a & b, "n11"), n(~a & ~b, "n00"), n(a & ~b, "n10"), n(~a & b, "n01"))


def chi2(b: Column, c: Column) -> Column:
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / (b + c)).otherwise(0.0)


def mcnemar(table: DataFrame) -> DataFrame:
    """McNemar's statistic with continuity correction and odds ratio (infinite is null); the p-value is made by p_value, as Spark has no erfc."""
    b, c = F.col("n10"), F.col("n01")
    return table.select("comparison", "n_examples", "n11", "n00", "n10", "n01", F.round(chi2(b, c), 4).alias("mcnemar_chi2"), F.round(F.when(c > 0, b / c), 4).alias("odds_ratio"))


def p_value(chi: float) -> float:
    """Of a chi-squared value with one degree of freedom."""
    return math.erfc(math.sqrt(chi / 2)) if chi > 0 else 1.0


def paired(table: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Paired bootstrap and McNemar test of each comparison, from its contingency."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, n, n11, n00, n10, n01 in pdf.itertuples(index=False):
                k = generator(name).multinomial(n, [n10 / n, n01 / n, 1 - (n10 + n01) / n], replicates)
                x = (k[:, 0] - k[:, 1]) / n
                lo, hi = interval(x)
                p, chi = two_sided(x), ((abs(n10 - n01) - 1) ** 2 / (n10 + n01) if n10 + n01 else 0.0)
                q = p_value(chi) if n10 + n01 else 1.0
                out.append((name, n, round((n11 + n10) / n, 4), round((n11 + n01) / n, 4), round((n10 - n01) / n, 6), round(p, 6), round(float(np.mean(x <= 0)), 6), round(lo, 6), round(hi, 6), p < 0.05, p < 0.01, round(chi, 4), round(q, 6), q < 0.05, stars(p)))
            yield pd.DataFrame(out, columns=PAIRED)

    types = ["string", "long", *["double"] * 7, "boolean", "boolean", "double", "double", "boolean", "string"]
    return table.select("comparison", "n_examples", "n11", "n00", "n10", "n01").mapInPandas(draw, ", ".join(f"{c} {t}" for c, t in zip(PAIRED, types)))


PAIRED = ["comparison", "n_examples", "f1_a", "f1_b", "delta_f1", "pb_p_two_sided", "pb_p_one_sided", "pb_ci_lower", "pb_ci_upper", "pb_significant_05", "pb_significant_01", "mcnemar_chi2", "mcnemar_p", "mcnemar_significant_05", "stars"]


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "n.s."


def stars_of(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def indicators(gold: Column, pred: Column, negatives: list[str]) -> list[Column]:
    """tp, fp, fn of the positive classes as 0 or 1."""
    g, p, hit = ~gold.isin(negatives), ~pred.isin(negatives), gold == pred
    return [x.cast("int") for x in (g & hit, p & ~hit, g & ~hit)]


STATE = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]


def joint_states(pairs: DataFrame, negatives: list[str] = NEGATIVES["n2"]) -> DataFrame:
    """Counts of the joint indicator states (at most 16) of each comparison and dataset."""
    ab = [*indicators(F.col("gold_a"), F.col("pred_a"), negatives), *indicators(F.col("gold_b"), F.col("pred_b"), negatives)]
    return pairs.select("comparison", "eval_dataset_name", *[x.alias(s) for x, s in zip(ab, STATE)]).groupBy("comparison", "eval_dataset_name", *STATE).agg(F.count("*").alias("n"))


def f1(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    den = 2 * tp + fp + fn
    return np.where(den > 0, 2 * tp / np.maximum(den, 1), 0.0)


def clustered(states: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Difference of positive-class F1, averaged over datasets, with interval and p-value (not clipped): each dataset's rows are drawn by themselves."""
    parts = states.groupBy("comparison").agg(F.sort_array(F.collect_list(F.struct("eval_dataset_name", *STATE, "n"))).alias("parts"))  # at most 16 parts for each dataset

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, parts in pdf.itertuples(index=False):
                by: dict[str, list] = {}
                for p in parts:
                    by.setdefault(p["eval_dataset_name"], []).append(([p[s] for s in STATE], p["n"]))
                g, draws, base_a, base_b = generator(name), [], [], []
                for own in by.values():
                    s, n = np.array([x for x, _ in own], float), np.array([k for _, k in own], float)
                    both = lambda k, s=s: (f1(*(k @ s[:, :3]).T), f1(*(k @ s[:, 3:]).T))
                    a, b = both(n[None, :])
                    base_a.append(a[0])
                    base_b.append(b[0])
                    a, b = both(g.multinomial(int(n.sum()), n / n.sum(), replicates).astype(float))
                    draws.append(a - b)
                x = np.mean(draws, axis=0)
                lo, hi = interval(x)
                out.append((name, len(by), float(np.mean(base_a)), float(np.mean(base_b)), float(np.mean(base_a) - np.mean(base_b)), lo, hi, two_sided(x, clip=False)))
            yield pd.DataFrame(out, columns=["comparison", "n_datasets", "f1_a", "f1_b", "delta", "ci_lower", "ci_upper", "p"])

    return parts.mapInPandas(draw, "comparison string, n_datasets int, f1_a double, f1_b double, delta double, ci_lower double, ci_upper double, p double")


def frontier_states(generation: DataFrame, frontier: DataFrame, config: tuple[str, str, int], negatives: list[str] = NEGATIVES["n3"]) -> DataFrame:
    """Joint states of a tuned configuration and each served model on the prompts both have, many to many: comparison, eval_dataset_name, states, n, and the rows.

    Both sides are first counted by hash and state (at most four), so a hot hash on both sides costs sixteen rows and not the product of its rows.
    """
    norm = T.NORMALIZERS["n3"]
    ind = lambda s: [x.alias(f"{n}_{s}") for x, n in zip(indicators(norm(F.col("relation")), norm(F.col("generated_relation")), negatives), ("tp", "fp", "fn"))]
    a = keep_configs(primary(generation.where(F.col("eval_dataset_name").isNotNull())), [config])
    a = a.select("eval_dataset_name", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"), *ind("a")).groupBy("eval_dataset_name", "prompt_hash", *STATE[:3]).agg(F.count("*").alias("na"))
    b = frontier.where((F.col("gen_type") == "gen_constrained") & F.col("model_id").isNotNull()).select("eval_dataset_name", "prompt_hash", "model_id", *ind("b")).groupBy("eval_dataset_name", "prompt_hash", "model_id", *STATE[3:]).agg(F.count("*").alias("nb"))
    return a.join(b, ["eval_dataset_name", "prompt_hash"]).groupBy(F.col("model_id").alias("comparison"), "eval_dataset_name", *STATE).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def served_states(generation: DataFrame, frontier: DataFrame, comparisons: list[Comparison], negatives: list[str] = NEGATIVES["n3"]) -> DataFrame:
    """Joint states of several tuned configurations, each with the served models it is compared with, on the prompts both have: comparison, eval_dataset_name, states, n.

    Both sides are counted by hash and state before they are joined, all configurations in one pass. A comparison without rows has none here.
    """
    norm = T.NORMALIZERS["n3"]
    ind = lambda s: [x.alias(f"{n}_{s}") for x, n in zip(indicators(norm(F.col("relation")), norm(F.col("generated_relation")), negatives), ("tp", "fp", "fn"))]
    own = ["model_id", "tuned_dataset_name", "model_shot"]
    a = keep_configs(primary(generation.where(F.col("eval_dataset_name").isNotNull())), list(dict.fromkeys(c.a for c in comparisons)))
    a = a.select("eval_dataset_name", *own, T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"), *ind("a")).groupBy("eval_dataset_name", "prompt_hash", *own, *STATE[:3]).agg(F.count("*").alias("na"))
    b = frontier.where((F.col("gen_type") == "gen_constrained") & F.col("model_id").isin([c.b[0] for c in comparisons])).select("eval_dataset_name", "prompt_hash", F.col("model_id").alias("served"), *ind("b")).groupBy("eval_dataset_name", "prompt_hash", "served", *STATE[3:]).agg(F.count("*").alias("nb"))
    name = F.lit(None).cast("string")
    for c in comparisons:
        m, r, k = c.a
        same = (F.col("model_id") == m) & (F.col("tuned_dataset_name") == r) & (F.col("model_shot") == k) & (F.col("served") == c.b[0])
        name = F.when(same & F.col("eval_dataset_name").isin(datasets_of(c.domain)), c.name).otherwise(name)
    j = a.join(b, ["eval_dataset_name", "prompt_hash"]).withColumn("comparison", name).where(F.col("comparison").isNotNull())
    return j.groupBy("comparison", "eval_dataset_name", *STATE).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def listed_first(df: DataFrame, names: list[str], column: str = "comparison") -> DataFrame:
    """A row for each of the names, in their order, those without rows in df with nulls."""
    rows = df.sparkSession.createDataFrame(list(enumerate(names)), f"place int, {column} string")
    return rows.join(df, column, "left")


def hit_rate(generation: DataFrame, frontier: DataFrame, config: tuple[str, str, int]) -> DataFrame:
    """Joined rows for a row of the served model, by model and dataset (may exceed 1: many to many), with the mean over datasets."""
    joined = frontier_states(generation, frontier, config).groupBy(F.col("comparison").alias("model_id"), "eval_dataset_name").agg(F.sum("n").alias("joined"))
    rows = frontier.where((F.col("gen_type") == "gen_constrained") & F.col("model_id").isNotNull()).groupBy("model_id", "eval_dataset_name").agg(F.count("*").alias("n"))
    d = rows.join(joined, ["model_id", "eval_dataset_name"], "left").select("model_id", "eval_dataset_name", F.coalesce("joined", F.lit(0)).alias("joined"), "n")
    rate = F.col("joined") / F.greatest("n", F.lit(1))
    return d.withColumns({"hit_rate": F.round(rate, 6), "mean_hit_rate": F.round(F.avg(rate).over(Window.partitionBy("model_id")), 6)})


def family_delta(metrics: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """Mean difference of large and small model of a family; interval by drawing datasets."""
    per = family_pairs(metrics).groupBy("family", "eval_dataset_name").agg(F.sum("delta").alias("s"), F.count("*").alias("n"))
    per = per.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("eval_dataset_name", "s", "n"))).alias("parts"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, parts in pdf.itertuples(index=False):
                s, n = np.array([p["s"] for p in parts]), np.array([p["n"] for p in parts], float)
                k = generator(name).multinomial(len(n), np.full(len(n), 1 / len(n)), replicates)
                lo, hi = interval((k @ s) / (k @ n))
                out.append((name, int(n.sum()), float(s.sum() / n.sum()), lo, hi))
            yield pd.DataFrame(out, columns=["family", "n_pairs", "delta", "ci_lower", "ci_upper"])

    return per.mapInPandas(draw, "family string, n_pairs int, delta double, ci_lower double, ci_upper double")


def family_delta_by_regime(metrics: DataFrame) -> DataFrame:
    return family_pairs(metrics).groupBy("family", regime().alias("regime")).agg(F.count("*").alias("n_pairs"), F.round(F.avg("delta"), 6).alias("delta"))


def design(controls: dict[str, list]) -> list[Column]:
    """Constant, log of the size, and an indicator for each level but the first of each control."""
    return [F.lit(1.0), F.log10(F.col("params_b")), *[(F.col(c) == v).cast("double") for c, levels in controls.items() for v in levels[1:]]]


def normal_equations(d: DataFrame, x: list[Column], y: str) -> DataFrame:
    """Sums of products (x'x by rows, then x'y) for each dataset."""
    sums = [F.sum(a * b) for a in x for b in x] + [F.sum(a * F.col(y)) for a in x]
    return d.groupBy("eval_dataset_name").agg(F.array(*sums).alias("sums"))


def slope(d: DataFrame, controls: dict[str, list], name: str, replicates: int = REPLICATES) -> DataFrame:
    """Slope of F1 on the log of the size with controls, by least squares of least norm; interval by drawing datasets (their weighted sums of products)."""
    x = design(controls)
    k = len(x)
    parts = normal_equations(d, x, "micro_f1").groupBy(F.lit(name).alias("model")).agg(F.sort_array(F.collect_list(F.struct("eval_dataset_name", "sums"))).alias("parts"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for model, parts in pdf.itertuples(index=False):
                s = np.array([p["sums"] for p in parts], float)
                solve = lambda w, s=s: (np.linalg.pinv((t := w @ s)[:, : k * k].reshape(-1, k, k), rcond=1e-10) @ t[:, k * k :, None])[:, 1, 0]
                w = generator(model).multinomial(len(s), np.full(len(s), 1 / len(s)), replicates).astype(float)
                lo, hi = interval(solve(w))
                out.append((model, len(s), float(solve(np.ones((1, len(s))))[0]), lo, hi))
            yield pd.DataFrame(out, columns=["model", "n_datasets", "slope", "ci_lower", "ci_upper"])

    return parts.mapInPandas(draw, "model string, n_datasets int, slope double, ci_lower double, ci_upper double")
