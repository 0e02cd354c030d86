"""Metrics of classification from the confusion cube: micro, macro, per class, schema validity, malformed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import KEYS, NEGATIVES
from quern.operators.cube import cube, negative

MALFORMED = 60  # characters above which an answer can't be a label


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return safe_div(2 * p * r, p + r)


def counts(c: DataFrame, negatives: list[str], keys: list[str] = KEYS) -> DataFrame:
    """tp, fp, fn over the positive labels, hits and rows of each group."""
    n, hit = F.col("n"), F.col("gold") == F.col("pred")
    gold_neg, pred_neg = negative(F.col("gold"), negatives), negative(F.col("pred"), negatives)
    some = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return c.groupBy(*keys).agg(some(hit & ~gold_neg).alias("tp"), some(~hit & ~pred_neg).alias("fp"), some(~hit & ~gold_neg).alias("fn"), some(hit).alias("hits"), F.sum(n).alias("support"))


def micro(c: DataFrame, negatives: list[str] = NEGATIVES["n1"], exclude: list[str] = (), keys: list[str] = KEYS) -> DataFrame:
    """micro_precision, micro_recall, micro_f1, accuracy and support, unrounded. Without negatives all four equal the accuracy. Groups all of whose gold labels are excluded have zeros."""
    kept = c.withColumn("n", F.when(negative(F.col("gold"), list(exclude)), 0).otherwise(F.col("n"))) if exclude else c
    k = counts(kept, list(negatives), keys)
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    k = k.select(*keys, p.alias("micro_precision"), r.alias("micro_recall"), safe_div(F.col("hits"), F.col("support")).alias("accuracy"), "support")
    return k.select(*keys, "micro_precision", "micro_recall", f1_of(F.col("micro_precision"), F.col("micro_recall")).alias("micro_f1"), "accuracy", "support")


def by_label(c: DataFrame, exclude: list[str] = (), keys: list[str] = KEYS) -> DataFrame:
    """tp, fp, fn and support of each label of a group, gold or predicted. One shuffle of the cube: each of its rows counts for its gold and, if another, its predicted label."""
    if exclude:
        c = c.where(~negative(F.col("gold"), list(exclude)))
    hit, n, zero = F.col("gold") == F.col("pred"), F.col("n"), F.lit(0).cast("long")
    side = lambda label, tp, fp, fn, s: F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), s.alias("support"))
    gold = side(F.col("gold"), F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n), n)
    pred = side(F.col("pred"), zero, n, zero, zero)
    sides = c.select(*keys, F.explode(F.when(hit, F.array(gold)).otherwise(F.array(gold, pred))).alias("x")).select(*keys, "x.*")
    return sides.groupBy(*keys, "label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "support")])


def per_class(c: DataFrame, negatives: list[str] = NEGATIVES["n1"], exclude: list[str] = (), keys: list[str] = KEYS) -> DataFrame:
    """precision, recall, f1 and support of each gold label that is no negative, unrounded."""
    k = by_label(c, exclude, keys).where((F.col("support") > 0) & ~negative(F.col("label"), list(negatives)))
    k = k.withColumns({"precision": safe_div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return k.select(*keys, "label", "precision", "recall", f1_of(F.col("precision"), F.col("recall")).alias("f1"), "support")


def macro(c: DataFrame, negatives: list[str] = NEGATIVES["n1"], exclude: list[str] = (), keys: list[str] = KEYS) -> DataFrame:
    """Unweighted means over the gold labels; labels that are only predicted are not averaged. Groups without such a label have zeros."""
    k = by_label(c, exclude, keys)
    k = k.withColumns({"p": safe_div(F.col("tp"), F.col("tp") + F.col("fp")), "r": safe_div(F.col("tp"), F.col("tp") + F.col("fn"))})
    own = (F.col("support") > 0) & ~negative(F.col("label"), list(negatives))
    mean = lambda x: F.coalesce(F.avg(F.when(own, x)), F.lit(0.0))
    return k.groupBy(*keys).agg(mean(F.col("p")).alias("macro_precision"), mean(F.col("r")).alias("macro_recall"), mean(f1_of(F.col("p"), F.col("r"))).alias("macro_f1"))


def allowed(c: DataFrame, by: list[str] = ("eval_dataset_name",)) -> DataFrame:
    """The normalised gold labels of each dataset, those of null gold only if another gold reads the same.

    Told by a sum of the cube's counts: a filter would be pushed below the cube, an aggregate without counts merged with it, and cost a second scan.
    """
    return c.groupBy(*by, F.col("gold").alias("label")).agg(F.sum(F.when(F.col("gold_null"), 0).otherwise(F.col("n"))).alias("_n")).where("_n > 0").drop("_n")


def in_schema(c: DataFrame, labels: DataFrame, by: list[str] = ("eval_dataset_name",), pred: str = "pred") -> DataFrame:
    """The cube with valid: whether the prediction is an allowed label."""
    lab = labels.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("label").alias("_label"), F.lit(True).alias("_valid"))
    on = F.col(pred) == F.col("_label")
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    return c.join(lab, on, "left").withColumn("valid", F.coalesce("_valid", F.lit(False))).drop(*[f"_{b}" for b in by], "_label", "_valid")


def quality(c: DataFrame, labels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """schema_valid_rate and malformed_rate over all rows of a group, whatever is excluded elsewhere."""
    n = F.col("n")
    rate = lambda cond: F.sum(F.when(cond, n).otherwise(0)) / F.sum(n)
    return in_schema(c, labels).groupBy(*keys).agg(rate(F.col("valid")).alias("schema_valid_rate"), rate((F.length("pred") > MALFORMED) | (F.col("pred") == "")).alias("malformed_rate"))


METRICS = ["micro_precision", "micro_recall", "micro_f1", "accuracy", "support", "macro_precision", "macro_recall", "macro_f1", "schema_valid_rate", "malformed_rate"]


def evaluate(rows: DataFrame, negatives: list[str] = NEGATIVES["n1"], exclude: list[str] = (), keys: list[str] = KEYS, digits: int | None = 6, labels: DataFrame | None = None) -> DataFrame:
    """All metrics of each group. The allowed labels are the dataset's gold labels over all configurations, unless given.

    Rows with a null key are left out; an empty table gives no rows. Rounded half up to `digits`.
    """
    c = cube(rows, keys=keys)
    labels = allowed(c) if labels is None else labels
    out = micro(c, negatives, exclude, keys).join(macro(c, negatives, exclude, keys), keys, "left").join(quality(c, labels, keys), keys)
    return out.select(*keys, *[rounded(m, digits) for m in METRICS])


def rounded(m: str, digits: int | None) -> Column:
    x = F.coalesce(F.col(m), F.lit(0.0)) if m.startswith("macro") else F.col(m)
    return x.alias(m) if digits is None or m == "support" else F.round(x, digits).alias(m)


def top_confused(c: DataFrame, k: int = 10, keys: list[str] = ("eval_dataset_name",)) -> DataFrame:
    """The k most frequent pairs of a gold label and another predicted one, of each group; of equal counts those first in the order of labels."""
    from pyspark.sql import Window

    pairs = c.where("gold <> pred").groupBy(*keys, "gold", "pred").agg(F.sum("n").alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "gold", "pred"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def cost(rows: DataFrame, rates: dict[str, tuple[float, float]], conditions: dict[str, int] = {"gen_constrained": 100, "gen_open": 50}, shots: tuple[int, ...] = (0, 2), key: str = "gen_id", first: int = 100, chars: int = 4, out: int = 10) -> DataFrame:
    """Tokens and cost of asking each served model for every row under every condition and number of shots.

    rates: dollars for a million input and output tokens, by model; conditions: tokens of the system prompt. A dataset's prompts are as long as
    its first rows' are on average (a window that Spark cuts to `first` rows while it sorts), `chars` characters a token; an answer has `out`.
    Null prompts have no length; a null dataset is one of its own.
    """
    lengths = [F.length(F.coalesce(f"prompt_{s}_shot", F.lit(""))).alias(f"l{s}") for s in shots]
    g = rows.select("eval_dataset_name", key, *lengths)
    n = g.groupBy("eval_dataset_name").agg(F.count("*").alias("n"))
    some = g.withColumn("k", F.row_number().over(Window.partitionBy("eval_dataset_name").orderBy(key))).where(F.col("k") <= first)
    t = some.groupBy(F.col("eval_dataset_name").alias("d")).agg(*[(F.avg(f"l{s}") / chars).alias(f"t{s}") for s in shots])
    t = t.join(n, F.col("d").eqNullSafe(F.col("eval_dataset_name")))
    one = sum((F.col(f"t{s}") + system for s in shots for system in conditions.values()), F.lit(0.0))
    inp, outp = F.sum(one * F.col("n")), F.sum(out * len(shots) * len(conditions) * F.col("n"))
    prices = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(a).alias("price_in"), F.lit(b).alias("price_out")) for k, (a, b) in rates.items()])).alias("p")
    d = t.select("*", prices).select("*", "p.*")
    return d.groupBy("model").agg(F.round(inp, 0).alias("input_tokens"), outp.alias("output_tokens"), F.round(inp / 1e6 * F.max("price_in") + outp / 1e6 * F.max("price_out"), 4).alias("cost"))
