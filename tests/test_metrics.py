import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.config import KEYS, NEGATIVES
from quern.operators import cube as C
from quern.operators import errors as E
from quern.operators import metrics as M

SCHEMA = "gen_id long, eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, prompt_shot int, gen_type string, prompt_0_shot string, relation string, generated_relation string"


def rows(n=400, seed=1, labels=("a", "b", "c", "Other", None, "x" * 70)):
    r = random.Random(seed)
    return [(k, r.choice(["d1", "d2"]), r.choice(["m1", "m2"]), "re_mixtune", 0, 0, "gen_constrained", f"p{k % 50}", r.choice(labels[:5]), r.choice(labels)) for k in range(n)]


def norm(x):
    return "none" if x is None else x.lower()


def slow(pairs, neg):
    labs = {x for p in pairs for x in p} - set(neg)
    c = {x: [0, 0, 0, 0] for x in labs}
    for g, p in pairs:
        if g in c:
            c[g][3] += 1
            c[g][0 if g == p else 2] += 1
        if p in c and g != p:
            c[p][1] += 1
    div = lambda a, b: a / b if b else 0.0
    tp, fp, fn = (sum(v[i] for v in c.values()) for i in range(3))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    own = [v for v in c.values() if v[3]]
    ps, rs = [div(v[0], v[0] + v[1]) for v in own], [div(v[0], v[0] + v[2]) for v in own]
    fs = [div(2 * x * y, x + y) for x, y in zip(ps, rs)]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    return p, r, div(2 * p * r, p + r), div(sum(g == q for g, q in pairs), len(pairs)), len(pairs), mean(ps), mean(rs), mean(fs)


@pytest.mark.parametrize("neg", [NEGATIVES["n1"], []])
def test_against_plain_python(spark, neg):
    data = rows()
    got = M.evaluate(spark.createDataFrame(data, SCHEMA), neg, digits=None).collect()
    groups = {}
    for x in data:
        groups.setdefault((x[1], x[2]), []).append((norm(x[8]), norm(x[9])))
    assert len(got) == len(groups)
    for r in got:
        pairs = groups[r.eval_dataset_name, r.model_id]
        assert [r[m] for m in M.METRICS[:8]] == pytest.approx(slow(pairs, neg))
        allowed = {norm(x[8]) for x in data if x[1] == r.eval_dataset_name and x[8] is not None}
        assert r.schema_valid_rate == pytest.approx(sum(p in allowed for _, p in pairs) / len(pairs))
        assert r.malformed_rate == pytest.approx(sum(len(p) > 60 for _, p in pairs) / len(pairs))
        if not neg:
            assert r.micro_precision == pytest.approx(r.micro_recall) == pytest.approx(r.accuracy)


def test_excluded_and_empty(spark):
    df = spark.createDataFrame([x for x in rows(60) if x[8] == "a"], SCHEMA)
    r = M.micro(C.cube(df), exclude=["a"]).first()
    assert (r.micro_f1, r.accuracy, r.support) == (0.0, 0.0, 0)
    assert M.evaluate(df.limit(0)).count() == 0
    assert M.evaluate(df.withColumn("model_id", F.lit(None).cast("string"))).count() == 0
    assert M.evaluate(df.withColumn("gold", F.lit(1)).withColumn("n", F.lit("x")).withColumn("valid", F.lit(0))).count() > 0


def test_doubling_rows_and_partitions_change_no_rate(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    key = lambda d: sorted(tuple(r) for r in d.drop("support").collect())
    a = key(M.evaluate(df))
    assert key(M.evaluate(df.unionAll(df))) == a
    assert key(M.evaluate(df.repartition(7))) == a


def test_categories(spark):
    neg = NEGATIVES["n4"]
    cases = [("a", "a", True, "correct"), ("a", "other", True, "default_negative"), ("a", "zz", False, "hallucinated"), ("a", "b", True, "near_neighbor"), ("other", "b", True, "false_positive"), ("other", "none", True, "other_error"), ("other", "zz", False, "hallucinated")]
    df = spark.createDataFrame(cases, "g string, p string, v boolean, want string")
    assert df.where(E.classify(F.col("g"), F.col("p"), F.col("v"), neg) != F.col("want")).count() == 0
    cases = [("a", "", False, "malformed_empty"), ("a", "x" * 61, True, "malformed_verbose"), ("a", "zz", False, "hallucinated_relation"), ("a", "b", True, "schema_valid_wrong"), ("a", "a", True, "other")]
    df = spark.createDataFrame(cases, "g string, p string, v boolean, want string")
    assert df.where(E.categorise(F.col("g"), F.col("p"), F.col("v")) != F.col("want")).count() == 0


def test_strata_add_up(spark):
    d = E.strata(spark.createDataFrame(rows(), SCHEMA))
    assert d.where(F.col("total") != sum((F.col(k) for k in E.CATEGORIES), F.lit(0))).count() == 0


def test_deduplication(spark):
    base = [(k, "d", m, "re_mixtune", 0, 0, "gen_open", f"p{k}", "a", "b") for m in ("m1", "m2", "m3") for k in range(4)]
    once = [(100 + k, *x[1:]) for k, x in enumerate(base)]
    twice = once + [(200 + k, *x[1:9], "late") for k, x in enumerate(base[:4])]
    other = [(300, "e", "m1", "re_mixtune", 0, 0, "gen_open", "p", "a", "b"), (301, "e", "m1", "re_mixtune", 0, 0, "gen_open", "p", "a", "c")]
    df = spark.createDataFrame(twice + other, SCHEMA)
    f = C.group_sizes(df).where("flagged").collect()
    assert [(r.eval_dataset_name, r.model_id, r["size"], r["mode"]) for r in f] == [("d", "m1", 8, 4)]
    got = C.deduplicated(df)
    assert got.where("eval_dataset_name = 'd'").count() == 12 and got.where("eval_dataset_name = 'e'").count() == 2
    assert got.where("generated_relation = 'late'").count() == 0
    assert C.deduplicated(df, "always").count() == 13 and C.deduplicated(df, "none").count() == 18
    with pytest.raises(ValueError, match="mode"):
        C.deduplicated(df, "some")


def test_top_confused(spark):
    data = rows()
    got = M.top_confused(C.cube(spark.createDataFrame(data, SCHEMA)), 3)
    for d in ("d1", "d2"):
        want = Counter((norm(x[8]), norm(x[9])) for x in data if x[1] == d and norm(x[8]) != norm(x[9]))
        own = got.where(F.col("eval_dataset_name") == d).orderBy("rank").collect()
        assert [((r["gold"], r["pred"]), r["count"]) for r in own] == sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:3]


def test_metric_plans_have_no_python(spark):
    plan = M.evaluate(spark.createDataFrame(rows(20), SCHEMA).select(*KEYS, "relation", "generated_relation"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cost(spark):
    """Each condition and number of shots is asked for: prompt tokens by characters, system prompt, answers."""
    rows = [(k, "d1", "x" * 400, "x" * 800) for k in range(10)] + [(100 + k, "d2", None, "y" * 40) for k in range(5)]
    d = spark.createDataFrame(rows, "gen_id long, eval_dataset_name string, prompt_0_shot string, prompt_2_shot string")
    got = M.cost(d, {"m": (2.0, 10.0)}).collect()[0]
    inp = 10 * (2 * 100 + 2 * 200 + 300) + 5 * (2 * 0 + 2 * 10 + 300)
    assert got.input_tokens == inp and got.output_tokens == 40 * 15 and got.cost == round(inp / 1e6 * 2 + 600 / 1e6 * 10, 4)
    assert M.cost(d, {"m": (2.0, 10.0)}, {"gen_open": 50}, (0,)).collect()[0].input_tokens == 10 * 150 + 5 * 50
