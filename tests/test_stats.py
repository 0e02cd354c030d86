import math
import random

import numpy as np
import pytest

from quern.config import COMPARISONS, REGIMES
from quern.operators import stats as S

SCHEMA = "gen_id long, eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, prompt_shot int, gen_type string, prompt_0_shot string, relation string, generated_relation string"


def test_accuracy_interval(spark):
    d = spark.createDataFrame([("a", 400, 1000), ("b", 0, 0), ("c", 50, 50)], "k string, hits long, support long")
    got = {r.k: r for r in S.accuracy_ci(d, ["k"]).collect()}
    sd = math.sqrt(0.4 * 0.6 / 1000)
    a = got["a"]
    assert a.point_f1 == 0.4 and a.std == pytest.approx(sd, rel=0.05)
    assert a.ci_lower == pytest.approx(0.4 - 1.96 * sd, abs=0.003) and a.ci_upper == pytest.approx(0.4 + 1.96 * sd, abs=0.003)
    assert (got["b"].point_f1, got["b"].ci_width) == (0.0, 0.0) and got["c"].ci_lower == 1.0
    again = {r.k: r for r in S.accuracy_ci(d.repartition(3), ["k"]).collect()}
    assert again == got


def test_paired(spark):
    t = spark.createDataFrame([("x", 100, 50, 20, 25, 5), ("same", 10, 6, 4, 0, 0)], "comparison string, n_examples long, n11 long, n00 long, n10 long, n01 long")
    got = {r.comparison: r for r in S.paired(t).collect()}
    x = got["x"]
    assert x.delta_f1 == 0.2 and x.f1_a == 0.75 and x.f1_b == 0.55
    assert x.mcnemar_chi2 == pytest.approx(361 / 30, abs=1e-4) and x.mcnemar_p == pytest.approx(math.erfc(math.sqrt(361 / 60)), abs=1e-6)
    assert x.pb_ci_lower < 0.2 < x.pb_ci_upper and x.pb_significant_01 and x.stars in ("***", "**")
    assert got["same"].pb_p_two_sided == 1.0 and got["same"].mcnemar_p == 1.0 and got["same"].stars == "n.s."
    assert {r.comparison: r.mcnemar_chi2 for r in S.mcnemar(t).collect()} == {"x": x.mcnemar_chi2, "same": 0.0}


def rows(n=80, seed=3):
    r = random.Random(seed)
    out = []
    for c in {x for k in COMPARISONS for x in (k.a, k.b)}:
        for d in ("tacred", "pg_fiction"):
            for k in range(n):
                gold = "abo"[k % 3]
                out.append((len(out), d, *c[:2], c[2], c[2], "gen_constrained", f"p{k}", "other" if gold == "o" else gold, r.choice(["a", "b", "other"])))
                if k % 9 == 0:  # a repeated row with another answer
                    out.append((len(out), *out[-1][1:9], "late"))
    return out


def test_alignment_and_clustered_bootstrap(spark):
    pairs = S.aligned(spark.createDataFrame(rows(), SCHEMA), normalizer="n2")
    by = {r["comparison"]: r["count"] for r in pairs.groupBy("comparison").count().collect()}
    assert by == {c.name: 80 if c.domain != "all" else 160 for c in COMPARISONS}
    assert pairs.where("pred_a = 'late' or gold_a <> gold_b").count() == 0
    states = S.joint_states(pairs)
    assert states.groupBy("comparison").sum("n").collect()
    got = S.clustered(states, 4000).collect()
    local = pairs.toPandas()
    neg = {"", "none", "other", "no_relation", "na"}
    for r in got:
        f = {"a": [], "b": []}
        for _, part in local[local.comparison == r.comparison].groupby("eval_dataset_name"):
            for s in "ab":
                g, p = part[f"gold_{s}"], part[f"pred_{s}"]
                tp = sum((a == b) and a not in neg for a, b in zip(g, p))
                fp = sum((a != b) and b not in neg for a, b in zip(g, p))
                fn = sum((a != b) and a not in neg for a, b in zip(g, p))
                f[s].append(2 * tp / (2 * tp + fp + fn))
        assert r.f1_a == pytest.approx(np.mean(f["a"])) and r.f1_b == pytest.approx(np.mean(f["b"]))
        assert r.ci_lower <= r.delta <= r.ci_upper


def metrics(spark, seed=5):
    r = np.random.default_rng(seed)
    size = {"m1": 0.4, "m2": 0.5, "m3": 3.0, "m4": 3.2}
    out = [(d, m, reg, s, {"m1": "A", "m2": "B", "m3": "A", "m4": "B"}[m], p, float(0.3 + 0.1 * np.log10(p) + 0.05 * s + r.normal() * 0.02)) for d in ("x", "y", "z") for m, p in size.items() for reg in REGIMES for s in (0, 2)]
    return out, spark.createDataFrame(out, "eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, family string, params_b double, micro_f1 double")


@pytest.mark.parametrize("controls", [{"tuned_dataset_name": list(REGIMES), "model_shot": [0, 2]}, {"family": ["A", "B"], "tuned_dataset_name": list(REGIMES), "model_shot": [0, 2]}])
def test_slope_equals_least_squares(spark, controls):
    out, df = metrics(spark)
    cols = {"tuned_dataset_name": 2, "model_shot": 3, "family": 4}
    x = np.array([[1.0, np.log10(r[5])] + [float(r[cols[c]] == v) for c, vs in controls.items() for v in vs[1:]] for r in out])
    want = np.linalg.lstsq(x, np.array([r[6] for r in out]), rcond=None)[0][1]
    got = S.slope(df, controls, "t", 500).first()
    assert got.slope == pytest.approx(want, abs=1e-9) and got.ci_lower <= got.slope <= got.ci_upper and got.n_datasets == 3


def test_domain_interval_and_hot_hash(spark):
    d = spark.createDataFrame([("tacred", "m", "r", 0, 8, 10), ("gids", "m", "r", 0, 5, 10), ("pg_fiction", "m", "r", 0, 0, 0)], "eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, hits long, support long")
    got = {r.domain: r for r in S.domain_ci(d).collect()}
    assert set(got) == {"general", "overall"} and got["general"].point_avg_f1 == 0.65 and got["general"].n_datasets == 2
    c = COMPARISONS[0].a
    g = spark.createDataFrame([(k, "tacred", c[0], c[1], c[2], c[2], "gen_constrained", "p", "a", "a" if k % 2 else "b") for k in range(300)], SCHEMA)
    import hashlib

    h = hashlib.md5(b"p").hexdigest()[:12]
    f = spark.createDataFrame([("tacred", h, "a", "gen_constrained", "served", "a")] * 200 + [("tacred", "zz", "a", "gen_constrained", "served", None)] * 50, "eval_dataset_name string, prompt_hash string, relation string, gen_type string, model_id string, generated_relation string")
    assert S.frontier_states(g, f, c).agg({"n": "sum"}).first()[0] == 300 * 200
    r = S.hit_rate(g, f, c).first()
    assert (r.joined, r.n, r.hit_rate) == (60_000, 250, 240.0)


def test_served_comparisons(spark):
    """Six comparisons: joint states are those of a plain many-to-many join, and those without rows stay, empty."""
    import hashlib

    from quern.config import served_comparisons

    cs = served_comparisons(["s1", "s2"])
    assert len(cs) == 6 and len({c.name for c in cs}) == 6
    r = random.Random(8)
    h = lambda p: hashlib.md5(p.encode()).hexdigest()[:12]
    own, served = [], []
    for c in cs[::2]:
        for d in ("tacred", "pg_fiction"):
            own += [(len(own) + k, d, *c.a, c.a[2], "gen_constrained", f"p{k % 6}", "ab"[k % 2], r.choice(["a", "b", "other"])) for k in range(20)]
    for k in range(60):
        served.append((r.choice(["tacred", "pg_fiction"]), h(f"p{k % 8}"), "s1", "gen_constrained", "ab"[k % 2], r.choice(["a", "b", "none"])))
    g = spark.createDataFrame(own, SCHEMA)
    f = spark.createDataFrame(served, "eval_dataset_name string, prompt_hash string, model_id string, gen_type string, relation string, generated_relation string")
    got = {(x.comparison, x.eval_dataset_name): x.n for x in S.served_states(g, f, cs).groupBy("comparison", "eval_dataset_name").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    want = {}
    for c in cs:
        for x in own:
            for y in served:
                if x[2:5] == c.a and y[2] == c.b[0] and x[1] == y[0] and h(x[7]) == y[1] and x[1] in S.datasets_of(c.domain):
                    want[c.name, x[1]] = want.get((c.name, x[1]), 0) + 1
    assert got == want and want
    d = S.listed_first(S.clustered(S.served_states(g, f, cs), 200), [c.name for c in cs]).orderBy("place").collect()
    assert [x.comparison for x in d] == [c.name for c in cs] and {x.delta is None for x in d if "s2" in x.comparison} == {True}
