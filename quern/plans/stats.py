"""Queries of resampling, paired tests and regressions. Where draws are made, SQL checks the counts and estimates they rest on in the queries beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import ANOMALIES, COMPARISONS, FAMILY, KEYS, NEGATIVES, REGIMES, SHOTS, TABLE, key_comparisons, served_comparisons
from quern.operators import cube as C
from quern.operators import metrics as M
from quern.operators import stats as S
from quern.operators import tables as R
from quern.operators.errors import lookup
from quern.plans.base import CUBE, HASHED, K, PRIMARY, REGIME, SAME, generation, is_config, label_sql, line, listed, normal, normals, query, read
from quern.plans.metrics import evaluated
from quern.plans.tables import FAM, W

LARGE = ("Llama-3.2-3B-Instruct", "re_gentune", 2)


def hits(spark, sf):
    """Hits and rows of each configuration of the main condition, duplicates taken out."""
    return M.counts(C.cube(C.primary(C.deduplicated(generation(spark, sf), "always"))), [])


ALWAYS = f"{HASHED}, dd_ as (select * from hashed_ where {PRIMARY} qualify row_number() over (partition by {SAME} order by gen_id) = 1)"


@query(f"with {ALWAYS}, {normals('dd_')} select {K}, count(*) filter (gold = pred) as hits, count(*) as support, round(count(*) filter (gold = pred) / count(*)::double, 6) as point_f1 from rows_ group by all")
def stat_b01_counts(spark, sf):
    d = hits(spark, sf)
    return d.select(*KEYS, "hits", "support", F.round(F.col("hits") / F.col("support"), 6).alias("point_f1"))


@query()
def stat_b01_bootstrap_accuracy_ci(spark, sf):
    return S.accuracy_ci(hits(spark, sf), KEYS)


@query()
def stat_b04_bootstrap_domain_avg(spark, sf):
    return S.domain_ci(hits(spark, sf))


def _takes(side, comparisons=COMPARISONS):
    return " union all ".join(f"select '{c.name}' as comparison, d.* from dd_ d where model_id = '{x[0]}' and tuned_dataset_name = '{x[1]}' and model_shot = {x[2]} and eval_dataset_name in ({listed(S.datasets_of(c.domain))})" for c in comparisons for x in [getattr(c, side)])


OCC = "row_number() over (partition by comparison, eval_dataset_name, prompt_hash order by relation nulls first) as occ"
aligned_sql = lambda cs: f"with {ALWAYS}, a as (select comparison, eval_dataset_name, prompt_hash, {OCC}, {normal('relation', 'gold_a')}, {normal('generated_relation', 'pred_a')} from ({_takes('a', cs)})), b as (select comparison, eval_dataset_name, prompt_hash, {OCC}, {normal('relation', 'gold_b')}, {normal('generated_relation', 'pred_b')} from ({_takes('b', cs)})), pair_ as (select comparison, eval_dataset_name, prompt_hash, occ, gold_a, pred_a, gold_b, pred_b from a join b using (comparison, eval_dataset_name, prompt_hash, occ))"
ALIGNED = aligned_sql(COMPARISONS)
COUNTED = f"{ALIGNED}, t as (select comparison, count(*) as n_examples, count(*) filter (gold_a = pred_a and gold_a = pred_b) as n11, count(*) filter (gold_a <> pred_a and gold_a <> pred_b) as n00, count(*) filter (gold_a = pred_a and gold_a <> pred_b) as n10, count(*) filter (gold_a <> pred_a and gold_a = pred_b) as n01 from pair_ group by all)"


@query(f"{ALIGNED} select * from pair_")
def join_j01_align_by_hash(spark, sf):
    return S.aligned(generation(spark, sf)).select("comparison", "eval_dataset_name", "prompt_hash", "occ", "gold_a", "pred_a", "gold_b", "pred_b")


@query(f"{COUNTED} select comparison, n_examples, n11, n00, n10, n01, round(case when n10 + n01 > 0 then (abs(n10 - n01) - 1) ** 2 / (n10 + n01)::double else 0.0 end, 4) as mcnemar_chi2, round(case when n01 > 0 then n10 / n01::double end, 4) as odds_ratio from t")
def stat_b03_mcnemar(spark, sf):
    return S.mcnemar(S.contingency(S.aligned(generation(spark, sf))))


@query()
def stat_b02_paired_bootstrap(spark, sf):
    return S.paired(S.contingency(S.aligned(generation(spark, sf))))


NAMES = [c.name for c in key_comparisons()]


@query(f"{COUNTED}, k as (select * from (values {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(NAMES))}) v(place, comparison)) select place, comparison, n_examples::double as n_examples, round((n10 - n01) / n_examples::double, 6) as delta_f1, round((n11 + n10) / n_examples::double, 4) as f1_a, round((n11 + n01) / n_examples::double, 4) as f1_b, case when n_examples is null then 'N/A' else round((n10 - n01) / n_examples::double, 6)::varchar end as reported from k left join t using (comparison)")
def stat_b10_key_comparisons(spark, sf):
    t = S.listed_first(S.contingency(S.aligned(generation(spark, sf))), NAMES)
    n = F.col("n_examples")
    delta = F.round((F.col("n10") - F.col("n01")) / n, 6)
    return t.select("place", "comparison", n.cast("double").alias("n_examples"), delta.alias("delta_f1"), F.round((F.col("n11") + F.col("n10")) / n, 4).alias("f1_a"), F.round((F.col("n11") + F.col("n01")) / n, 4).alias("f1_b"), F.coalesce(delta.cast("string"), F.lit("N/A")).alias("reported"))


@query()
def stat_b10_significance(spark, sf):
    """All key comparisons with interval, p-value and stars, those without rows as N/A."""
    t = S.listed_first(S.paired(S.contingency(S.aligned(generation(spark, sf)))), NAMES)
    return t.withColumn("stars", F.coalesce("stars", F.lit("N/A")))


@query("select x::double as p, case when x < 0.001 then '***' when x < 0.01 then '**' when x < 0.05 then '*' else 'n.s.' end as stars from (values (0.0), (0.0005), (0.001), (0.005), (0.01), (0.03), (0.05), (0.5), (1.0)) v(x)")
def stat_b11_significance_stars(spark, sf):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.0005, 0.001, 0.005, 0.01, 0.03, 0.05, 0.5, 1.0)], "p double")
    return d.select("p", S.stars_of(F.col("p")).alias("stars"))


def _ind(g, p, s):
    neg = listed(NEGATIVES["n2"])
    return f"({g} not in ({neg}) and {g} = {p})::int as tp_{s}, ({p} not in ({neg}) and {g} <> {p})::int as fp_{s}, ({g} not in ({neg}) and {g} <> {p})::int as fn_{s}"


@query(f"{ALIGNED} select comparison, eval_dataset_name, {_ind('gold_a', 'pred_a', 'a')}, {_ind('gold_b', 'pred_b', 'b')}, count(*) as n from pair_ group by all")
def stat_b05_joint_states(spark, sf):
    return S.joint_states(S.aligned(generation(spark, sf)))


@query()
def stat_b05_paired_clustered(spark, sf):
    return S.clustered(S.joint_states(S.aligned(generation(spark, sf), normalizer="n2")))


@query(f"{aligned_sql(TABLE)} select comparison, eval_dataset_name, {_ind('gold_a', 'pred_a', 'a')}, {_ind('gold_b', 'pred_b', 'b')}, count(*) as n from pair_ group by all")
def stat_b10_table_states(spark, sf):
    return S.joint_states(S.aligned(generation(spark, sf), TABLE))


@query()
def stat_b10_table_clustered(spark, sf):
    return S.clustered(S.joint_states(S.aligned(generation(spark, sf), TABLE, normalizer="n2")))


NORM3 = lambda c: f"coalesce({line(c)}, 'nan')"
A = f"a as (select eval_dataset_name, left(md5(coalesce(prompt_0_shot, 'nan')), 12) as prompt_hash, {NORM3('relation')} as ga, {NORM3('generated_relation')} as pa from generation where {PRIMARY} and {is_config([LARGE])})"
FB = f"b as (select eval_dataset_name, prompt_hash, model_id, {NORM3('relation')} as gb, {NORM3('generated_relation')} as pb from frontier_generation where gen_type = 'gen_constrained' and model_id is not null)"
N3 = NEGATIVES["n3"]
IND3 = lambda g, p, s: f"({g} not in ({listed(N3)}) and {g} = {p})::int as tp_{s}, ({p} not in ({listed(N3)}) and {g} <> {p})::int as fp_{s}, ({g} not in ({listed(N3)}) and {g} <> {p})::int as fn_{s}"


@query(f"with {A}, {FB} select model_id as comparison, a.eval_dataset_name, {IND3('ga', 'pa', 'a')}, {IND3('gb', 'pb', 'b')}, count(*) as n from a join b on a.eval_dataset_name = b.eval_dataset_name and a.prompt_hash = b.prompt_hash group by all")
def join_j02_join_frontier(spark, sf):
    return S.frontier_states(generation(spark, sf), read(spark, sf, "frontier_generation"), LARGE)


@query(f"with {A}, {FB}, j as (select b.model_id, b.eval_dataset_name, count(*) as joined from a join b on a.eval_dataset_name = b.eval_dataset_name and a.prompt_hash = b.prompt_hash group by all), n as (select model_id, eval_dataset_name, count(*) as n from b group by all), h as (select model_id, eval_dataset_name, coalesce(joined, 0) as joined, n, coalesce(joined, 0) / greatest(n, 1)::double as r from n left join j using (model_id, eval_dataset_name)) select model_id, eval_dataset_name, joined, n, round(r, 6) as hit_rate, round(avg(r) over (partition by model_id), 6) as mean_hit_rate from h")
def agg_a14_join_hit_rate(spark, sf):
    return S.hit_rate(generation(spark, sf), read(spark, sf, "frontier_generation"), LARGE)


def _served(c):
    m, r, k = c.a
    a = f"select eval_dataset_name, left(md5(coalesce(prompt_0_shot, 'nan')), 12) as prompt_hash, {NORM3('relation')} as ga, {NORM3('generated_relation')} as pa from generation where {PRIMARY} and {is_config([c.a])} and eval_dataset_name in ({listed(S.datasets_of(c.domain))})"
    b = f"select eval_dataset_name, prompt_hash, {NORM3('relation')} as gb, {NORM3('generated_relation')} as pb from frontier_generation where gen_type = 'gen_constrained' and model_id = '{c.b[0]}'"
    return f"select '{c.name}' as comparison, a.eval_dataset_name, {IND3('ga', 'pa', 'a')}, {IND3('gb', 'pb', 'b')}, count(*) as n from ({a}) a join ({b}) b on a.eval_dataset_name = b.eval_dataset_name and a.prompt_hash = b.prompt_hash group by all"


@query(" union all ".join(map(_served, served_comparisons())))
def stat_b06_served_states(spark, sf):
    return S.served_states(generation(spark, sf), read(spark, sf, "frontier_generation"), served_comparisons())


@query()
def stat_b06_frontier_paired(spark, sf):
    """Six comparisons: three tuned configurations with two served models."""
    cs = served_comparisons()
    d = S.clustered(S.served_states(generation(spark, sf), read(spark, sf, "frontier_generation"), cs))
    return S.listed_first(d, [c.name for c in cs])


@query(f"{FAM} select family, {REGIME} as regime, count(*) as n_pairs, round(avg(delta), 6) as delta from fp group by family, tuned_dataset_name")
def stat_b07_family_delta_by_regime(spark, sf):
    return S.family_delta_by_regime(evaluated(spark, sf))


@query()
def stat_b07_within_family_delta(spark, sf):
    return S.family_delta(evaluated(spark, sf))


@query(f"{W} select round(regr_slope(micro_f1, log10(params_b)), 6) as slope, round(regr_intercept(micro_f1, log10(params_b)), 6) as intercept, count(*) as n from clean_ c join model_metadata m on c.model_id = m.model_id")
def stat_b08_ols_slope_plain(spark, sf):
    d = sized(spark, sf)
    return d.agg(F.round(F.regr_slope("micro_f1", F.log10("params_b")), 6).alias("slope"), F.round(F.regr_intercept(F.col("micro_f1"), F.log10("params_b")), 6).alias("intercept"), F.count("*").alias("n"))


def sized(spark, sf):
    """Metrics of the main condition without the anomalies, with size and family of the model."""
    d = R.keep_configs(C.primary(evaluated(spark, sf)), ANOMALIES, False)
    d = d.join(read(spark, sf, "model_metadata").select("model_id", "params_b"), "model_id")
    return d.withColumn("family", lookup(F.col("model_id"), FAMILY, F.lit("unknown")))


CONTROLS = {"tuned_dataset_name": list(REGIMES), "model_shot": SHOTS}
FAMILIES = {"family": sorted(set(FAMILY.values()))}


@query()
def stat_b08_ols_slope(spark, sf):
    return S.slope(sized(spark, sf), CONTROLS, "naive")


@query()
def stat_b09_slope_ci(spark, sf):
    return S.slope(sized(spark, sf), {**FAMILIES, **CONTROLS}, "family")


@query()
def stat_b12_regression_ratio(spark, sf):
    d = sized(spark, sf)
    a = S.slope(d, CONTROLS, "naive").select(F.lit(1).alias("k"), F.col("slope").alias("naive"))
    b = S.slope(d, {**FAMILIES, **CONTROLS}, "family").select(F.lit(1).alias("k"), F.col("slope").alias("family"))
    return a.join(b, "k").select("naive", "family", F.round(F.col("family") / F.col("naive") * 100, 2).alias("ratio_pct"))


@query(f"with {normals('generation')}, {CUBE}, {label_sql()}, g as (select {K}, gold as label, sum(n)::bigint as gold_n from cube_ group by all), p as (select {K}, pred as label, sum(n)::bigint as pred_n from cube_ group by all) select {K}, label, coalesce(gold_n, 0) as gold_n, coalesce(pred_n, 0) as pred_n from g full join p using ({K}, label)")
def join_j12_confusion_join(spark, sf):
    c = C.cube(generation(spark, sf))
    g = c.groupBy(*KEYS, F.col("gold").alias("label")).agg(F.sum("n").alias("gold_n"))
    p = c.groupBy(*KEYS, F.col("pred").alias("label")).agg(F.sum("n").alias("pred_n"))
    return g.join(p, [*KEYS, "label"], "full_outer").select(*KEYS, "label", F.coalesce("gold_n", F.lit(0)).alias("gold_n"), F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
