"""Queries of the derived tables and joins over the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import ANOMALIES, CROSS, FAMILY, FAMILY_PAIRS, GENERAL, KEYS, LITERARY, MODELS, PARAMS, REGIMES, SCALE, SERVED, SHORT, SHOTS
from quern.operators import cube as C
from quern.operators import metrics as M
from quern.operators import tables as R
from quern.plans.base import DOMAIN, DS, IN_GEN, IN_LIT, METRICS, PRIM, REGIME, is_config, listed, metrics_sql, query, read
from quern.plans.metrics import case, evaluated
from quern.session import fresh, gathered

W = f"with {METRICS}, {PRIM}"
AVG = lambda cond, x="micro_f1": f"avg(case when {cond} then {x} end)"
Q = "'"


def text_case(c, table, default):
    return f"case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + f" else {default} end"


@query(f"{W} select z.model_id as base_model, coalesce(param_label, '') as params, model_shot || '-shot' as prompt_style, {REGIME} as tuning_regime, round({AVG(IN_GEN)}, 4) as general_avg_f1, round({AVG(IN_LIT)}, 4) as literature_avg_f1, round(avg(micro_f1), 4) as overall_avg_f1 from zero_ z left join model_metadata m on z.model_id = m.model_id group by z.model_id, param_label, model_shot, tuned_dataset_name")
def tab_r01_main_summary(spark, sf):
    return R.main_summary(evaluated(spark, sf), read(spark, sf, "model_metadata"))


@query(f"{W}, c as (select tuned_dataset_name, {AVG(IN_GEN)} as g, {AVG(IN_LIT)} as l from prim_ group by tuned_dataset_name, model_id, model_shot), a as (select tuned_dataset_name, avg(g) as g, avg(l) as l from c where tuned_dataset_name in ({listed(REGIMES)}) group by all) select {REGIME} as tuning_regime, round(g, 4) as avg_on_general, round(l, 4) as avg_on_literature, round(case tuned_dataset_name when 're_gentune' then g - l when 're_littune' then l - g else abs(g - l) end, 4) as cross_domain_gap, round(case when g is null then l when l is null then g else (g + l) / 2 end, 4) as overall_avg from a")
def tab_r02_cross_domain_transfer(spark, sf):
    return R.transfer_by_regime(evaluated(spark, sf))


def _delta(cond, x, name):
    two, none = (f"model_shot = {s} and {cond}" for s in (2, 0))
    return f"round({AVG(two, x)} - {AVG(none, x)}, 4) as delta_{name}"


@query(f"{W} select model_id as base_model, {REGIME} as tuning_regime, {_delta(IN_GEN, 'micro_f1', 'general_avg_f1')}, {_delta(IN_LIT, 'micro_f1', 'literature_avg_f1')}, {_delta('true', 'micro_f1', 'overall_avg_f1')}, {_delta('true', 'micro_precision', 'precision')}, {_delta('true', 'micro_recall', 'recall')} from zero_ group by model_id, tuned_dataset_name having bool_or(model_shot = 2) and bool_or(model_shot = 0)")
def tab_r03_prompt_delta(spark, sf):
    return R.prompt_delta(evaluated(spark, sf))


@query(f"{W}, a as (select model_id, model_shot, tuned_dataset_name, round({AVG(IN_LIT)}, 4) as literature_avg_f1, round(avg(micro_f1), 4) as overall_avg_f1 from prim_ group by all) select a.model_id || ' (' || {REGIME} || ', ' || model_shot || '-shot)' as model, a.model_id, params_b, checkpoint_gb, avg_inference_latency_ms, literature_avg_f1, overall_avg_f1, round(overall_avg_f1 / params_b, 4) as f1_per_b_params, case when checkpoint_gb > 0 then round(overall_avg_f1 / checkpoint_gb, 4) end as f1_per_gb from a left join model_metadata m on a.model_id = m.model_id")
def tab_r04_efficiency(spark, sf):
    return R.efficiency(evaluated(spark, sf), read(spark, sf, "model_metadata"))


CELLS = ", ".join(f"round(max(case when eval_dataset_name = '{d}' then micro_f1 end), 4) as {d}" for d in DS)
NAME = f"model_id || ' | ' || {REGIME} || ' | ' || model_shot || '-shot'"


@query(f"{W} select {NAME} as model_config, {CELLS} from zero_ group by model_id, tuned_dataset_name, model_shot")
def tab_r05_full_grid(spark, sf):
    return R.full_grid(evaluated(spark, sf))


def _mean(ds):
    k = " + ".join(f"(case when {d} is null then 0 else 1 end)" for d in ds)
    units = " + ".join(f"coalesce(round({d} * 10000)::bigint, 0)" for d in ds)
    return f"floor((2 * ({units}) + ({k})) / nullif(2 * ({k}), 0)::double) / 10000"


GRID = f"grid_ as (select * from (values {', '.join(f'({Q}{m}{Q})' for m in MODELS)}) a(model_id), (values {', '.join(f'({Q}{r}{Q})' for r in REGIMES)}) b(tuned_dataset_name), (values {', '.join(f'({s})' for s in SHOTS)}) c(model_shot))"
SHORT_SQL = text_case("model_id", SHORT, "model_id")
MATRIX = f"{W}, {GRID}, cells as (select model_id, tuned_dataset_name, model_shot, {CELLS} from zero_ group by all), matrix_ as (select {SHORT_SQL} as model, {REGIME} as regime, model_shot || 's' as shot, model || ' ' || regime || ' ' || shot as config, {', '.join(DS)}, {_mean(GENERAL)} as general_avg, {_mean(LITERARY)} as literary_avg, {_mean(DS)} as overall_avg from grid_ left join cells using (model_id, tuned_dataset_name, model_shot))"


@query(f"{MATRIX} select * from matrix_")
def tab_r06_results_matrix(spark, sf):
    return R.results_matrix(evaluated(spark, sf))


@query(f"{W}, g as (select {NAME} as model_config, {CELLS} from zero_ group by model_id, tuned_dataset_name, model_shot) select *, {_mean(DS)} as row_mean from g")
def tab_r07_heatmap_order(spark, sf):
    return R.heatmap(evaluated(spark, sf))


@query(f"{W} select model_id, tuned_dataset_name, model_shot, round(avg(micro_f1), 4) as mean_f1, {text_case('model_id', FAMILY, Q + 'unknown' + Q)} as family, {case('model_id', PARAMS, '0.0')}::double as params_b from clean_ group by model_id, tuned_dataset_name, model_shot")
def tab_r08_scaling_points(spark, sf):
    return R.scaling_points(evaluated(spark, sf))


PAIRS = f"{W}, pair_ as (select eval_dataset_name, model_id, tuned_dataset_name, model_shot, max(case when gen_type = 'gen_open' then micro_f1 end) as gen_open, max(case when gen_type = 'gen_constrained' then micro_f1 end) as gen_constrained, gen_open - gen_constrained as delta from metrics_ where model_shot = prompt_shot and not {is_config(ANOMALIES)} group by eval_dataset_name, model_id, tuned_dataset_name, model_shot having gen_open is not null and gen_constrained is not null)"
SEM = "round(100 * avg(delta), 4) as mean_pp, round(100 * case when count(*) > 1 then stddev_samp(delta) / sqrt(count(*)) else 0.0 end, 4) as sem_pp, count(*) as n"


@query(f"{PAIRS}, l as (select 'dataset' as level, eval_dataset_name as name, delta from pair_ union all select 'scale', {case('model_id', SCALE, Q + 'unknown' + Q)}, delta from pair_ union all select 'overall', 'all', delta from pair_) select level, name, {SEM} from l group by all")
def tab_r09_open_minus_constrained(spark, sf):
    return R.open_minus_constrained(evaluated(spark, sf))


@query(f"{PAIRS} select eval_dataset_name, model_id, tuned_dataset_name, model_shot, gen_open, gen_constrained, round(delta, 6) as delta from pair_")
def join_j04_open_vs_constrained(spark, sf):
    return R.open_pairs(evaluated(spark, sf)).withColumn("delta", F.round("delta", 6))


@query(f"{PAIRS} select eval_dataset_name, {SEM} from pair_ group by all")
def agg_a18_mean_sem(spark, sf):
    return R.open_pairs(evaluated(spark, sf)).groupBy("eval_dataset_name").agg(*R.mean_sem(F.col("delta")))


FK = ["eval_dataset_name", "model_id", "gen_type"]
FRONT = f"with {metrics_sql('(select * from frontier_generation where gen_type = ' + Q + 'gen_constrained' + Q + ' and model_id is not null and relation is not null and generated_relation is not null)', [], ', '.join(FK))}"


def frontier(spark, sf):
    """Metrics of served models: all classes count, rows without model, gold or answer are left out."""
    d = read(spark, sf, "frontier_generation").where("gen_type = 'gen_constrained'").dropna(subset=["model_id", "relation", "generated_relation"])
    return M.evaluate(d.dropna(subset=KEYS), [], keys=FK)


@query(f"{FRONT} select * from metrics_")
def agg_frontier_metrics(spark, sf):
    return frontier(spark, sf)


@query(f"{FRONT} select model_id, round({AVG(IN_GEN)}, 4) as general_avg_f1, round({AVG(IN_LIT)}, 4) as literary_avg_f1, round(avg(micro_f1), 4) as overall_avg_f1, round({AVG(IN_GEN, 'schema_valid_rate')} * 100, 1) as gen_schema_valid_pct, round({AVG(IN_LIT, 'schema_valid_rate')} * 100, 1) as lit_schema_valid_pct, count(*) filter ({IN_GEN}) as n_general, count(*) filter ({IN_LIT}) as n_literary from metrics_ group by all")
def tab_r10_frontier_table(spark, sf):
    return R.frontier_table(frontier(spark, sf))


@query(f"{FRONT} select eval_dataset_name, {', '.join(f'round(max(case when model_id = {Q}{m}{Q} then micro_f1 end), 4) as {chr(34)}{m}{chr(34)}' for m in SERVED)} from metrics_ group by all")
def tab_r11_frontier_pivot(spark, sf):
    models = [r[0] for r in gathered(read(spark, sf, "frontier_generation").where("model_id is not null").select("model_id").distinct())]  # a column for each
    return R.frontier_pivot(frontier(spark, sf), sorted(models))


CROSS_SQL = "(" + " or ".join(f"(tuned_dataset_name = '{r}' and eval_dataset_name in ({listed(ds)}))" for r, ds in CROSS.items()) + ")"
OWN_SQL = f"(tuned_dataset_name in ({listed(CROSS)}) and not {CROSS_SQL} and eval_dataset_name in ({listed(DS)}))"
CK = "model_id, tuned_dataset_name, model_shot, prompt_shot"
TRANSFER = f"{W}, x as (select {CK}, avg(micro_f1) as c from metrics_ where gen_type = 'gen_constrained' and {CROSS_SQL} group by all), o as (select {CK}, avg(micro_f1) as i from metrics_ where gen_type = 'gen_constrained' and {OWN_SQL} group by all), transfer_ as (select {CK}, case when tuned_dataset_name = 're_gentune' then 'General' else 'Literary' end as in_domain, round(i, 4) as in_domain_avg_f1, case when tuned_dataset_name = 're_gentune' then 'Literary' else 'General' end as cross_domain, round(c, 4) as cross_domain_avg_f1, round(c - i, 4) as delta_f1 from x left join o using ({CK}))"


@query(f"{TRANSFER} select * from transfer_")
def tab_r12_transfer_table(spark, sf):
    m = evaluated(spark, sf)
    return R.transfer_table(m, m)


OWN = f"{W}, o as (select {CK}, avg(micro_f1) as i, count(*) as n from metrics_ where gen_type = 'gen_constrained' and {OWN_SQL} group by all), x as (select {CK}, avg(micro_f1) as c from metrics_ where gen_type = 'gen_constrained' and {CROSS_SQL} group by all)"


@query(f"{OWN} select {CK}, round(i, 4) as in_domain_avg_f1, n as n_in_domain, round(c, 4) as cross_domain_avg_f1 from o left join x using ({CK})")
def join_j06_in_vs_cross(spark, sf):
    """All configurations of a regime with a domain of its own, with their means off it where they have any."""
    return R.in_and_cross(evaluated(spark, sf))


@query(f"{TRANSFER} select tuned_dataset_name, round(avg(in_domain_avg_f1), 4) as avg_in_domain_f1, round(avg(cross_domain_avg_f1), 4) as avg_cross_domain_f1, round(avg(delta_f1), 4) as avg_delta from transfer_ group by all")
def agg_a31_transfer_summary(spark, sf):
    m = evaluated(spark, sf)
    return R.transfer_summary(R.transfer_table(m, m))


@query(f"{W} select * from metrics_ where {CROSS_SQL}")
def proj_p06_filter_cross_domain(spark, sf):
    return R.cross_only(evaluated(spark, sf))


# the adapted model's rows stand for those of a model further trained, its base's for the plain one
ADAPTED, BASE_MODEL = "Qwen2.5-3B-Instruct", "Llama-3.2-3B-Instruct"
DAPT = f"{W}, s as (select * from metrics_ where gen_type = 'gen_constrained' and model_shot = 0 and prompt_shot = 0), a as (select tuned_dataset_name, eval_dataset_name, micro_f1 as adapted_f1 from s where model_id = '{ADAPTED}'), b as (select tuned_dataset_name, eval_dataset_name, micro_f1 as base_f1 from s where model_id = '{BASE_MODEL}'), d as (select * from a full join b using (tuned_dataset_name, eval_dataset_name)), u as (select tuned_dataset_name, eval_dataset_name, adapted_f1, base_f1 from d union all select tuned_dataset_name, 'avg:' || {DOMAIN}, avg(adapted_f1), avg(base_f1) from d where {DOMAIN} <> 'unknown' group by all) select tuned_dataset_name, eval_dataset_name, round(base_f1, 4) as base_f1, round(adapted_f1, 4) as adapted_f1, round(adapted_f1 - base_f1, 4) as delta, case when adapted_f1 - base_f1 > 0.01 then 'IMPROVED' when adapted_f1 - base_f1 < -0.01 then 'DEGRADED' when adapted_f1 - base_f1 is not null then '~same' end as direction from u"


def _adapted(spark, sf):
    m = evaluated(spark, sf).where("gen_type = 'gen_constrained' and model_shot = 0 and prompt_shot = 0")
    return R.adapted_or_base(m.where(F.col("model_id") == ADAPTED), m.where(F.col("model_id") == BASE_MODEL))


@query(DAPT)
def tab_r13_dapt_table(spark, sf):
    return _adapted(spark, sf)


@query(DAPT)
def join_j07_dapt_vs_base(spark, sf):
    return _adapted(spark, sf)


COMPLEX = f"{W}, lc as (select eval_dataset_name as dataset, round(avg(micro_f1), 4) as mean_micro_f1, round(stddev_samp(micro_f1), 4) as std_micro_f1, round(min(micro_f1), 4) as min_micro_f1, round(max(micro_f1), 4) as max_micro_f1, count(*) as n_configs from prim_ group by all), complexity_ as (select lc.*, coalesce(n_labels, -1) as n_labels, case when lc.dataset in ({listed(LITERARY)}) then 'literary' else 'general' end as domain from lc left join dataset_group g on lc.dataset = g.dataset)"


@query(f"{COMPLEX} select * from complexity_")
def tab_r14_label_complexity(spark, sf):
    return R.label_complexity(evaluated(spark, sf), read(spark, sf, "dataset_group"))


@query(f"{COMPLEX} select dataset, mean_micro_f1, std_micro_f1, min_micro_f1, max_micro_f1, n_configs from complexity_")
def agg_a17_describe_group(spark, sf):
    return R.label_complexity(evaluated(spark, sf), read(spark, sf, "dataset_group")).select("dataset", "mean_micro_f1", "std_micro_f1", "min_micro_f1", "max_micro_f1", "n_configs")


@query(f"{COMPLEX}, r as (select *, row_number() over (order by n_labels, dataset) as rx, row_number() over (order by mean_micro_f1, dataset) as ry from complexity_) select round(corr(n_labels, mean_micro_f1), 4) as pearson, round(corr(rx, ry), 4) as spearman from r")
def agg_a21_correlations(spark, sf):
    return R.correlations(R.label_complexity(evaluated(spark, sf), read(spark, sf, "dataset_group")))


@query()
def tab_r15_dashboard_json(spark, sf):
    return R.dashboard(evaluated(spark, sf))


@query(f"{MATRIX} select * from matrix_ where regime = 'MixTune'")
def tab_r16_matrix_explorer(spark, sf):
    return R.explorer(R.results_matrix(evaluated(spark, sf)), regime_name="MixTune")


@query(f"{MATRIX} select * from matrix_ order by coalesce(overall_avg, -1) desc, config limit 5")
def set_o02_top_k(spark, sf):
    return R.explorer(R.results_matrix(evaluated(spark, sf))).limit(5)


@query(f"{MATRIX} select {', '.join(f'max({d}) as {d}' for d in [*DS, 'overall_avg'])} from matrix_")
def set_o03_max_per_column(spark, sf):
    return R.results_matrix(evaluated(spark, sf)).agg(*[F.max(c).alias(c) for c in [*DS, "overall_avg"]])


@query(f"{W} select model_id, tuned_dataset_name, model_shot, round({AVG(IN_GEN)}, 4) as general, round({AVG(IN_LIT)}, 4) as literary, round(avg(micro_f1), 4) as overall from prim_ group by all")
def agg_a15_domain_avg(spark, sf):
    d = C.primary(evaluated(spark, sf)).groupBy("model_id", "tuned_dataset_name", "model_shot")
    return d.agg(F.round(R.mean_in(GENERAL), 4).alias("general"), F.round(R.mean_in(LITERARY), 4).alias("literary"), F.round(F.avg("micro_f1"), 4).alias("overall"))


@query(f"{W}, c as (select tuned_dataset_name, {AVG(IN_GEN)} as g, {AVG(IN_LIT)} as l from prim_ group by tuned_dataset_name, model_id, model_shot) select tuned_dataset_name, round(avg(g), 4) as avg_general, round(avg(l), 4) as avg_literary from c group by all")
def agg_a16_avg_of_avgs(spark, sf):
    per = C.primary(evaluated(spark, sf)).groupBy("tuned_dataset_name", "model_id", "model_shot").agg(R.mean_in(GENERAL).alias("g"), R.mean_in(LITERARY).alias("l"))
    return per.groupBy("tuned_dataset_name").agg(F.round(F.avg("g"), 4).alias("avg_general"), F.round(F.avg("l"), 4).alias("avg_literary"))


SMALL = f"model_id in ({listed(m for m, s in SCALE.items() if s == 'sub-billion')})"


@query(f"{W}, a as (select tuned_dataset_name, model_shot, model_id, avg(micro_f1) as f from clean_ group by all), b as (select tuned_dataset_name, model_shot, max(case when {SMALL} then f end) as s, max(case when not {SMALL} then f end) as l from a group by all) select tuned_dataset_name, model_shot, round(s, 4) as best_small, round(l, 4) as best_large, round(l - s, 4) as gap from b where tuned_dataset_name in ({listed(REGIMES)})")
def agg_a26_best_per_group(spark, sf):
    return R.best_by_scale(evaluated(spark, sf))


@query(f"{W} select model_id, round({AVG('gen_type = ' + Q + 'gen_open' + Q, 'schema_valid_rate')}, 4) as gen_open, round({AVG('gen_type = ' + Q + 'gen_constrained' + Q, 'schema_valid_rate')}, 4) as gen_constrained from metrics_ group by all")
def agg_a27_schema_rate_avg(spark, sf):
    return R.schema_rates(evaluated(spark, sf))


SIDE = "case " + " ".join(f"when model_id = '{s}' then 's' when model_id = '{b}' then 'b'" for s, b in FAMILY_PAIRS.values()) + " end"
FAM = f"{W}, f as (select *, {text_case('model_id', FAMILY, Q + 'unknown' + Q)} as family, {SIDE} as size from clean_), fp as (select s.family, s.tuned_dataset_name, s.model_shot, s.eval_dataset_name, s.micro_f1 as micro_f1_s, b.micro_f1 as micro_f1_b, b.micro_f1 - s.micro_f1 as delta from f s join f b on s.family = b.family and s.tuned_dataset_name = b.tuned_dataset_name and s.model_shot = b.model_shot and s.eval_dataset_name = b.eval_dataset_name where s.size = 's' and b.size = 'b')"


@query(f"{FAM} select * replace (round(delta, 6) as delta) from fp")
def join_j03_paired_cells(spark, sf):
    return R.family_pairs(evaluated(spark, sf)).withColumn("delta", F.round("delta", 6))


@query(f"{W} select model_id as base_model, {REGIME} as tuning_regime, {_delta('true', 'micro_f1', 'overall_avg_f1')} from zero_ group by model_id, tuned_dataset_name having bool_or(model_shot = 2) and bool_or(model_shot = 0)")
def join_j05_shot_pair(spark, sf):
    return R.prompt_delta(evaluated(spark, sf)).select("base_model", "tuning_regime", "delta_overall_avg_f1")


@query(f"{W} select m.*, param_label, params_b, checkpoint_gb, domain from metrics_ m left join model_metadata d on m.model_id = d.model_id left join dataset_group g on m.eval_dataset_name = g.dataset")
def join_j08_dim_lookup(spark, sf):
    d = evaluated(spark, sf).join(read(spark, sf, "model_metadata").select("model_id", "param_label", "params_b", "checkpoint_gb"), "model_id", "left")
    return d.join(read(spark, sf, "dataset_group").select(F.col("dataset").alias("eval_dataset_name"), "domain"), "eval_dataset_name", "left")


@query(f"{W} select * from metrics_ where {'gen_type = ' + Q + 'gen_constrained' + Q} and model_shot = prompt_shot")
def proj_p03_filter_primary(spark, sf):
    return C.primary(evaluated(spark, sf))


@query(f"{W} select * from metrics_ where {is_config(ANOMALIES)}")
def proj_p05_filter_in_tuple_set(spark, sf):
    return R.keep_configs(evaluated(spark, sf), ANOMALIES)


@query(f"{W} select * from metrics_ where not {is_config(ANOMALIES)}")
def proj_p05_filter_not_in_tuple_set(spark, sf):
    return R.keep_configs(evaluated(spark, sf), ANOMALIES, False)


@query(f"{W} select * from zero_")
def proj_p08_override_value(spark, sf):
    return R.reported_zero(C.primary(evaluated(spark, sf)))


@query(f"{W} select distinct model_id, tuned_dataset_name, eval_dataset_name, {text_case('model_id', FAMILY, Q + 'unknown' + Q)} as family, {case('model_id', SCALE, Q + 'unknown' + Q)} as scale, {REGIME} as regime, {DOMAIN} as domain from metrics_")
def proj_p09_map_literal(spark, sf):
    from quern.operators.errors import lookup

    d = evaluated(spark, sf).select("model_id", "tuned_dataset_name", "eval_dataset_name").distinct()
    return d.withColumns({"family": lookup(F.col("model_id"), FAMILY, F.lit("unknown")), "scale": lookup(F.col("model_id"), SCALE, F.lit("unknown")), "regime": R.regime(), "domain": R.domain(F.col("eval_dataset_name"))})


@query(f"{W} select distinct model_id || '|' || tuned_dataset_name || '|ms' || model_shot || '|ps' || prompt_shot || '|' || gen_type as config_key, {NAME} as model_config from metrics_")
def proj_p10_concat_key(spark, sf):
    key = F.concat_ws("|", "model_id", "tuned_dataset_name", F.concat(F.lit("ms"), "model_shot"), F.concat(F.lit("ps"), "prompt_shot"), "gen_type")
    return evaluated(spark, sf).select(key.alias("config_key"), R.config_name().alias("model_config")).distinct()


@query("select model_id, params_b, round(log10(params_b), 6) as log10_params from model_metadata")
def proj_p12_add_log10(spark, sf):
    return read(spark, sf, "model_metadata").select("model_id", "params_b", F.round(F.log10("params_b"), 6).alias("log10_params"))


@query(f"{MATRIX} select config, overall_avg, overall_avg = max(overall_avg) over () as best from matrix_ where overall_avg is not null")
def src_s12_best_flags(spark, sf):
    from quern.sources.writers import best_flags

    d = best_flags(R.results_matrix(evaluated(spark, sf)), ["overall_avg"])
    return d.where("overall_avg is not null").select("config", "overall_avg", F.col("best_overall_avg").alias("best"))


COLUMNS_TEX = [*DS, "general_avg", "literary_avg", "overall_avg"]
TEX = " || ' & ' || ".join(f"case when {c} is null then '--' when {c} = max({c}) over () then '\\textbf{{' || printf('%.3f', round({c}, 3)) || '}}' else printf('%.3f', round({c}, 3)) end" for c in COLUMNS_TEX)


@query(f"{MATRIX} select config, model || ' & ' || regime || ' & ' || shot || ' & ' || {TEX} || ' \\\\' as line from matrix_")
def src_s12_latex_rows(spark, sf):
    from quern.sources.writers import latex_rows

    return latex_rows(R.results_matrix(evaluated(spark, sf)))


PAGE = "<html><script>const data = __DATA__;</script></html>"


@query(f"{MATRIX} select 30 as n_configs, count(overall_avg) as n_filled, round(max(overall_avg), 4) as best from matrix_")
def src_s13_write_page(spark, sf):
    """The page is written, its JSON read back."""
    from quern.sources.writers import read_text, write_page

    at = f"{fresh(spark, 'page')}/index.html"
    write_page(R.dashboard(evaluated(spark, sf)), PAGE, at, spark)
    body = F.regexp_extract(F.lit(read_text(spark, at)), r"const data = (.*);</script>", 1)
    rows = F.from_json(F.get_json_object(body, "$.matrix"), "array<struct<config: string, overall_avg: double>>")
    d = spark.range(1).select(F.explode(rows).alias("x")).select("x.*")
    return d.agg(F.count("*").cast("int").alias("n_configs"), F.count("overall_avg").alias("n_filled"), F.round(F.max("overall_avg"), 4).alias("best"))
