"""Queries of the metric engine and of the error strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import KEYS, NEGATIVES, PARAMS, REGIMES, SCALE, SERVED
from quern.operators import cube as C
from quern.operators import errors as E
from quern.operators import metrics as M
from quern.plans.base import CUBE, DEDUP, HASHED, K, METRICS, NOT_NULL, PRIM, PRIMARY, REGIME, SAME, SENT, SIZES, busy, class_sql, generation, label_sql, line, listed, metrics_sql, micro_sql, normal, normals, query, read, strip
from quern.functions import text as T

W = "with "
ROUND = lambda cs: ", ".join(f"round({c}, 6) as {c}" for c in cs)
BASE = W + normals("generation") + ", " + CUBE


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def evaluated(spark, sf):
    """Metrics of every configuration and dataset, rows merged twice taken out."""
    return M.evaluate(C.deduplicated(busy(spark, sf)))


@query(f"{BASE}, {label_sql()} select * from lab_")
def agg_a01_confusion_counts(spark, sf):
    return M.by_label(C.cube(busy(spark, sf)))


@query(f"{BASE}, {micro_sql()} select {K}, {ROUND(['micro_precision', 'micro_recall', 'micro_f1', 'accuracy'])}, support from micro_")
def agg_a02_micro_metrics(spark, sf):
    return M.micro(C.cube(busy(spark, sf))).select(*KEYS, *r6("micro_precision", "micro_recall", "micro_f1", "accuracy"), "support")


@query(f"{BASE}, {micro_sql([])} select {K}, {ROUND(['micro_precision', 'micro_recall', 'micro_f1', 'accuracy'])}, support from micro_")
def agg_a02_micro_all_classes(spark, sf):
    return M.micro(C.cube(busy(spark, sf)), []).select(*KEYS, *r6("micro_precision", "micro_recall", "micro_f1", "accuracy"), "support")


@query(f"{BASE}, {label_sql()}, {class_sql()}, m as (select {K}, avg(precision_) as p, avg(recall_) as r, avg(f1) as f from class_ group by all), k as (select distinct {K} from cube_) select {K}, coalesce(round(p, 6), 0.0) as macro_precision, coalesce(round(r, 6), 0.0) as macro_recall, coalesce(round(f, 6), 0.0) as macro_f1 from k left join m using ({K})")
def agg_a03_macro_metrics(spark, sf):
    return M.macro(C.cube(busy(spark, sf))).select(*KEYS, *r6("macro_precision", "macro_recall", "macro_f1"))


@query(f"{W}{DEDUP}, {normals('dedup_')}, {CUBE}, {label_sql()}, {class_sql()} select {K}, label, round(precision_, 6) as precision, round(recall_, 6) as recall, round(f1, 6) as f1, support from class_ where {PRIMARY}")
def agg_a04_per_class(spark, sf):
    d = M.per_class(C.cube(C.primary(C.deduplicated(generation(spark, sf)))))
    return d.select(*KEYS, "label", *r6("precision", "recall", "f1"), "support").orderBy(*KEYS, F.desc("support"), "label")


@query(f"{W}{metrics_sql()} select {K}, schema_valid_rate from metrics_")
def agg_a05_schema_valid_rate(spark, sf):
    c = C.cube(busy(spark, sf))
    return M.quality(c, M.allowed(c)).select(*KEYS, *r6("schema_valid_rate"))


@query(f"{W}{metrics_sql()} select {K}, malformed_rate from metrics_")
def agg_a06_malformed_rate(spark, sf):
    c = C.cube(busy(spark, sf))
    return M.quality(c, M.allowed(c)).select(*KEYS, *r6("malformed_rate"))


@query(f"{W}{metrics_sql()} select * from metrics_")
def agg_a07_evaluate_slice(spark, sf):
    return M.evaluate(busy(spark, sf))


@query(f"{W}{METRICS} select * from metrics_")
def agg_a08_evaluate_dataset(spark, sf):
    return evaluated(spark, sf)


@query(f"{W}{SIZES} select {K}, size, mode_size as mode, flagged from flag_")
def agg_a09_group_size_mode(spark, sf):
    return C.group_sizes(generation(spark, sf))


@query(f"{W}{DEDUP} select * from dedup_")
def agg_a10_dedup_if_multiple(spark, sf):
    return C.deduplicated(generation(spark, sf))


@query(f"{W}{HASHED} select * from hashed_ qualify row_number() over (partition by {SAME} order by gen_id) = 1")
def agg_a10_dedup_always(spark, sf):
    return C.deduplicated(generation(spark, sf), "always")


@query(f"{BASE}, p as (select eval_dataset_name, gold, pred, sum(n)::bigint as count from cube_ where gold <> pred group by all) select *, row_number() over (partition by eval_dataset_name order by count desc, gold, pred) as rank from p qualify rank <= 15")
def agg_a11_top_confused_pairs(spark, sf):
    return M.top_confused(C.cube(busy(spark, sf)), 15)


KIND = f"case when gold = pred then 'correct' when gold not in ({listed(NEGATIVES['n4'])}) and pred in ({listed(NEGATIVES['n4'])}) then 'default_negative' when lab is null and pred not in ({listed(NEGATIVES['n4'])}) then 'hallucinated' when lab is not null and pred not in ({listed(NEGATIVES['n4'])}) and gold not in ({listed(NEGATIVES['n4'])}) then 'near_neighbor' when gold in ({listed(NEGATIVES['n4'])}) and pred not in ({listed(NEGATIVES['n4'])}) then 'false_positive' else 'other_error' end"
case = lambda c, table, default: f"case {c} " + " ".join(f"when '{a}' then {b!r}" for a, b in table.items()) + f" else {default} end"
STRATA = (
    f"{W}{normals(f'(select * from generation where {PRIMARY})')}, {CUBE}, al as (select distinct eval_dataset_name, gold as lab from cube_), "
    f"kinds as (select c.*, {KIND} as kind from cube_ c left join al on c.eval_dataset_name = al.eval_dataset_name and c.pred = al.lab), "
    f"strata_ as (select eval_dataset_name as dataset, model_id, tuned_dataset_name, model_shot, {case('model_id', SCALE, chr(39) + 'unknown' + chr(39))} as scale_group, {case('model_id', PARAMS, '0.0')}::double as params_b, sum(n)::bigint as total, "
    + ", ".join(f"sum(case when kind = '{k}' then n else 0 end)::bigint as {k}" for k in E.CATEGORIES)
    + " from kinds group by all)"
)
PCT = lambda cs: ", ".join(f"round({k} / total::double * 100, 2) as {k}_pct" for k in cs)
SUMS = ", ".join(f"sum({k})::bigint as {k}" for k in ["total", *E.CATEGORIES])


@query(f"{STRATA} select * from strata_")
def agg_a12_error_counts(spark, sf):
    return E.strata(busy(spark, sf))


@query(f"{STRATA} select *, {PCT(E.CATEGORIES)} from strata_")
def agg_a25_pct_of_total(spark, sf):
    return E.percentages(E.strata(busy(spark, sf)))


@query(f"{STRATA}, s as (select scale_group, {SUMS} from strata_ group by all) select scale_group, total, {PCT(E.CATEGORIES)} from s")
def agg_a25_pct_by_scale(spark, sf):
    return E.summary(E.strata(busy(spark, sf)), "scale_group")


@query(f"{STRATA}, s as (select {REGIME} as regime, {SUMS} from strata_ group by all) select regime, total, {PCT(E.CATEGORIES)} from s")
def agg_a25_pct_by_regime(spark, sf):
    return E.summary(E.strata(busy(spark, sf)), "regime")


@query(f"{STRATA}, t as (select kind, sum(n)::bigint as n from kinds group by all) select kind, n from t")
def err_c01_classify_error(spark, sf):
    d = E.strata(busy(spark, sf))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in E.CATEGORIES])).alias("x")
    return d.select(pairs).select("x.*").groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


COLS = ", ".join(E.ANALYSED)
ANALYSED = f"dist_ as (select distinct {COLS} from generation where {PRIMARY} and eval_dataset_name is not null), an_ as (select {COLS}, {normal('relation', 'gold')}, {normal('generated_relation', 'pred')} from dist_)"
WRONG = f"{ANALYSED}, al as (select distinct eval_dataset_name, gold as lab from an_ where relation is not null), wr_ as (select an_.*, case when pred = '' then 'malformed_empty' when length(pred) > 60 then 'malformed_verbose' when lab is null then 'hallucinated_relation' when pred <> gold then 'schema_valid_wrong' else 'other' end as error_category from an_ left join al on an_.eval_dataset_name = al.eval_dataset_name and an_.pred = al.lab where gold <> pred)"


@query(f"{W}{WRONG} select eval_dataset_name, gold, pred, error_category, count(*) as n from wr_ group by all")
def err_c02_categorise_error(spark, sf):
    return E.wrong(busy(spark, sf), prompts=False).groupBy("eval_dataset_name", "gold", "pred", "error_category").agg(F.count("*").alias("n"))


@query(f"{W}{ANALYSED} select eval_dataset_name, model_id, tuned_dataset_name, model_shot, count(*) as total, count(*) filter (gold = pred) as correct, round(1 - correct / total::double, 4) as error_rate from an_ where model_id is not null and tuned_dataset_name is not null group by all")
def agg_a13_error_rate(spark, sf):
    return E.error_rates(busy(spark, sf))


@query(f"{W}{WRONG}, t as (select eval_dataset_name, error_category, count(*) as n from wr_ group by all) select *, round(n / sum(n) over (partition by eval_dataset_name)::double, 4) as share from t")
def agg_a32_value_counts(spark, sf):
    return E.category_shares(busy(spark, sf))


SAMPLE_KEY = "md5('42|' || " + " || '|' || ".join(f"coalesce({c}::varchar, '')" for c in E.ANALYSED) + ")"


@query(f"{W}{WRONG}, h as (select *, {SAMPLE_KEY} as h from wr_), k1 as (select * from h qualify row_number() over (partition by eval_dataset_name, error_category, model_id order by h) <= 3), k2 as (select * from k1 qualify row_number() over (partition by eval_dataset_name, error_category order by h) <= 20) select eval_dataset_name as dataset, error_category, relation as gold_relation, generated_relation as predicted_relation, model_id, {REGIME} as tuning_regime, model_shot || '-shot' as prompt_style, left({SENT}, 300) as text_snippet from (select *, coalesce(prompt_0_shot, 'nan') as p from k2)")
def tab_r17_error_examples(spark, sf):
    return E.examples(generation(spark, sf))


RIGHT = lambda cond: f"array_to_string(list_sort(list({REGIME}) filter ({cond})), ', ')"
SAID = ", ".join(f"max(case when tuned_dataset_name = '{r}' then said end) as pred_{n}" for r, n in REGIMES.items())
DISAGREE = (
    f"{W}{ANALYSED}, b as (select eval_dataset_name, left(prompt_0_shot, 100) as opening, relation, tuned_dataset_name, bool_or(gold = pred) as ok, arg_min_null(generated_relation, (model_id, model_shot, coalesce(generated_relation, ''))) as said, min(prompt_0_shot) as pr from an_ where relation is not null and prompt_0_shot is not null and tuned_dataset_name is not null group by all), "
    f"x as (select eval_dataset_name, opening, relation, {RIGHT('ok')} as correct_regimes, {RIGHT('not ok')} as wrong_regimes, min(pr) as p, {SAID} from b group by eval_dataset_name, opening, relation having bool_or(ok) and bool_or(not ok)) "
    f"select eval_dataset_name as dataset, left({SENT}, 300) as text_snippet, relation as gold_relation, correct_regimes, wrong_regimes, {', '.join(f'pred_{n}' for n in REGIMES.values())} from x qualify row_number() over (partition by eval_dataset_name order by opening, relation) <= 50"
)


@query(DISAGREE)
def tab_r18_regime_disagreements(spark, sf):
    return E.disagreements(generation(spark, sf))


@query(f"{W}{ANALYSED}, d as (select eval_dataset_name, left(prompt_0_shot, 100) as opening, relation, tuned_dataset_name, bool_or(gold = pred) as ok from an_ where relation is not null and prompt_0_shot is not null and tuned_dataset_name is not null group by all) select eval_dataset_name, opening, relation, count(*) as n_regimes, bool_or(ok) and bool_or(not ok) as disagree from d group by all")
def agg_a19_any_per_group(spark, sf):
    d = E.analysed(generation(spark, sf)).where(F.col("relation").isNotNull() & F.col("prompt_0_shot").isNotNull() & F.col("tuned_dataset_name").isNotNull())
    key = ["eval_dataset_name", "opening", "relation"]
    d = d.withColumn("opening", F.left("prompt_0_shot", F.lit(100))).groupBy(*key, "tuned_dataset_name").agg(F.bool_or(F.col("gold") == F.col("pred")).alias("ok"))
    return d.groupBy(*key).agg(F.count("*").alias("n_regimes"), (F.bool_or("ok") & F.bool_or(~F.col("ok"))).alias("disagree"))


@query(f"select eval_dataset_name, array_to_string(list_sort(list(distinct x)), ', ') as labels, count(distinct x) as n_labels from (select eval_dataset_name, {strip('relation')} as s, case when relation is null or lower(s) in ('', 'nan', 'null', 'none') then 'none' else s end as x from generation) group by all")
def agg_a20_distinct_labels(spark, sf):
    x = T.normalize_label(F.col("relation"))
    d = generation(spark, sf).select("eval_dataset_name", x.alias("x")).distinct()
    return d.groupBy("eval_dataset_name").agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("labels"), F.count("*").alias("n_labels"))


@query("with tr as (select distinct dataset, relation from source_example where split = 'train' and relation is not null), te as (select distinct dataset, relation from source_example where split = 'test' and relation is not null) select te.dataset, count(*) as n_test_labels, round(count(tr.relation) / count(*)::double, 6) as coverage from te left join tr using (dataset, relation) group by all")
def agg_a23_coverage(spark, sf):
    d = read(spark, sf, "source_example").where("relation is not null").select("dataset", "relation", "split").groupBy("dataset", "relation").agg(F.bool_or(F.col("split") == "train").alias("tr"), F.bool_or(F.col("split") == "test").alias("te"))
    return d.where("te").groupBy("dataset").agg(F.count("*").alias("n_test_labels"), F.round(F.avg(F.col("tr").cast("double")), 6).alias("coverage"))


@query(f"{BASE}, p as (select {K}, pred, sum(n) as n from cube_ group by all) select {K}, count(*) as n_distinct, round(max(n) / sum(n)::double, 6) as top_share, count(*) <= 1 or max(n) / sum(n)::double > 0.95 as collapsed from p group by all")
def agg_a24_collapse_check(spark, sf):
    d = C.cube(busy(spark, sf)).groupBy(*KEYS, "pred").agg(F.sum("n").alias("n"))
    share = F.max("n") / F.sum("n")
    return d.groupBy(*KEYS).agg(F.count("*").alias("n_distinct"), F.round(share, 6).alias("top_share"), ((F.count("*") <= 1) | (share > 0.95)).alias("collapsed"))


@query(f"{W}{METRICS}, {PRIM} select round(avg(micro_f1), 4) as micro_f1, round(avg(macro_f1), 4) as macro_f1, round(avg(schema_valid_rate), 4) as schema_valid_rate, round(avg(malformed_rate), 4) as malformed_rate from prim_")
def agg_a28_summary_means(spark, sf):
    from quern.operators.tables import means

    return means(evaluated(spark, sf))


RATES = {m: (1.0, 4.0) for m in SERVED}  # an example, dollars for a million input and output tokens: pass your own
COST = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in RATES.items())
TOKENS = "sum((2 * t0 + 2 * t2 + 300) * n)"  # both conditions (100 and 50 tokens of system prompt) with both shots


@query(f"with f as (select eval_dataset_name, prompt_0_shot, prompt_2_shot, gen_id, row_number() over (partition by eval_dataset_name order by gen_id) as k from generation), a as (select eval_dataset_name, count(*) as n, avg(case when k <= 100 then length(coalesce(prompt_0_shot, '')) end) / 4 as t0, avg(case when k <= 100 then length(coalesce(prompt_2_shot, '')) end) / 4 as t2 from f group by all), p(model, price_in, price_out) as (values {COST}) select model, round({TOKENS}, 0) as input_tokens, sum(40 * n)::bigint as output_tokens, round({TOKENS} / 1e6 * max(price_in) + sum(40 * n) / 1e6 * max(price_out), 4) as cost from a cross join p group by model")
def agg_a29_cost_estimate(spark, sf):
    return M.cost(generation(spark, sf), RATES)


def variant_sql(v: str) -> str:
    null = {"n2": "''", "n3": "'nan'"}.get(v)
    if null:
        rows = f"rows_ as (select {K}, coalesce({line('relation')}, {null}) as gold, coalesce({line('generated_relation')}, {null}) as pred, relation is null as gold_null from generation where {NOT_NULL})"
    else:
        rows = normals("generation")
    return f"with {rows}, {CUBE}, {micro_sql(NEGATIVES[v])} select {K}, {ROUND(['micro_precision', 'micro_recall', 'micro_f1', 'accuracy'])}, support from micro_"


def _variant(v):
    def f(spark, sf):
        d = M.micro(C.cube(busy(spark, sf), v), NEGATIVES[v])
        return d.select(*KEYS, *r6("micro_precision", "micro_recall", "micro_f1", "accuracy"), "support")

    f.__name__ = f"agg_variant_{v}"
    query(variant_sql(v))(f)


for _v in NEGATIVES:
    _variant(_v)
