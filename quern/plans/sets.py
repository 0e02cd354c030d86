"""Queries of projections, text functions, set operations, sampling, mixtures and token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import DATASETS, EXAMPLE_COLUMNS, GROUPS, LITERARY, MAX_LENGTH, MIXTURES, MODELS, NEGATIVES, REGIMES, SHOTS
from quern.functions import text as T
from quern.operators import merging as G
from quern.operators import mixing as X
from quern.operators import tokens as N
from quern.operators.cube import drop_duplicates
from quern.plans.base import DS, SENT, SQL, busy, generation, line, listed, normal, query, read, strip
from quern.session import fresh
from quern.sources.writers import is_done, mark_done, replace_table

B = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
ANSWER = lambda x: strip(f"regexp_replace({x}, '(?i)^answer\\s*:\\s*', '')")
SEED = 42


def source(spark, sf):
    return read(spark, sf, "source_example")


# projections and predicates


@query(f"select example_id, {strip('prompt_0_shot')} || chr(10) || 'Answer: ' as prompt, relation, dataset from source_example where split = 'train'")
def proj_p01_select_reshape(spark, sf):
    return X.reshape(source(spark, sf).where("split = 'train'"), "prompt_0_shot")


@query(f"select example_id, {strip('prompt_0_shot')} || chr(10) || 'Answer: ' as prompt from source_example")
def proj_p02_zero_shot_suffix(spark, sf):
    return source(spark, sf).select("example_id", T.zero_shot_suffix(F.col("prompt_0_shot")).alias("prompt"))


@query("select gen_id, relation, generated_relation from generation where model_id = 'SmolLM3-3B' and tuned_dataset_name = 're_mixtune' and model_shot = 2 and prompt_shot = 2 and gen_type = 'gen_open'")
def proj_p04_filter_config(spark, sf):
    want = {"model_id": "SmolLM3-3B", "tuned_dataset_name": "re_mixtune", "model_shot": 2, "prompt_shot": 2, "gen_type": "gen_open"}
    d = generation(spark, sf)
    for c, v in want.items():
        d = d.where(F.col(c) == v)
    return d.select("gen_id", "relation", "generated_relation")


@query("select gen_id from generation where model_id is not null and relation is not null and generated_relation is not null")
def proj_p07_dropna_subset(spark, sf):
    return generation(spark, sf).dropna(subset=["model_id", "relation", "generated_relation"]).select("gen_id")


@query(f"select gen_id, case when generated_relation is not null then generated_relation when eval_dataset_name = 'pg_fiction' and relation = 'none' then 'none' else '' end as generated_relation from generation")
def proj_p11_fix_nan_predictions(spark, sf):
    fill = F.when((F.col("eval_dataset_name") == "pg_fiction") & (F.col("relation") == "none"), "none").otherwise("")
    return generation(spark, sf).select("gen_id", F.coalesce("generated_relation", fill).alias("generated_relation"))


@query("select row_id, try_cast(model_shot as integer) as shot, try_cast(model_shot as double) as shot_number from frontier_generation")
def proj_p13_to_numeric_coerce(spark, sf):
    return read(spark, sf, "frontier_generation").select("row_id", F.col("model_shot").try_cast("int").alias("shot"), F.col("model_shot").try_cast("double").alias("shot_number"))


@query("select row_id, case when input_tokens > 0 then output_tokens / input_tokens::double else 0.0 end as ratio from frontier_generation")
def proj_p14_safe_div(spark, sf):
    from quern.operators.metrics import safe_div

    return read(spark, sf, "frontier_generation").select("row_id", safe_div(F.col("output_tokens"), F.col("input_tokens")).alias("ratio"))


@query("select row_id, round(output_tokens / input_tokens::double, 6) as r6, round(output_tokens / input_tokens::double, 4) as r4, round(output_tokens / input_tokens::double * 100, 2) as r2 from frontier_generation where input_tokens > 0")
def proj_p15_round(spark, sf):
    x = F.col("output_tokens") / F.col("input_tokens")
    return read(spark, sf, "frontier_generation").where("input_tokens > 0").select("row_id", F.round(x, 6).alias("r6"), F.round(x, 4).alias("r4"), F.round(x * 100, 2).alias("r2"))


@query("select gen_id, contains(lower(generated_relation), '<think>') as think, gen_type = 'gen_constrained' as schema from generation where generated_relation is not null")
def proj_p16_flag_case(spark, sf):
    return generation(spark, sf).where("generated_relation is not null").select("gen_id", F.lower("generated_relation").contains("<think>").alias("think"), (F.col("gen_type") == "gen_constrained").alias("schema"))


@query("with s as (select distinct model_shot from generation where model_shot in (0, 2)) select model_shot, unnest(case when model_shot = 0 then [0] else [0, 2] end) as prompt_shot from s")
def proj_p17_shot_policy(spark, sf):
    m = F.col("model_shot")
    shots = F.when(m == 0, F.array(F.lit(0))).when(m == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("no prompts for model_shot "), m.cast("string"))))
    return generation(spark, sf).select("model_shot").where("model_shot is not null").distinct().select("model_shot", F.explode(shots).alias("prompt_shot"))


# text


@query(f"select gen_id, gold, pred from (select gen_id, {normal('relation', 'gold')}, {normal('generated_relation', 'pred')} from generation)")
def text_t01_normalize_relation(spark, sf):
    return busy(spark, sf).select("gen_id", T.normalize_relation(F.col("relation")).alias("gold"), T.normalize_relation(F.col("generated_relation")).alias("pred"))


@query(f"select gen_id, case when relation is null or lower({strip('relation')}) in ('', 'nan', 'null', 'none') then 'none' else {strip('relation')} end as label from generation")
def text_t02_normalize_label(spark, sf):
    return busy(spark, sf).select("gen_id", T.normalize_label(F.col("relation")).alias("label"))


@query(f"select gen_id, coalesce(nullif({strip('relation')}, ''), 'none') as label from generation")
def text_t03_label_set_norm(spark, sf):
    return busy(spark, sf).select("gen_id", T.label_set_label(F.col("relation")).alias("label"))


LINE1 = strip(f"regexp_extract({strip('coalesce(generated_relation, ' + chr(39) * 2 + ')')}, '^([^{B[1:]}*)', 1)".replace("[^[", "[^"))


@query(f"select gen_id, {ANSWER(LINE1)} as label from generation")
def text_t04_postprocess_relation(spark, sf):
    return busy(spark, sf).select("gen_id", T.postprocess(F.col("generated_relation")).alias("label"))


THINK = "regexp_replace(regexp_replace(coalesce(generated_relation, ''), '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', '')"


@query(f"with l as (select gen_id, list_filter(list_transform(regexp_split_to_array({THINK}, '\\r\\n|{B}'), lambda x: {strip('x')}), lambda x: x <> '') as ls from generation) select gen_id, {ANSWER('coalesce(ls[1], ' + chr(39) * 2 + ')')} as label from l")
def text_t05_postprocess_think(spark, sf):
    return busy(spark, sf).select("gen_id", T.postprocess_think(F.col("generated_relation")).alias("label"))


@query("select gen_id, left(md5(coalesce(prompt_0_shot, 'nan')), 12) as prompt_hash from generation")
def text_t06_prompt_hash(spark, sf):
    return busy(spark, sf).select("gen_id", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"))


ALLOWED = f"select dataset, array_to_string(list_sort(list(distinct {strip('relation')})), ', ') as labels from source_example where {strip('relation')} <> '' group by all"


@query(ALLOWED)
def text_t07_format_allowed_labels(spark, sf):
    return busy(spark, sf, "source_example").groupBy("dataset").agg(T.allowed_labels(F.col("relation")).alias("labels"))


TEMPLATE = "Name the relation. Answer with one of: {allowed_labels}."


@query(f"select dataset, replace('{TEMPLATE}', '{{allowed_labels}}', labels) as system from ({ALLOWED})")
def text_t08_build_system_prompt(spark, sf):
    d = source(spark, sf).groupBy("dataset").agg(T.allowed_labels(F.col("relation")).alias("labels"))
    return d.select("dataset", T.system_prompt(F.lit(TEMPLATE), F.col("labels")).alias("system"))


DEMO = "(?s)(.*?)\\r?\\nAnswer:\\s*(.*?)(?:\\r?\\n\\r?\\n|$)"
TRY = "'Now you try:'"
MSG = lambda role, x: f"{{'role': '{role}', 'content': {x}}}"
GROUP = lambda i: f"list_transform(regexp_extract_all(demo, '{DEMO}', {i}), lambda x: {strip('x')})"
UNRAVEL = (
    f"with p as (select example_id, {strip('coalesce(prompt_2_shot, ' + chr(39) * 2 + ')')} as t from source_example), "
    f"d as (select example_id, t, contains(t, {TRY}) as few, {strip(f'split_part(t, {TRY}, 1)')} as demo, {strip(f'substr(t, instr(t, {TRY}) + 12)')} as fin from p), "
    f"z as (select *, list_filter(list_zip({GROUP(1)}, {GROUP(2)}), lambda s: s[1] <> '' and s[2] <> '') as zs from d), "
    f"m as (select example_id, case when few then flatten(list_transform(zs, lambda s: [{MSG('user', 'case when ends_with(s[1], ' + chr(39) + 'Answer:' + chr(39) + ') then s[1] else s[1] || chr(10) || ' + chr(39) + 'Answer:' + chr(39) + ' end')}, {MSG('assistant', 's[2]')}])) || [{MSG('user', 'case when fin <> ' + chr(39) * 2 + ' then fin else t end')}] else [{MSG('user', 't')}] end as ms from z)"
)


@query(f"{UNRAVEL} select example_id, (i - 1)::int as turn, ms[i].role as role, ms[i].content as content from (select example_id, ms, unnest(range(1, len(ms) + 1)) as i from m)")
def text_t09_unravel_fewshot(spark, sf):
    m = F.posexplode(T.unravel(F.col("prompt_2_shot"))).alias("turn", "m")
    return busy(spark, sf, "source_example").select("example_id", m).select("example_id", "turn", "m.role", "m.content")


@query(f"{UNRAVEL} select example_id, 'Name the relation.' || chr(10) || chr(10) || array_to_string(list_transform(ms, lambda x: x.content), chr(10) || chr(10)) || chr(10) as chat from m")
def text_t10_build_chat_text(spark, sf):
    return busy(spark, sf, "source_example").select("example_id", T.chat_text(F.lit("Name the relation."), T.unravel(F.col("prompt_2_shot"))).alias("chat"))


WSS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"


def span_sql(text: str, mention: str, n: str) -> str:
    """Select items <n>_b and <n>_e: where the mention stands in the text."""
    loose = f"array_to_string(list_transform(list_filter(regexp_split_to_array({n}_m, '{WSS}+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '{WSS}*')"
    found = f"regexp_extract({text}, {loose})"
    return (
        f"{strip(f'coalesce({mention}, {chr(39) * 2})')} as {n}_m, instr({text}, {n}_m) as {n}_at, case when {n}_m <> '' and {n}_at = 0 then {found} else '' end as {n}_f, "
        f"case when {n}_m = '' then -1 when {n}_at > 0 then {n}_at - 1 when {n}_f <> '' then instr({text}, {n}_f) - 1 else -1 end as {n}_b, "
        f"case when {n}_m = '' then -1 when {n}_at > 0 then {n}_at - 1 + length({n}_m) when {n}_f <> '' then instr({text}, {n}_f) - 1 + length({n}_f) else -1 end as {n}_e"
    )


@query(f"select example_id, a_b::int as \"begin\", a_e::int as \"end\" from (select example_id, {span_sql('text', 'entity1', 'a')} from source_example where text is not null and entity1 is not null)")
def text_t11_find_span(spark, sf):
    s = T.find_span(F.col("text"), F.col("entity1"))
    return busy(spark, sf, "source_example").where("text is not null and entity1 is not null").select("example_id", s["begin"].alias("begin"), s["end"].alias("end"))


OPEN_TAG = lambda tag, t: f"case when coalesce({t}, '') in ('', 'None') then '[{tag}]' else '[{tag}] ' || {t} || ' :' end"


def _inline(p, po, pt, q, qo, qt):
    cut = lambda i, j: f"substr(s, {i} + 1, {j} - {i})"
    return f"{cut('0', p + '_b')} || ' ' || {po} || ' ' || {cut(p + '_b', p + '_e')} || ' [/{pt}] ' || {cut(p + '_e', q + '_b')} || ' ' || {qo} || ' ' || {cut(q + '_b', q + '_e')} || ' [/{qt}] ' || {cut(q + '_e', 'length(s)')}"


MARKED = (
    f"with t as (select example_id, coalesce(text, 'None') as s, entity1, entity2, {OPEN_TAG('E1', 'entity1type')} as o1, {OPEN_TAG('E2', 'entity2type')} as o2 from source_example), "
    f"x as (select *, {span_sql('s', 'entity1', 'a')}, {span_sql('s', 'entity2', 'b')} from t) "
    f"select example_id, case when a_b < 0 or b_b < 0 or not (a_e <= b_b or b_e <= a_b) then s || ' ' || o1 || ' ' || coalesce(entity1, 'None') || ' [/E1] ' || o2 || ' ' || coalesce(entity2, 'None') || ' [/E2]' "
    f"when a_b < b_b then {_inline('a', 'o1', 'E1', 'b', 'o2', 'E2')} else {_inline('b', 'o2', 'E2', 'a', 'o1', 'E1')} end as marked from x"
)


@query(MARKED)
def text_t12_mark_entities(spark, sf):
    return busy(spark, sf, "source_example").select("example_id", T.mark_entities(*[F.col(c) for c in ("text", "entity1", "entity2", "entity1type", "entity2type")]).alias("marked"))


@query(f"select example_id, {SENT} as sentence from (select example_id, prompt_0_shot as p from source_example)")
def text_t13_extract_sentence(spark, sf):
    return busy(spark, sf, "source_example").select("example_id", T.extract_sentence(F.col("prompt_0_shot")).alias("sentence"))


@query("select example_id, left(text, 100) as t100, left(text, 300) as t300 from source_example")
def text_t14_truncate_text(spark, sf):
    return busy(spark, sf, "source_example").select("example_id", T.truncate(F.col("text"), 100).alias("t100"), T.truncate(F.col("text"), 300).alias("t300"))


@query("select distinct 'owner/' || model_id || '-' || tuned_dataset_name || '-' || model_shot || '-shot' as name from generation where model_id is not null and tuned_dataset_name is not null and model_shot is not null")
def text_t15_repo_name(spark, sf):
    return busy(spark, sf).dropna(subset=["model_id", "tuned_dataset_name", "model_shot"]).select(T.run_name("owner", F.col("model_id"), F.col("tuned_dataset_name"), F.col("model_shot")).alias("name")).distinct()


@query("select model_id, left(lower(split_part(model_id, '-', 1)), 7) as short_key from model_metadata")
def text_t16_short_model_key(spark, sf):
    return read(spark, sf, "model_metadata").select("model_id", T.short_key(F.col("model_id")).alias("short_key"))


@query(f"select gen_id, lower({strip('relation')}) in ({listed(NEGATIVES['n2'])}) as catch_all from generation where relation is not null")
def text_t17_is_catch_all(spark, sf):
    return busy(spark, sf).where("relation is not null").select("gen_id", T.is_negative(F.col("relation"), NEGATIVES["n2"]).alias("catch_all"))


# set operations, sampling, mixtures

SORT = ["eval_dataset_name", "tuned_dataset_name", "model_id", "model_shot", "prompt_shot", "gen_type", "relation", "generated_relation"]


@query(f"select gen_id, {', '.join(SORT)} from generation order by {', '.join(SORT)}, gen_id")
def set_o01_stable_sort(spark, sf):
    return generation(spark, sf).select("gen_id", *SORT).orderBy(*SORT, "gen_id")


@query("select eval_dataset_name, model_id, gen_type, relation from generation union all select eval_dataset_name, model_id, gen_type, relation from frontier_generation")
def set_o04_union_all(spark, sf):
    c = ["eval_dataset_name", "model_id", "gen_type", "relation"]
    return generation(spark, sf).select(*c).unionByName(read(spark, sf, "frontier_generation").select(*c))


@query(f"select distinct {', '.join(SORT)} from generation")
def set_o05_distinct(spark, sf):
    return generation(spark, sf).select(*SORT).distinct()


@query("select eval_dataset_name, prompt_0_shot, gen_id, model_id, generated_relation from generation qualify row_number() over (partition by eval_dataset_name, prompt_0_shot order by gen_id) = 1")
def set_o06_drop_duplicates(spark, sf):
    d = generation(spark, sf).select("eval_dataset_name", "prompt_0_shot", "gen_id", "model_id", "generated_relation")
    return drop_duplicates(d, ["eval_dataset_name", "prompt_0_shot"], "gen_id")


@query("select eval_dataset_name, label, max(a) = 1 as gold, max(b) = 1 as predicted from (select eval_dataset_name, relation as label, 1 as a, 0 as b from generation where relation is not null union all select eval_dataset_name, generated_relation, 0, 1 from generation where generated_relation is not null) group by all")
def set_o07_intersection_difference(spark, sf):
    g = generation(spark, sf)
    side = lambda c, a: g.where(F.col(c).isNotNull()).select("eval_dataset_name", F.col(c).alias("label"), F.lit(a).alias("a"))
    d = side("relation", True).unionAll(side("generated_relation", False))
    return d.groupBy("eval_dataset_name", "label").agg(F.bool_or("a").alias("gold"), F.bool_or(~F.col("a")).alias("predicted"))


@query("select eval_dataset_name, relation as label from generation where relation is not null intersect select eval_dataset_name, generated_relation from generation")
def set_o07_intersect(spark, sf):
    g = generation(spark, sf)
    return g.where("relation is not null").select("eval_dataset_name", F.col("relation").alias("label")).intersect(g.select("eval_dataset_name", "generated_relation"))


@query("select eval_dataset_name, generated_relation as label from generation except select eval_dataset_name, relation from generation")
def set_o07_difference(spark, sf):
    g = generation(spark, sf)
    return g.select("eval_dataset_name", F.col("generated_relation").alias("label")).subtract(g.select("eval_dataset_name", "relation"))


@query(f"select distinct {', '.join(EXAMPLE_COLUMNS)} from generation")
def set_o08_merge_shards(spark, sf):
    g = generation(spark, sf)
    early, late = g.where("shard_file < 'generations_shard_000_050.csv' or shard_file is null"), g.where("shard_file >= 'generations_shard_000_050.csv'")
    return G.merged(G.merge_shards([early, late], EXAMPLE_COLUMNS, strict=True), EXAMPLE_COLUMNS, dedup=True)


@query(f"select example_id, case split when 'train' then 'train_' || s when 'validation' then 'eval_' || s else 'test_' || s end as split from (select example_id, split, case when dataset in ({listed(LITERARY)}) then 2 else 0 end as s from source_example where dataset in ({listed(DS)}) and split in ('train', 'validation', 'test'))")
def set_o09_merge_splits(spark, sf):
    general = X.mixture(source(spark, sf), MIXTURES["gentune"], 0).select("example_id", "split")
    literary = X.mixture(source(spark, sf), MIXTURES["littune"], 2).select("example_id", "split")
    return X.merge_splits([general, literary])


SPLICED = "(model_id = 'SmolLM3-3B' and tuned_dataset_name = 're_mixtune' and model_shot = 0)"


@query(f"with n as (select gen_id, eval_dataset_name, model_id, tuned_dataset_name, model_shot, {SPLICED} as own, generated_relation, list_filter(list_transform(regexp_split_to_array({THINK}, '\\r\\n|{B}'), lambda x: {strip('x')}), lambda x: x <> '') as ls from generation) select gen_id, eval_dataset_name, model_id, tuned_dataset_name, model_shot, case when own then {ANSWER('coalesce(ls[1], ' + chr(39) * 2 + ')')} else generated_relation end as generated_relation from n")
def set_o10_splice(spark, sf):
    c = ["gen_id", "eval_dataset_name", "model_id", "tuned_dataset_name", "model_shot", "generated_relation"]
    g = generation(spark, sf).select(*c)
    return G.splice(g, g.withColumn("generated_relation", T.postprocess_think(F.col("generated_relation"))), ("SmolLM3-3B", "re_mixtune", 0))


@query(SQL["set_o10_splice"].replace("gen_id, eval_dataset_name, model_id, tuned_dataset_name, model_shot, case when", "gen_id, model_id, tuned_dataset_name, model_shot, case when"))
def set_o10_splice_in_place(spark, sf):
    """The table is written, its rows of one configuration are replaced in place, and the first table is kept as a backup."""
    at = f"{fresh(spark, 'splice')}/generations"
    c = ["gen_id", "model_id", "tuned_dataset_name", "model_shot", "generated_relation"]
    generation(spark, sf).select(*c).write.parquet(at)
    for _ in range(2):  # doing it again changes nothing
        g = spark.read.parquet(at)
        replace_table(G.splice(g, g.withColumn("generated_relation", T.postprocess_think(F.col("generated_relation"))), ("SmolLM3-3B", "re_mixtune", 0)), at)
    return spark.read.parquet(at)


HASH = lambda key, seed=SEED: f"md5('{seed}:' || {key})"


@query(f"select example_id, dataset, row_number() over (order by {HASH('example_id')}, example_id) as place from source_example")
def set_o11_shuffle(spark, sf):
    return X.places(source(spark, sf).select("example_id", "dataset"), SEED)


@query(f"select example_id, dataset from source_example qualify row_number() over (partition by dataset order by {HASH('example_id')}, example_id) <= 200")
def set_o12_cap(spark, sf):
    return X.cap(source(spark, sf).select("example_id", "dataset"), 200, SEED)


LIT = f"dataset in ({listed(LITERARY)})"


@query(f"with d as (select example_id, dataset, {LIT} as lit from source_example where dataset is not null), n as (select least(count(*) filter (lit), count(*) filter (not lit)) as n from d) select example_id, dataset from d qualify row_number() over (partition by lit order by case when lit then {HASH('example_id', SEED + 1)} else {HASH('example_id')} end, example_id) <= (select n from n)")
def set_o13_domain_balanced(spark, sf):
    return X.domain_balanced(source(spark, sf).where("dataset is not null").select("example_id", "dataset"), LITERARY, SEED)


@query(f"with n as (select min(k) as n from (select count(*) as k from source_example group by dataset)) select example_id, dataset from source_example qualify row_number() over (partition by dataset order by {HASH('example_id')}, example_id) <= (select n from n)")
def set_o14_dataset_balanced(spark, sf):
    return X.dataset_balanced(source(spark, sf).select("example_id", "dataset"), SEED)


MIX = f"select example_id, {{prompt}} as prompt, relation, dataset, case split when 'train' then 'train_{{shot}}' when 'validation' then 'eval_{{shot}}' when 'test' then 'test_{{shot}}' end as split, {{shot}} as shot from source_example where dataset in ({listed(DS)}) and split in ('train', 'validation', 'test')"
ZERO = strip("prompt_0_shot") + " || chr(10) || 'Answer: '"


@query(f"with d as ({MIX.format(prompt=ZERO, shot=0)} union all {MIX.format(prompt='prompt_2_shot', shot=2)} union all {MIX.format(prompt='prompt_5_shot', shot=5)}), e as (select *, {LIT} as lit from d), n as (select split, least(count(*) filter (lit), count(*) filter (not lit)) as n from e group by split) select e.* exclude (lit) from e join n on e.split = n.split qualify row_number() over (partition by lit, e.split order by case when lit then {HASH('example_id', SEED + 1)} else {HASH('example_id')} end, example_id) <= n.n")
def set_o15_build_mixture(spark, sf):
    return X.mixture(source(spark, sf), MIXTURES["mixtune"], [0, 2, 5])


@query(f"select example_id from source_example order by {HASH('example_id')}, example_id limit 50")
def set_o16_sample(spark, sf):
    return X.sample(source(spark, sf).select("example_id"), 50, SEED, "example_id")


@query("select example_id, dataset from source_example order by example_id limit 100")
def set_o17_prefix_cap(spark, sf):
    return X.head(source(spark, sf).select("example_id", "dataset"), 100, "example_id")


@query("select example_id, (example_id % 7)::int as shard from source_example")
def set_o18_shard(spark, sf):
    return X.shard(source(spark, sf).select("example_id"), 7, "example_id")


@query("select example_id, floor(example_id / 32)::bigint as batch from source_example")
def set_o19_batching(spark, sf):
    return X.batches(source(spark, sf).select("example_id"), 32, "example_id")


TOK = lambda x: f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"
WIN = f"with d as (select doc_id, {TOK('text')} as t from documents), w as (select doc_id, t, unnest(range(case when len(t) <= 512 then 1 else ceil((len(t) - 512) / 384.0)::int + 1 end))::int as window_ from d)"


@query(f"{WIN} select doc_id, window_ as window, len(t[window_ * 384 + 1 : window_ * 384 + 512]) as n_tokens, array_to_string(t[window_ * 384 + 1 : window_ * 384 + 512], ' ') as tokens from w")
def set_o20_windowed_tokenisation(spark, sf):
    d = N.windows(read(spark, sf, "documents"), N.words(F.col("text")), 512, 128, ["doc_id"])
    return d.select("doc_id", "window", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(f"with d as (select floor(doc_id / 100)::bigint as batch, flatten(list({TOK('text')} order by doc_id)) as t from documents group by 1), b as (select batch, t, unnest(range(greatest(len(t) // 256, 1)::int))::int as block from d where len(t) > 0) select batch, block, array_to_string(t[block * 256 + 1 : block * 256 + 256], ' ') as tokens from b")
def set_o21_group_texts(spark, sf):
    d = N.blocks(read(spark, sf, "documents"), N.words(F.col("text")), F.floor(F.col("doc_id") / 100).cast("long"), "doc_id", 256)
    return d.select("batch", "block", F.array_join("tokens", " ").alias("tokens"))


MASK_IDS = f"select example_id, len({TOK('prompt_0_shot')}) as p, list_transform({TOK('prompt_0_shot')} || {TOK('relation')}, lambda w: length(w)) as ids from source_example"


@query(f"with m as ({MASK_IDS}) select example_id, array_to_string((list_transform(range(least(p, len(ids))), lambda i: -100) || ids[p + 1 :])[1:{MAX_LENGTH}], ' ') as labels from m")
def set_o22_label_mask(spark, sf):
    p, a = N.words(F.col("prompt_0_shot")), N.words(F.col("relation"))
    ids = F.transform(F.concat(p, a), F.length)
    labels = N.label_mask(ids, F.size(p), MAX_LENGTH)
    return source(spark, sf).select("example_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), " ").alias("labels"))


@query(f"with m as (select example_id, floor(example_id / 16)::bigint as batch, list_transform({TOK('relation')}, lambda w: length(w)) as ids from source_example) select example_id, batch, array_to_string(ids || list_transform(range(max(len(ids)) over (partition by batch) - len(ids)), lambda i: 0), ' ') as ids from m")
def set_o23_pad(spark, sf):
    d = source(spark, sf).select("example_id", F.floor(F.col("example_id") / 16).cast("long").alias("batch"), F.transform(N.words(F.col("relation")), F.length).alias("ids"))
    return N.pad(d, "ids", "batch", 0).select("example_id", "batch", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


FIRST = "first_ as (select eval_dataset_name, prompt_0_shot, coalesce(prompt_2_shot, prompt_0_shot) as prompt_2_shot, coalesce(relation, '') as relation from generation where prompt_0_shot is not null qualify row_number() over (partition by eval_dataset_name, prompt_0_shot order by gen_id) = 1)"


@query(f"with {FIRST} select * from first_")
def tab_r20_first_per_prompt(spark, sf):
    return N.first_per_prompt(generation(spark, sf))


TRUNC = f"with {FIRST}, l as (select eval_dataset_name as dataset, '0-shot' as condition, len({TOK('prompt_0_shot')}) as p, len({TOK('relation')}) as r from first_ union all select eval_dataset_name, '2-shot', len({TOK('prompt_2_shot')}), len({TOK('relation')}) from first_), s as (select dataset, condition, count(*) as n_examples, trunc(quantile_cont(p, 0.5))::int as infer_median, trunc(quantile_cont(p, 0.95))::int as infer_p95, max(p)::int as infer_max, trunc(quantile_cont(p + r, 0.5))::int as train_median, trunc(quantile_cont(p + r, 0.95))::int as train_p95, max(p + r)::int as train_max, round(100 * avg(case when p + r > {MAX_LENGTH} then 1.0 else 0.0 end), 3) as pct_train_trunc, round(100 * avg(case when p >= {MAX_LENGTH} and p + r > {MAX_LENGTH} then 1.0 else 0.0 end), 3) as pct_train_label_cut from l group by all)"


@query(f"{TRUNC} select * from s")
def tab_r19_truncation_stats(spark, sf):
    return N.truncation(N.first_per_prompt(generation(spark, sf)), MAX_LENGTH)


@query(f"{TRUNC} select dataset, max(train_max) as train_max, max(pct_train_trunc) as pct_train_trunc, max(infer_max) as infer_max from s group by all")
def agg_a30_max_worst_case(spark, sf):
    return N.worst_case(N.truncation(N.first_per_prompt(generation(spark, sf)), MAX_LENGTH))


@query("select eval_dataset_name, quantile_cont(length(generated_relation), [0.025, 0.5, 0.95, 0.975]) as q from generation where generated_relation is not null group by all".replace("quantile_cont(length(generated_relation), [0.025, 0.5, 0.95, 0.975]) as q", "round(quantile_cont(length(generated_relation), 0.025), 6) as q025, round(quantile_cont(length(generated_relation), 0.5), 6) as q500, round(quantile_cont(length(generated_relation), 0.95), 6) as q950, round(quantile_cont(length(generated_relation), 0.975), 6) as q975"))
def agg_a22_percentile_linear(spark, sf):
    d = generation(spark, sf).where("generated_relation is not null").groupBy("eval_dataset_name").agg(F.percentile(F.length("generated_relation"), F.array(*[F.lit(x) for x in (0.025, 0.5, 0.95, 0.975)])).alias("q"))
    return d.select("eval_dataset_name", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q025", "q500", "q950", "q975"))])


@query("select model_id, scale_group, avg_inference_latency_ms, round(avg(avg_inference_latency_ms) over (partition by scale_group), 4) as group_latency_ms, round(avg(checkpoint_gb) over (partition by scale_group), 4) as group_gb from model_metadata")
def agg_a33_latency_mean(spark, sf):
    m = read(spark, sf, "model_metadata")
    g = m.groupBy("scale_group").agg(F.round(F.avg("avg_inference_latency_ms"), 4).alias("group_latency_ms"), F.round(F.avg("checkpoint_gb"), 4).alias("group_gb"))
    return m.select("model_id", "scale_group", "avg_inference_latency_ms").join(g, "scale_group", "left")


# joins and grids


RUN = {"model_id": "SmolLM3-3B", "tuned_dataset_name": "re_mixtune", "model_shot": 2, "prompt_shot": 2, "gen_type": "gen_open"}
OF_RUN = " and ".join(f"g.{c} = {v!r}" for c, v in RUN.items())
LEFT = f"select s.example_id from source_example s where s.split = 'test' and s.dataset in ({{datasets}}) and not exists (select 1 from generation g where {OF_RUN} and g.eval_dataset_name = s.dataset and left(md5(coalesce(g.prompt_0_shot, 'nan')), 12) = left(md5(coalesce(s.prompt_0_shot, 'nan')), 12))"


def of_run(spark, sf):
    d = generation(spark, sf)
    for c, v in RUN.items():
        d = d.where(F.col(c) == v)
    return d


def test_prompts(spark, sf, datasets=DATASETS):
    d = source(spark, sf).where((F.col("split") == "test") & F.col("dataset").isin(datasets))
    return d.select("example_id", F.col("dataset").alias("eval_dataset_name"), T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"))


@query(LEFT.format(datasets=listed(DS)))
def join_j10_anti_completed(spark, sf):
    """The test prompts that one configuration has not answered yet."""
    done = of_run(spark, sf).select("eval_dataset_name", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"))
    return G.remaining(test_prompts(spark, sf), done, ["eval_dataset_name", "prompt_hash"]).select("example_id")


@query(LEFT.format(datasets=listed(d for d in DS if d not in ("tacred", "rebel"))))
def udf_u05_resume(spark, sf):
    """What a run has left to do: datasets whose folder has the marker of completion are passed over, prompts answered elsewhere too."""
    at = fresh(spark, "runs")
    answers = of_run(spark, sf).select("eval_dataset_name", "prompt_0_shot", "generated_relation").where(F.col("eval_dataset_name").isin(DATASETS))
    answers.write.partitionBy("eval_dataset_name").parquet(at)
    place = lambda d: f"{at}/eval_dataset_name={d}"
    for d in ("tacred", "rebel"):
        mark_done(spark, place(d))
    todo = test_prompts(spark, sf, [d for d in DATASETS if not is_done(spark, place(d))])
    done = spark.read.schema(answers.schema).parquet(at).select("eval_dataset_name", T.prompt_hash(F.col("prompt_0_shot")).alias("prompt_hash"))
    return G.remaining(todo, done, ["eval_dataset_name", "prompt_hash"]).select("example_id")


GROUPED = " or ".join(f"(tuned_dataset_name = '{r}'" + (")" if ds == "all" else f" and eval_dataset_name in ({listed(ds)}))") for r, ds in GROUPS.items())
vals = lambda xs, n: "(values " + ", ".join(f"({x!r})" for x in xs) + f") {n[0]}_({n})"
JOBS = f"select * from {vals(MODELS, 'model_id')}, {vals(list(REGIMES), 'tuned_dataset_name')}, {vals(DS, 'eval_dataset_name')}, {vals(SHOTS, 'model_shot')}, {vals(SHOTS, 'prompt_shot')} where ({GROUPED}) and prompt_shot <= model_shot"


def jobs(spark):
    """Every job to run: models x regimes x datasets of their group x shots, made without reading data."""
    rows = [(m, r, d, a, b) for m in MODELS for r in REGIMES for d in DATASETS if GROUPS[r] == "all" or d in GROUPS[r] for a in SHOTS for b in SHOTS if b <= a]
    return spark.createDataFrame(rows, "model_id string, tuned_dataset_name string, eval_dataset_name string, model_shot int, prompt_shot int")


@query(JOBS)
def udf_u07_job_grid(spark, sf):
    return jobs(spark)


@query(f"with j as ({JOBS}), d as (select model_id, tuned_dataset_name, eval_dataset_name, model_shot, prompt_shot, count(*) as n from generation group by all) select j.*, d.n from j left join d using (model_id, tuned_dataset_name, eval_dataset_name, model_shot, prompt_shot)")
def join_j11_cross_grid(spark, sf):
    k = ["model_id", "tuned_dataset_name", "eval_dataset_name", "model_shot", "prompt_shot"]
    done = generation(spark, sf).groupBy(*k).agg(F.count("*").alias("n"))
    return jobs(spark).join(done, k, "left")


@query("select g.gen_id, g.eval_dataset_name, l.label is not null as valid from generation g left join (select distinct dataset, label from label_schema) l on g.eval_dataset_name = l.dataset and g.generated_relation = l.label")
def join_j09_semi_allowed(spark, sf):
    lab = read(spark, sf, "label_schema").select(F.col("dataset").alias("eval_dataset_name"), F.col("label").alias("generated_relation"), F.lit(True).alias("v")).distinct()
    return generation(spark, sf).select("gen_id", "eval_dataset_name", "generated_relation").join(lab, ["eval_dataset_name", "generated_relation"], "left").select("gen_id", "eval_dataset_name", F.coalesce("v", F.lit(False)).alias("valid"))


@query(f"select doc_id, array_to_string(list_transform({TOK('text')}, lambda w: length(w)), ' ') as ids from documents")
def udf_u02_batched_tokenise(spark, sf):
    d = N.tokenise(read(spark, sf, "documents"), "text", "doc_id", lambda xs: [[len(w) for w in x.split()] for x in xs])
    return d.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("with p as (select distinct probe_id, prompt_0_shot from probe_prompt union select distinct gen_id, prompt_0_shot from generation) select probe_id as id, case least(2, length(coalesce(prompt_0_shot, '')) // 300) when 0 then 'short' when 1 then 'medium' else 'long' end as generated_relation from p")
def udf_u04_scorer(spark, sf):
    d = read(spark, sf, "probe_prompt").select(F.col("probe_id").alias("id"), "prompt_0_shot").unionAll(generation(spark, sf).select("gen_id", "prompt_0_shot"))
    return N.score(d, "prompt_0_shot", "id", N.length_scorer)


@query("select row_id, generated_relation like 'ERROR:%' or (input_tokens is null and output_tokens is null) as is_error from frontier_generation where generated_relation is not null")
def udf_u06_error_rows(spark, sf):
    err = F.col("generated_relation").startswith("ERROR:") | (F.col("input_tokens").isNull() & F.col("output_tokens").isNull())
    return read(spark, sf, "frontier_generation").where("generated_relation is not null").select("row_id", err.alias("is_error"))


@query(f"select gen_id, {line('relation')} as plain_line from generation where relation is not null")
def text_plain_line(spark, sf):
    return generation(spark, sf).where("relation is not null").select("gen_id", T.plain_line(F.col("relation")).alias("plain_line"))
