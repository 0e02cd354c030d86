"""Registering queries with their SQL, and the pieces of SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.config import ANOMALIES, CONSTRAINED, DATASETS, GENERAL, KEYS, LITERARY, NEGATIVES, REGIMES, REPORTED_ZERO
from quern.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def generation(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "generation")


def busy(spark: SparkSession, sf: str, table: str = "generation") -> DataFrame:
    """A table whose rows are worked on by costly expressions before the first shuffle."""
    return spread(read(spark, sf, table))


def listed(xs) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs)


WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
K = ", ".join(KEYS)
NOT_NULL = " and ".join(f"{k} is not null" for k in KEYS)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def line(x: str) -> str:
    first = strip(f"split_part({strip(x)}, chr(10), 1)")
    return f"regexp_replace(lower({first}), '{WS}+', ' ', 'g')"


def normal(x: str, out: str) -> str:
    """Select items that end in the column `out`: the normalised label."""
    bare = f"case when length({out}_l) >= 2 and left({out}_l, 1) = right({out}_l, 1) and left({out}_l, 1) in ('\"', '''') then {strip(f'substr({out}_l, 2, length({out}_l) - 2)')} else {out}_l end"
    return f"{line(x)} as {out}_l, {bare} as {out}_q, case when {x} is null or {out}_q in ('', 'nan', 'null', 'none') then 'none' else {out}_q end as {out}"


def normals(src: str, keys: str = K) -> str:
    """CTE named rows_: keys, gold, pred, gold_null of a relation."""
    return f"rows_ as (select {keys}, {normal('relation', 'gold')}, {normal('generated_relation', 'pred')}, relation is null as gold_null from {src} where {NOT_NULL})"


def cubes(keys: str = K) -> str:
    return f"cube_ as (select {keys}, gold, pred, gold_null, count(*) as n from rows_ group by all)"


CUBE = cubes()


def div(a: str, b: str) -> str:
    return f"case when {b} > 0 then {a} / {b}::double else 0.0 end"


def micro_sql(neg: list[str] = NEGATIVES["n1"], name: str = "micro_", src: str = "cube_", keys: str = K) -> str:
    g, p = (f"{c} not in ({listed(neg)})" if neg else "true" for c in ("gold", "pred"))
    c = f"select {keys}, sum(case when gold = pred and {g} then n else 0 end) as tp, sum(case when gold <> pred and {p} then n else 0 end) as fp, sum(case when gold <> pred and {g} then n else 0 end) as fn, sum(case when gold = pred then n else 0 end) as hits, sum(n)::bigint as support from {src} group by all"
    return f"{name} as (select {keys}, {div('tp', '(tp + fp)')} as micro_precision, {div('tp', '(tp + fn)')} as micro_recall, case when micro_precision + micro_recall > 0 then 2 * micro_precision * micro_recall / (micro_precision + micro_recall) else 0.0 end as micro_f1, {div('hits', 'support')} as accuracy, support from ({c}))"


def label_sql(name: str = "lab_", src: str = "cube_", keys: str = K) -> str:
    a = f"select {keys}, gold as label, sum(case when gold = pred then n else 0 end) as tp, 0 as fp, sum(case when gold <> pred then n else 0 end) as fn, sum(n) as support from {src} group by all"
    b = f"select {keys}, pred, 0, sum(n), 0, 0 from {src} where gold <> pred group by all"
    return f"{name} as (select {keys}, label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(support)::bigint as support from ({a} union all {b}) group by all)"


def class_sql(neg: list[str] = NEGATIVES["n1"], name: str = "class_", src: str = "lab_", keys: str = K) -> str:
    cond = f" and label not in ({listed(neg)})" if neg else ""
    return f"{name} as (select {keys}, label, {div('tp', '(tp + fp)')} as precision_, {div('tp', '(tp + fn)')} as recall_, case when precision_ + recall_ > 0 then 2 * precision_ * recall_ / (precision_ + recall_) else 0.0 end as f1, support from {src} where support > 0{cond})"


def metrics_sql(src: str = "generation", neg: list[str] = NEGATIVES["n1"], keys: str = K, ctes: str = "", name: str = "metrics_", labels: str = "allowed_ as (select distinct eval_dataset_name, gold as label from cube_ where not gold_null)") -> str:
    """CTEs up to `name`: all metrics, rounded to six digits."""
    keyed = keys.split(", ")
    on = " and ".join(f"a.{k} = m.{k}" for k in keyed)
    macro = f"macro_ as (select {keys}, avg(precision_) as macro_precision, avg(recall_) as macro_recall, avg(f1) as macro_f1 from class_ group by all)"
    qual = f"qual_ as (select {', '.join(f'c.{k}' for k in keyed)}, sum(case when a.label is not null then n else 0 end) / sum(n)::double as schema_valid_rate, sum(case when length(pred) > 60 or pred = '' then n else 0 end) / sum(n)::double as malformed_rate from cube_ c left join allowed_ a on c.eval_dataset_name = a.eval_dataset_name and c.pred = a.label group by all)"
    r = lambda c, t: f"round({t}.{c}, 6) as {c}"
    cols = [r(c, "m") for c in ("micro_precision", "micro_recall", "micro_f1", "accuracy")] + ["m.support"] + [f"coalesce(round(a.{c}, 6), 0.0) as {c}" for c in ("macro_precision", "macro_recall", "macro_f1")] + [r(c, "q") for c in ("schema_valid_rate", "malformed_rate")]
    final = f"{name} as (select {', '.join(f'm.{k}' for k in keyed)}, {', '.join(cols)} from micro_ m left join macro_ a on {on} join qual_ q on {on.replace('a.', 'q.')})"
    return ", ".join([*([ctes] if ctes else []), normals(src, keys), cubes(keys), micro_sql(neg, keys=keys), label_sql(keys=keys), class_sql(neg, keys=keys), macro, labels, qual, final])


# the sentence of a prompt p
SENT = f"case when regexp_matches(p, 'Sentence:\\s*\"[^\"]+\"') then {strip('regexp_extract(p, ' + chr(39) + 'Sentence:' + chr(92) + 's*' + chr(34) + '([^' + chr(34) + ']+)' + chr(34) + chr(39) + ', 1)')} when regexp_matches(p, '\"[^\"]{{20,}}\"') then {strip('regexp_extract(p, ' + chr(39) + chr(34) + '([^' + chr(34) + ']{20,})' + chr(34) + chr(39) + ', 1)')} else coalesce(left(list_filter(list_transform(string_split({strip('p')}, chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 30 and not starts_with(x, 'You are') and not starts_with(x, 'Extract'))[1], 200), left(p, 200)) end"

SAME = f"{K}, prompt_hash, relation"
HASHED = f"hashed_ as (select {K}, relation, generated_relation, left(md5(coalesce(prompt_0_shot, 'nan')), 12) as prompt_hash, gen_id from generation)"
SIZES = f"sizes_ as (select {K}, count(*) as size from generation where {NOT_NULL} group by all), usual_ as (select eval_dataset_name, gen_type, size, count(*) as k from sizes_ group by all), mode_ as (select eval_dataset_name, gen_type, size as mode_size from usual_ qualify row_number() over (partition by eval_dataset_name, gen_type order by k desc, size) = 1), flag_ as (select s.*, mode_size, size > mode_size and size % mode_size = 0 as flagged from sizes_ s join mode_ m on s.eval_dataset_name = m.eval_dataset_name and s.gen_type = m.gen_type)"
DEDUP = f"{HASHED}, {SIZES}, dedup_ as (select * exclude (rn) from (select *, row_number() over (partition by {SAME} order by gen_id) as rn from hashed_) where rn = 1 or eval_dataset_name is null or eval_dataset_name not in (select eval_dataset_name from flag_ where flagged))"
METRICS = metrics_sql("dedup_", ctes=DEDUP)

PRIMARY = f"gen_type = '{CONSTRAINED}' and model_shot = prompt_shot"


def is_config(configs) -> str:
    return "(" + " or ".join(f"(model_id = '{m}' and tuned_dataset_name = '{r}' and model_shot = {s})" for m, r, s in configs) + ")"


DOMAIN = f"case when eval_dataset_name in ({listed(GENERAL)}) then 'general' when eval_dataset_name in ({listed(LITERARY)}) then 'literary' else 'unknown' end"
REGIME = "case tuned_dataset_name " + " ".join(f"when '{a}' then '{b}'" for a, b in REGIMES.items()) + " else tuned_dataset_name end"
PRIM = f"prim_ as (select * from metrics_ where {PRIMARY}), zero_ as (select * replace (case when {is_config(REPORTED_ZERO)} then 0.0 else micro_f1 end as micro_f1) from prim_), clean_ as (select * from prim_ where not {is_config(ANOMALIES)})"
IN_GEN, IN_LIT = (f"eval_dataset_name in ({listed(x)})" for x in (GENERAL, LITERARY))
DS = DATASETS
