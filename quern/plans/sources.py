"""Queries of sources and sinks: what is written is read again. Files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.config import EXAMPLE_COLUMNS, NA_VALUES
from quern.plans.base import generation, listed, query, read
from quern.session import fresh
from quern.sources import readers as I
from quern.sources import writers as O

COLS = ", ".join(EXAMPLE_COLUMNS)


def folder(spark) -> str:
    return fresh(spark, "sources")


def examples(spark, sf):
    return generation(spark, sf).select(*EXAMPLE_COLUMNS)


@query("select example_id, prompt_0_shot, relation from source_example where dataset = 'tacred' and split = 'validation'")
def src_s01_read_hub_split(spark, sf):
    return I.read_split(spark, sf, I.Source("tacred", "general"), "eval").select("example_id", "prompt_0_shot", "relation")


NA = f"({listed(NA_VALUES)})"


@query(f"select {', '.join(f'case when {c} not in {NA} then {c} end as {c}' for c in ('eval_dataset_name', 'relation', 'generated_relation'))}, model_shot from generation")
def src_s02_read_csv_chunked(spark, sf):
    at = folder(spark)
    O.append(examples(spark, sf), at, "csv")
    return I.read_csv(spark, at, I.GENERATION, ["eval_dataset_name", "relation", "generated_relation", "model_shot"])


@query("select eval_dataset_name, coalesce(generated_relation, '') as generated_relation, model_shot::varchar as model_shot from generation")
def src_s03_read_csv_strings(spark, sf):
    at = folder(spark)
    O.append(examples(spark, sf), at, "csv")
    return I.read_csv_text(spark, at, EXAMPLE_COLUMNS).select("eval_dataset_name", "generated_relation", "model_shot")


@query("select gen_id, eval_dataset_name, relation from generation")
def src_s04_read_parquet(spark, sf):
    return generation(spark, sf).select("gen_id", "eval_dataset_name", "relation")


@query("select model_id, round(params_b, 4) as params_b, round(checkpoint_gb, 4) as checkpoint_gb from model_metadata")
def src_s05_read_dictrows(spark, sf):
    at = folder(spark)
    O.append(read(spark, sf, "model_metadata").select("model_id", "params_b", F.coalesce(F.col("checkpoint_gb").cast("string"), F.lit("--")).alias("checkpoint_gb")), at, "csv")
    return I.read_records(spark, at).select("model_id", I.number(F.col("params_b")).alias("params_b"), I.number(F.col("checkpoint_gb")).alias("checkpoint_gb"))


def _by_dataset(spark, sf):
    at = folder(spark)
    O.write_table(examples(spark, sf).where("eval_dataset_name is not null").select("eval_dataset_name", "relation"), at, by=["eval_dataset_name"])
    return at


@query("select distinct eval_dataset_name as dataset from generation where eval_dataset_name is not null")
def src_s06_discover_datasets(spark, sf):
    names = I.folders(spark, _by_dataset(spark, sf), "*.parquet")
    return spark.createDataFrame([(n.split("=", 1)[1],) for n in sorted(set(names))], "dataset string")


@query("select eval_dataset_name, relation from generation where eval_dataset_name is not null")
def src_s06_partition_discovery(spark, sf):
    return spark.read.parquet(_by_dataset(spark, sf)).select("eval_dataset_name", "relation")


@query("select 'generations_shard_' || lpad(k::varchar, 3, '0') as shard, k::int as worker, count(g.gen_id) as n from range(4) r(k) left join generation g on g.gen_id % 4 = k group by all")
def src_s07_discover_shards(spark, sf):
    """Shards are written as files of one folder, found by their names and read with their number."""
    at = folder(spark)
    g = generation(spark, sf).select("gen_id", F.pmod("gen_id", F.lit(4)).cast("int").alias("k"))
    for k in range(4):
        g.where(F.col("k") == k).select("gen_id").write.parquet(f"{at}/generations_shard_{k:03d}.parquet")
    g.limit(0).write.parquet(f"{at}/other.parquet")
    found = I.shards(spark, at, "parquet")
    parts = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(p).alias("p"), "n") for p in found]  # a row for each shard
    d = parts[0]
    for x in parts[1:]:
        d = d.unionAll(x)
    return d.select(F.regexp_extract("p", r"(generations_shard_\d+)", 1).alias("shard"), I.shard_number(F.col("p")).alias("worker"), "n")


@query("select eval_dataset_name, nullif(relation, '') as relation, model_shot from generation union all select eval_dataset_name, nullif(relation, ''), model_shot from generation where model_shot = 2")
def src_s08_append_csv(spark, sf):
    at = folder(spark)
    d = examples(spark, sf)
    O.append(d, at, "csv")
    O.append(d.where("model_shot = 2"), at, "csv")
    return I.read_csv(spark, at, I.GENERATION, ["eval_dataset_name", "relation", "model_shot"], na=False)


@query("select gen_id, relation from generation union all select gen_id, relation from generation where model_shot = 2")
def src_s09_append_parquet(spark, sf):
    at = folder(spark)
    d = generation(spark, sf).select("gen_id", "relation", "model_shot")
    O.append(d, at, "parquet")
    O.append(d.where("model_shot = 2"), at, "parquet")
    return spark.read.parquet(at).select("gen_id", "relation")


@query("select gen_id, model_id from generation")
def src_s10_append_dispatch(spark, sf):
    at = folder(spark)
    O.append(generation(spark, sf).select("gen_id", "model_id"), at, " Parquet ")
    return spark.read.parquet(at)


@query("select gen_type, model_shot, count(*) as n from generation group by all")
def src_s11_write_table(spark, sf):
    at = folder(spark)
    O.write_table(generation(spark, sf).groupBy("gen_type", "model_shot").agg(F.count("*").alias("n")), at, by=["gen_type"])
    return spark.read.parquet(at).select("gen_type", "model_shot", "n")


@query("select row_id, eval_dataset_name, model_shot, input_tokens from frontier_generation")
def src_frontier_schema(spark, sf):
    return spark.read.parquet(f"{sf}/frontier_generation.parquet").select("row_id", "eval_dataset_name", "model_shot", "input_tokens")


KEPT = ["eval_dataset_name", "model_id", "tuned_dataset_name", "model_shot", "prompt_shot", "gen_type", "prompt_0_shot", "relation", "generated_relation", "written_at"]


@query(f"select eval_dataset_name, count(*) as n from (select distinct {', '.join(KEPT)} from generation) group by all")
def stream_ingest(spark, sf):
    """Shards streamed into a table, rows merged twice dropped, then counted."""
    from quern.streaming import ingest

    at = folder(spark)
    g = generation(spark, sf).select(*KEPT)
    O.append(g, f"{at}/in", "parquet")
    ingest.append_new(ingest.stream(spark, f"{at}/in", g.schema), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("eval_dataset_name").agg(F.count("*").alias("n"))


@query("select date_trunc('hour', written_at) as start, eval_dataset_name, model_id, count(*) as n from generation group by all")
def stream_windows(spark, sf):
    """Rows by hour, dataset and model, kept up by a stream."""
    from quern.streaming import ingest

    at = folder(spark)
    g = generation(spark, sf).select("eval_dataset_name", "model_id", "relation", "generated_relation", "written_at")
    O.append(g, f"{at}/in", "parquet")
    d = ingest.accuracy_by_window(ingest.stream(spark, f"{at}/in", g.schema))

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out")

    d.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "eval_dataset_name", "model_id", "n")
