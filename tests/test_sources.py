from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators.tables import grid
from quern.sources import readers as I
from quern.sources import writers as O
from quern.streaming import ingest

ROWS = [("d", 'say "hi"\nnext\r\nline', "p\\q", " lead", "gen_open", "m", "r", 0, 2, "NA"), ("d", "é “q”", None, "none", "gen_open", "m", "r", 2, 2, "nan")]


def test_csv_round_trip(spark, tmp_path):
    at = str(tmp_path / "g")
    df = spark.createDataFrame(ROWS, I.GENERATION)
    O.append(df, at, "csv")
    back = I.read_csv(spark, at, I.GENERATION)
    assert sorted(back.collect(), key=str) == sorted(I.nulls(df).collect(), key=str)
    assert back.where("generated_relation is not null").count() == 0 and back.where("relation = 'none'").count() == 1
    text = I.read_csv_text(spark, at, I.GENERATION.names)
    assert text.where("prompt_2_shot = ''").count() == 1 and text.schema["model_shot"].dataType.simpleString() == "string"
    O.append(df, at, "csv")
    assert I.read_csv(spark, at, I.GENERATION, ["relation"]).count() == 4
    with pytest.raises(ValueError, match="format"):
        O.append(df, at, "xml")


def test_write_once(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame(ROWS, I.GENERATION)
    O.write_table(df, at, by=["model_shot"])
    with pytest.raises(Exception, match="(?i)exists"):
        O.write_table(df, at)
    O.write_table(df.limit(1), at, overwrite=True)
    assert spark.read.parquet(at).count() == 1


def test_discovery(spark, tmp_path):
    for name in ("b", "a", "none"):
        (tmp_path / name).mkdir()
    for name in ("a", "b"):
        (tmp_path / name / "generations.csv").write_text("x\n1\n")
    assert I.folders(spark, str(tmp_path)) == ["a", "b"]
    (tmp_path / "a" / "generations_shard_1.csv").write_text("x\n1\n")
    (tmp_path / "a" / "generations_shard_0.csv").write_text("x\n2\n")
    assert [p.rsplit("/", 1)[1] for p in I.shards(spark, str(tmp_path / "a"))] == ["generations_shard_0.csv", "generations_shard_1.csv"]
    (tmp_path / "a" / "generations_merged.csv").write_text("x\n1\n")
    assert [p.rsplit("/", 1)[1] for p in I.shards(spark, str(tmp_path / "a"))] == ["generations_merged.csv"]
    d = I.with_folder(spark.read.csv(str(tmp_path / "*" / "generations.csv"), header=True))
    assert sorted(r[0] for r in d.select("eval_dataset_name").collect()) == ["a", "b"]
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfk,v\na,1.23456\nb,--\nc,\n")
    r = I.read_records(spark, str(tmp_path / "bom.csv"))
    assert {x.k: x.v for x in r.select("k", I.number(F.col("v")).alias("v")).collect()} == {"a": 1.2346, "b": None, "c": None}


def test_reports(spark, tmp_path):
    from quern.config import DATASETS

    m = grid(spark).where("model_shot = 0").select(F.col("model_id").alias("model"), F.col("tuned_dataset_name").alias("regime"), F.lit("0s").alias("shot"), F.concat_ws(" ", "model_id", "tuned_dataset_name").alias("config"), *[F.lit(0.5).alias(d) for d in DATASETS[:-1]], F.lit(None).cast("double").alias(DATASETS[-1]), *[F.lit(0.1).alias(c) for c in ("general_avg", "literary_avg", "overall_avg")])
    O.write_latex(m, str(tmp_path / "t.tex"))
    text = (tmp_path / "t.tex").read_text()
    assert r"\textbf{0.500}" in text and "--" in text and text.count(r"\midrule") == 4
    O.write_page(spark.createDataFrame([('[{"a": 1}]',)], "rows string"), "<p>__DATA__</p>", str(tmp_path / "p.html"))
    assert (tmp_path / "p.html").read_text() == '<p>{"rows": [{"a": 1}]}</p>'
    with pytest.raises(ValueError, match="__DATA__"):
        O.write_page(spark.createDataFrame([("1",)], "rows string"), "<p></p>", str(tmp_path / "p.html"))


def test_source_splits(spark, tmp_path):
    spark.createDataFrame([("tacred", "validation", 1), ("tacred", "train", 2), ("gids", "validation", 3)], "dataset string, split string, k int").write.parquet(str(tmp_path / "source_example.parquet"))
    assert [r.k for r in I.read_split(spark, str(tmp_path), I.Source("tacred", "general"), "eval").collect()] == [1]
    with pytest.raises(ValueError, match="split"):
        I.read_split(spark, str(tmp_path), I.Source("tacred", "general"), "dev")


def test_stream(spark, tmp_path):
    schema = "eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, prompt_shot int, gen_type string, prompt_0_shot string, relation string, generated_relation string, written_at timestamp_ntz"
    row = ("d", "m", "r", 0, 0, "g", "p", "a", "a")
    df = spark.sql("select timestamp_ntz'2025-01-01 10:00:00' as t").collect()[0].t
    df = spark.createDataFrame([(*row, df)] * 3 + [(*row[:8], "b", df)], schema)
    at = str(tmp_path)
    df.write.parquet(at + "/in")
    for _ in range(2):
        ingest.append_new(ingest.stream(spark, at + "/in", df.schema), at + "/out", at + "/ck").awaitTermination()
    assert spark.read.parquet(at + "/out").count() == 2


def test_stream_keeps_late_rows(spark, tmp_path):
    schema = "eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, prompt_shot int, gen_type string, prompt_0_shot string, relation string, generated_relation string, written_at timestamp_ntz"
    at, days = str(tmp_path), [26, 6, 5, 20, 1, 6, 26]
    for i, day in enumerate(days):  # a late row first, then times in no order; each file but the first repeats a row of the one before
        rows = [("d", "m", "r", 0, 0, "g", None if k == 1 else f"p{k}", "a", "a", datetime(2025, 1, x)) for k, x in ((i, day), (max(i - 1, 0), days[max(i - 1, 0)]))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at + "/in")
    given = spark.read.parquet(at + "/in")
    for _ in range(2):
        ingest.append_new(ingest.stream(spark, at + "/in", given.schema, per_trigger=1), at + "/out", at + "/ck").awaitTermination()
    want = sorted((r.prompt_0_shot or "", r.written_at) for r in given.distinct().collect())
    got = spark.read.parquet(at + "/out").withColumn("written_at", F.col("written_at").cast("timestamp_ntz"))
    assert len(want) == 7 and sorted((r.prompt_0_shot or "", r.written_at) for r in got.collect()) == want
    ingest.append_new(ingest.stream(spark, at + "/in", given.schema), at + "/out", at + "/again").awaitTermination()  # all of it once more
    assert spark.read.parquet(at + "/out").count() == 7
    (tmp_path / "sink" / "_spark_metadata").mkdir(parents=True)
    with pytest.raises(ValueError, match="file sink"):
        ingest.append_new(ingest.stream(spark, at + "/in", given.schema), at + "/sink", at + "/other")


def test_marker_of_completion(spark, tmp_path):
    from quern.sources import writers as O

    at = str(tmp_path / "run")
    spark.range(3).write.parquet(at)
    assert not O.is_done(spark, at)
    O.mark_done(spark, at)
    O.mark_done(spark, at + "/")
    assert O.is_done(spark, at) and spark.read.parquet(at).count() == 3  # readers pass the marker over


def test_table_is_replaced_in_place(spark, tmp_path):
    """The table may be read by what replaces it; only the first one replaced is kept."""
    from quern.sources import writers as O

    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    for k in (1, 2):
        O.replace_table(spark.read.parquet(at).selectExpr("id + 10 as id"), at)
        assert sorted(r.id for r in spark.read.parquet(at).collect()) == [10 * k, 10 * k + 1, 10 * k + 2]
    assert sorted(r.id for r in spark.read.parquet(at + ".bak").collect()) == [0, 1, 2]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t", "t.bak"]


def test_page_and_shards_by_the_session(spark, tmp_path):
    from quern.sources import readers as I
    from quern.sources import writers as O

    at = str(tmp_path / "page.html")
    payload = spark.createDataFrame([('[1, "é"]',)], "matrix string")
    O.write_page(payload, "<p>__DATA__</p>", at, spark)
    assert O.read_text(spark, at) == '<p>{"matrix": [1, "é"]}</p>'
    with pytest.raises(ValueError, match="__DATA__"):
        O.write_page(payload, "<p></p>", at, spark)
    for n in ("generations_shard_001.csv", "generations_shard_000.csv", "other.csv"):
        (tmp_path / n).write_text("a\n1\n")
    assert [p.rsplit("/", 1)[1] for p in I.shards(spark, str(tmp_path))] == ["generations_shard_000.csv", "generations_shard_001.csv"]
    (tmp_path / "generations_merged.csv").write_text("a\n1\n")
    assert [p.rsplit("/", 1)[1] for p in I.shards(spark, str(tmp_path))] == ["generations_merged.csv"]
