import pytest
from pyspark.sql import functions as F

from quern.config import MixSpec
from quern.operators import merging as G
from quern.operators import mixing as X
from quern.operators import tables as R
from quern.operators import tokens as N


def ids(df, c="example_id"):
    return sorted((r[0] for r in df.select(c).collect()), key=str)


def source(spark, n=900):
    rows = [(k, ["tacred", "gids", "pg_fiction"][0 if k % 10 < 6 else 1 if k % 10 < 8 else 2], ["train", "validation", "test"][k % 3], f" q{k} ", None if k % 7 == 0 else f"two{k}", "five", f"r{k % 4}") for k in range(n)]
    return spark.createDataFrame(rows, "example_id long, dataset string, split string, prompt_0_shot string, prompt_2_shot string, prompt_5_shot string, relation string")


@pytest.mark.parametrize("n", [0, 1, 37, 10_000])
def test_first_n_is_exact_and_stable(spark, n):
    df = source(spark)
    got = X.first_n(df, ["dataset"], F.lit(n), 42)
    import hashlib

    want = []
    for d in ("tacred", "gids", "pg_fiction"):
        own = [k for k in range(900) if ["tacred", "gids", "pg_fiction"][0 if k % 10 < 6 else 1 if k % 10 < 8 else 2] == d]
        want += sorted(own, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())[:n]
    assert ids(got) == sorted(want, key=str)
    assert ids(X.first_n(df.repartition(7), ["dataset"], F.lit(n), 42)) == ids(got)


def test_first_n_of_odd_groups(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "a", "x") for k in range(20)], "example_id long, dataset string, h string")
    got = X.cap(df, 3, 1)
    assert got.groupBy("dataset").count().where("count <> 3").count() == 0 and got.count() == 6
    assert X.cap(df, None, 1).count() == 20 and X.cap(df.limit(0), 3, 1).count() == 0


def test_mixtures(spark):
    df = source(spark)
    m = X.mixture(df, MixSpec(["tacred", "gids"], ["pg_fiction"], "domain"), 0)
    by = {(r["split"], r["lit"]): r["count"] for r in m.withColumn("lit", F.col("dataset") == "pg_fiction").groupBy("split", "lit").count().collect()}
    assert by == {(s, x): 60 for s in ("train_0", "eval_0", "test_0") for x in (True, False)}
    assert m.where("not prompt like 'q%' or not prompt like '%Answer: '").count() == 0
    d = X.mixture(df, MixSpec(["tacred", "gids"], ["pg_fiction"], "dataset", cap=50), 2)
    assert {r["count"] for r in d.groupBy("dataset", "split").count().collect()} == {50}
    assert X.mixture(df, MixSpec(["tacred"], [], cap=10), 5).count() == 30
    with pytest.raises(ValueError, match="unknown sources"):
        X.mixture(df, MixSpec(["rebel-dataset"], []), 0)
    with pytest.raises(ValueError, match="missing columns"):
        X.reshape(df.drop("relation"), "prompt_0_shot")
    assert X.merge_splits([m, X.mixture(df, MixSpec(["tacred"], []), 2)]).count() > m.count()
    with pytest.raises(ValueError, match="train_0"):
        X.merge_splits([m, m])


def test_sample_and_shuffle(spark):
    df = source(spark).select("example_id")
    a = [r[0] for r in X.shuffle(df, 7).collect()]
    assert a == [r[0] for r in X.shuffle(df.repartition(5), 7).collect()] and sorted(a) == list(range(900)) and a != sorted(a)
    assert ids(X.sample(df, 20, 7, "example_id")) == sorted(a[:20], key=str)
    assert X.shard(df, 4, "example_id").groupBy("shard").count().count() == 4
    assert X.batches(df, 32, "example_id").agg(F.max("batch")).first()[0] == 28


def test_places_of_all_rows(spark, tmp_path):
    import hashlib

    from quern.plans.registry import QUERIES

    source(spark).repartition(5).write.parquet(str(tmp_path / "source_example.parquet"))
    want = [(k, i + 1) for i, k in enumerate(sorted(range(900), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()))]
    assert [(r.example_id, r.place) for r in QUERIES["set_o11_shuffle"](spark, str(tmp_path)).collect()] == want
    odd = spark.createDataFrame([(None,), (3,), (3,), (1,)], "example_id long").repartition(3)
    got = [(r.example_id, r.place) for r in X.places(odd, 7).collect()]
    assert [p for _, p in got] == [1, 2, 3, 4] and [k for k, _ in got] == [r[0] for r in X.shuffle(odd, 7).collect()]
    assert X.places(odd.limit(0), 7).count() == 0


def test_splice_twice_is_splice_once(spark):
    c = ("m", "re_mixtune", 0)
    t = spark.createDataFrame([(1, "m", "re_mixtune", 0, "old"), (2, "m", None, 0, "keep"), (3, "n", "re_mixtune", 0, "keep")], "gen_id long, model_id string, tuned_dataset_name string, model_shot int, generated_relation string")
    new = spark.createDataFrame([("new", 9, "m", "re_mixtune", 0, 1), ("other", 8, "n", "re_mixtune", 0, 1)], "generated_relation string, gen_id long, model_id string, tuned_dataset_name string, model_shot int, extra int")
    once = G.splice(t, new, c)
    want = [(2, "keep"), (3, "keep"), (9, "new")]
    assert sorted((r.gen_id, r.generated_relation) for r in once.collect()) == want
    assert sorted((r.gen_id, r.generated_relation) for r in G.splice(once, new, c).collect()) == want


def test_merging(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    assert G.merged(G.merge_shards([a, b], ["a", "b"]), ["a", "b"], dedup=True, sort=True).collect()[0].b == "x"
    with pytest.raises(ValueError, match="columns"):
        G.merge_shards([a, b], ["a"], strict=True)
    with pytest.raises(ValueError, match="missing columns"):
        G.merge_shards([a], ["c"])
    with pytest.raises(ValueError, match="no shards"):
        G.merge_shards([], [])
    assert G.merge_shards([a, b.drop("a")], ["b"], missing=True).count() == 3
    assert G.remaining(a.unionByName(b), a, ["a"]).count() == 1
    assert G.check_single(spark.createDataFrame([("d",), (" d ",), ("e",), (None,)], "eval_dataset_name string"), "d").count() == 1


def test_windows_and_blocks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None), (4, "x y z")], "doc_id long, text string")
    w = {}
    for r in N.windows(df, N.words(F.col("text")), 4, 1, ["doc_id"]).orderBy("doc_id", "window").collect():
        w.setdefault(r.doc_id, []).append(" ".join(r.tokens))
    assert w == {1: ["a b c d", "d e f g"], 2: [""], 3: [""], 4: ["x y z"]}
    b = N.blocks(df, N.words(F.col("text")), F.lit(0), "doc_id", 4).orderBy("block").collect()
    assert [" ".join(r.tokens) for r in b] == ["a b c d", "e f g x"] and b[0].labels == b[0].tokens
    assert [r.tokens for r in N.blocks(df.where("doc_id = 4"), N.words(F.col("text")), F.lit(0), "doc_id", 4).collect()] == [["x", "y", "z"]]
    with pytest.raises(ValueError, match="stride"):
        N.windows(df, N.words(F.col("text")), 4, 4, ["doc_id"])
    m = lambda ids, p, n: spark.range(1).select(N.label_mask(F.array(*[F.lit(i) for i in ids]), F.lit(p), n).alias("y")).first().y
    assert m([1, 2, 3, 4], 2, 9) == [-100, -100, 3, 4] and m([1, 2, 3], 5, 9) == [-100] * 3 and m([1, 2, 3, 4], 1, 3) == [-100, 2, 3]


def test_sequences_reach_the_reference_length(spark, tmp_path):
    from quern.plans.registry import QUERIES

    prompt = {1: 3, 2: 64, 3: 200, 4: 1023, 5: 1024}
    rows = [(k, "w " * n, "per:age of") for k, n in prompt.items()]
    spark.createDataFrame(rows, "example_id long, prompt_0_shot string, relation string").write.parquet(str(tmp_path / "source_example.parquet"))
    got = {r.example_id: r.labels.split(" ") for r in QUERIES["set_o22_label_mask"](spark, str(tmp_path)).collect()}
    assert got == {k: (["-100"] * n + ["7", "2"])[:1024] for k, n in prompt.items()}
    rows = [(k, "d", "w " * n, "w " * n, "per:age of") for k, n in prompt.items()]
    spark.createDataFrame(rows, "gen_id long, eval_dataset_name string, prompt_0_shot string, prompt_2_shot string, relation string").write.parquet(str(tmp_path / "generation.parquet"))
    got = QUERIES["tab_r19_truncation_stats"](spark, str(tmp_path)).collect()
    assert [(r.train_max, r.pct_train_trunc, r.pct_train_label_cut) for r in got] == [(1026, 40.0, 20.0)] * 2
    assert [r.pct_train_trunc for r in QUERIES["agg_a30_max_worst_case"](spark, str(tmp_path)).collect()] == [40.0]


def test_tokenise_and_score(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "k long, t string")
    assert {r.k: r.ids for r in N.tokenise(df, "t", "k", lambda xs: [[len(w) for w in x.split()] for x in xs]).collect()} == {1: [1, 2], 2: []}
    assert {r.k: r.generated_relation for r in N.score(df, "t", "k", N.length_scorer).collect()} == {1: "short", 2: "short"}


def test_means_of_rounded_cells(spark):
    df = spark.createDataFrame([(0.2532, 0.2533, None), (None, None, None), (0.1, 0.2, 0.3)], "a double, b double, c double")
    assert [r.y for r in df.select(R.row_mean(["a", "b", "c"]).alias("y")).collect()] == [0.2533, None, 0.2]
    d = spark.createDataFrame([(0.02,), (-0.02,), (0.0,), (None,)], "x double")
    assert [r.y for r in d.select(R.direction(F.col("x")).alias("y")).collect()] == ["IMPROVED", "DEGRADED", "~same", None]


def test_splits_and_rows_beyond_a_bound_raise(spark, monkeypatch):
    """A table with more splits, or a driver's table with more rows, than the bound is an error, never cut."""
    from quern import session as O

    monkeypatch.setattr(X, "MOST_SPLITS", 5)
    many = spark.range(7).select(F.concat(F.lit("s"), "id").alias("split"))
    with pytest.raises(ValueError, match="more than 5"):
        X.merge_splits([many, many.where("split = 's0'")])
    assert len(O.gathered(spark.range(101), 101)) == 101
    with pytest.raises(ValueError, match="more than 100"):
        O.gathered(spark.range(101), 100)


def metrics(spark):
    """Metrics with rows of either regime in and off its domain."""
    rows = []
    for k, (m, r) in enumerate([("m1", "re_gentune"), ("m2", "re_gentune"), ("m1", "re_littune"), ("m3", "re_mixtune")]):
        for i, d in enumerate(["tacred", "rebel", "biographical", "pg_fiction"]):
            if not (m == "m2" and i > 1):
                rows.append((d, m, r, 2, 2, "gen_constrained", (k + 1) / 10 + i / 100))
                rows.append((d, m, r, 2, 2, "gen_open", 0.9))
    return spark.createDataFrame(rows, "eval_dataset_name string, model_id string, tuned_dataset_name string, model_shot int, prompt_shot int, gen_type string, micro_f1 double")


def test_transfer_between_domains(spark):
    d = metrics(spark)
    assert {(r.tuned_dataset_name, r.eval_dataset_name) for r in R.cross_only(d).collect()} == {("re_gentune", "biographical"), ("re_gentune", "pg_fiction"), ("re_littune", "tacred"), ("re_littune", "rebel")}
    t = {(r.model_id, r.tuned_dataset_name): r for r in R.transfer_table(d, d).collect()}
    assert set(t) == {("m1", "re_gentune"), ("m1", "re_littune")}  # m2 has no row off its domain, a mixed model no domain of its own
    g, lit = t["m1", "re_gentune"], t["m1", "re_littune"]
    assert (g.in_domain, g.cross_domain, g.in_domain_avg_f1, g.cross_domain_avg_f1, g.delta_f1) == ("General", "Literary", 0.105, 0.125, 0.02)
    assert (lit.in_domain, lit.in_domain_avg_f1, lit.cross_domain_avg_f1, lit.delta_f1) == ("Literary", 0.325, 0.305, -0.02)
    s = {r.tuned_dataset_name: r.avg_delta for r in R.transfer_summary(R.transfer_table(d, d)).collect()}
    assert s == {"re_gentune": 0.02, "re_littune": -0.02}
    both = {(r.model_id, r.tuned_dataset_name): (r.in_domain_avg_f1, r.n_in_domain, r.cross_domain_avg_f1) for r in R.in_and_cross(d).collect()}
    assert both == {("m1", "re_gentune"): (0.105, 2, 0.125), ("m2", "re_gentune"): (0.205, 2, None), ("m1", "re_littune"): (0.325, 2, 0.305)}
    assert R.transfer_table(d.limit(0), d).count() == 0 and R.in_and_cross(d.limit(0)).count() == 0


def test_remaining(spark):
    """What is done, even by many rows of a hot key, is not left to do; null keys are never done."""
    todo = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", "x"), (4, "b", "x")], "id long, d string, h string")
    done = spark.createDataFrame([("a", "x")] * 50 + [(None, "x")], "d string, h string")
    assert ids(G.remaining(todo, done, ["d", "h"]), "id") == [2, 3, 4, 4]
    assert G.remaining(todo, done.limit(0), ["d", "h"]).count() == 5


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    """More groups than may be sent to all tasks: the same rows, without a broadcast."""
    df = source(spark)
    want = [ids(X.cap(df, 7, 42)), ids(X.domain_balanced(df, ["pg_fiction"], 42, split="split"))]
    from quern import session

    monkeypatch.setattr(X, "MOST_SENT", 1)
    monkeypatch.setattr(session.sent, "__defaults__", (None, 1))
    got = X.cap(df, 7, 42)
    assert "ResolvedHint (strategy=broadcast)" not in got._jdf.queryExecution().analyzed().toString()
    assert [ids(got), ids(X.domain_balanced(df, ["pg_fiction"], 42, split="split"))] == want
