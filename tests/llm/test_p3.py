import numpy as np
import pytest

from quern.llm import defects as D

ENTRIES = [(1, "rebel", "registrar of the parish", "parish registrar"), (2, "rebel", "steward of the manuscript", None), (3, "nyt", "/kin/dialect/instructor", "dialect instructor"), (4, "bio", "Other", None), (5, "bio", "physicianOfTheatre", None)]
NAMES = ["Morkjaem", "Vossy", "Kael Brun", "Lindhil", "Tross Mills", "Yarn Choir", "Quelm", "Dorset Ferry"]
ADJ, NOUN, VERB = "old gray quiet broken tame silver".split(), "lamp bridge ledger wagon garden river oven".split(), "sold painted carried lost mended counted".split()


def prompt(r):
    a, b = r.choice(NAMES, 2, replace=False)
    w = lambda xs: xs[int(r.integers(len(xs)))]
    s = f"{a} {w(VERB)} the {w(ADJ)} {w(NOUN)} and a {w(ADJ)} {w(NOUN)} while {b} {w(VERB)} that {w(ADJ)} {w(NOUN)} near the {w(NOUN)}."
    return f'Name the tie that the passage states.\nSentence: "{s}"\nFirst: {a}\nSecond: {b}\nWhat is the relation between {a} and {b}?\nAnswer:'


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(0)
    return D.train([prompt(r) for _ in range(300)], ENTRIES, ["le chat dort dans la maison et les enfants jouent pour toujours", "der Hund und die Katze sind nicht neben dem Haus und das ist gut"])


def test_held_out_accuracy(model):
    r = np.random.default_rng(9)
    pairs = D.synthetic([prompt(r) for _ in range(100)], [e[2] for e in ENTRIES], [], model.tongue, r)
    got = D.predict(model, D.Extractor(ENTRIES, model.tongue), [p for p, _, _ in pairs], [x for _, x, _ in pairs], {})
    for d in D.DEFECTS:
        hit = sum(g == d and w == d for g, (_, _, w) in zip(got, pairs))
        assert hit / max(1, sum(w == d for _, _, w in pairs)) > 0.93, d
        assert hit / max(1, sum(g == d for g in got)) > 0.93, d


def test_cases(model):
    p = prompt(np.random.default_rng(4))
    q = D.Prompt(p)
    cases = {
        None: ["registrar of the parish", "none", "N/A", "Answer: parish registrar", "registrar of the parish, registrar of the parish"], "empty": [None, "", " \n", "​", "Answer:", "<think>\n\n</think>\n\n", "**", '""'],
        "truncated": ["registrar of the par", f"The relation between {q.mentions[0]} and {q.mentions[1]} is", "<think>\nThe passage mentions a thing and the ot"],
        "refusal": ["I'm sorry, but I cannot determine the relation.", "As an AI language model, I am unable to answer this."], "copy": [p, q.sentence, q.question], "language": ["verheiratet mit", "родился в", "为其工作", "La relation est : né à"],
    }
    for want, xs in cases.items():
        assert D.predict(model, D.Extractor(ENTRIES, model.tongue), [p] * len(xs), xs, {}) == [want] * len(xs)


def test_threshold_and_rows():
    assert 0.1 < D.threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 1, 0.0])) < 0.3
    rows = D.Rows([(np.array([0, 2]), np.array([1.0, 2.0])), (np.array([1]), np.array([3.0]))])
    assert rows.dot(np.array([1.0, 10.0, 100.0])).tolist() == [201.0, 30.0]
    assert rows.take(np.array([1])).dot(np.array([1.0, 10.0, 100.0])).tolist() == [30.0]


def test_tables(spark, model):
    r = np.random.default_rng(5)
    p = prompt(r)
    rows = [(1, p, "", "x"), (2, None, "I cannot determine the relation", "x"), (3, "no layout", "registrar of the parish", "x"), (4, p, p * 400, "x"), (4, p, None, "x"), (None, "", None, None)]
    df = spark.createDataFrame(rows, "gen_id long, prompt_0_shot string, generated_relation string, defect string")
    got = sorted(((x.gen_id, x.defect) for x in D.judge(df, model).collect()), key=str)
    assert [g for g in got if g[0] != 4 or g[1] == "empty"] == sorted([(1, "empty"), (2, "refusal"), (4, "empty"), (None, "empty")], key=str)
    assert D.judge(df.limit(0), model).count() == 0
    assert D.judge(df.withColumnRenamed("defect", "x"), model, "x").columns == ["gen_id", "x", "defect"]
    entries = spark.createDataFrame(ENTRIES, "label_id long, dataset string, label string, display_name string")
    docs = spark.createDataFrame([(1, None, "fr"), (2, "x", None)], "doc_id long, text string, lang string")
    assert (D.fit_tables(df.limit(0), entries, docs).weights == 0).all()
    assert D.fit_tables(df, entries, docs.limit(0)).weights.shape[0] == len(D.DEFECTS)


def test_fit_sees_whole_texts_and_all_entries(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(D, "train", lambda prompts, entries, texts: seen.append((prompts, entries, texts)))
    g = spark.createDataFrame([(1, "p")], "gen_id long, prompt_0_shot string")
    entries = spark.createDataFrame(ENTRIES, "label_id long, dataset string, label string, display_name string")
    text = "le chat dort " * 100 + "fin"
    D.fit_tables(g, entries, spark.createDataFrame([(1, text, "fr")], "doc_id long, text string, lang string"))
    assert seen[0][2] == [text] and len(seen[0][1]) == len(ENTRIES)
    out = {x for k in range(40) for x in D.snippets(["".join(chr(0x4E00 + i) for i in range(300))], {}, np.random.default_rng(k))}
    assert max(ord(x[0]) - 0x4E00 for x in out) > 150
    monkeypatch.setattr(D, "MAX_ENTRIES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        D.fit_tables(g, entries, spark.createDataFrame([(1, text, "fr")], "doc_id long, text string, lang string"))


def test_sample_is_of_distinct_values(spark):
    """Null, blank and repeated values leave the sample as large as documented."""
    rows = [(None,), ("  ",), ("",)] * 50 + [("hot",)] * 300 + [(f"p{k}",) for k in range(500)]
    df = spark.createDataFrame(rows, "v string")
    got = D.first_by_hash(df, "v", 20)
    assert len(got) == len(set(got)) == 20 and got == D.first_by_hash(df.repartition(7), "v", 20)
    assert len(D.first_by_hash(df, "v", 1000)) == 501


def test_lists_hold_no_answer_of_the_tables():
    """No phrase of two words or more of the lists that training texts are made of is an answer of the table."""
    pd = pytest.importorskip("pandas")
    try:
        answers = pd.read_parquet("/root/testdata/sf0.01/generation.parquet", columns=["generated_relation"])["generated_relation"].dropna()
    except FileNotFoundError:
        pytest.skip("no tables")
    bare = lambda x: " ".join(D.TOKEN.findall(x.lower()))
    answers = {bare(x) for x in answers}
    lists = [D.DENIALS, D.LEADS, D.CLAUSES, D.THOUGHTS, D.WITHOUT, D.TAILS, D.OBJECTS, D.OPENERS, D.VERBS, D.NOUNS]
    assert not {x for xs in lists for x in map(bare, xs) if " " in x and x in answers}


def test_words_of_languages(model):
    t = model.tongue
    assert all(t[w] > 0.3 for w in "married partners the with twin".split()) and all(t[w] < 0 for w in "nicht dla della für que".split())
    assert D.inflects("neighbours", {"neighbor": 1.0, "neighbour": 0.9}) and D.inflects("gambles", {"gamble": 1.0}) and not D.inflects("mieszka", t)
