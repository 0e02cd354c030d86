import numpy as np
import pytest

from quern.llm import lookalikes as K

SAME = [
    ("file office", "ﬁle oﬃce"), ("Full Width 12!", "Ｆｕｌｌ　Ｗｉｄｔｈ　１２！"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("zero​width", "zerowidth"), ("soft­hyphen", "softhyphen"), ("paypal scope", "раураl ѕсоре"),
    ("Νobody knows", "Nobody knows"), ("новый дом", "нoвый дoм"), ("ёж", "ëж"), ("line\r\nend", "line\nend"), ("Kelvin", "Kelvin"), ("﻿start", "start"), ("Tһylm", "Thylm"), ("Ωμέγα", "Ωµέγα"),
]
DIFFERENT = [("Case", "case"), ("cafe", "café"), ("room 12", "room 13"), ("a b", "a  b"), ("end.", "end!"), ("x²", "x2"), ("½", "1⁄2 "), ("hand", "hands"), ("новый", "новыи"), ("l1", "ll"), ("a\tb", "a b"), ("O", "0")]


LOOK = K.Look(K.BASE, K.SAME_SCRIPT)


def reader():
    return K.Reader(LOOK, {})


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    r = reader()
    assert K.form(a, r) == K.form(b, r)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    r = reader()
    assert K.form(a, r) != K.form(b, r)


def test_reading_is_of_one_script():
    r = reader()
    assert K.form("рrоduсt", r) == "product" and K.form("пpивeт", r) == "привет"
    assert K.form(K.form("Τһe fаir", r), r) == K.form("Τһe fаir", r) == "The fair"


def test_viterbi_against_all_paths():
    import itertools
    import random

    n = len(LOOK.letters) + 1
    rng = np.random.default_rng(1)
    r = K.Reader(LOOK, dict(enumerate(rng.integers(0, 50, n * n).tolist())))
    pick = random.Random(2)
    for _ in range(60):
        token = "".join(pick.choice(LOOK.letters + ["b", "ж", "ω", "́"]) for _ in range(pick.randint(1, 5)))
        groups = [LOOK.groups[LOOK.class_of[c]] if c in LOOK.class_of else c for c in token]

        def cost(path):
            changes, score, last, s = 0, 0.0, "", ""
            for c in path:
                own = K.script(c) if c.isalpha() else ""
                changes += bool(own and s and own != s)
                score -= r.score(LOOK.index.get(last, 0), LOOK.index.get(c, 0))
                last, s = c, own or s
            return changes, round(score, 9)

        assert cost(r.read(token)) == min(cost(p) for p in itertools.product(*groups))


def test_confusables_of_unicode(spark):
    """Letters beyond the base table, by the library's data; what differs within a script still does."""
    at = K.look(spark)
    r = K.Reader(at, {})
    same = [("Tea", "Ꭲea"), ("cat", "ᴄat"), ("zoo", "ᴢoo"), ("good", "ցood"), ("yes", "γes"), ("bad", "Ьad"), ("Rice", "Ꭱice"), ("LISU", "ꓡꓲꓢꓴ"), ("Straße", "Straβe")]
    for a, b in [*SAME, *same]:
        assert K.form(a, r) == K.form(b, r), (a, b)
    for a, b in [*DIFFERENT, ("ill", "iIl"), ("ünder", "under"), ("вид", "виц"), ("σοφία", "οοφία")]:
        assert K.form(a, r) != K.form(b, r), (a, b)
    assert all(len({K.script(c) for c in g}) == len(g) for g in at.groups)


def test_hot_form(spark, monkeypatch):
    """A form that holds a third of all rows, in several spellings of many copies, is split; pairs and classes are those of brute force."""
    from quern.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    texts = [["scope", "ѕcope", "sсope"][k % 3] for k in range(30)] + [f"text {k}" for k in range(60)] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = sorted((a, b) for a in range(30) for b in range(a + 1, 30) if texts[a] != texts[b])
    assert sorted(tuple(x) for x in K.same_look(df).collect()) == want
    got = {x.doc_id: (x.class_id, x.n_links) for x in K.look_classes(df).collect()}
    assert len(got) == len(texts) and {got[k][1] for k in range(30)} == {20} and len({got[k][0] for k in range(30)}) == 1
    assert {got[k][1] for k in range(30, 93)} == {0} and [got[k][0] for k in (90, 91, 92)] == [None] * 3
    assert K.look_classes(df.limit(0)).count() == 0


def test_rows(spark):
    texts = ["pay now", "рay now", "pay now", "ｐａｙ now", None, "", "  ", "​", "Pay now", "х" * 200_000, "x" * 200_000]
    df = spark.createDataFrame([(k, t, "f", b"o") for k, t in enumerate(texts)], "doc_id long, text string, form string, own binary").repartition(3)
    got = sorted(tuple(r) for r in K.same_look(df).collect())
    assert got == [(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (9, 10)]
    forms = {r.doc_id: r.form for r in K.forms(df).collect()}
    assert forms[4] is None and forms[5] == "" and forms[0] == forms[1] == forms[3]
    assert K.same_look(df.limit(0)).count() == 0 and K.forms(df.limit(0)).count() == 0
