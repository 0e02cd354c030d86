import os

import pytest

from quern.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.vocabulary_path()), reason="no vocabulary file")
TEXTS = ["", None, "Hello world", "  lead", "a" * 3000, "x\x1cy\x85z　 q", "<|endoftext|>", "don't we'll I'M", "¹½Ⅷ٣ abc123", "日本語のテキスト", "😀👩‍🚀", "𐐷𐐷 1", " \n\n  a  ", "aaaa aaaaa aa", "é é", "�", "naïve—‘quotes’…"]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(E.vocabulary_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_equals_the_library(spark):
    ref = reference()
    rows = [(k, t, "x", [1]) for k, t in enumerate(TEXTS * 2)]
    got = E.encode_table(spark.createDataFrame(rows, "doc_id long, text string, ids string, extra array<int>")).collect()
    assert {r.doc_id: r.ids for r in got} == {k: ref(t) for k, t, *_ in rows}
    assert E.encode_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.ids for r in E.encode_table(spark.createDataFrame([(None, "a")], "doc_id long, text string")).collect()] == [ref("a")]


def test_long_words_and_round_trip():
    import random

    r = random.Random(3)
    e, ref = E.encoder(E.vocabulary_path()), reference()
    long = "".join(r.choice("abcdefghij") for _ in range(20_000))
    assert e.encode([long])[0].tolist() == ref(long)
    words = ["".join(r.choice("aeioustr n'0éя") for _ in range(r.randint(1, 30))) for _ in range(500)]
    ids, lens = e.encode(words)
    assert lens.tolist() == e.count(words).tolist()
    assert ids.tolist() == [i for w in words for i in ref(w)]


def test_forgetting_words_changes_nothing(monkeypatch):
    e = E.Encoder(E.vocabulary_path())
    a = e.encode(TEXTS)[0].tolist()
    monkeypatch.setattr(E, "KEPT_WORDS", 3)
    assert [x for t in TEXTS for x in e.encode([t])[0].tolist()] == a
