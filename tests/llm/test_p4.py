import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces as P


def check(text, limit, overlap):
    s = P.spans(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b in s) == text
    assert all(0 < e - b <= limit for b, _, e in s)
    for k, (b, own, e) in enumerate(s):
        assert (b == own) if k == 0 else (s[k - 1][0] <= b <= own and own - b <= overlap)
    return s


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n\r!?́‍😀。 "), max_size=400), st.integers(12, 60), st.integers(0, 5))
def test_any_text_comes_back(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    r = random.Random(1)
    text = "\n\n".join(" ".join("word" + str(r.randint(0, 99)) for _ in range(30)) + "." for _ in range(40))
    s = check(text, P.LIMIT, P.OVERLAP)
    assert len(s) > 4
    assert sum(text[own - 2 : own] == "\n\n" for _, own, _ in s[1:]) >= len(s) // 2
    assert all(120 <= own - b <= 160 for b, own, _ in s[1:])
    assert all(text[own - 1].isspace() and (b == own or text[b - 1].isspace()) for b, own, _ in s[1:])
    long = "x" * 5000
    assert all(own - b == 160 for b, own, _ in check(long, P.LIMIT, P.OVERLAP)[1:])
    assert P.spans("", 10, 2) == [] and P.spans("a" * 10, 10, 2) == [(0, 0, 10)]
    check("é" * 4000, P.LIMIT, P.OVERLAP)
    assert all(("é" * 4000)[own] == "e" for _, own, _ in P.spans("é" * 4000))
    with pytest.raises(ValueError, match="overlap"):
        P.spans("a" * 99, 10, 6)


def test_rows(spark):
    rows = [(1, "text", "a b " * 400, "p"), (2, "text", "a b " * 401, "p"), (2, "text", "a b " * 401, "p"), (3, "text", None, "p"), (4, "text", "", "p"), (None, None, "\U0001f600" * 1601, "p"), (5, "text", "z" * 300_000, "p")]
    df = spark.createDataFrame(rows, "id long, field string, value string, piece string")
    got = P.cut_values(df)
    assert sorted(((r.id, r.n_pieces) for r in got.where("piece = 0").collect()), key=str) == sorted([(2, 2), (2, 2), (None, 2), (5, 256)], key=str)
    text = "".join(r.piece_text[r.own - r.begin :] for r in got.where("id = 5").orderBy("piece").collect())
    assert text == "z" * 300_000
    assert P.cut_values(df.limit(0)).count() == 0
