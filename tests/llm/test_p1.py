import numpy as np
import pytest

from quern.llm import labels as L

ENTRIES = [
    (1, "rebel", "registrar of the parish", "parish registrar"), (2, "rebel", "steward of the manuscript", None), (3, "rebel", "keeper of the fleet", "fleet keeper"), (4, "rebel", "keeper of the vault", None),
    (10, "tacred", "fig:observer_of_colony", "colony observer"), (11, "tacred", "no_relation", None), (12, "tacred", "grp:observer_of_academy", None),
    (20, "bio", "Other", None), (21, "bio", "heirOfSyndicate", None), (22, "bio", "physicianOfTheatre", "theatre physician"),
    (30, "nyt", "/kin/dialect/instructor", "dialect instructor"), (31, "nyt", "/trade/dialect/instructor", None),
]
CASES = [
    ("rebel", "Registrar of the Parish", 1), ("rebel", "parish's registrar", 1), ("rebel", "regsitrar of teh parish", 1), ("rebel", "RegistrarOfTheParish", 1), ("rebel", "registrar (parish)", 1), ("rebel", "is the registrar of this parish", 1),
    ("rebel", "parishs registrars", 1), ("rebel", "registrar of the par", 1), ("rebel", "Answer: **registrar of the parish**", 1), ("rebel", '{"relation": "parish::registrar"}', 1), ("rebel", "registrar of the parish\nExplanation: The keeper slept.", 1),
    ("rebel", "stewardmanuscript, stewardmanuscript", 2), ("rebel", "stewaradMnuscript", 2), ("rebel", "<think>\nkeeper of the fleet?\n</think>\n\nsteward of the manuscript", 2), ("rebel", "keeper of the fl", 3), ("rebel", "keeper of the", -1),
    ("rebel", "observer of the colony", -1), ("rebel", "Frère de", -1), ("rebel", "I cannot determine the relation.", -1), ("rebel", "<think>\nThe passage mentions the keeper of the fleet", -1), ("rebel", "keeper of the dockyard", -1), ("rebel", "competes_behind_cargo", -1),
    ("tacred", "observer (colony)", 10), ("tacred", "academy observer", 12), ("tacred", "No relation.", 11), ("tacred", "no_relation / no_relation", 11), ("tacred", "the relation is unclear", -1), ("tacred", "fig:observer_of_col", 10),
    ("bio", "other relation (certain)", 20), ("bio", "OTHER\r\n", 20), ("bio", "Answer: the relation that hol", -1), ("bio", "heirOfSyn", 21), ("bio", "each other", -1), ("bio", "theatre physicians", 22), ("bio", "syndicate heir, syndicate heir", 21),
    ("nyt", "/kin/dialect/intsructor", 30), ("nyt", "/TRADE/DIALECT/INSTRUCTOR", 31), ("nyt", "/trade/dialect/inst", 31),
]


@pytest.fixture(scope="module")
def vocabulary():
    return L.Vocabulary(ENTRIES)


@pytest.mark.parametrize(("dataset", "value", "want"), CASES)
def test_values(vocabulary, dataset, value, want):
    vocabulary.repair(set(L.tokens_of(L.clean(value))))
    got = vocabulary.entry(dataset, value)
    assert got == want or dataset == "nyt" and value.startswith("/trade/dialect/inst") and got in (30, 31, -1)


def test_distance_is_that_of_all_prefixes():
    def slow(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    tokens, words = ["steard", "tsewadr", "x", "manuscriptof"], ["steward", "a", "manuscript", "of"]
    pairs = [(a, b) for a in tokens for b in words]
    got = L.osa([a for a, _ in pairs], [b for _, b in pairs])
    for p, (a, b) in enumerate(pairs):
        for i in range(len(a) + 1):
            assert got[i, p] == slow(b, a[:i])


def test_rows(spark):
    schema = "id long, field string, dataset string, value string, label_id string"
    rows = [
        (1, "f", "rebel", None, "x"), (2, "f", "rebel", "  ", "x"), (3, "f", "rebel", "NaN", "x"), (4, "f", "rebel", '"none"', "x"), (5, "f", "rebel", "registrar of the parish", "x"), (6, "f", "rebel", "Parish registrar", "x"), (6, "f", "rebel", "Parish registrar", "x"),
        (7, "f", None, "parish registrar", "x"), (8, "f", "unknown", "parish registrar", "x"), (9, "f", "rebel", "registrar " * 20_000, "x"), (10, "f", "rebel", "<think></think>", "x"), (11, "f", "rebel", "Answer:", "x"), (12, "f", "rebel", "​", "x"), (None, "f", "bio", "other", None),
    ]
    entries = spark.createDataFrame([(*e, "extra") for e in ENTRIES], "label_id long, dataset string, label string, display_name string, value string")
    got = sorted(((r.id, r.label_id) for r in L.map_values(spark.createDataFrame(rows, schema), entries).collect()), key=str)
    assert got == sorted([(6, 1), (6, 1), (7, -1), (8, -1), (9, -1), (None, 20)], key=str)
    assert L.map_values(spark.createDataFrame([], schema), entries).count() == 0
    assert {r.label_id for r in L.map_values(spark.createDataFrame(rows, schema), entries.limit(0)).collect()} == {-1}


def test_repetition_without_separators_and_lines(vocabulary):
    for dataset, value, want in [("rebel", "parishregistrar" * 4, 1), ("bio", "Other" * 12, 20), ("bio", "heirOfSyndicate" * 5, 21), ("bio", "Answer:\nOther", 20), ("bio", "Answer:\n\nnot this one", -1), ("rebel", "x" * 5000, -1), ("rebel", "keeper of the " + "vault" * 30, 4)]:
        vocabulary.repair(set(L.tokens_of(L.clean(value))))
        assert vocabulary.entry(dataset, value) == want, value


def test_one_place_is_one_word(vocabulary):
    """A token like two words of an entry stands for one of them only; further words in the window lower the score."""
    v = L.Vocabulary([(1, "d", "patron of the charter", None), (2, "d", "steward of the manuscript", None)])
    for value, want in [("old chess partners", -1), ("steward of the old manuscript", 2), ("steward who once kept that manuscript", -1), ("steward", -1), ("manuscript", -1)]:
        v.repair(set(L.tokens_of(value)))
        assert v.entry("d", value) == want, value


def test_index_loses_no_candidate():
    r = np.random.default_rng(3)
    letters = list("abcdeiorst")
    forms = sorted({"".join(r.choice(letters, int(r.integers(2, 13)))) for _ in range(300)})
    index = L.Segments(forms)
    for f in (int(x) for x in r.integers(0, len(forms), 400)):
        t = list(forms[f])
        for _ in range(int(r.integers(0, L.slips(forms[f]) + 1))):
            i, kind = int(r.integers(0, len(t))), int(r.integers(4))
            t[i : i + 1] = [] if kind == 0 and len(t) > 1 else [t[i], str(r.choice(letters))] if kind == 1 else [str(r.choice(letters))]
            if kind == 3 and i + 1 < len(t):
                t[i], t[i + 1] = t[i + 1], t[i]
        token = "".join(t)
        got = set(index.candidates(token).tolist())
        d = L.osa([token] * len(forms), forms)[len(token)]
        assert {k for k in range(len(forms)) if d[k] <= min(L.slips(forms[k]), max(0, len(forms[k]) - 1))} <= got


def test_as_many_entries_as_allowed():
    """A list of MAX_ENTRIES entries: the tables of a block stay bounded and values are still found."""
    import resource

    r = np.random.default_rng(5)
    parts = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()
    words = sorted({"".join(r.choice(parts, int(r.integers(3, 6)))) for _ in range(12_000)})
    pairs = r.integers(0, len(words), (L.MAX_ENTRIES, 2))
    v = L.Vocabulary([(k, "d", f"{words[a]} of {words[b]}", None) for k, (a, b) in enumerate(pairs)])
    for k in (7, 70_000):
        a, b = (words[x] for x in pairs[k])
        for value in (f"{b} {a}", f"{a[:2]}{a[3:]} of the {b}"):
            v.repair(set(L.tokens_of(value)))
            assert {words[x] for x in pairs[v.entry("d", value)]} == {a, b}
    v.repair({"".join(r.choice(parts, 5)) for _ in range(200)})
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3_000_000


def test_long_values_are_linear(vocabulary):
    import time

    for value, want in [("registrar " * 50_000, -1), ("registrra of the parihs " * 20_000, 1), ("registrar of parisg, steward " * 20_000, 1), ("keeper and fleet far away " * 10_000 + "keeper of fleeet", 3)]:
        began = time.perf_counter()
        vocabulary.repair(set(L.tokens_of(L.clean(value))))
        assert vocabulary.entry("rebel", value) == want, value[:40]
        assert time.perf_counter() - began < 20
