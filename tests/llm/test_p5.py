import random

from quern.llm.overlaps import apart, overlaps, p5_report  # noqa: F401

SCHEMA = "id long, split string, dataset string, text string, entity1 string, entity2 string"


def slow(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_word_distance_is_exact_up_to_the_bound():
    r = random.Random(1)
    for _ in range(400):
        a = [r.choice("abcdef") for _ in range(r.randint(0, 30))]
        b = [x for x in a if r.random() > 0.15] + [r.choice("abcdef") for _ in range(r.randint(0, 4))]
        for most in (0, 1, 3, 8, 40):
            want = slow(a, b)
            assert apart(list(a), list(b), most) == (want if want <= most else most + 1)
    assert apart(["x"] * 50_000, ["x"] * 49_999 + ["y", "z"], 10_000) == 2


def pairs(spark, rows):
    members, linked = overlaps(spark.createDataFrame(rows, SCHEMA))
    a = members.where("train").selectExpr("cls as cls_a", "id as x")
    b = members.where("not train").selectExpr("cls as cls_b", "id as y")
    return sorted(tuple(r) for r in linked.join(a, "cls_a").join(b, "cls_b").select("x", "y").collect())


def brute(rows):
    import re

    key = lambda r: tuple(re.sub(r"[\W_]+", "", e.lower()) for e in r[4:])
    ws = lambda r: re.findall(r"[^\W_]+", r[3].lower())
    ok = [r for r in rows if all(x and x.strip() for x in r[3:])]
    out = []
    for a in ok:
        for b in ok:
            if a[1] == "train" and b[1] in ("validation", "test") and key(a) == key(b):
                x, y = ws(a), ws(b)
                if slow(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                    out.append((a[0], b[0]))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 10
    rows = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.randint(1, 40))]
        for _ in range(r.randint(1, 4)):
            t = [w if r.random() > r.choice([0, 0.1, 0.2, 0.3]) else r.choice(words) for w in base]
            t = [w for w in t if r.random() > 0.04]
            rows.append((len(rows), r.choice(["train", "validation", "test"]), r.choice(["d1", "d2", None]), " ".join(t) or None, f"E {k % 7}", f"F{k % 3}"))
    rows += [(len(rows) + i, *x[1:]) for i, x in enumerate(rows[:40])]
    assert pairs(spark, rows) == brute(rows)


def test_odd_rows(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [
        (1, "train", "a", t, "Ann Lee", "Rome"), (2, "test", "b", t.upper() + "!", "ANN  LEE", "rome."), (3, "test", "b", t, "Rome", "Ann Lee"),
        (4, "validation", None, t.replace("ten", "x"), "Ann Lee", "Rome"), (5, "test", "a", None, "Ann Lee", "Rome"), (6, "train", "a", "  ", "Ann Lee", "Rome"),
        (7, "test", "a", t, None, "Rome"), (8, "other", "a", t, "Ann Lee", "Rome"), (9, None, "a", t, "Ann Lee", "Rome"), (10, "train", "a", "...", "Ann Lee", "Rome"), (11, "test", "a", "!?", "Ann Lee", "Rome"),
    ]
    assert pairs(spark, rows) == [(1, 2), (1, 4), (10, 11)]
    assert pairs(spark, []) == []
    extra = spark.createDataFrame([(*x, "z", 1) for x in rows], SCHEMA + ", words string, cls long")
    members, _ = overlaps(extra)
    assert members.count() == 5


def test_hot_pair_and_classes(spark, monkeypatch, tmp_path):
    """One mention pair and one text hold a third of all rows: lists and classes are split; links are those of brute force."""
    from quern.llm import common
    from quern.llm.overlaps import p5_classes, p5_found

    monkeypatch.setattr(common, "HOT", 6)
    r = random.Random(11)
    hot = [("train" if k % 2 else "test", " ".join(r.choice(["red", "blue", "green"]) for _ in range(r.randint(4, 8)))) for k in range(40)]
    hot += [("train", "one hot text of copies")] * 12 + [("validation", "one hot text of copies")] * 9
    rows = [(k, s, "d", t, "A", "B") for k, (s, t) in enumerate(hot)]
    rows += [(100 + k, r.choice(["train", "test"]), None, f"text number {k % 9} is here and stays so", f"E{k % 5}", "F") for k in range(60)] + [(900, "train", "d", None, "A", "B"), (901, "other", "d", "x", "A", "B")]
    path = str(tmp_path / "source_example.parquet")
    spark.createDataFrame(rows, SCHEMA.replace("id long", "example_id long")).write.parquet(path)
    want = brute(rows)
    assert sorted(tuple(x) for x in p5_found(spark, str(tmp_path)).collect()) == sorted((min(p), max(p)) for p in want)
    got = {x.example_id: x for x in p5_classes(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in rows}
    for i in got:
        assert got[i].n_links == sum(i in p for p in want), i
    assert got[900].class_id is None and len({got[k].class_id for k in range(40, 61)}) == 1
