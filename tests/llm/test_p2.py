import random
import re
from collections import Counter

from quern.llm import terms as T


def brute(rows):
    occ, rec = Counter(), Counter()
    for f, v in rows:
        if v is not None and f is not None:
            ts = re.findall(r"[^\W_]+", v.lower())
            occ.update((f, t) for t in ts)
            rec.update({(f, t) for t in ts})
    return {(f, t): (n, rec[f, t]) for (f, t), n in occ.items()}


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdé1") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["hot"] * 300
    rows = [(r.choice(["x", "y"]), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for _ in range(3000)] + [("x", None), (None, "a"), ("x", ""), ("y", "--"), ("y", "a_b İx ½ ٣"), ("y", "long" * 50_000)]
    df = spark.createDataFrame([(*x, "t", 3) for x in rows], "field string, value string, term string, records int").repartition(7)
    for burst, entries in ((256, 50_000), (4, 20)):
        monkeypatch.setattr(T, "BURST", burst)
        monkeypatch.setattr(T, "ROUTE_ENTRIES", entries)
        monkeypatch.setattr(T, "MAX_ROUTES", 10**9)
        got = {(x.field, x.term): (x.occurrences, x.records) for x in T.term_counts(df).collect()}
        assert got == brute(rows)


def test_marks(spark):
    rows = [("f", "a b")] * 3 + [("f", "a c")] * 2 + [("f", "d " * 400)] * 3
    df = spark.createDataFrame(rows, "field string, value string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in T.marked(df).collect()}
    assert got == {"a": (5, 5, None), "b": (3, 3, None), "c": (2, 2, "rare"), "d": (1200, 3, "common")}
    assert T.marked(df.limit(0)).count() == 0


def test_trie_bursts_and_keeps_counts():
    t, want = T.BurstTrie(), Counter()
    r = random.Random(2)
    for _ in range(20_000):
        w = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        t.add(w, 2, 1)
        want[w] += 1
    got = {p + s: tuple(c) for p, k in t.containers() for s, c in k.items()}
    assert got == {w: (2 * n, n) for w, n in want.items()}
    assert max(len(k) for _, k in t.containers()) <= T.BURST


def test_hot_prefix_is_divided(spark, monkeypatch):
    """A third of all terms share a long opening: their route is divided by hash, and the counts stay those of plain counting."""
    from collections import Counter

    monkeypatch.setattr(T, "ROUTE_ENTRIES", 30)
    monkeypatch.setattr(T, "MAX_ROUTES", 10_000)
    monkeypatch.setattr(T, "BURST", 4)
    terms = [f"samelongopening{k}" for k in range(300)] + [f"{k}x{k % 7}" for k in range(600)] + ["samelongopening", "samelong", "s"]
    rows = [("f", " ".join(terms[k::11] + terms[k % 5 :: 17])) for k in range(22)]
    blocks = T.materialise(spark.createDataFrame(rows, "field string, value string").repartition(6).mapInPandas(T.count_block, T.LEAF), "t")
    heavy = T.heavy_prefixes(blocks)
    routes = {T.route_of("f", t, heavy) for t in terms}
    assert sum("#" in r for r in routes) > 3 and ("f", "samelong") in heavy
    size = Counter(T.route_of("f", t, heavy) for t in terms)
    assert max(size.values()) < 200
    got = {r.term: (r.occurrences, r.records) for r in T.merge(blocks).collect()}
    occ, rec = Counter(), Counter()
    for _, v in rows:
        occ.update(v.split())
        rec.update(set(v.split()))
    assert got == {t: (occ[t], rec[t]) for t in occ}
