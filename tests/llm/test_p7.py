import os

import numpy as np
import pytest

from quern.llm import containers as C
from quern.llm.encoding import vocabulary_path


def used(runs, capacity):
    out = np.zeros(capacity + 1, int)
    for items, n in runs:
        assert n > 0 and sum(s * k for s, k in items.items()) <= capacity
        for s, k in items.items():
            out[s] += n * k
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_items_and_little_room(seed):
    r = np.random.default_rng(seed)
    cap = int(r.choice([64, 256, 1024]))
    sizes = np.minimum(cap, r.lognormal(np.log(cap / 5), 0.8, 4000).astype(int) + 1)
    counts = np.bincount(sizes, minlength=cap + 1)
    runs = C.plan(counts, cap)
    assert (used(runs, cap)[1:] == counts[1:]).all()
    assert sum(n for _, n in runs) <= np.ceil(sizes.sum() / cap) * 1.01 + 1


def test_plan_of_odd_histograms():
    for counts in ([0] * 11, [5] + [0] * 10, [0] * 10 + [3], [0, 7] + [0] * 9, [0] * 6 + [4] + [0] * 4):
        c = np.array(counts)
        assert (used(C.plan(c, 10), 10)[1:] == c[1:]).all()
    assert sum(n for _, n in C.plan(np.array([0, 7] + [0] * 9), 10)) == 1


def test_every_rank_has_a_container():
    counts = np.array([0, 30, 11, 9, 8, 2, 5, 0, 1, 0, 2])
    slots = C.Slots(C.plan(counts, 10))
    room = np.full(slots.containers, 10)
    for s in range(1, 11):
        for c in slots.container(np.full(counts[s], s), np.arange(counts[s])):
            room[c] -= s
    assert (room >= 0).all() and (room < 10).all()


@pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary file")
def test_documents(spark):
    texts = ["hello world " * k for k in range(40)] + [None, "", "a b c d " * 400, "same text"] + ["same text"] * 50
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, size int, container string").repartition(5)
    got = C.pack(df, capacity=64).toPandas()
    assert len(got[got.piece == 0]) == len(texts) and not got.duplicated(["doc_id", "piece"]).any()
    none = got[got["size"] == 0]
    assert set(none.doc_id) == {0, 40, 41} and none.container.isna().all()
    full = got[got["size"] > 0].groupby("container")["size"].sum()
    assert full.max() <= 64 and set(full.index) == set(range(len(full)))
    assert len(full) <= np.ceil(got["size"].sum() / 64) + 2
    big = got[got.doc_id == 42]
    assert (big["size"].iloc[:-1] == 64).sum() >= len(big) - 2 and big.n_pieces.nunique() == 1
    assert C.pack(df.limit(0), capacity=64).count() == 0
