"""Problem 7: items into containers of fixed capacity.

Method: non-negative least squares. From the histogram of sizes (at most CAPACITY bins, whatever the number of documents) all combinations of
up to three sizes that fill a container to within WINDOW tokens are enumerated, their repeat counts are solved for by accelerated projected
gradients, rounded down as far as the items last, and what is left is packed greedily, combination by combination. The plan is a list of
runs (a combination and how often), so its length depends on the number of sizes and not on that of the documents.

The rank of an item among those of its size comes from a count in each task and the tasks' offsets, so that no size, however frequent, is
sorted or gathered in one place; the tasks' sizes are written to the shared folder first, so ranks are the same if a task is run again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import materialise

from .common import read
from .encoding import blocks, encoder, vocabulary_path

CAPACITY = 1024
WINDOW = 0  # tokens that an enumerated combination may leave free
STEPS = 600  # of the solver


def combinations(present: np.ndarray, capacity: int, window: int) -> np.ndarray:
    """Rows of three sizes (0: none) of the sizes present, descending, whose sum is in [capacity - window, capacity]."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    out = []
    for total in range(capacity - window, capacity + 1):
        for c in np.nonzero(have)[0]:
            if 3 * c > total:
                break
            b = np.arange(c, (total - c) // 2 + 1)
            a = total - c - b
            ok = have[b] & (a <= capacity) & (a > 0)
            ok[ok] &= have[a[ok]]
            out.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' sizes nearest to the histogram: min |A x - h|^2 by accelerated projected gradients.

    Sizes are weighted: a long item left over costs more room than a short one.
    """
    n = len(counts)
    weight = 0.2 + np.arange(n) / n
    weight[0] = 0
    flat = combos.ravel()
    times = lambda x: np.bincount(flat, np.repeat(x, combos.shape[1]), n) * weight
    back = lambda r: (r * weight)[combos].sum(1)
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(times(v))
        v /= (norm := np.linalg.norm(v))
    step, h = 1 / (1.05 * norm), counts * weight
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - h))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        if (y - new) @ (new - x) < 0:  # momentum against the descent: begin anew
            y, t2 = new, 1.0
        x, t = new, t2
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Runs (sizes with multiplicities, repeats) that use up the histogram counts[size] exactly; no run exceeds the capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[dict[int, int], int]] = []

    def take(items: dict[int, int], most: int) -> None:
        n = min([most, *(int(left[s]) // k for s, k in items.items())])
        if n > 0:
            for s, k in items.items():
                left[s] -= n * k
            runs.append((items, n))

    if left[capacity]:
        take({capacity: 1}, int(left[capacity]))
    combos = combinations(np.nonzero(left)[0], capacity, window)
    if len(combos):
        x = solve(combos, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            items: dict[int, int] = defaultdict(int)
            for s in combos[i]:
                if s:
                    items[int(s)] += 1
            take(dict(items), int(x[i] + 0.5))
    while left.any():  # the largest left, then again and again the largest that fits
        items, room = defaultdict(int), capacity
        while room:
            fits = np.nonzero(left[1 : room + 1] > np.array([items.get(s, 0) for s in range(1, room + 1)]))[0]
            if not len(fits):
                break
            s = int(fits[-1]) + 1
            k = max(1, min(room // s, int(left[s]) - items[s])) if 2 * s <= room else 1
            items[s] += k
            room -= s * k
        take(dict(items), int(left.max()))
    return runs


class Slots:
    """Container of the item with rank r among those of its size."""

    def __init__(self, runs: list[tuple[dict[int, int], int]]):
        at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by size: first rank, first container, items of the size in each
        used: dict[int, int] = defaultdict(int)
        first = 0
        for items, n in runs:
            for s, k in items.items():
                at[s].append((used[s], first, k))
                used[s] += n * k
            first += n
        self.containers = first
        self.at = {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in at.items()}

    def container(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.full(len(sizes), -1, np.int64)
        for s in np.unique(sizes):
            if s in self.at:
                own = np.nonzero(sizes == s)[0]
                begin, first, k = self.at[s]
                i = np.searchsorted(begin, ranks[own], "right") - 1
                out[own] = first[i] + (ranks[own] - begin[i]) // k[i]
        return out


ITEM = "doc_id long, piece int, n_pieces int, size int, part int, nth long"


def sizes(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> items (doc_id, piece, n_pieces, size, part, nth): nth item of its size in its task. A text larger than a container is cut into full ones and a rest."""
    path = path or vocabulary_path()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in blocks(texts := batch.column("text").to_pylist()):
                n = e.count(texts[a:b])
                ids = batch.column("doc_id").slice(a, b - a).to_numpy(zero_copy_only=False)
                pieces = np.maximum(1, -(-n // capacity))
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(capacity, n[row] - piece * capacity)
                order = np.argsort(size, kind="stable")
                s = size[order]
                begin = np.r_[0, np.nonzero(np.diff(s))[0] + 1] if len(s) else np.zeros(0, int)
                nth = np.empty(len(s), np.int64)
                nth[order] = np.arange(len(s)) - np.repeat(begin, np.diff(np.r_[begin, len(s)])) + seen[s]
                seen += np.bincount(size, minlength=capacity + 1)
                cols = [ids[row], piece.astype(np.int32), pieces[row].astype(np.int32), size.astype(np.int32), np.full(len(row), part, np.int32), nth]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "piece", "n_pieces", "size", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(measure, ITEM)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs (doc_id long, text string) -> (doc_id, piece, n_pieces, size, container), one row for each document or piece.

    Null and empty texts take no room: size 0 and a null container. Repeated rows are items of their own; further columns are not carried;
    an empty table gives no rows. Containers are numbered from 0 without gaps.
    """
    items = materialise(sizes(docs, capacity, path), "p7-items")
    by_part = items.where("size > 0").groupBy("part", "size").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most one row for each size
        counts[r["size"]] = r["n"]
    slots = Slots(plan(counts, capacity))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = by_part.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = items.join(offset, ["part", "size"], "left").select("doc_id", "piece", "n_pieces", "size", (F.col("nth") + F.coalesce("offset", F.lit(0))).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = slots.container(pdf["size"].to_numpy(), pdf["rank"].to_numpy())
            yield pdf.assign(container=pd.Series(c, index=pdf.index, dtype="Int64").mask(c < 0)).drop(columns="rank")

    return ranked.mapInPandas(place, "doc_id long, piece int, n_pieces int, size int, container long")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each document or piece."""
    return pack(read(spark, sf, "documents"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: containers by tokens left free."""
    used = p7_containers(spark, sf).where("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    return used.groupBy((F.lit(CAPACITY) - F.col("used")).alias("free")).agg(F.count("*").alias("n_containers"))
