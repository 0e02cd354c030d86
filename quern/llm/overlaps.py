"""Problem 5: evaluation rows that recur, exactly or almost, in the train rows.

Method: weighted cosine join. A row's vector has its numbered words (the second "the" is another term than the first) with weights from a
clipped idf; the inverted lists hold, of the rows of either side, only the opening terms up to which the norm of the rest is below the
threshold (residual-norm pruning), and a posting's weight and residual bound the dot product of the pairs it gives (maximum-weight pruning).
Exact dot products and then the exact count of differing words follow; grouped counts make the report.

The bound is lossless for the problem: with squared weights in [1, SPAN], texts that differ in at most DIFFER of the longer one's words have
a cosine of at least (1 - DIFFER) / (1 - DIFFER + DIFFER * SPAN).

Postings are keyed by both mentions and the term, so rows of other mentions never meet; exact copies are one class each, joined once, and
only the result brings their members back. Sides, words and classes are found by hash joins, with no broadcast that grows with the data:
the frequent terms' table holds at most KINDS times the mean length, as each is in at least 1 / KINDS of the rows. A list that holds very many
postings (a mention pair of a third of all rows), and a class of very many copies, are split among tasks (common.split_join).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise

from .common import read, split_join

DIFFER, SPAN, KINDS = 0.2, 1.25, 500
THRESHOLD = (1 - DIFFER) / (1 - DIFFER + DIFFER * SPAN)
EPS = 1e-9


def plain(c: Column) -> Column:
    """Without case, spacing and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]+", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}\p{M}]+"), 0)


def not_blank(c: Column) -> Column:
    return c.isNotNull() & F.regexp_like(c, F.lit(r"[^\s\p{Z}\p{Cf}]"))


def apart(a: list, b: list, most: int) -> int:
    """Word edit distance of a and b, or more than most if it is that. Bands of growing width are tried, so texts with few differences cost little, however long."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    reach = 8
    while True:
        reach = min(max(reach, len(b) - len(a)), most)
        d = banded(x, y, reach)
        if d <= reach or reach == most:
            return d if d <= most else most + 1
        reach *= 4


def banded(x: np.ndarray, y: np.ndarray, reach: int) -> int:
    """Edit distance of x and y if it is at most reach, else something larger."""
    m, steps = len(y), np.arange(2 * reach + 1)
    far = m + len(x) + 1
    padded = np.r_[np.full(reach, -1), y, np.full(reach + len(x) + 1, -2)]
    d = np.where(steps >= reach, steps - reach, far)  # cell k of row i is column i - reach + k
    d[steps - reach > m] = far
    for i in range(1, len(x) + 1):
        col = i - reach + steps
        diag = d + (padded[i - 1 : i + 2 * reach] != x[i - 1])
        up = np.r_[d[1:] + 1, far]
        new = np.minimum(diag, up)
        new[col == 0] = i
        new[(col < 0) | (col > m)] = far
        d = np.minimum.accumulate(new - steps) + steps
        d[(col < 0) | (col > m)] = far
        if d.min() > reach:
            return far
    k = m - len(x) + reach
    return int(d[k]) if 0 <= k <= 2 * reach else far


def weight2(df: float, n: float) -> float:
    """Squared weight of a term in df of n rows: 1 for one in all rows, SPAN for one in n / KINDS or fewer."""
    return 1 + (SPAN - 1) * min(1.0, max(0.0, math.log(n / max(df, 1e-9)) / math.log(KINDS)))


def numbered(ws: list) -> list[tuple[str, int]]:
    seen: dict = {}
    out = []
    for w in ws:
        k = seen[w] = seen.get(w, 0) + 1
        out.append((w, k))
    return out


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: (id, split, dataset, text, entity1, entity2). Members (id, split, dataset, train, cls) of the mention pairs on both sides, and their classes (cls, pair, words, n, train, eval)."""
    cs = ("text", "entity1", "entity2")
    ok = rows.where(F.col("split").isin("train", "validation", "test"))
    for c in cs:
        ok = ok.where(not_blank(F.col(c)))
    train = F.col("split") == "train"
    pair = F.md5(F.concat_ws("\x01", plain(F.col("entity1")), plain(F.col("entity2"))))
    ok = ok.select("id", "split", "dataset", train.alias("train"), pair.alias("pair"), "text")
    both = ok.groupBy("pair").agg(F.bool_or("train").alias("a"), F.bool_or(~F.col("train")).alias("b")).where("a and b").select("pair")
    kept = ok.join(both, "pair", "left_semi").withColumn("words", words(F.col("text")))
    kept = kept.withColumn("cls", F.md5(F.concat_ws("\x01", "pair", F.concat_ws(" ", "words")))).drop("text")
    kept = materialise(kept, "p5-rows")
    reps = kept.groupBy("cls").agg(F.first("pair").alias("pair"), F.first("words").alias("words"), F.count("*").alias("n"), F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("eval"))
    return kept.select("id", "split", "dataset", "train", "cls"), materialise(reps, "p5-classes")


def frequent(reps: DataFrame) -> tuple[dict[str, int], int]:
    """Rows of each term that is in at least 1 / KINDS of all rows, and the number of rows. At most KINDS x mean number of terms."""
    total = reps.agg(F.sum("n")).first()[0] or 0
    df = reps.select(F.explode(F.array_distinct("words")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("df")).where(F.col("df") * KINDS >= total)
    return {r["t"]: r["df"] for r in df.collect()}, total


def links(reps: DataFrame) -> DataFrame:
    """Pairs (cls_a with train rows, cls_b with others) of different classes whose texts differ in at most DIFFER of their words."""
    table, total = frequent(reps)
    w2 = {t: weight2(df, total) for t, df in table.items()}

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cls, pair, ws, train, ev in zip(pdf["cls"], pdf["pair"], pdf["words"], pdf["train"], pdf["eval"]):
                terms = sorted((-w2.get(w, SPAN), w, k) for w, k in numbered(ws))  # heavy terms first, the same order in every row
                norm = -sum(t[0] for t in terms)
                rest = norm
                for v, w, k in terms:
                    if rest < THRESHOLD**2 * norm - EPS:
                        break
                    rest += v
                    out.append((cls, f"{pair}\x01{w}\x01{k}", math.sqrt(-v / norm), math.sqrt(max(rest, 0) / norm), len(ws), bool(train), bool(ev)))
            yield pd.DataFrame(out, columns=["cls", "key", "weight", "rest", "size", "train", "eval"])

    post = materialise(reps.mapInPandas(postings, "cls string, key string, weight double, rest double, size int, train boolean, eval boolean"), "p5-postings")
    side = lambda x: post.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("cls", "weight", "rest", "size")])
    a = side("a").where(post["train"])
    b = side("b").where(post["eval"])
    met = split_join(a, b, "key").where("cls_a <> cls_b")
    met = met.where(F.least("size_a", "size_b") >= (1 - DIFFER) * F.greatest("size_a", "size_b") - EPS)
    met = met.where(F.col("weight_a") * F.col("weight_b") + F.col("rest_a") * F.col("rest_b") >= THRESHOLD - EPS)
    met = met.select("cls_a", "cls_b").distinct()
    text = reps.select("cls", "words")
    met = met.join(text.select(F.col("cls").alias("cls_a"), F.col("words").alias("wa")), "cls_a").join(text.select(F.col("cls").alias("cls_b"), F.col("words").alias("wb")), "cls_b")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for wa, wb in zip(pdf["wa"], pdf["wb"]):
                ta, tb = set(numbered(wa)), set(numbered(wb))
                dot = sum(w2.get(w, SPAN) for w, _ in ta & tb)
                norms = math.sqrt(sum(w2.get(w, SPAN) for w, _ in ta) * sum(w2.get(w, SPAN) for w, _ in tb))
                most = int(DIFFER * max(len(wa), len(wb)) + EPS)
                keep.append(dot >= (THRESHOLD - EPS) * norms and apart(list(wa), list(wb), most) <= most)
            yield pdf.loc[keep, ["cls_a", "cls_b"]]

    return met.mapInPandas(exact, "cls_a string, cls_b string")


def overlaps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: (id long, split, dataset, text, entity1, entity2) -> members (id, split, dataset, train, cls) and linked classes (cls_a of train rows, cls_b of others).

    Rows with a null or blank text or mention are in neither; a null dataset stays null; texts without any word are alike; a class is linked
    with itself if it has rows of both sides; an empty table gives no rows.
    """
    members, reps = classes(rows)
    same = reps.where("train and eval").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    return members, links(reps).unionAll(same)


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_example").select(F.col("example_id").alias("id"), "split", "dataset", "text", "entity1", "entity2")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a train row and a validation or test row that are the same or almost."""
    members, linked = overlaps(examples(spark, sf))
    a = members.where("train").select(F.col("cls").alias("cls_a"), F.col("id").alias("x"))
    b = members.where("not train").select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    pairs = split_join(b, split_join(a, linked, "cls_a"), "cls_b")
    return pairs.select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b"))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of source_example with the class of its copies and the number of its links: rows of the other side that are the same or almost. Makes no pairs.

    Rows whose mentions are not on both sides, and rows that are no cases, have a null class and no links.
    """
    rows = examples(spark, sf)
    members, linked = overlaps(rows)
    linked = materialise(linked, "p5-links")
    n = materialise(members.groupBy("cls").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval")), "p5-sizes")
    side = lambda own, other, count: linked.join(n.select(F.col("cls").alias(other), F.col(count).alias("n")), other).groupBy(F.col(own).alias("cls")).agg(F.sum("n").alias("n"))
    links = n.select("cls").join(side("cls_a", "cls_b", "n_eval").withColumnRenamed("n", "of_train"), "cls", "left").join(side("cls_b", "cls_a", "n_train").withColumnRenamed("n", "of_eval"), "cls", "left")
    each = split_join(members.select("id", "train", "cls"), links, "cls")
    each = each.select("id", F.col("cls").alias("class_id"), F.coalesce(F.when(F.col("train"), F.col("of_train")).otherwise(F.col("of_eval")), F.lit(0)).alias("n_links"))
    return rows.select("id").join(each, "id", "left").select(F.col("id").alias("example_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Of each evaluation split and dataset: rows that recur in train rows, the train rows' dataset, and the pairs. Counted by class, without making the pairs."""
    members, linked = overlaps(examples(spark, sf))
    a = members.where("train").groupBy(F.col("cls").alias("cls_a"), F.col("dataset").alias("train_dataset")).agg(F.count("*").alias("na"))
    b = members.where("not train").groupBy(F.col("cls").alias("cls_b"), "split", "dataset").agg(F.count("*").alias("nb"))
    by = linked.join(a, "cls_a").join(b, "cls_b").groupBy("cls_b", "split", "dataset", "train_dataset").agg(F.first("nb").alias("nb"), F.sum(F.col("na") * F.col("nb")).alias("np"))
    return by.groupBy("split", "dataset", "train_dataset").agg(F.sum("nb").alias("n_rows"), F.sum("np").alias("n_pairs"))
