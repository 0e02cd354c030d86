"""Problem 2: occurrences and records of every distinct term.

Method: burst-trie counting. Each task routes the terms of its rows by their first characters into small containers, which burst into one
container a further character when they hold more than BURST terms, and writes its compact trie: a row for each container. What the
terms of all tasks' tries below each prefix then decide how far terms are routed in the merge (prefixes with more than a bounded share of all
entries are divided further), and matching subtrees of all tasks are merged, each route by one task.

A term held by a third of all rows is one entry of each task's trie, so there is no hot key; the routing table has at most MAX_ROUTES
prefixes, whatever the input. Terms that share REACH characters and are still too many for one route are divided by their hash, so a third
of all terms below one long prefix is no hot route either.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise

from .common import read, words_re

BURST = 256  # terms in a container before it bursts
HELD = 400_000  # terms in a task's trie before it is written and begun anew
ROUTE_ENTRIES = 50_000  # entries of all tasks below a prefix before the merge divides it further
MAX_ROUTES = 20_000  # prefixes in the routing table
REACH = 8  # characters of the longest prefix
RARE, COMMON_SHARE = 2, 100

LEAF = "field string, prefix string, suffixes array<string>, occurrences array<long>, records array<long>"


class BurstTrie:
    """Counters (occurrences, records) by term. A node is a dict by character with the key None for the term that ends there; a container a dict by suffix."""

    def __init__(self):
        self.root: tuple[bool, dict] = (False, {})
        self.held = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        inner, at, k = self.root[0], self.root[1], 0
        parent, edge = None, None
        while inner:
            if k == len(term):
                c = at.setdefault(None, [0, 0])
                self.held += c == [0, 0]
                c[0] += occurrences
                c[1] += records
                return
            parent, edge = at, term[k]
            inner, at = at.setdefault(edge, (False, {}))
            k += 1
        c = at.get(term[k:])
        if c is None:
            at[term[k:]] = [occurrences, records]
            self.held += 1
            if len(at) > BURST:
                self.burst(parent, edge, at)
        else:
            c[0] += occurrences
            c[1] += records

    def burst(self, parent: dict | None, edge: str | None, container: dict) -> None:
        node: dict = {}
        for suffix, c in container.items():
            if suffix:
                node.setdefault(suffix[0], (False, {}))[1][suffix[1:]] = c
            else:
                node[None] = c
        if parent is None:
            self.root = (True, node)
        else:
            parent[edge] = (True, node)

    def containers(self) -> Iterator[tuple[str, dict]]:
        todo = [("", *self.root)]
        while todo:
            prefix, inner, at = todo.pop()
            if not inner:
                if at:
                    yield prefix, at
            else:
                if None in at:
                    yield prefix, {"": at[None]}
                todo += [(prefix + e, *x) for e, x in at.items() if e is not None]


def leaves(tries: dict[str, BurstTrie]) -> pd.DataFrame:
    rows = [(f, p, list(c), [x[0] for x in c.values()], [x[1] for x in c.values()]) for f, t in tries.items() for p, c in t.containers()]
    return pd.DataFrame(rows, columns=["field", "prefix", "suffixes", "occurrences", "records"])


def count_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(field, value) -> the task's trie, a row for each container."""
    find = words_re().findall
    tries: dict[str, BurstTrie] = {}
    for pdf in batches:
        for field, part in pdf.groupby("field")["value"]:
            occ, rec = Counter(), Counter()
            for value, n in part.value_counts().items():
                terms = Counter(find(value.lower()))
                for t, k in terms.items():
                    occ[t] += k * n
                    rec[t] += n
            trie = tries.setdefault(field, BurstTrie())
            for t, k in occ.items():
                trie.add(t, k, rec[t])
        if sum(t.held for t in tries.values()) > HELD:
            yield leaves(tries)
            tries = {}
    yield leaves(tries)


def heavy_prefixes(blocks: DataFrame) -> dict[tuple[str, str], int]:
    """Prefixes below which the tasks hold so many entries that the merge must divide them, with the routes that the entries below fill; at most MAX_ROUTES."""
    n = F.size("suffixes").cast("long")
    total = blocks.agg(F.sum(n)).first()[0] or 0
    if total <= ROUTE_ENTRIES:
        return {}
    least = max(ROUTE_ENTRIES, total * (REACH + 1) // MAX_ROUTES)  # an entry counts for its prefix of each length
    openings = F.explode(F.transform("suffixes", lambda s: F.left(F.concat("prefix", s), F.lit(REACH))))
    by = blocks.select("field", openings.alias("p")).groupBy("field", "p").agg(F.count("*").alias("n"))
    ups = F.explode(F.transform(F.sequence(F.lit(0), F.length("p")), lambda k: F.substring("p", F.lit(1), k)))
    sums = by.select("field", ups.alias("p"), "n").groupBy("field", "p").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return {(r["field"], r["p"]): -(-r["n"] // least) for r in sums.select("field", "p", "n").limit(MAX_ROUTES + 1).collect()}


def route_of(field: str, term: str, heavy: dict[tuple[str, str], int]) -> str:
    """The shortest prefix of the term that is not heavy; $: the term ends where the routes divide; #: the longest prefix is heavy too and divided by hash."""
    k = 0
    while k < len(term) and k < REACH and (field, term[:k]) in heavy:
        k += 1
    parts = heavy.get((field, term[:k]))
    if parts is None:
        return term[:k]
    return term[:k] + (f"#{zlib.crc32(term.encode('utf-8', 'replace')) % parts}" if k == REACH and len(term) > k else "$")


def term_counts(values: DataFrame) -> DataFrame:
    """values: (field string, value string) -> (field, term, occurrences long, records long), one row for each distinct term of a field.

    Null values and values without letters or digits have no terms; an empty table gives no rows; repeated rows count each time; further
    columns are ignored; a term of any length is kept whole.
    """
    blocks = materialise(values.select("field", "value").where("value is not null and field is not null").mapInPandas(count_block, LEAF), "p2-tries")
    return merge(blocks)


def merge(blocks: DataFrame) -> DataFrame:
    heavy = heavy_prefixes(blocks)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple[str, str], tuple[list, list, list]] = {}
            for f, p, ss, oo, rr in pdf.itertuples(index=False):
                for s, o, r in zip(ss, oo, rr):
                    term = p + s
                    to = route_of(f, term, heavy)
                    a, b, c = out.setdefault((f, to), ([], [], []))
                    a.append(term)
                    b.append(o)
                    c.append(r)
            yield pd.DataFrame([(f, p, *x) for (f, p), x in out.items()], columns=["field", "prefix", "suffixes", "occurrences", "records"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = BurstTrie()
        for tt, oo, rr in zip(pdf["suffixes"], pdf["occurrences"], pdf["records"]):
            for t, o, r in zip(tt, oo, rr):
                trie.add(t, int(o), int(r))
        rows = [(p + s, o, r) for p, c in trie.containers() for s, (o, r) in c.items()]
        return pd.DataFrame(rows, columns=["term", "occurrences", "records"]).assign(field=pdf["field"].iloc[0])

    routed = blocks.mapInPandas(route, LEAF)
    return routed.groupBy("field", "prefix").applyInPandas(merged, "term string, occurrences long, records long, field string").select("field", "term", "occurrences", "records")


def marked(values: DataFrame) -> DataFrame:
    """term_counts with mark: rare (at most RARE records), common (in more, and at least 1 / COMMON_SHARE of the field's occurrences) or null."""
    blocks = materialise(values.select("field", "value").where("value is not null and field is not null").mapInPandas(count_block, LEAF), "p2-tries")
    totals = blocks.groupBy("field").agg(F.sum(F.aggregate("occurrences", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    totals = {r["field"]: r["total"] for r in totals.collect()}  # one row for each field
    total = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv])[F.col("field")] if totals else F.lit(None).cast("long")
    mark = F.when(F.col("records") <= RARE, "rare").when(F.col("occurrences") * COMMON_SHARE >= total, "common")
    return merge(blocks).withColumn("mark", mark)


def label_values(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "source_example").select(F.lit("source_example.relation").alias("field"), F.col("relation").alias("value"))
    b = read(spark, sf, "generation").select(F.lit("generation.generated_relation").alias("field"), F.col("generated_relation").alias("value"))
    return a.unionAll(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The terms too rare or too common to be useful."""
    return marked(label_values(spark, sf)).where("mark is not null").select("field", "term", "mark")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct term with its counts and its mark, if any."""
    return marked(label_values(spark, sf))
