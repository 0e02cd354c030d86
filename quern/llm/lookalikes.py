"""Problem 8: one form for texts that look the same.

Method: after compatibility normalization (width, ligatures, kinds of space) and deletion of ignorable characters, each token is a lattice of
the look-alike letters of its characters. Viterbi finds the path with the fewest changes of script and, among those, the best score of a
character bigram model counted over all documents. The lattice depends on how a token looks only, so tokens that look the same get the same
letters, and two texts look the same if and only if their forms are equal.

Which letters look alike is Unicode's table of confusable characters, as the library for Unicode in Spark's own distribution has it: letters of
one skeleton are a class with at most one letter of each script, so that what differs within a script (case, l and I) stays different, and
further Latin letters of an ASCII letter's skeleton stand for that letter. A few classes come before it (BASE), which also serve alone where
the driver has no such library.

The bigram model has at most one count for each pair of look-alike letters, whatever the corpus. Forms are compared by a 128-bit hash; exact
copies are one class, and only classes of different texts are paired. A form or text that holds many rows is split among tasks.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise

from .common import read, split_join

# Letters that look alike, Latin first where there is one, at most one of each script.
BASE = [
    "aаα", "cсϲ", "dԁ", "eе", "hһ", "iіι", "jјϳ", "kкκ", "lӏ", "oоοօ", "pрρ", "qԛ", "sѕ", "uυս", "vѵν", "wԝ", "xхχ", "yу", "nո",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ", "VѴ", "WԜ", "XХΧ", "YҮΥ", "ZΖ", "UՍ",
    "ГΓ", "ПΠ", "ФΦ", "пπ", "фφ", "ЛΛ", "гɼ",
]
# Further letters that look like the first letter of such a group but share its script.
SAME_SCRIPT = {"ɡ": "g", "ɑ": "a", "ı": "ı", "Ӏ": "І", "У": "Ү"}
MARKS_IGNORED = "͏ᅟᅠ឴឵ㅤﾠ"
TOKEN = re.compile(r"([^\x00-@\[-`{-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7 -⁯　-〿︰-﹏＀-／]+)")
CACHE = 300_000  # tokens whose reading a task keeps


def script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


@functools.cache
def compatible() -> dict[int, str]:
    """The compatibility form of each character that differs from it in width, joining, font or kind of space only, and nothing for ignorable ones."""
    out: dict[int, str] = {}
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        cat = unicodedata.category(c)
        if cat == "Cf" and not 0xE0000 <= n <= 0xE007F or c in MARKS_IGNORED or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F:
            out[n] = ""
        elif cat == "Cc":
            out[n] = "\n" if n == 0x85 else ""
        elif cat in ("Zl", "Zp"):
            out[n] = "\n"
        elif cat == "Zs":
            if n != 0x1680:
                out[n] = " "
        elif (d := unicodedata.decomposition(c)).startswith("<"):
            kind, *codes = d.split(" ")
            if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or kind == "<compat>" and codes[0] != "0020":
                x = unicodedata.normalize("NFKC", c)
                out[n] = "".join(out.get(ord(y), y) for y in x)
    for n in [*range(9), 11, 12, *range(14, 32), 127]:
        out[n] = ""
    return out


def plain(text: str) -> str:
    """Without ignorable characters, in decomposed compatibility form, with one kind of space and of line break."""
    if text.isascii():
        x = text.translate(compatible()) if CONTROL.search(text) else text
    else:
        x = unicodedata.normalize("NFD", text.translate(compatible()))
    return x.replace("\r\n", "\n").replace("\r", "\n") if "\r" in x else x


CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


class Look:
    """The classes of look-alike letters: a string for each, with at most one letter of each script; same: letters read as another of their script."""

    def __init__(self, groups: list[str], same: dict[str, str]):
        self.groups, self.same = groups, same
        self.class_of = {c: k for k, group in enumerate(groups) for c in group}
        self.letters = [c for group in groups for c in group]
        self.index = {c: k + 1 for k, c in enumerate(self.letters)}  # 0: another character
        self.scripts = {c: script(c) for c in self.letters}

    def table(self) -> np.ndarray:
        out = np.zeros(0x110000, np.int16)
        for c, k in self.index.items():
            out[ord(c)] = k
        return out


def confusable(skeletons: dict[str, str]) -> Look:
    """BASE, extended by letters of equal skeleton. skeletons: letter -> its skeleton, a single character."""
    groups, same = [*BASE], dict(SAME_SCRIPT)
    at = {c: k for k, g in enumerate(groups) for c in g}
    scripts = [{script(c) for c in g} for g in groups]
    by: dict[str, list[str]] = {}
    for c, x in sorted(skeletons.items()):
        by.setdefault(x, []).append(c)
    for x, cs in sorted(by.items()):
        for c in cs:
            if c in at or c in same or c == "ı":
                continue
            plain_letter = x.isascii() and x.isalpha()
            anchor = "I" if x == "l" and not c.islower() else x if plain_letter else next((y for y in cs if y in at), cs[0])
            if anchor not in at:
                at[anchor] = len(groups)
                groups.append(anchor)
                scripts.append({script(anchor)})
            k = at[anchor]
            if c != anchor and script(c) not in scripts[k]:
                groups[k] += c
                scripts[k].add(script(c))
                at[c] = k
            elif c != anchor and plain_letter and script(c) == "LATIN":
                same[c] = anchor
    return Look([g for g in groups if len(g) > 1 or g in same.values()], same)


@functools.lru_cache(1)
def candidates() -> tuple[str, ...]:
    """Letters, without ideographs and syllables, that the compatibility form leaves as they are."""
    skip = [(0x1400, 0x167F), (0x3400, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x17000, 0x1B2FF)]
    return tuple(c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "L" and ord(c) not in compatible() and not any(a <= ord(c) <= b for a, b in skip))


def look(spark: SparkSession) -> Look:
    """The classes by the driver's library for Unicode, or BASE alone."""
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except (TypeError, AttributeError):
        return Look(BASE, SAME_SCRIPT)
    cs = candidates()
    found = checker.getSkeleton("\n".join(cs)).split("\n")
    return confusable({c: x for c, x in zip(cs, found) if len(x) == 1})


def bigrams(docs: DataFrame, at: Look) -> dict[int, int]:
    """Counts of pairs of neighbours among the look-alike letters (0: any other character), by first * n + second, over all documents."""
    n = len(at.letters) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = at.table(), np.zeros(n * n, np.int64)
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for k in range(0, len(texts), 500):
                code = np.frombuffer(" ".join(texts[k : k + 500]).encode("utf-32-le", "replace"), np.uint32)
                of = table[code].astype(np.int32)
                some, times = np.unique(of[:-1] * n + of[1:], return_counts=True)
                total[some] += times
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    sums = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in sums.collect()}  # at most n * n rows


class Reader(dict):
    """Token (decomposed) -> its form."""

    def __init__(self, at: Look, counts: dict[int, int]):
        super().__init__()
        self.look, self.n = at, len(at.letters) + 1
        rows: dict[int, int] = {}
        for pair, k in counts.items():
            rows[pair // self.n] = rows.get(pair // self.n, 0) + k
        self.rest = [math.log(0.1 / (rows.get(k, 0) + 0.1 * self.n)) for k in range(self.n)]  # of pairs not seen
        self.seen = {pair: math.log((k + 0.1) / (rows[pair // self.n] + 0.1 * self.n)) for pair, k in counts.items()}
        self.own = [{at.scripts[c]: c for c in g} for g in at.groups]  # by class: the letter of each script

    def __missing__(self, token: str) -> str:
        if len(self) > CACHE:
            self.clear()
        x = self[token] = self.read(token)
        return x

    def score(self, a: int, b: int) -> float:
        """Log probability of letter b after letter a, by number."""
        return self.seen.get(a * self.n + b, self.rest[a])

    def read(self, token: str) -> str:
        at = self.look
        token = "".join(at.same.get(c, c) for c in token)
        classes = [at.class_of.get(c) for c in token]
        if all(k is None for k in classes):
            return token
        # the scripts that all letters have: if it is one, the only path without a change of script is in it
        common: set[str] | None = None
        for c, k in zip(token, classes):
            here = self.own[k].keys() if k is not None else {script(c)} if c.isalpha() else None
            if here is not None:
                common = set(here) if common is None else common & here
                if not common:
                    break
        if common is not None and len(common) == 1:
            (own,) = common
            return "".join(c if k is None else self.own[k][own] for c, k in zip(token, classes))
        # states of the lattice: the letters of each class; the cost of a path: changes of script, then the score
        paths: dict[tuple[str, str], tuple[int, float, str]] = {("", ""): (0, 0.0, "")}  # by last character and last script
        for t, k in zip(token, classes):
            new: dict[tuple[str, str], tuple[int, float, str]] = {}
            for c in t if k is None else at.groups[k]:
                own = at.scripts.get(c) or (script(c) if c.isalpha() else "")
                if common and own and own not in common:
                    continue  # some path has no change of script: this one would
                row = at.index.get(c, 0)
                for (last, s), (changes, score, path) in paths.items():
                    cost = (changes + bool(own and s and own != s), score - self.score(at.index.get(last, 0), row), path + c)
                    key = (c, own or s)
                    if key not in new or cost < new[key]:
                        new[key] = cost
            paths = new
        return min(paths.values())[2]


@functools.lru_cache(2)
def reader_of(groups: tuple, same: tuple, counts: tuple) -> Reader:
    """The worker's reader for these classes and counts: what it has read serves its later tasks too."""
    return Reader(Look(list(groups), dict(same)), dict(counts))


def form(text: str, reader: Reader) -> str:
    parts = TOKEN.split(plain(text))
    parts[1::2] = map(reader.__getitem__, parts[1::2])
    return unicodedata.normalize("NFC", "".join(parts))


def forms(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs (doc_id long, text string) -> (doc_id, form string) or, without text, (doc_id, form and own binary hashes).

    A null text has a null form, an empty one an empty form; repeated rows get the same form; further columns are not carried.
    """
    at = look(docs.sparkSession)
    key = tuple(at.groups), tuple(at.same.items()), tuple(sorted(bigrams(docs, at).items()))

    def read_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(*key)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = [None if t is None else form(t, reader) for t in texts]
            if keep_text:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "form"])
            else:
                digest = lambda x: None if x is None else hashlib.md5(x.encode("utf-8", "replace"), usedforsecurity=False).digest()
                blank = [m is None or not m.strip() for m in made]
                cols = [batch.column("doc_id"), *(pa.array([None if b else digest(x) for x, b in zip(xs, blank)], pa.binary()) for xs in (made, texts))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "form", "own"])

    return docs.select("doc_id", "text").mapInArrow(read_forms, "doc_id long, form string" if keep_text else "doc_id long, form binary, own binary")


def kinds_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (doc_id, form, own) of texts that are not blank, kinds (form, own, n) of forms of several texts, those forms (form, n_form))."""
    rows = materialise(forms(docs, keep_text=False).where("form is not null"), "p8-forms")
    kinds = materialise(rows.groupBy("form", "own").agg(F.count("*").alias("n")), "p8-kinds")
    several = kinds.groupBy("form").agg(F.sum("n").alias("n_form"), F.count("*").alias("k")).where("k > 1").select("form", "n_form")
    return rows, kinds.join(several, "form", "left_semi"), several


def same_look(docs: DataFrame) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of rows with different texts of one form. Null, empty and blank texts have none; copies of one text are no pairs of their own."""
    rows, kinds, several = kinds_of(docs)
    kinds = kinds.select("form", "own")
    pairs = split_join(kinds.withColumnRenamed("own", "own_a"), kinds.withColumnRenamed("own", "own_b"), "form").where("own_a < own_b").select("own_a", "own_b")
    members = rows.join(several, "form", "left_semi").select("doc_id", "own")
    pairs = split_join(members.select(F.col("own").alias("own_a"), F.col("doc_id").alias("x")), pairs, "own_a")
    pairs = split_join(members.select(F.col("own").alias("own_b"), F.col("doc_id").alias("y")), pairs, "own_b")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def look_classes(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, class_id, n_links) of every row: the class of the texts that look the same, and the rows with another text in it. Makes no pairs.

    Null, empty and blank texts have a null class and no links.
    """
    made = materialise(forms(docs, keep_text=False), "p8-forms")
    kinds = materialise(made.where("form is not null").groupBy("form", "own").agg(F.count("*").alias("n")), "p8-kinds")
    several = kinds.groupBy("form").agg(F.sum("n").alias("n_form"), F.count("*").alias("k")).where("k > 1")
    linked = kinds.join(several, "form").select("form", "own", (F.col("n_form") - F.col("n")).alias("links"))
    one = split_join(made.where("form is not null"), linked.drop("form"), "own", "left")
    one = one.select("doc_id", F.lower(F.hex("form")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return one.unionByName(made.where("form is null").select("doc_id", F.lit(None).cast("string").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that look the same."""
    return same_look(read(spark, sf, "documents"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The one form of every document's text."""
    return forms(read(spark, sf, "documents"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of look-alike texts of every document, and its links, without pairs."""
    return look_classes(read(spark, sf, "documents"))
