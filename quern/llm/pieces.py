"""Problem 4: cutting oversized values into overlapping pieces at natural boundaries.

Method: recursive bisection. A part longer than the limit minus the overlap is cut at the strongest boundary near its midpoint, and so are
its halves; then each piece but the first is given the end of the one before. Every value is cut by itself where it is scanned: no shuffle,
and the JVM's filter on the length leaves only the long values to Python.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LIMIT, OVERLAP = 1600, 160
FIELDS = ("text", "prompt_2_shot")
# Boundaries, the strongest first; a cut is at the end of a match.
BOUNDARIES = [
    re.compile(r"(?:\r\n|[\n\r ])[ \t]*(?:\r\n|[\n\r ])\s*"),
    re.compile(r"\r\n|[\n\r  \x85]"),
    re.compile(r"(?:[.!?…][\"'”’\xbb)\]]*\s+)|[。！？][”’」』]?"),
    re.compile(r"[,;:—–][\"'”’)\]]*\s+|[，；：、]|\s(?=[(“\"])"),
    re.compile(r"\s+"),
]


def boundaries(text: str) -> list[list[int]]:
    return [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]


def joined(text: str, at: int) -> bool:
    """Whether a cut at `at` would part what is one character on the page (a base and its marks, an emoji sequence, CR and LF)."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return unicodedata.category(b) in ("Mn", "Me", "Mc") or "‍" in (a, b) or "\U0001f3fb" <= b <= "\U0001f3ff" or b == "️" or a + b == "\r\n"


def best_cut(text: str, at: list[list[int]], a: int, b: int) -> int:
    """The cut of [a, b): the strongest boundary within a quarter of its length around the midpoint, of equals the nearest, of those the first."""
    mid, reach = (a + b) // 2, max(1, (b - a) // 4)
    for ends in at:
        i, j = bisect_left(ends, mid - reach), bisect_right(ends, mid + reach)
        if inside := [e for e in ends[i:j] if a < e < b and not joined(text, e)]:
            return min(inside, key=lambda e: (abs(e - mid), e))
    cut = mid
    while cut > mid - reach and cut > a + 1 and joined(text, cut):
        cut -= 1
    return cut if not joined(text, cut) else mid


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, own, end) of each piece: text[begin:end], of which text[begin:own] repeats the piece before. A text within the limit is one piece; an empty one none."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    at, parts, todo = boundaries(text), [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            parts.append((a, b))
        else:
            cut = best_cut(text, at, a, b)
            todo += [(cut, b), (a, cut)]
    every = sorted({e for ends in at for e in ends})
    out, before = [], 0
    for k, (a, b) in enumerate(parts):
        begin = a
        if k:
            low = max(a - overlap, before)
            i = bisect_left(every, low)
            begin = every[i] if i < len(every) and every[i] < a else low
            while begin < a and joined(text, begin):
                begin += 1
        out.append((begin, a, b))
        before = begin
    return out


PIECE = "piece int, n_pieces int, begin int, own int, end int, piece_text string"


def cut_values(values: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """values: (id long, field string, value string) -> the pieces of each value longer than the limit: (id, field, piece, n_pieces, begin, own, end, piece_text).

    Lengths are of Unicode code points. Null, empty and short values have no rows; repeated rows are cut each time; further columns are not
    carried. text[own:end] of the pieces in order give the value back.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, f, v in pdf.itertuples(index=False):
                s = spans(v, limit, overlap)
                rows += [(i, f, k, len(s), a, b, c, v[a:c]) for k, (a, b, c) in enumerate(s)]
            yield pd.DataFrame(rows, columns=["id", "field", "piece", "n_pieces", "begin", "own", "end", "piece_text"])

    long = values.select("id", "field", "value").where(F.length("value") > limit)
    return long.mapInPandas(cut, "id long, field string, " + PIECE)


def example_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")
    rows = read(spark, sf, "source_example").where(f"length(text) > {LIMIT} or length(prompt_2_shot) > {LIMIT}")
    return rows.select(F.col("example_id").alias("id"), pairs).select("id", "x.field", "x.value")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The values that get cut: those of which the operator made more than one piece."""
    return cut_values(example_values(spark, sf)).where("piece = 0 and n_pieces > 1").select(F.col("id").alias("example_id"), "field")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces."""
    return cut_values(example_values(spark, sf)).withColumnRenamed("id", "example_id")
