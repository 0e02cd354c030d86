"""What several problems need: reading tables, character classes, emptiness of an answer."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import spread


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table; that of one small file over all cores, as most of its rows go through Python. Large ones are read as they lie."""
    return spread(spark.read.parquet(f"{sf}/{table}.parquet"))


HOT, MOST_HOT = 20_000, 1000  # rows of a key from which it may be split, and keys that are split at most


def split_join(big: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with other on key, the rows of big of a hot key split among several tasks, those of other repeated for each.

    A key is hot with more than HOT rows and more than one in MOST_HOT of all rows, so at most MOST_HOT keys, and no more, are broadcast.
    big should be a stored table or cheap to read twice. Null keys join nothing. Every row counts, as in a plain join.
    """
    rest = [F.col(c) for c in big.columns if c != key]
    least = max(HOT, big.count() // MOST_HOT)
    hashed = F.xxhash64(key).alias("_h")
    hot = big.where(F.col(key).isNotNull()).groupBy(hashed).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    hot = F.broadcast(hot.select("_h", F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    a = big.withColumn("_h", hashed).join(hot, "_h", "left").withColumn("_part", F.pmod(F.xxhash64(*rest), parts).cast("int") if rest else F.lit(0)).drop("_h", "_parts")
    b = other.withColumn("_h", hashed).join(hot, "_h", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_h", "_parts")
    return a.join(b, [key, "_part"], how).drop("_part")


@functools.cache
def char_class(prefixes: str) -> str:
    """Body of a character class for `re` with all code points whose general category starts with one of the letters given."""
    out, start, prev = [], None, None
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in prefixes:
            if start is None:
                start = c
            prev = c
        elif start is not None:
            out.append((start, prev))
            start = None
    if start is not None:
        out.append((start, prev))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in out)


@functools.cache
def words_re() -> re.Pattern:
    """Longest runs of letters and digits (categories L and N)."""
    return re.compile(f"[{char_class('LN')}]+")


THINK_CLOSED = re.compile(r"<think>.*?</think>", re.S | re.I)
THINK_OPEN = re.compile(r"<think>.*\Z", re.S | re.I)
EMPTY_THINK = re.compile(r"<think>\W*</think>|<think>\W*\Z", re.I)
ONLY_MARKER = re.compile(r"\W*(?:(?:final\s+)?(?:answer|output|response)\W*|(?:label|relation)\s*[:=]\W*)?\Z", re.I)
NONE_WORD = re.compile(r"""^[\s"'`‘’“”]*(?:none|null|nan|na|n/a)[\s"'`‘’“”]*$""", re.I)


def is_empty(value: str | None) -> bool:
    """Null, or nothing but spaces, invisible characters, punctuation, an answer marker or an empty think block."""
    if value is None or value != value:
        return True
    if value[:1].isalnum() and "<" not in value and not ONLY_MARKER.match(value):
        return False  # a letter or digit that is no marker's
    x = EMPTY_THINK.sub(" ", value)
    if ONLY_MARKER.match(x):
        return not any(unicodedata.category(c)[0] == "S" for c in x if c not in "`^~|<>=+$")
    return not any(unicodedata.category(c)[0] in "LNS" for c in x if c not in "`^~|<>=+$")


def is_none_word(value: str) -> bool:
    return bool(NONE_WORD.match(value))
