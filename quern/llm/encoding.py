"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: batched numpy merge rounds. The new words of a block lie in one flat array of symbols; in each round the pairs of neighbours are
looked up by binary search over the sorted pair keys, each word's lowest-rank pair is merged wherever it stands, and finished words leave
the array. Words already encoded in the task are taken from a bounded table, and texts are put together from it by one gather.

Texts are encoded where they are scanned (Arrow batches, no shuffle). The vocabulary file is read by each worker from its path.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import char_class, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  # or QUERN_TOKENIZER
KEPT_WORDS = 200_000  # words a task keeps encoded
BLOCK_CHARS = 1_000_000  # of the texts that are put together at once
NONE = np.int32(2**31 - 1)
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path() -> str:
    return os.environ.get("QUERN_TOKENIZER", VOCABULARY)


@functools.cache
def pattern(reach: str) -> re.Pattern:
    """The words of a text: contractions, letters, digits, other characters, white space. reach: the code points texts may have (ascii, bmp, all)."""
    if reach == "ascii":
        letters, digits, space = "A-Za-z", "0-9", r"\t-\r "
    else:
        letters, digits, space = char_class("L"), char_class("N"), SPACE
        if reach == "bmp":
            letters, digits = (re.sub(r"\\U000[1-9a-f][0-9a-f]{4}(?:-\\U[0-9a-f]{8})?|\\U0010[0-9a-f]{4}(?:-\\U[0-9a-f]{8})?", "", x) for x in (letters, digits))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def split(text: str) -> list[str]:
    if text.isascii():
        return pattern("ascii").findall(text)
    return pattern("all" if ASTRAL.search(text) else "bmp").findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if it is printable in Latin-1, else one from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def rerank(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        rank[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        rank[at] = self.ranks(sym[at], sym[at + 1])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lens = np.array([len(r) for r in raw], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE)  # of each symbol's pair with the next one of its word
        self.rerank(sym, word, rank, np.arange(len(sym)))
        while len(sym):
            begins = np.nonzero(np.r_[True, word[1:] != word[:-1]])[0]
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.r_[begins, len(sym)])
            over = least == NONE
            if over.any():
                over_at = np.repeat(over, sizes)
                done.append((word[over_at], sym[over_at]))
                sym, word, rank = sym[~over_at], word[~over_at], rank[~over_at]
                least, sizes = least[~over], sizes[~over]
                if not len(sym):
                    break
            hit = np.nonzero(rank == np.repeat(least, sizes))[0]
            # of hits in a row (the pair is twice the same symbol) every other one is merged
            run = np.r_[True, np.diff(hit) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.result[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))  # where the merged symbols are now; their pairs and those before them are new
            self.rerank(sym, word, rank, np.union1d(at, at[at > 0] - 1))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.forget()
            new = list(words)
        if new:
            ids, lens = self.merge(new)
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(lens)]
            self.ids = np.r_[self.ids, ids]

    def indices(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The known words' numbers of all texts one after another, and how many each text has."""
        split_up = [split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split_up)))
        sizes = np.array([len(s) for s in split_up], np.int64)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split_up)), np.int64, sizes.sum()), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another and each one's number of ids; none for a null or empty text."""
        at, sizes = self.indices(texts)
        lens = self.starts[at + 1] - self.starts[at]
        total = np.r_[0, np.cumsum(lens)]
        ids = self.ids[np.repeat(self.starts[at] - total[:-1], lens) + np.arange(total[-1])]
        ends = np.cumsum(sizes)
        return ids, np.diff(np.r_[0, total[ends]]) if len(ends) else np.zeros(0, np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, sizes = self.indices(texts)
        total = np.r_[0, np.cumsum(self.starts[at + 1] - self.starts[at])]
        return np.diff(np.r_[0, total[np.cumsum(sizes)]]) if len(sizes) else np.zeros(0, np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= BLOCK_CHARS:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs: (doc_id long, text string) -> (doc_id, ids array<int>), one row for each row.

    Null and empty texts have an empty list. Special tokens' strings are ordinary text. Repeated rows are encoded alike; further columns are
    not carried; texts of any length are encoded whole.
    """
    path = path or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for a, b in blocks(texts := batch.column("text").to_pylist()):
                ids, lens = e.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return encode_table(read(spark, sf, "documents"))
