"""Problem 1: free-entered values onto the entries of a reference list.

Method: token-level repair, then soft TF-IDF. Each distinct token of a block of values is joined with the reference vocabulary (the words
of all entries) by edit distance: an index of the forms' segments gives the candidates, and one numpy programme (optimal string alignment)
over the candidate pairs their distances. Tokens that hold a whole entry without separators are split into two repaired words and a
connective. All entries that share a repaired word with the value are then ranked by soft TF-IDF: the cosine of the entry's weights and those
of a window of the value, in which words that are not the entry's count too, connectives at nothing. The value means the entry of the best
window, if its score reaches LEAST.

An entry of a single content word has no window but a whole line or the whole value. A value's last word may be cut off: it is then like the
entry's word that it begins, and of entries that are equally like it none is meant.

The vocabulary comes from the reference list, whose size is checked (MAX_ENTRIES); the values are mapped where they are scanned, so that
there is no shuffle and a value that holds a third of all rows is no hot key.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import THINK_CLOSED, THINK_OPEN, is_empty, is_none_word, read

MAX_ENTRIES = 100_000  # of the reference list, which every task holds
CACHE = 200_000  # tokens and values whose repair and entry a task keeps; the rest is computed again
CELLS = 4_000_000  # of the edit-distance programme's tables at once
LEAST = 0.77  # score from which a value means an entry: one whole word of two has at most 0.76 unless it is in far fewer entries than the other
CUT_OFF = 0.8  # likeness of a word and its opening letters
FIELDS = ("generated_relation", "relation")
# Words that may stand between the two words of an entry, or around an entry that is a single word; they weigh nothing.
BETWEEN = "of the a an at in for this that to by on with s is and its".split()
AROUND = "i think it is the relation answer label likely certain high confidence probably would be this a an that so my final s sure low medium".split()
GLUE = "|of|ofthe|ofa|ofan|ofthis|at|atthe|ata|atan|in|inthe|ina|inan|for|forthe|fora|foran|s|a|an|the".split("|")
WORD = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def osa(tokens: list[str], words: list[str]) -> np.ndarray:
    """d[i, p]: optimal string alignment distance of words[p] and the first i characters of tokens[p], for i up to the longest token. Strings have at most 100 characters."""
    n, m = max(map(len, tokens)), max(map(len, words))
    code = lambda xs, k: np.array([x.ljust(k, "\0") for x in xs], f"<U{k}").view(np.uint32).reshape(len(xs), k).T.copy()
    t, w, wl = code(tokens, max(n, 1)), code(words, max(m, 1)), np.array([len(x) for x in words])
    t[t == 0] = 0xFFFFFFFF  # padding equals nothing
    out = np.zeros((n + 1, len(tokens)), np.int8)
    d = np.zeros((3, n + 1, len(tokens)), np.int8)  # the last rows of the programme, by word characters; each step works on all pairs
    d[0] = np.arange(n + 1, dtype=np.int8)[:, None]
    out[:, wl == 0] = d[0][:, wl == 0]
    before, x = np.zeros((n, len(tokens)), bool), np.empty(len(tokens), np.int8)
    for j in range(1, m + 1):
        a, b, c = d[j % 3], d[(j - 1) % 3], d[(j - 2) % 3]
        a[0] = j
        other = t[:n] != w[j - 1]
        for i in range(1, n + 1):
            np.minimum(b[i], a[i - 1], out=x)
            x += 1
            np.minimum(x, b[i - 1] + other[i - 1], out=a[i])
            if i > 1 and j > 1:
                swap = np.flatnonzero(~(before[i - 1] | other[i - 2]))
                if len(swap):
                    a[i, swap] = np.minimum(a[i, swap], c[i - 2, swap] + 1)
        before = other
        at = wl == j
        out[:, at] = a[:, at]
    return out


def begins(x: str, word: str, whole: bool = False) -> bool:
    """Whether at most one edit (a letter more, less or other, or two swapped) makes x the opening of the word, or the whole word."""
    n = min(len(x), len(word))
    i = 0
    while i < n and x[i] == word[i]:
        i += 1
    rests = (x[i:], word[i:]), (x[i + 1 :], word[i:]), (x[i:], word[i + 1 :]), (x[i + 1 :], word[i + 1 :])
    if i + 1 < n and x[i] == word[i + 1] and x[i + 1] == word[i]:
        rests += ((x[i + 2 :], word[i + 2 :]),)
    return any(a == b if whole else b.startswith(a) for a, b in rests)


def slips(word: str) -> int:
    """Edits up to which a token still means the word."""
    return 3 if len(word) >= 8 else 2 if len(word) >= 6 else 1 if len(word) >= 4 else 0


def likeness(edits: int, size: int) -> float:
    return 1 - 0.25 * edits / max(size, 1)


def nearest(found: dict) -> dict:
    """Only the best if it needs no edit, else those within one edit of it: an exact word is never taken for a similar one."""
    least = min(found.values(), default=0)
    return {k: d for k, d in found.items() if d <= least + (least > 0)}


@functools.lru_cache(100_000)
def glue_cost(x: str) -> int:
    """Edits that make x a connective, 9 if more than one."""
    if x in GLUE:
        return 0
    if len(x) > 8:
        return 9
    return 1 if len(x) < 2 or any(begins(x, g, True) for g in GLUE[1:]) else 9


def period(token: str) -> str:
    """The token, or what it repeats: copies of at least four letters without separators, the last of which may break off."""
    n = len(token)
    if n < 8:
        return token
    fail, k = [0] * n, 0
    for i in range(1, n):
        while k and token[i] != token[k]:
            k = fail[k - 1]
        k += token[i] == token[k]
        fail[i] = k
    p = n - fail[-1]
    return token[:p] if p >= 4 and n >= 2 * p else token


class Segments:
    """Index of the forms by the pieces that some of must be left whole: with at most k edits one of k + 1 pieces of a form stands in the token within k places.

    A swap of two letters over the border of two pieces spoils both, so a form is also listed with each choice of borders swapped and as many
    edits fewer.
    """

    def __init__(self, forms: list[str]):
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.lengths: set[int] = set()
        for f, form in enumerate(forms):
            k = min(slips(form), max(0, len(form) - 1))
            cuts = [len(form) * i // (k + 1) for i in range(k + 2)]
            seen = set()
            for chosen in range(1 << k):
                if chosen.bit_count() > k:
                    continue
                x = list(form)
                for i in range(k):
                    if chosen >> i & 1:
                        b = cuts[i + 1]
                        x[b - 1], x[b] = x[b], x[b - 1]
                y = "".join(x)
                seen |= {(y[a:b], a) for a, b in zip(cuts, cuts[1:])}
            for piece, a in seen:
                at[piece].append((f, a))
                self.lengths.add(len(piece))
        self.at = {p: (np.array([f for f, _ in x], np.int32), np.array([a for _, a in x], np.int16)) for p, x in at.items()}

    def candidates(self, token: str) -> np.ndarray:
        """Forms that may be within their limit of some prefix of the token."""
        out = []
        for n in self.lengths:
            for i in range(len(token) - n + 1):
                if (x := self.at.get(token[i : i + n])) is not None:
                    out.append(x[0][abs(x[1] - i) <= 3])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


class Vocabulary:
    """The reference list: entries by dataset, their words and the words' weights."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]]):
        self.exact: dict[str, dict[str, int]] = defaultdict(dict)
        self.size: dict[str, int] = defaultdict(int)
        self.forms_of: list[tuple[int, frozenset, float]] = []  # label_id, content words, squared norm: one for a label, one for another name with other words
        self.holding: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))  # by dataset and word: places in forms_of
        self.singles: dict[str, dict[str, int]] = defaultdict(dict)  # by dataset and word or glued words
        df: dict[str, int] = defaultdict(int)
        listed = []
        for label_id, dataset, label, display in sorted(entries, key=lambda e: (e[1], e[0])):
            self.size[dataset] += 1
            both = []
            for form in (label, display):
                if form:
                    self.exact[dataset].setdefault(fold(form), label_id)
                    words = [x.lower() for x in WORD.findall(CAMEL.sub(" ", form.replace("_", " ")))]
                    if (content := frozenset(x for x in words if x not in BETWEEN) or frozenset(words)) and content not in both:
                        both.append(content)
            for x in frozenset().union(*both):
                df[x] += 1
            listed += [(label_id, dataset, c) for c in both]
        n = max(1, len(entries))
        self.idf2 = {w: 1 + math.log(n / k) / math.log(max(n, 2)) for w, k in df.items()}  # squared weights, from 1 (in all entries) to 2
        for label_id, dataset, content in listed:
            if len(content) == 1:
                self.singles[dataset].setdefault(next(iter(content)), label_id)
            else:
                for w in content:
                    self.holding[dataset][w].append(len(self.forms_of))
                self.forms_of.append((label_id, content, sum(self.idf2[w] for w in content)))
        self.sorted_singles = {d: sorted(x) for d, x in self.singles.items()}
        forms = {}
        for w in df:
            for f in (w, w + "s", w + "es", w[:-1] + "ies" if w.endswith("y") else w + "s") if len(w) > 3 else (w,):
                forms.setdefault(f, w)
        forms = {f: w for f, w in forms.items() if len(f) <= 90}  # longer words are matched whole only
        self.forms, self.base = list(forms), list(forms.values())
        self.long = {w for w in df if w not in forms}
        self.limit = np.array([slips(f) for f in self.forms])
        self.length = np.array([len(f) for f in self.forms])
        self.front, self.back = Segments(self.forms), Segments([f[::-1] for f in self.forms])
        # a token longer than two words, their edits and a connective is none of them
        self.longest = 2 * (int(self.length.max(initial=0)) + 3) + 9
        self.kept: dict[str, tuple] = {}
        self.known: dict[tuple[str, str], int] = {}

    def repair(self, tokens: set[str]) -> None:
        """Join the tokens not known yet with the vocabulary. kept[token]: (words [(word, edits)], splits [(first, second, edits)], openings [(word, rest, edits)])."""
        new = sorted((t for t in tokens if t not in self.kept), key=len)
        if len(self.kept) > CACHE:
            self.kept.clear()
            new = sorted(tokens, key=len)
        for t in new:
            if len(t) > self.longest:
                self.kept[t] = ([(t, 0)] if t in self.long else [], [], [])
        new = [t for t in new if len(t) <= self.longest]
        block: list[tuple[str, np.ndarray, np.ndarray]] = []
        held = 0
        for t in new:
            a = self.front.candidates(t)
            b = self.back.candidates(t[::-1]) if len(t) >= 6 else np.zeros(0, np.int32)
            block.append((t, a, b))
            held += (len(a) + len(b)) * (len(t) + 1)
            if held > CELLS:
                self.join(block)
                block, held = [], 0
        self.join(block)

    def distances(self, block: list[tuple[str, np.ndarray]], turned: bool) -> list[np.ndarray]:
        """Of each token and its candidates: d[i, c], the edits from form c to the token's first (turned: last) i characters."""
        tokens = [t[::-1] if turned else t for t, fs in block for _ in range(len(fs))]
        words = [self.forms[f][::-1] if turned else self.forms[f] for _, fs in block for f in fs]
        d = osa(tokens, words) if tokens else np.zeros((1, 0), np.int8)
        ends = np.cumsum([len(fs) for _, fs in block])
        return [d[:, e - len(fs) : e] for e, (_, fs) in zip(ends, block)]

    def join(self, block: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        front, back = self.distances([(t, a) for t, a, _ in block], False), self.distances([(t, b) for t, _, b in block], True)
        for (t, fs, bs), f, b in zip(block, front, back):
            n = len(t)
            whole = f[n] if len(fs) else f[0]
            least: dict[str, int] = {}
            for k in np.nonzero(whole <= (self.limit[fs] if n > 3 and t not in BETWEEN else 0))[0]:
                w = self.base[fs[k]]
                least[w] = min(least.get(w, 9), int(whole[k]))
            words = sorted(nearest(least).items(), key=lambda p: (p[1], p[0]))
            splits, opening = {}, {}
            if n >= 6 and not (words and words[0][1] == 0):
                heads = self.ends(f, fs, n)
                tails = self.ends(b, bs, n)
                for a, i, d in heads:
                    for c, j, e in tails:
                        if i + j <= n and d + e <= 3 and (g := glue_cost(t[i : n - j])) + d + e <= 4:
                            splits[a, c] = min(splits.get((a, c), 9), g + d + e)
                    if d <= 1 and n > i:
                        for g in GLUE:
                            if t.startswith(g, i) and n - i - len(g) >= 2:
                                key = (a, t[i + len(g) :])
                                opening[key] = min(opening.get(key, 9), d)
            self.kept[t] = (words, [(a, c, d) for (a, c), d in nearest(splits).items()], [(a, r, d) for (a, r), d in opening.items()])

    def ends(self, d: np.ndarray, fs: np.ndarray, n: int) -> list[tuple[str, int, int]]:
        """(word, characters, edits) of the forms that the token begins with."""
        at, k = np.nonzero(d[: n + 1] <= self.limit[fs])
        ok = (at >= self.length[fs[k]] - 2) & (at >= 3)
        return [(self.base[fs[c]], int(i), int(d[i, c])) for i, c in zip(at[ok], k[ok])]

    def entry(self, dataset: str, value: str) -> int:
        """The entry's id, or -1 for none."""
        if (x := self.known.get((dataset, value))) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            x = self.known[dataset, value] = self.best(dataset, value)
        return x

    def best(self, dataset: str, value: str) -> int:
        core = clean(value)
        if (x := self.exact[dataset].get(fold(core))) is not None:
            return x
        tokens = tokens_of(core)
        if not tokens:
            return -1
        lines = [tokens, *(tokens_of(y) for y in core.split("\n") if y.strip())] if "\n" in core and self.singles[dataset] else [tokens]
        found = self.ranked(dataset, tokens)
        for line in lines if self.singles[dataset] else ():
            found = max(found, self.single(dataset, line))
        score, _, ids = found
        return ids[0] if score >= LEAST and len(ids) == 1 else -1

    def ranked(self, dataset: str, tokens: list[str]) -> tuple[float, int, tuple[int, ...]]:
        """The best window of the entries of several words: (score, minus its place, ids). More than one id: the last word is cut off and several are equally like it."""
        hits: list[tuple[int, dict[str, float]]] = []  # place and what may stand there, a reading after the other
        weight = [0.0] * (len(tokens) + 1)  # of the words before each place
        for at, t in enumerate(tokens):
            words, splits, openings = self.kept[t]
            readings = [{w: likeness(d, len(w))} for w, d in words] + [{a: likeness(d, len(t)), b: likeness(d, len(t))} for a, b, d in splits]
            if at == len(tokens) - 1 and not splits:
                readings += [{a: likeness(d, len(a))} for a, _, d in openings]
            hits += [(at, r) for r in readings]
            own = 0.0 if t in BETWEEN or len(t) <= 5 and glue_cost(t) <= 1 and not words else max((self.idf2[w] for r in readings for w in r), default=2.0)
            weight[at + 1] = weight[at] + own
        holding = self.holding[dataset]
        bound: dict[int, dict[str, float]] = {}
        for _, r in hits:
            for w, s in r.items():
                for e in holding.get(w, ()):
                    x = bound.setdefault(e, {})
                    x[w] = max(x.get(w, 0.0), s)
        last = tokens[-1]
        rests = [last] if not self.kept[last][1] else []
        rests += [r for _, r, _ in self.kept[last][2]]
        rests = [r for r in dict.fromkeys(rests) if len(r) >= 2]
        best: tuple[float, int, tuple[int, ...]] = (0.0, 0, ())
        for e, have in bound.items():
            label_id, content, norm = self.forms_of[e]
            cut = {}
            for w in content - have.keys():
                if (x := max((self.opening(r, w) for r in rests), default=0.0)) > 0:
                    cut[w] = x
            for more in ({}, cut) if cut else ({},):
                both = {**have, **more}
                own = sum(self.idf2[w] for w in both)
                top = sum(self.idf2[w] * s for w, s in both.items()) / math.sqrt(norm * own)
                if top < LEAST or top < best[0] - 1e-9:
                    continue
                score, at = self.window(content, norm, hits, weight, more, len(tokens) - 1)
                if score > best[0] + 1e-9 or abs(score - best[0]) <= 1e-9 and -at > best[1]:
                    best = (score, -at, (label_id,))
                elif more and abs(score - best[0]) <= 1e-9 and -at == best[1] and label_id not in best[2]:
                    best = (best[0], best[1], (*best[2], label_id))
        return best

    def opening(self, rest: str, word: str) -> float:
        """Likeness of a word and its opening letters, or 0."""
        n = len(rest)
        if n > len(word) + 1 or rest == word:
            return 0.0
        if word.startswith(rest):
            return CUT_OFF
        return CUT_OFF - 0.1 if n >= 4 and begins(rest, word) else 0.0

    def window(self, content: frozenset, norm: float, hits: list, weight: list[float], cut: dict[str, float], end: int) -> tuple[float, int]:
        """The best score of a window that begins and ends with words of the entry, and where it ends. cut: the entry's words that the last token, at `end`, may begin."""
        own: dict[int, list[tuple[dict[str, float], float]]] = {}  # by place: the readings that hold words of the entry, with the weight of their other words
        for at, r in hits:
            inside = {w: s for w, s in r.items() if w in content}
            if inside:
                own.setdefault(at, []).append((inside, sum(self.idf2[w] for w in r if w not in content)))
        if cut:
            before = [i for i, _ in own.get(end, ())]  # a glued token: its first word is whole, the second cut off
            own[end] = [({**i, w: s}, 0.0) for w, s in cut.items() for i in (before or [{}]) if w not in i]
        best, most = 0.0, 0
        # of a run of places that read alike only the first and the last can bound the best window
        line = list(own.items())
        line = [x for k, x in enumerate(line) if not (0 < k < len(line) - 1 and line[k - 1][1] == x[1] == line[k + 1][1])]
        top: dict[str, float] = {}
        for _, readings in line:
            for inside, _ in readings:
                for w, s in inside.items():
                    top[w] = max(top.get(w, 0.0), s)
        bound = sum(self.idf2[w] * s for w, s in top.items()) / math.sqrt(norm * sum(self.idf2[w] for w in top)) if top else 0.0
        for k, (start, _) in enumerate(line):
            have: dict[str, float] = {}
            mine = dot = less = 0.0  # less: weight of the entry's places
            for at, readings in line[k:]:
                inside, more = max(readings, key=lambda x: (sum(self.idf2[w] * max(0.0, s - have.get(w, 0.0)) for w, s in x[0].items()), -x[1]))
                less += weight[at + 1] - weight[at] - more
                gain = False
                for w, s in inside.items():
                    if s > have.get(w, 0.0):
                        mine += 0.0 if w in have else self.idf2[w]
                        dot += self.idf2[w] * (s - have.get(w, 0.0))
                        have[w] = s
                        gain = True
                others = max(0.0, weight[at + 1] - weight[start] - less)
                if gain and (score := dot / math.sqrt(norm * (mine + others))) > best + 1e-9:
                    best, most = score, at
                if others > norm / LEAST**2 or have == top:  # no further word makes up for these, or there is none
                    break
            if best > bound - 1e-9:
                break
        return best, most

    def single(self, dataset: str, tokens: list[str]) -> tuple[float, int, tuple[int, ...]]:
        """An entry of one content word against all words of a line: repeated copies count once, words of AROUND nothing."""
        words = self.singles[dataset]
        rest = [t for t in tokens if t in words or t not in AROUND and t not in BETWEEN]
        best: tuple[float, int, tuple[int, ...]] = (0.0, 0, ())
        if not rest:
            return best
        offers: dict[str, float] = {}
        for t in set(rest):
            for w, d in self.kept[t][0] if t in self.kept else ():
                if w in words:
                    offers[w] = max(offers.get(w, 0.0), likeness(d, len(w)))
            for a, b, d in self.kept[t][1] if t in self.kept else ():
                if a == b and a in words:
                    offers[a] = max(offers.get(a, 0.0), likeness(d, len(t)))
            for a, r, d in self.kept[t][2] if t in self.kept else ():
                if a in words and (r in AROUND or r in BETWEEN or a.startswith(r)):
                    offers[a] = max(offers.get(a, 0.0), likeness(d, len(a)))
        t = rest[-1]
        if len(t) >= 3 and not offers:
            some = self.sorted_singles[dataset]
            i = bisect_left(some, t)
            for w in some[i : i + 2]:  # two are enough to see that it is not one
                if w.startswith(t) and w != t:
                    offers[w] = CUT_OFF
        for w, s in offers.items():
            near = lambda t, w=w: any(x == w for x, _ in self.kept[t][0]) or any(w in (a, b) for a, b, _ in self.kept[t][1]) or any(a == w for a, _, _ in self.kept[t][2]) or len(t) >= 2 and w.startswith(t)
            others = sum(2.0 for t in set(rest) if not near(t))
            score = s * self.idf2[w] / math.sqrt(self.idf2[w] * (self.idf2[w] + others))
            if score > best[0] + 1e-9:
                best = (score, 0, (words[w],))
            elif abs(score - best[0]) <= 1e-9 and words[w] not in best[2]:
                best = (score, 0, (*best[2], words[w]))
        return best


@functools.lru_cache(4)
def vocabulary(entries: tuple) -> Vocabulary:
    """The worker's vocabulary of these entries: the tokens it has repaired serve its later tasks too."""
    return Vocabulary(list(entries))


def fold(x: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", x).lower().split())


def tokens_of(core: str) -> list[str]:
    return [period(t.lower()) for t in WORD.findall(core.replace("_", " "))]


def clean(value: str) -> str:
    """The value without think blocks, in compatibility form and without invisible characters."""
    x = THINK_OPEN.sub(" ", THINK_CLOSED.sub(" ", value))
    x = unicodedata.normalize("NFKC", x)
    return "".join(c for c in x if unicodedata.category(c) != "Cf").strip()


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """values: (id long, field string, dataset string, value string) -> (id, field, value, label_id long).

    One row for each row whose value is a case: not null, blank, empty as an answer, a none word, or byte for byte a label of its dataset.
    label_id is -1 if the value means no entry, also for a null dataset or one without entries. Repeated rows are mapped alike, further
    columns of values are not carried, and of two equal scores the entry found first in the value counts, then the smaller id.
    """
    listed = entries.select("label_id", "dataset", "label", "display_name").where("label is not null and dataset is not null").limit(MAX_ENTRIES + 1).collect()
    if len(listed) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    rows = tuple(sorted((tuple(r) for r in listed), key=str))
    labels = defaultdict(set)
    for _, dataset, label, _ in rows:
        labels[dataset].add(label)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(rows) if rows else None
        for pdf in batches:
            pdf = pdf[[v not in labels.get(d, ()) for d, v in zip(pdf["dataset"], pdf["value"])]]
            keys = list(dict.fromkeys(zip(pdf["dataset"], pdf["value"])))
            keep = {k: -1 for k in keys if not is_none_word(k[1]) and not is_empty(k[1])}
            if voc:
                todo = [k for k in keep if k[0] in voc.size]
                todo = [k for k in todo if k not in voc.known or keep.update({k: voc.known[k]})]
                voc.repair({t for _, v in todo for t in tokens_of(clean(v))})
                for k in todo:
                    keep[k] = voc.entry(*k)
            ids = [keep.get(k) for k in zip(pdf["dataset"], pdf["value"])]
            pdf = pdf.assign(label_id=ids)
            yield pdf[pdf["label_id"].notna()].astype({"label_id": "int64"})[["id", "field", "value", "label_id"]]

    known = F.broadcast(entries.select(F.col("dataset").alias("_d"), F.col("label").alias("_l")).distinct())
    todo = values.select("id", "field", "dataset", "value").where("trim(value) <> ''")
    todo = todo.join(known, (todo["dataset"] == known["_d"]) & (todo["value"] == known["_l"]), "left_anti")
    return todo.mapInPandas(mapped, "id long, field string, value string, label_id long")


def generation_values(generation: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")
    return generation.select(F.col("gen_id").alias("id"), F.col("eval_dataset_name").alias("dataset"), pairs).select("id", "dataset", "x.field", "x.value")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each case of the two fields of generation with the entry it means."""
    found = map_values(generation_values(read(spark, sf, "generation")), read(spark, sf, "label_schema"))
    return found.select(F.col("id").alias("gen_id"), "field", "label_id")


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The report: values that mean no entry, with the rows that have them."""
    found = map_values(generation_values(read(spark, sf, "generation")), read(spark, sf, "label_schema"))
    return found.where("label_id = -1").groupBy("field", "value").agg(F.count("*").alias("n_rows"))
