"""Problem 3: broken prompt and response pairs.

Method: a multi-label linear classifier (one logistic regression for each defect) on hashed word and character n-grams of the response, the
mentions masked, and on features of the pair (what the response shares with the prompt, how it ends, whether a label breaks off, which of its
words are English). It is trained on synthetic responses: labels and answers of a bounded sample of prompts are truncated, copied, swapped,
refused and put in other languages; each defect's threshold is calibrated on held-out synthetic pairs. `empty` follows from its definition.

No answer of the table is a training text. Refusals and broken sentences are put together of general word classes; other languages are learnt
from the foreign documents and from words that a public tokenizer's vocabulary for many languages has and its English one has not, in random
runs; plain answers are random runs of English words, also after words of denial, and invented words.

Rows are judged where they are scanned: no shuffle, and a prompt that holds a third of all rows is no hot key. The fit sees SAMPLE_PROMPTS
distinct prompts and SAMPLE_TEXTS distinct foreign texts, drawn by their hash from the whole tables; the thresholds and weights are of fixed
size. The two vocabulary files are read by the driver only.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import THINK_CLOSED, is_empty, is_none_word, read
from .labels import BETWEEN, CAMEL, GLUE, Vocabulary

SAMPLE_PROMPTS, SAMPLE_TEXTS = 1000, 600  # bounds of the sample the classifier is fitted on
MAX_ENTRIES = 100_000  # of the reference list, which every task holds
WIDTH, DENSE = 1 << 16, 56  # hashed and pair features
DEFECTS = ("truncated", "refusal", "copy", "language")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
END = ".!?。！？؟…"
QUOTES = "\"'”’»)]*`"

LEXICONS = "/opt/tokenizers"  # or QUERN_LEXICONS: folder of the two vocabularies, of English and of many languages, with a word's rank
ENGLISH, MANY = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
# Closed-class words (articles, prepositions, pronouns, conjunctions, forms of to be and to have) of languages in Latin letters.
CLOSED = {
    "en": "a an the of to in on at by for from with as into about over under after before between and or but if than that this these those who which whose it its he him his she her they them their we us our you your i me my is are was were be been am do does did has have had not no so up out off all both each other one",
    "fr": "le la les l un une des du de d à au aux en dans sur sous par pour avec sans chez et ou mais que qui ne pas ce cette ces son sa ses leur leurs il elle ils elles je nous vous est sont été était a ont se",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht von vom zu zum zur mit bei in im an am auf aus für über unter nach vor ist sind war waren hat haben wird er sie es ich wir ihr sich sein seine ihre",
    "es": "el la los las un una unos unas de del a al en con por para sin sobre entre y o pero que no es son era fue está ha han se su sus él ella ellos lo le les yo",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai in nel nella con per da dal dalla su sul tra fra e o ma che non è sono era ha hanno si suo sua loro lui lei egli",
    "pt": "o a os as um uma de do da dos das em no na nos nas ao à por pelo pela para com sem e ou mas que não é são foi era está tem se seu sua ele ela eles",
    "nl": "de het een van in op aan bij met voor door uit naar over te en of maar niet is zijn was waren heeft hebben wordt hij zij ze het hun haar dat die",
    "sv": "en ett den det de av i på till för med från om och eller men inte är var har hade som han hon sin sina vid hos",
    "da": "en et den det de af i på til for med fra om og eller men ikke er var har havde som han hun sin sit ved hos",
    "pl": "w we z ze na do od dla o po przy przez u i oraz lub ale nie jest są był była być się to ten ta jego jej ich on ona oni który która",
    "cs": "v ve z ze na do od pro o po při u s se i a nebo ale ne je jsou byl byla být to ten ta jeho její jejich on ona který která",
    "tr": "ve veya ama ile için bir bu şu o da de mi ne gibi kadar değil olan olarak onun",
    "ro": "un o de la în din cu pe pentru prin și sau dar nu este sunt era a au se lui ei său",
    "hu": "a az egy és vagy de nem van volt hogy ki aki mint meg el be",
    "fi": "ja tai mutta ei on ovat oli se hän he joka kanssa",
}
CLOSED = {k: v.split() for k, v in CLOSED.items()}
OWN = frozenset(CLOSED["en"])
OTHERS = frozenset(w for k, v in CLOSED.items() if k != "en" for w in v) - OWN
# Word classes that refusals are put together of; {v} is a verb of VERBS, {n} a noun of NOUNS.
OPENERS = ["", "", "", "Sorry, ", "I'm sorry, ", "I am sorry, but ", "I’m sorry, ", "Unfortunately, ", "Apologies, but ", "I apologize, but ", "Regrettably, ", "Well, ", "As an AI, ", "As an AI assistant, ", "As an AI language model, ", "As a language model, ", "Based on this alone, "]
DENIALS = ["I cannot {v}", "I can't {v}", "I can’t {v}", "I could not {v}", "I couldn't {v}", "I am unable to {v}", "I'm unable to {v}", "unable to {v}", "cannot {v}", "I am not able to {v}", "I'm not able to {v}", "I will not {v}", "I won't {v}", "I do not wish to {v}", "I must decline to {v}", "I decline to {v}", "I refuse to {v}", "I prefer not to {v}", "I would rather not {v}", "it is impossible to {v}", "it is not possible to {v}", "it is impossible for me to {v}", "it is not possible for me to {v}", "there is no way to {v}", "I do not know how to {v}", "I don't {v}", "I do not {v}", "I don’t {v}", "there is not enough {n} to {v}", "there is too little {n} to {v}", "I do not have enough {n} to {v}", "I don't have enough {n} to {v}", "I lack the {n} to {v}", "insufficient {n} to {v}", "the {n} does not allow me to {v}", "no {n} is given to {v}"]
VERBS = "answer|tell|say|determine|decide|identify|judge|name|label|classify|infer|conclude|provide|give|help with|comment on|speculate about|guess|respond to|assist with|comply with|choose|establish|know|fulfil".split("|")
DENYING = frozenset("cannot can't can’t couldn't couldn’t won't won’t don't don’t unable not refuse decline impossible insufficient".split())
ANSWERING = frozenset(v for v in VERBS if " " not in v)
NOUNS = "information|context|detail|evidence|text|data|knowledge|background".split("|")
OBJECTS = ["", " this", " that", " it", " this pair", " this request", " this question", " the relation", " the label", " a relation", " an answer", " the requested relation", " the relation of these entities", " how they are related", " the relation between {a} and {b}", " from this text", " that from the text given"]
TAILS = ["", "", ".", ".", "!", ". More context is needed.", ". Please give more text.", ". Could you provide more context?"]
# Word classes that sentences are put together of before they are broken off.
THINGS = "relation|link|tie|connection|label|answer|bond|category".split("|")
TEXTS = "text|passage|sentence|paragraph|excerpt|example".split("|")
LEADS = ["Looking at the {t}, ", "Reading the {t}, ", "Given the {t}, ", "Judging by the {t}, ", "According to the {t}, ", "Based on the {t}, ", "In the {t}, ", "From the {t} ", "Here ", ""]
CLAUSES = ["the {k} between {a} and {b} is", "the {k} of {a} and {b} would be", "the {k} that fits best is", "the best {k} here would be the", "{a} and {b} are described as", "{a} and {b} appear as the", "{a} seems to be the", "{a} was the", "{b} is called a", "the two names share a", "the two are joined by the", "the {t} says that {s}", "the {t} mentions {a} and", "it is said that {s}", "we can see that {s}", "it seems that {s}", "{s}"]
THOUGHTS = ["{s}", "The {t} names {a} and {b}. {s}", "The {k} has to be found. {s}", "I should read the {t} first. {s}"]
# Words of denial in answers that are no refusals: what follows is no verb of VERBS.
WITHOUT = "unable to|not able to|cannot|can't|could not|never|not|no longer|sorry for|sorry about|refuses to|refused to|declines|unwilling to|without|will not|won't|knows nothing about|impossible to|doubts".split("|")
WRAPS = ["{x}", "{x}", "{x}", "{x}", "{x}", "{x} / {x} / {x} / {x} / {x} / {x}", "{x}\n{x}\n{x}\n{x}\n{x}", "{x}, {x}, {x}, {x}, {x}, {x}", "Answer: {x}", "answer : {x}", "The {k} is {x}.", "I think it is {x}", "I would say {x}", "{x} (probably)", "{x} (sure)", "{{\"relation\": \"{x}\"}}", "**{x}**", "`{x}`", "- {x}", "\"{x}\"", "{x}\n", "  {x} ", "<think>\n{s}\n</think>\n\n{x}", "<think>\nyes\n</think>\n{x}", "{x}\nReason: {s}", "{x}, {x}", "{x} / {x} / {x}", "{x}\n{x}", "{x}.", "Label: {x}", "The best {k} here is {x}.", "It must be {x}, from the {t}."]


def lexicons(folder: str) -> dict[str, float]:
    """Words of the two vocabularies, from 0.4 to 1 for English ones and -1 for those of other languages only; openings of English words are not listed."""

    def ranks(name: str) -> dict[str, int]:
        out = {}
        with open(os.path.join(folder, name), "rb") as f:
            for line in f:
                piece, rank = line.split()
                w = base64.b64decode(piece).decode("utf-8", "ignore")
                if w[:1] == " " and w[1:].isalpha() and w[1:].islower() | (w[1:].upper() == w[1:].lower()):
                    out[w[1:]] = int(rank) + 1
        return out

    english, many = ranks(ENGLISH), ranks(MANY)
    openings = {w[:n] for w in english for n in range(3, len(w))}
    british = lambda w: w.replace("our", "or").replace("is", "iz")
    out = {w: 1.0 if w not in many else max(0.4, min(1.0, math.log2(many[w] / r))) for w, r in english.items() if len(w) > 1}
    out |= {w: -1.0 for w in OTHERS if len(w) <= 3 or w in many and 4 * many[w] < english.get(w, 1 << 20)}
    out |= {w: 1.0 for w in OWN}
    out |= {w: -1.0 for w in many if w not in english and w not in openings and not inflects(w, out) and not inflects(british(w), out)}
    return out


def inflects(w: str, tongue: dict[str, float]) -> bool:
    """Whether w is an English word, an inflection of one, or one with an opening of negation or repetition."""
    if tongue.get(w, 0) > 0.3:
        return True
    for end in ("s", "es", "d", "ed", "ing", "er", "ly", "'s", "’s"):
        if w.endswith(end) and len(w) > len(end) + 2 and max(tongue.get(w[: -len(end)], 0), tongue.get(w[: -len(end)] + "e", 0)) > 0.3:
            return True
    return len(w) > 4 and w[:2] in ("un", "re") and tongue.get(w[2:], 0) > 0.3


class Prompt:
    """What a prompt is made of: its sentence, question and mentions, as far as they are there."""

    def __init__(self, prompt: str):
        self.text = prompt
        body = prompt[i + 11 :] if (i := prompt.find('Sentence: "')) >= 0 else prompt
        j = body.find('"\nFirst:')
        self.sentence = body[:j] if j >= 0 else body.split("\n")[0]
        lines = [x for x in prompt.split("\n") if x.strip()]
        self.mentions = [x.split(":", 1)[1].strip() for x in lines if x.startswith(("First:", "Second:"))]
        self.question = next((x for x in reversed(lines) if x.rstrip().endswith("?")), "")


def mention_words(prompt: str) -> frozenset[str]:
    i = prompt.rfind("\nFirst:")
    if i < 0:
        return frozenset()
    part = prompt[i:].split("\n", 3)[:3]
    return frozenset(w for x in part if ":" in x for w in TOKEN.findall(x.split(":", 1)[1].lower()))


def grams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:]))


class Extractor:
    """Features of a pair: numbers of the hashed ones with their values, then the pair features."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]], tongue: dict[str, float]):
        voc = Vocabulary(entries)
        # some words of other languages are left out, so that the fit meets words that are not listed
        self.tongue = {w: v for w, v in tongue.items() if v > 0 or w in OTHERS or zlib.crc32(w.encode()) % 5 < 3}
        self.openings = {w[:n] for w, v in tongue.items() if v > 0 for n in range(2, len(w))}
        self.words = set(voc.forms)
        self.stems: dict[str, bool] = {}
        for w in voc.idf2:
            for n in range(2, len(w) - 2):  # a cut drops at least three letters
                self.stems[w[:n]] = True
        self.pieces = {w[i : i + 4] for w in self.words for i in range(len(w) - 3)}
        self.with_bigram: dict[str, list[str]] = {}
        for w in self.words:
            for b in {w[i : i + 2] for i in range(len(w) - 1)}:
                self.with_bigram.setdefault(b, []).append(w)
        self.near: dict[str, float] = {}
        self.prompts: dict[str, tuple] = {}

    def nearness(self, token: str) -> float:
        """Largest Dice similarity of the token's bigrams and those of a label word."""
        if (x := self.near.get(token)) is None:
            if len(self.near) > 50_000:
                self.near.clear()
            own = {token[i : i + 2] for i in range(len(token) - 1)}
            shared: dict[str, int] = {}
            for b in own:
                for w in self.with_bigram.get(b, ()):
                    shared[w] = shared.get(w, 0) + 1
            x = self.near[token] = max((2 * n / (len(own) + len(w) - 1) for w, n in shared.items()), default=0.0)
        return x

    def english(self, w: str) -> float:
        """From 1 (an English word or its inflection) to -1 (a word of another language), 0 for neither."""
        return self.tongue.get(w) or float(inflects(w, self.tongue))

    def cut_label(self, ws: list[str]) -> bool:
        """Whether the response is label words of which the last breaks off."""
        last, rest = ws[-1], ws[:-1]
        known = [w for w in rest if w not in BETWEEN]
        if last in self.stems and last not in self.words and known and known[-1] in self.words:
            return True
        if len(last) >= 6 and last not in self.words:  # without separators
            for n in range(len(last) - 2, 3, -1):
                if last[:n] in self.words:
                    return any(last.startswith(g, n) and last[n + len(g) :] in self.stems for g in GLUE)
        return False

    def parts(self, prompt: str) -> tuple:
        if (x := self.prompts.get(prompt)) is None:
            if len(self.prompts) > 300:
                self.prompts.clear()
            p = Prompt(prompt)
            s, q, t = (TOKEN.findall(y.lower()) for y in (p.sentence, p.question, p.text))
            x = self.prompts[prompt] = (set(t), grams(t), grams(s), grams(q))
        return x

    def pair(self, prompt: str, response: str, ws: list[str], shown: list[str], masked: int) -> dict[int, float]:
        n = len(ws)
        core = response.strip()
        tail = core.rstrip(QUOTES)
        ended = bool(tail) and tail[-1] in END
        bare = THINK_CLOSED.sub(" ", response)
        thinks = "<think>" in bare.lower()
        split = [w.lower() for w in TOKEN.findall(CAMEL.sub(" ", core.replace("_", " ")))]
        d = {0: 1.0}
        d[1 if n <= 1 else 2 if n <= 3 else 3 if n <= 5 else 4 if n <= 8 else 5] = 1.0
        letters = [c for c in core if c.isalpha()]
        foreign = sum(ord(c) > 0x36F and not 0x1E00 <= ord(c) <= 0x1FFF and not 0xFF00 <= ord(c) <= 0xFF5E or 0x370 <= ord(c) <= 0x3FF for c in letters)
        if letters and foreign / len(letters) > 0.3:
            d[6] = 1.0
        elif foreign:
            d[7] = 1.0
        label = any(w in self.words for w in split[-4:])
        if split and n <= 12 and self.cut_label(split):
            d[8] = 2.0
        if label:
            d[9] = 1.0
        if split and split[-1] in self.words:
            d[10] = 1.0
        if thinks:
            d[11] = 2.0
        elif "<think>" in response.lower():
            d[12] = 1.0
        d[13 if ended else 14] = 1.0
        if n >= 5 and not ended and not label:
            d[15] = 1.0
        if n >= 5 and core[:1].isupper() and not ended:
            d[16] = 1.0
        if len(core) < 120:
            tri = [w[i : i + 4] for w in split if w not in BETWEEN for i in range(len(w) - 3)]
            like = sum(x in self.pieces for x in tri) / max(1, len(tri))
            d[35] = like
            d[36] = float(like > 0.25)
            d[37] = float(like > 0.5)
            near = [self.nearness(w) for w in split if len(w) > 3 and w not in BETWEEN]
            d[38] = sum(near) / len(near) if near else 0.0
            d[39] = 2.0 * (d[38] > 0.55)
        short = len(core) < 120
        said = shown[1:] if shown[:1] in (["answer"], ["label"]) else shown
        rest = [w for w in said if w != "\0" and not w.isdigit() and w not in self.words and not (short and len(w) > 3 and self.nearness(w) > 0.55)]
        if rest:
            values = [self.english(w) for w in rest]
            d[40] = sum(v > 0.3 for v in values) / len(rest)
            d[41] = sum(v < -0.3 for v in values) / len(rest)
            d[42] = 1 - d[40] - d[41]
            d[43] = float(d[41] > 0)
            d[44] = float(d[41] > 0 and d[40] < 0.4)
            d[45] = float(min(values) > 0.3)
            d[46] = 2.0 * (d[41] > 0.3)
            d[47] = float(d[40] == 0)
            closed = sum(w in OTHERS and self.english(w) < 0 for w in said)
            bare = sum(w in OWN for w in rest)
            if d[42] > 0 and sum(v > 0.3 for v in values) == bare:  # no English word but closed-class ones
                d[53] = 1.0
                d[54] = 2.0 * (bare > 0)
            d[50] = 2.0 * (closed > 0)
            d[51] = 2.0 * (closed > 0 and d[40] < 0.4)
        else:
            d[48] = 1.0
        if said and (w := said[-1]) != "\0" and not ended and core[-1:].isalpha() and w in self.openings and w not in self.words and self.english(w) <= 0 and not (len(w) > 4 and any(w + e in self.tongue for e in ("s", "d", "r", "ed", "ing"))) and not (short and self.nearness(w) > 0.55):
            d[52] = 2.0  # breaks off inside a word
        if not DENYING.isdisjoint(ws) and not ANSWERING.isdisjoint(ws):
            d[55] = 2.0  # denies an act of answering
        if any("\u00c0" <= c <= "\u024f" for w in shown for c in w):
            d[49] = 1.0
        if masked and n <= masked + 4:
            d[17] = 1.0
        if "'" in core or "’" in core:
            d[18] = 1.0
        if n >= 4 and prompt:
            inside, all_g, sent_g, quest_g = self.parts(prompt)
            own = grams(ws[1:] if ws[0] in ("answer", "sentence") else ws)
            share = sum(w in inside for w in ws) / n
            both = len(own & all_g) / max(1, len(own))
            sent = len(own & sent_g) / max(1, len(sent_g))
            quest = len(own & quest_g) / max(1, len(quest_g))
            for k, v in ((20, share), (21, both), (22, sent), (23, quest)):
                d[k] = v
                d[k + 4] = float(v > 0.5)
                d[k + 8] = float(v > 0.8)
            if both > 0.75 and (sent > 0.4 or quest > 0.6):
                d[32] = 2.0
            if both < 0.4:
                d[33] = 1.0
            if both > 0.75 and sent < 0.3 and quest < 0.3:
                d[34] = 1.0
        return d

    def hashed(self, ws: list[str]) -> np.ndarray:
        """Numbers of the hashed n-grams. ws: words, mentions as \\x00."""
        if len(ws) < 20:
            grams_ = ["w" + w for w in ws] + ["v" + a + " " + b for a, b in zip(["^", *ws], [*ws, "$"])]
            chars = [w for w in ws if w != "\0"]
        else:  # each distinct one once
            grams_ = ["w" + w for w in set(ws)] + ["v" + a + " " + b for a, b in set(zip(["^", *ws], [*ws, "$"]))]
            chars = list(set(ws) - {"\0"})
        for w in chars:
            x = "^" + w + "$"
            grams_ += ["c" + x[i : i + 3] for i in range(len(x) - 2)]
            if len(ws) < 20:
                grams_ += ["d" + x[i : i + 4] for i in range(len(x) - 3)]
        return np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) % WIDTH for g in grams_), np.int64, len(grams_)))

    def row(self, prompt: str, response: str, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        ws = TOKEN.findall(response.lower())
        names = mention_words(prompt)
        shown = ["\0" if w in names else w for w in ws]
        masked = shown.count("\0")
        key = None
        if kept is not None and len(ws) < 4 and not masked:
            key = response
            if (x := kept.get(key)) is not None:
                return x
        h = self.hashed(shown)
        d = self.pair(prompt, response, ws, shown, masked)
        idx = np.r_[h, np.fromiter(d, np.int64, len(d)) + WIDTH]
        val = np.r_[np.full(len(h), 1.5 / math.sqrt(max(1, len(h)))), np.fromiter(d.values(), float, len(d))]
        if key is not None:
            if len(kept) > 20_000:
                kept.clear()
            kept[key] = (idx, val)
        return idx, val


class Rows:
    """Sparse rows one after another."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.lens = np.array([len(i) for i, _ in rows], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lens)]
        self.idx = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.val * w[self.idx], self.starts[:-1]) if self.n else np.zeros(0)

    def take(self, which: np.ndarray) -> Rows:
        out = Rows([])
        out.n, out.lens = len(which), self.lens[which]
        out.starts = np.r_[0, np.cumsum(out.lens)]
        at = np.repeat(self.starts[which] - out.starts[:-1], out.lens) + np.arange(out.starts[-1])
        out.idx, out.val = self.idx[at], self.val[at]
        return out


def fit(rows: Rows, y: np.ndarray, rng: np.random.Generator, epochs: int = 8, l2: float = 1e-6) -> np.ndarray:
    """Logistic regressions, one for each row of y, by AdaGrad over shuffled blocks that all of them share."""
    w, g2 = np.zeros((len(y), WIDTH + DENSE)), np.full((len(y), WIDTH + DENSE), 1e-3)
    for _ in range(epochs):
        order = rng.permutation(rows.n)
        for k in range(0, rows.n, 256):
            which = order[k : k + 256]
            part = rows.take(which)
            used, at = np.unique(part.idx, return_inverse=True)
            own = w[:, used]
            score = np.add.reduceat(part.val * own[:, at], part.starts[:-1], axis=1)
            err = np.repeat(1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[:, which], part.lens, axis=1) * part.val
            g = np.stack([np.bincount(at, e, len(used)) for e in err]) / part.n + l2 * own
            g2[:, used] += g * g
            w[:, used] -= 0.15 * g / np.sqrt(g2[:, used])
    return w


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on held-out pairs; of equals the middle."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    k = int(best[-1])
    s = score[order]
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2)


def slip(x: str, rng: np.random.Generator) -> str:
    if len(x) < 5:
        return x
    i, kind = int(rng.integers(1, len(x) - 2)), rng.integers(4)
    return x[:i] + (x[i + 1] + x[i] + x[i + 2 :] if kind == 0 else x[i + 1 :] if kind == 1 else x[i] + x[i:] if kind == 2 else "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + x[i + 1 :])


def pick_gap(rng: np.random.Generator) -> str:
    return ["", "_", "-", ", ", "  ", ".", "::", " - "][int(rng.integers(8))]


def respell(x: str, rng: np.random.Generator) -> str:
    ws = [w.lower() for w in TOKEN.findall(CAMEL.sub(" ", x.replace("_", " ")))]
    content = [w for w in ws if w not in BETWEEN]
    k = rng.integers(14)
    if len(content) > 1:
        a, b = content[-2:]
        x = [x, x, x, f"is the {a} of this {b}", f"{a} {['for', 'at', 'in'][int(rng.integers(3))]} the {b}", f"{a} of the {b}", f"{b} {a}", f"{b}'s {a}", f"{a}Of{b.title()}", f"is the {a} of this {b}", f"{a} ({b})", f"{b}s {a}s", f"{b}/{a}", f"{a.title()} At An {b.title()}"][k]
    for _ in range(int(rng.integers(4)) if rng.random() < 0.5 else 0):
        x = slip(x, rng)
    x = x.replace(" ", pick_gap(rng)) if rng.random() < 0.25 else x
    return x.upper() if rng.random() < 0.15 else x.title() if rng.random() < 0.15 else x


def invented(parsed: list[Prompt], rng: np.random.Generator) -> str:
    """A word made of pieces of names."""
    names = [w for _ in range(3) for w in TOKEN.findall(" ".join(parsed[int(rng.integers(len(parsed)))].mentions).lower()) if len(w) > 3] or ["name"]
    return "".join(names[int(rng.integers(len(names)))][: int(rng.integers(4, 8))] for _ in range(int(rng.integers(1, 4))))


def scripts(tongue: dict[str, float]) -> list[list[str]]:
    """The words of other languages by script, Latin first."""
    by: dict[str, list[str]] = {"LATIN": []}
    for w, v in tongue.items():
        if v < -0.5:
            by.setdefault(unicodedata.name(w[0], "?").split(" ")[0], []).append(w)
    return [ws for ws in by.values() if len(ws) >= 20] or [["mot"]]


def synthetic(prompts: list[str], labels: list[str], foreign: list[str], tongue: dict[str, float], rng: np.random.Generator) -> list[tuple[str, str, str]]:
    """(prompt, response, defect or "") made of sampled prompts: answers kept, swapped, truncated, copied, refused or put in another language."""
    out: list[tuple[str, str, str]] = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    parsed = [Prompt(p) for p in prompts]
    single = [x for x in labels if len([w for w in TOKEN.findall(CAMEL.sub(" ", x.replace("_", " ")).lower()) if w not in BETWEEN]) == 1 or "relation" in x.lower()] or labels
    own = tuple(w[:5] for w in VERBS + NOUNS)  # inflections of these are no plain words either
    english = [w for w, v in tongue.items() if v > 0.9 and len(w) > 2 and not w.startswith(own)] or ["word"]
    tongues, latin = scripts(tongue), [k for k in CLOSED if k != "en"]
    some = lambda n, xs=english: [pick(xs) for _ in range(n)]
    for p in parsed:
        other, third = pick(parsed), pick(parsed)
        a, b = (p.mentions + ["the first", "the second"])[:2]
        s, o = p.sentence, other.sentence or "The end was near."
        ows = o.split()
        low = o[0].lower() + o[1:]
        fill = lambda form, a=a, b=b, **kw: form.format(a=a, b=b, k=pick(THINGS), t=pick(TEXTS), **kw)
        add = lambda x, d="", p=p: out.append((p.text, x, d))
        full = o if o.rstrip(QUOTES)[-1:] in END else o + "."
        # kept, or another answer than the right one
        for _ in range(8):
            add(fill(pick(WRAPS), x=respell(pick(single if chance(0.12) else labels), rng), s=full if chance(0.6) else " ".join(some(2))))
        for _ in range(4):
            plain = some(int(rng.integers(1, 5)))
            if chance(0.35):
                plain = [pick(WITHOUT[:6] if chance(0.6) else WITHOUT), *plain[: pick([1, 1, 2, 3])]]
            elif chance(0.5):
                plain = [invented(parsed, rng), *some(int(rng.integers(0, 2)))]
            x = pick([" ", " ", "_"]).join(plain)
            x = f"{a} {x} {b}" if chance(0.15) else x
            add(respell(x, rng) if chance(0.15) else x)
        ws = [w for w in TOKEN.findall(third.sentence.lower()) if len(w) > 3]
        if len(ws) > 4:
            k = int(rng.integers(len(ws) - 3))
            add(pick([" ", "_"]).join(ws[k : k + int(rng.integers(1, 4))] + some(int(rng.integers(2)))))
            clause = lambda xs=ows: " ".join(xs[-int(rng.integers(3, max(4, len(xs) // 2 + 1))) :]).rstrip(".!?\"”")
            add(f"{a} and {b} {pick(english)} {clause()}, and {clause(third.sentence.split())}.")
        if chance(0.2):
            add(f"{a} {pick(WITHOUT)} {pick(english)} {b}.")
        # truncated
        x = pick(labels)
        x = respell(x, rng) if chance(0.3) else x
        m = re.search(r"[^\W_]+\W*\Z", x)
        word = re.split(CAMEL, m.group(0))[-1] if m else ""
        if len(word) >= 5:
            cut = x[: len(x) - int(rng.integers(3, max(4, len(word) - 1)))]
            cut = cut if re.search(r"[^\W_]{2}\Z", cut) else x[:-3]
            add(pick(["{x}"] * 8 + ["Answer: {x}"]).format(x=cut.upper() if chance(0.1) else cut), "truncated")
        cut_at = lambda t: t[: int(rng.integers(max(1, len(t) // 8), max(2, len(t) - 8)))].rstrip(".!?,; ") if len(t) > 20 else t[:10]
        for _ in range(2):
            x = fill((pick(LEADS) if chance(0.7) else "") + pick(CLAUSES), s=cut_at(low))
            x = x[0].upper() + x[1:]
            x = x if chance(0.5) or len(x) < 20 else x[: int(rng.integers(12, len(x)))].rstrip()
            add("Answer: " + x if chance(0.15) else x, "truncated")
        if (m := re.match(r"\w+ (is|are|was|were) (.+?)\W*\Z", p.question)) and chance(0.5):  # the question restated
            x = f"{m.group(2)} {m.group(1)}"
            add(x[0].upper() + x[1:] if chance(0.7) else fill(pick(LEADS)) + x, "truncated")
        if chance(0.5):
            add("<think>\n" + fill(pick(THOUGHTS), s=cut_at(o)), "truncated")
        # refused
        for _ in range(2):
            x = pick(DENIALS).format(v=pick(VERBS), n=pick(NOUNS))
            opener = pick(OPENERS)
            x = opener + (x if opener or chance(0.3) else x[0].upper() + x[1:]) + ("" if chance(0.3) else fill(pick(OBJECTS))) + pick(TAILS)
            x = fill(pick(["{x}"] * 6 + ["Answer: {x}", "<think>\n{s}\n</think>\n{x}", "<think>\nyes\n</think>\n{x}"]), x=x, s=full if chance(0.6) else " ".join(some(2)))
            add(x.upper() if chance(0.1) else x, "refusal")
        if chance(0.8):
            x = pick(DENIALS).format(v=pick(VERBS), n=pick(NOUNS))
            add((x[0].upper() + x[1:] if chance(0.5) else x) + pick(["", "", "."]), "refusal")
        # copied
        k = rng.integers(9)
        sw = s.split()
        if len(sw) >= 5:
            most = " ".join(sw[: max(4, int(len(sw) * rng.uniform(0.6, 0.95)))])
            x = [p.text, f'Sentence: "{s}"', s, s.lower(), re.sub(r"[^\w\s]", "", s), most + ".", most, "  " + s + "\n", p.text[: -len("Answer:")] if p.text.endswith("Answer:") else p.text][k]
            add("Answer: " + x if chance(0.1) else x, "copy")
        if p.question:
            x = p.question if chance(0.7) else p.question.upper() if chance(0.5) else p.question.lower()
            add("Answer: " + x if chance(0.3) else x, "copy")
        # in another language
        for _ in range(8):
            words = tongues[0] if chance(0.7) else pick(tongues)
            run = some(int(rng.integers(1, 4)), words)
            if words is tongues[0] and chance(0.6):
                c = CLOSED[pick(latin)]
                c = [w for w in c if w in OWN] or c if chance(0.25) else c  # those that look like English ones
                run = [*run[:1], pick(c)] if chance(0.4) else [*run[:1], pick(c), *run[1:]]
            x = ("" if "぀" <= run[0][0] <= "鿿" else " ").join(run)
            cognate = lambda: (w := pick(english if chance(0.5) else THINGS))[: max(3, len(w) - int(rng.integers(1, 4)))] + pick(tongues[0])[-int(rng.integers(1, 4)) :]
            if words is tongues[0] and chance(0.15):
                x = cognate() + " " + x
            if chance(0.2):
                c = CLOSED[pick(latin)]
                lead = (cognate() if chance(0.7) else pick(THINGS)) if words is tongues[0] else pick(words)
                x = (f"{pick(c)} {lead} {pick(c)}" if words is tongues[0] and chance(0.6) else lead) + pick([": ", " : "]) + x
            if foreign and chance(0.3):
                x = pick(foreign)
            if chance(0.3):
                x = f"{a} {x} {b}" if chance(0.7) else f"{x} {b}"
            x = x[0].upper() + x[1:] if chance(0.3) else x
            add(("Answer: " if chance(0.1) else "") + x + pick(["", "", ".", "!"]), "language")
    return out


def snippets(texts: list[str], tongue: dict[str, float], rng: np.random.Generator) -> list[str]:
    """Short runs of words of texts that are not English: by their scripts, or as more of their words are other languages' than English ones."""
    out = []
    for t in texts:
        ws = TOKEN.findall(t)
        if len(ws) < 3:
            if len(t) > 6 and not t.isascii() and unicodedata.category(t[len(t) // 2]) == "Lo":
                k = int(rng.integers(len(t) - 3))
                out.append(t[k : k + int(rng.integers(4, 24))])
            continue
        values = [tongue.get(w.lower(), 0.0) for w in ws]
        latin = sum(c < "Ͱ" for w in ws for c in w) > 0.6 * sum(map(len, ws))
        if latin and sum(v < -0.3 for v in values) <= sum(v > 0.3 for v in values):
            continue
        for _ in range(4):
            k = int(rng.integers(len(ws)))
            out.append(" ".join(ws[k : k + int(rng.integers(1, 13))])[:160])
    return [x for x in out if x.strip()]


class Model:
    def __init__(self, entries: list[tuple], tongue: dict[str, float], weights: np.ndarray, cuts: np.ndarray):
        self.entries, self.tongue, self.weights, self.cuts = entries, tongue, weights, cuts


def train(prompts: list[str], entries: list[tuple], texts: list[str], seed: int = 42, folder: str | None = None) -> Model:
    rng = np.random.default_rng(seed)
    tongue = lexicons(folder or os.environ.get("QUERN_LEXICONS", LEXICONS))
    ex = Extractor(entries, tongue)
    labels = [x for e in entries for x in (e[2], e[3]) if x] or ["part of the whole"]
    pairs = synthetic(prompts, labels, snippets(texts, tongue, np.random.default_rng(seed)), tongue, rng) if prompts else []
    pairs = [p for p in pairs if not is_empty(p[1])]
    if not pairs:
        return Model(entries, tongue, np.zeros((len(DEFECTS), WIDTH + DENSE)), np.full(len(DEFECTS), 1e9))
    rows = Rows([ex.row(p, r) for p, r, _ in pairs])
    held = rng.random(rows.n) < 0.25
    a, b = rows.take(np.nonzero(~held)[0]), rows.take(np.nonzero(held)[0])
    y = np.array([[p[2] == d for p in pairs] for d in DEFECTS], float)
    weights = fit(a, y[:, ~held], rng)
    cuts = [threshold(b.dot(w), z) for w, z in zip(weights, y[:, held])]
    return Model(entries, tongue, weights, np.array(cuts))


def predict(model: Model, ex: Extractor, prompts: list[str], responses: list[str], kept: dict) -> list[str | None]:
    """The defect of each pair: of those whose score passes its threshold, the one that passes it most."""
    out: list[str | None] = [None] * len(prompts)
    todo, rows = [], []
    for k, (p, r) in enumerate(zip(prompts, responses)):
        if is_empty(r):
            out[k] = "empty"
        elif not is_none_word(r):
            todo.append(k)
            rows.append(ex.row(p or "", r, kept))
    if rows:
        x = Rows(rows)
        scores = np.stack([x.dot(w) - c for w, c in zip(model.weights, model.cuts)])
        best, most = scores.argmax(0), scores.max(0)
        for i, k in enumerate(todo):
            if most[i] > 0:
                out[k] = DEFECTS[best[i]]
    return out


def first_by_hash(df: DataFrame, value: str, n: int) -> list[str]:
    """The n distinct values, not null and not blank, that hash lowest: a sample that depends neither on the order of rows nor on their repetition.

    Only values below a cut that about 4 n of them pass are compared, so what the tasks send to the driver doesn't grow with their number.
    """
    d, h = df.select(value).where(F.trim(value) != ""), F.xxhash64(value)
    share = min(1.0, (4 * n + 100) / max(1, d.agg(F.approx_count_distinct(h)).first()[0]))
    d = d.where(h <= int(share * 2**64) - 2**63 - 1) if share < 1 else d
    return sorted(r[0] for r in d.distinct().orderBy(h, value).limit(n).collect())


def fit_tables(generation: DataFrame, entries: DataFrame, documents: DataFrame) -> Model:
    listed = [tuple(r) for r in entries.select("label_id", "dataset", "label", "display_name").where("label is not null and dataset is not null").limit(MAX_ENTRIES + 1).collect()]
    if len(listed) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    prompts = first_by_hash(generation, "prompt_0_shot", SAMPLE_PROMPTS)
    texts = first_by_hash(documents.where("lower(coalesce(lang, '')) not like 'en%' and lang <> ''"), "text", SAMPLE_TEXTS)
    return train(prompts, sorted(listed, key=str), texts)


@functools.lru_cache(2)
def extractor(entries: tuple, words: tuple) -> tuple[Extractor, dict]:
    """The worker's extractor for these entries and words, and the rows it has kept: they serve its later tasks too."""
    return Extractor(list(entries), dict(words)), {}


def judge(generation: DataFrame, model: Model, *carried: str) -> DataFrame:
    """generation (gen_id long, prompt_0_shot, generated_relation) -> (gen_id, defect) of the rows with a defect, at most one for each row, with the columns to carry.

    A null response is empty; a null or malformed prompt leaves the features of the pair at nothing; repeated rows are judged alike; columns
    not named are not carried; an empty table gives no rows.
    """
    entries, words = tuple(model.entries), tuple(model.tongue.items())

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex, kept = extractor(entries, words)
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part = pdf.iloc[k : k + 2000]
                d = predict(model, ex, part["prompt_0_shot"].tolist(), part["generated_relation"].tolist(), kept)
                res = part[["gen_id", *carried]].assign(defect=d)
                yield res[res["defect"].notna()]

    columns = ["gen_id", *carried]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in generation.select(*columns).schema)
    return generation.select(*columns, *[c for c in ("prompt_0_shot", "generated_relation") if c not in carried]).mapInPandas(found, kinds + ", defect string")


def tables(spark: SparkSession, sf: str) -> tuple[DataFrame, Model]:
    generation = read(spark, sf, "generation")
    return generation, fit_tables(generation, read(spark, sf, "label_schema"), read(spark, sf, "documents"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of generation with a broken answer, and the defect."""
    return judge(*tables(spark, sf))


def p3_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Defective rows by model and defect."""
    return judge(*tables(spark, sf), "model_id").groupBy("model_id", "defect").agg(F.count("*").alias("n_rows"))
