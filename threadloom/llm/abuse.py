"""Scores for abusive, hateful or sexual language.

A linear classifier over hashed character n-grams whose features are scaled by
naive Bayes log-count ratios. It is trained on reviewed documents: a document
is as bad as its worst unit (a sentence, or a window of a long one), so training
alternates between choosing the units that make the positive documents positive
and fitting. Text is read as a reader would: case, homoglyphs, digits for
letters, stretched, spaced and dotted words and invisible characters are undone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.tokens import source_name
from threadloom.operators.worker import kept

#: Bounds of the labelled sample that the classifier is fitted on: reviewed documents, their runes (whole documents), and negative units in the regression.
REVIEWED, REVIEWED_RUNES, NEGATIVE_UNITS = 20_000, 5_000_000, 6_000
#: Log2 of the feature buckets, n-gram lengths, and runes of a unit: a longer sentence is cut into windows of LONG runes, half overlapping.
BITS, LENGTHS, LONG = 18, (2, 3, 4, 5), 144
#: Folds of the reviewed documents; share of the negative documents whose worst unit a supported one must beat, and its least evidence; how often a unit counts at most.
FOLDS, QUIET, LEAST, MOST_TIMES = 3, 0.97, 0.5, 20
#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁһӏɡαβεικνορτυχ", "abekmhopctyxijsdhlgabeikvoptux"))
FOR_LETTERS = dict(zip("0134578@$€", "oieastbase"))

#: Labelled sentences that every training starts from, so that a few reviews are enough: (1 = content of the problem, text).
SEEDS = (
    (1, "you are a complete idiot and a disgrace"), (1, "shut up you stupid moron"), (1, "go kill yourself, nobody likes you"), (1, "I will find you and hurt you"), (1, "drop dead, you worthless trash"),
    (1, "fuck you, asshole"), (1, "what a pathetic loser you are"), (1, "those people are animals and should be wiped out"), (1, "foreigners are parasites, throw them all out"), (1, "women are too stupid to vote"),
    (1, "immigrants are a plague and must be driven out"), (1, "they are subhuman and do not deserve rights"), (1, "burn their houses down"), (1, "watch free porn videos with naked girls"), (1, "hot singles want sex with you tonight"),
    (1, "she spread her legs and he thrust into her"), (1, "send me nudes, I am horny"), (1, "I hope you die a painful death"), (1, "you useless brainless imbecile"),
    (1, "du dummer Idiot, halt die Klappe"), (1, "verpiss dich, du Stück Dreck"), (1, "diese Leute sind Ungeziefer und gehören vertrieben"), (1, "Ausländer sind Parasiten, raus mit ihnen"), (1, "nackte Frauen und Sexvideos kostenlos"),
    (1, "ferme ta gueule, pauvre idiot"), (1, "va mourir, espèce de connard"), (1, "ces gens sont de la vermine, dehors"), (1, "vidéos porno et filles nues"), (1, "sale crétin inutile"),
    (1, "cállate, idiota de mierda"), (1, "ojalá te mueras, basura"), (1, "esa gente es una plaga, fuera todos"), (1, "chicas desnudas y videos porno"), (1, "eres un imbécil inútil"),
    (1, "你这个白痴去死吧"), (1, "滚出去，你这个废物"), (1, "这些人都是害虫应该赶走"), (1, "免费色情视频裸体美女"), (1, "你就是个蠢货"),
    (1, "I know your address and I am coming for you"), (1, "watch your back, I will get you"), (1, "the world would be a better place without you"), (1, "nobody would miss you if you were gone"), (1, "he kissed her breasts and pulled off her clothes"),
    (1, "her naked body trembled as he moaned"), (1, "looking for casual sex tonight, no strings"), (1, "that race only knows how to steal"), (1, "never let these people into our country"),
    (1, "people like you should not be allowed to speak"), (1, "what a dumb piece of shit you are"), (1, "your mother should have aborted you"), (1, "jump off a bridge, loser"), (1, "they are thieves by nature, send them back"),
    (0, "kill the process and restart the server"), (0, "this damn build fails again"), (0, "I hate this stupid bug"), (0, "the idiot light on the panel is on"), (0, "the female wolf gave birth to four pups"),
    (0, "the bitch had five puppies in the example"), (0, "sexual reproduction of plants"), (0, "the form asks for sex and age"), (0, "the rule forbids words like idiot or moron"), (0, "the labels are hate, abuse and sexual content"),
    (0, "breast cancer data set"), (0, "the master and slave nodes"), (0, "adult education classes"),
    (0, "die Sau hat acht Ferkel"), (0, "das verdammte Skript hängt schon wieder"), (0, "ce fichu test échoue encore"), (0, "el ejemplo tonto imprime un saludo"), (0, "杀死进程后重新启动"),
    (0, "refugees and immigrants can use the form"), (0, "naked eye observation"), (0, "execute the child and abort the parent"), (0, "the filter's word list starts with bastard"),
    (0, "the palette has nude and beige tones"), (0, "calling somebody an idiot leads to a warning"), (0, "single numbers are parsed"), (0, "this damn build is slow"),
)


def _make_table() -> np.ndarray:
    """What each code point below 0x10000 is read as; 0: nothing, 32: a gap, 10: a line break."""
    table = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me") or kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85":
            table[i] = 0
        elif c in "\n\r\x85  ":
            table[i] = 10
        elif c in "\t\x0b\x0c" or kind == "Zs":
            table[i] = 32
        elif 0xD800 <= i < 0xE000 or kind[0] == "L" and i >= 0x3400:
            continue
        else:
            base = unicodedata.normalize("NFKD", c)[0].lower()
            base = LOOKALIKES.get(base, base)
            table[i] = ord(base[0]) if len(base) else i
    return table


#: Stands between texts that are worked on together, and runes of such a run.
BETWEEN, RUN = "\ue000", 150_000
#: Bits of the classes of read code points: ends a sentence; ends it before a gap or an ideograph; a gap; white; a sign; a Latin letter; any letter; a digit.
END, MAY_END, GAP, WHITE, SIGN, LATIN, LETTER, IDEOGRAPH = (1 << i for i in range(8))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what a code point is read as, what it is read as before a letter, its classes)."""
    inside = np.arange(0x10000, dtype=np.uint32)
    for a, b in FOR_LETTERS.items():
        inside[ord(a)] = ord(b)
    kind = np.zeros(0x10000, np.uint8)
    every = np.arange(0x10000)
    kind[[10, 93, 0x3002, 0xFF01, 0xFF1F, ord(BETWEEN)]] |= END
    kind[[33, 46, 63]] |= MAY_END
    kind[[32, 46, 45, 95]] |= GAP
    kind[[32, 10, ord(BETWEEN)]] |= WHITE
    kind[(every < 48) | ((every > 57) & (every < 97)) | ((every > 122) & (every < 0xC0)) | (every == ord(BETWEEN))] |= SIGN
    kind[97:123] |= LATIN
    kind[[i for i in range(0x10000) if chr(i).isalpha()]] |= LETTER
    kind[0x3400:0xD800] |= IDEOGRAPH
    return _make_table(), inside, kind


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points as a reader sees them, their classes, where what may be a sentence begins after a gap)."""
    table, inside, kind = kept("abuse tables", _tables)
    raw, small = text.encode("utf-32-le", "surrogatepass"), text.lower()
    c = np.frombuffer(small.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, bool)
    capital = np.frombuffer(raw, np.uint32) != c if len(small) == len(text) else np.zeros(len(c), bool)
    c = np.where(c < 0x10000, table[np.minimum(c, 0xFFFF)], c)
    soft = np.zeros(len(c), bool)  # a gap after a small letter and before a capitalised word
    if len(c) > 3:
        soft[1:-2] = capital[2:-1] & ~capital[3:] & (c[1:-2] == 32) & (c[:-3] >= 97) & ~capital[:-3]
    there = c != 0
    if not there.all():
        c, soft = c[there], soft[there]
    if not len(c):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, bool)
    k = np.where(c < 0x10000, kind[np.minimum(c, 0xFFFF)], LETTER)
    alpha = (k & LETTER) > 0
    letter_next = _shifted(alpha, -1) & ~alpha & (_shifted(alpha, 1) | (c != 64))  # "@" only inside a word
    c = np.where(letter_next, inside[np.minimum(c, 0xFFFF)], c)
    c[(c >= 48) & (c <= 57)] = 48
    latin = (c >= 97) & (c <= 122)
    lone = latin & ~_shifted(latin, 1) & ~_shifted(latin, -1)
    drop = ((k & GAP) > 0) & _shifted(lone, 1) & _shifted(lone, -1)
    drop[1:] |= (c[1:] == c[:-1]) & (c[1:] != ord(BETWEEN))
    c, soft = c[~drop], soft[~drop]
    return c, np.where(c < 0x10000, kind[np.minimum(c, 0xFFFF)], LETTER).astype(np.uint8), soft


def units(c: np.ndarray, k: np.ndarray, soft: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the units: sentences, and windows of long ones."""
    if not len(c):
        return []
    after = _shifted(k, -1)
    after[-1] = WHITE
    ends = np.flatnonzero(((k & END) > 0) | (((k & MAY_END) > 0) & ((after & (WHITE | IDEOGRAPH)) > 0))) + 1
    starts = np.concatenate([[0], ends])
    ends = np.append(ends, len(c))
    # a unit begins at its first character that is no sign
    word = np.append(np.flatnonzero((k & SIGN) == 0), len(c))
    starts = np.minimum(word[np.searchsorted(word, starts)], ends)
    spots = np.flatnonzero(soft)
    low, high = np.searchsorted(spots, starts), np.searchsorted(spots, ends)
    spaces = np.concatenate([[0], np.cumsum(c == 32)])
    out = []
    for start, end, a, b in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        if end <= start:
            continue
        if end - start > LONG:
            at = start
            while at < end:
                out.append((at, min(end, at + LONG)))
                if at + LONG >= end:
                    break
                at += LONG // 2
            continue
        for p in spots[a:b].tolist():
            if p - start >= 20 and end - p >= 20:
                out.append((start, p))
                start = p + 1
        if end > start and (c[end - 1] != 93 or spaces[end] > spaces[start]):  # a tag in brackets is no sentence
            out.append((start, end))
    return out


def buckets(c: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length the bucket of the n-gram at each place."""
    out, h = [], c.astype(np.uint32)
    grown = h
    for n in range(2, max(LENGTHS) + 1):
        grown = grown[:-1] * np.uint32(0x01000193) + h[n - 1 :] if len(grown) > 1 else grown[:0]
        if n in LENGTHS:
            x = (grown ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append(((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out


def run_scores(texts: list[str | None], weights: np.ndarray, bias: float) -> list[float]:
    """The score of the worst unit of each text (minus infinity where there is none), the texts worked on as one run."""
    c, k, soft = read(BETWEEN.join((t or "").replace(BETWEEN, " ") for t in texts))
    best = np.full(len(texts), -np.inf)
    spans = np.array(units(c, k, soft), np.int64).reshape(-1, 2)
    if len(spans):
        total, grams = np.zeros(len(spans)), np.zeros(len(spans))
        for n, b in zip(LENGTHS, buckets(c)):
            sums = np.zeros(len(b) + 1)
            np.cumsum(weights[b], out=sums[1:])
            s = np.minimum(spans[:, 0], len(b))
            e = np.clip(spans[:, 1] - n + 1, s, len(b))
            total += sums[e] - sums[s]
            grams += e - s
        owner = np.searchsorted(np.flatnonzero(c == ord(BETWEEN)), spans[:, 0], "right")
        np.maximum.at(best, owner, bias + total / np.sqrt(np.maximum(grams, 1)))
    return best.tolist()


def text_scores(texts: list[str | None], weights: np.ndarray, bias: float) -> list[float]:
    """``run_scores`` over runs of bounded length; a text is never cut."""
    out: list[float] = []
    run: list[str | None] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size > RUN:
            out += run_scores(run, weights, bias)
            run, size = [], 0
    return out + (run_scores(run, weights, bias) if run else [])


def _distinct(x: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << BITS, bool)
    seen[x] = True
    return np.flatnonzero(seen).astype(np.uint32)


class Rows:
    """Distinct units as rows of bucket numbers, which documents have them, and the buckets of each document."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.seen: dict[bytes, int] = {}
        self.at: list[tuple[int, int]] = []

    def add(self, text: str, owner: int) -> None:
        c, k, soft = read(text)
        b = buckets(c)
        for s, e in units(c, k, soft):
            key = c[s:e].tobytes()
            row = self.seen.get(key)
            if row is None:
                grams = np.concatenate([x[s : max(s, e - n + 1)] for n, x in zip(LENGTHS, b)])
                if not len(grams):
                    continue
                row = self.seen[key] = len(self.parts)
                self.parts.append(grams)
            self.at.append((owner, row))

    def closed(self) -> Rows:
        self.seen = {}
        self.size = np.array([len(p) for p in self.parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.index = np.concatenate(self.parts)
        self.parts = []
        self.doc, self.unit = np.unique(np.array(self.at, np.int64), axis=0).T
        self.at = []
        docs = np.flatnonzero(np.bincount(self.doc))
        low, high = np.searchsorted(self.doc, docs), np.searchsorted(self.doc, docs, "right")
        own = [_distinct(self.take(self.unit[a:b])[0]) for a, b in zip(low, high)]
        self.held, self.holder = np.concatenate(own), np.repeat(docs, [len(o) for o in own])
        return self

    def documents_with(self, docs: np.ndarray) -> np.ndarray:
        """By bucket the number of these documents that have it."""
        member = np.zeros(int(self.holder[-1]) + 1 if len(self.holder) else 1, bool)
        member[docs[docs < len(member)]] = True
        return np.bincount(self.held[member[self.holder]], minlength=1 << BITS).astype(np.int32)

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Sum of the values of each unit's n-grams."""
        out = np.empty(len(self.size))
        for a in range(0, len(out), 20_000):
            b = min(len(out), a + 20_000)
            own = self.index[self.start[a] : self.start[b - 1] + self.size[b - 1]]
            out[a:b] = np.add.reduceat(v[own], self.start[a:b] - self.start[a])
        return out

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, number of the row) of all n-grams of some rows."""
        size = self.size[rows]
        row = np.repeat(np.arange(len(rows)), size)
        return self.index[np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())], row

    def worst(self, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit, value) of each document's unit with the greatest value; -1 and minus infinity where it has none. ``value`` is by ``unit`` of (doc, unit)."""
        unit, top = np.full(docs, -1), np.full(docs, -np.inf)
        order = np.argsort(value, kind="stable")
        unit[self.doc[order]], top[self.doc[order]] = self.unit[order], value[order]
        return unit, top


def ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log ratio of the share of positive documents (or units) to that of negative documents with an n-gram, each smoothed towards its share in all; 0 for one never seen."""
    share = n_pos / (n_pos + n_neg)
    out = np.log((np.maximum(pos, 0) + share) / n_pos) - np.log((np.maximum(neg, 0) + 1 - share) / n_neg)
    return np.clip(out, -4, 4).astype(np.float32)


def fit_linear(x: Rows, rows: np.ndarray, y: np.ndarray, ratio: np.ndarray, times: np.ndarray, rounds: int = 30, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled features of the rows. Returns (weights by bucket, bias).

    A positive row weighs at most eight times a negative one, so that a few wrongly chosen ones are outvoted by their like. Starts from the
    naive Bayes weights; accelerated gradient steps of the inverse curvature.
    """
    index, row = x.take(rows)
    scale = 1 / np.sqrt(x.size[rows])
    weight = np.where(y > 0, min(8.0, max(1.0, (y <= 0).sum() / max(1, (y > 0).sum()))), 1.0)
    weight *= times
    weight /= weight.sum()
    start = np.cumsum(x.size[rows]) - x.size[rows]
    length = np.add.reduceat(ratio[index] ** 2, start) * scale**2 + 1
    step = 4.0 / float((weight * length).sum() * 2)
    w, b = np.full(1 << BITS, 0.3, np.float32), 0.0
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(rounds):
        z = np.add.reduceat((ratio * ahead)[index], start) * scale + ahead_b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - (y > 0))
        new = (ahead - step * (ratio * np.bincount(index, weights=(g * scale)[row], minlength=1 << BITS) + ridge * ahead)).astype(np.float32)
        new_b = ahead_b - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + np.float32((t - 1) / t_new) * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return ratio * w, b


class Labels:
    """The labelled documents and the seeds (each a document of its own) as units, with the counts of their n-grams."""

    def __init__(self, labelled: list[tuple[str, int]]):
        self.x = Rows()
        for i, text in enumerate([t for t, _ in labelled] + [t for _, t in SEEDS]):
            self.x.add(text, i)
        self.x.closed()
        self.n = len(labelled)
        self.y = np.array([y for _, y in labelled] + [y for y, _ in SEEDS], np.int64)
        self.seed = np.arange(len(self.y)) >= self.n
        self.fold = np.where(self.seed, -1, (np.arange(len(self.y)) * 7919 + 13) % FOLDS)

    def evidence(self, docs: np.ndarray) -> np.ndarray:
        """By (doc, unit) of ``docs`` the evidence that other documents give a unit, less what is needed; minus infinity for other documents.

        The evidence of a unit are the ratios of its n-grams, counted without the document itself. Near-equal units share
        their n-grams, so what is harmless in one wording is so in all: a template that the negative documents have too has no evidence,
        however few documents have one of its wordings. A unit needs more evidence than nearly all worst units of negative documents.
        """
        x, pos, neg = self.x, docs[self.y[docs] == 1], docs[self.y[docs] == 0]
        with_pos, with_neg = x.documents_with(pos), x.documents_with(neg)
        size = x.size[x.unit] + 8.0
        own = self.y[x.doc] == 1
        less = lambda a, b: x.sums(ratios(with_pos - a, with_neg - b, len(pos), len(neg)))
        value = np.where(own, less(1, 0)[x.unit], less(0, 1)[x.unit]) / size
        member = np.zeros(len(self.y), bool)
        member[docs] = True
        value[~member[x.doc]] = -np.inf
        top = x.worst(value, len(self.y))[1]
        below = top[neg[~self.seed[neg]]]
        below = below[np.isfinite(below)]
        return value - max(float(np.quantile(below, QUIET)) if len(below) else 0.0, LEAST)

    def supported(self, value: np.ndarray) -> np.ndarray:
        """The units (repeated for each document) of positive documents whose value is over 0, and those of the positive seeds."""
        return self.x.unit[(self.y[self.x.doc] == 1) & ((value > 0) | self.seed[self.x.doc])]

    def fitted(self, docs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
        """The classifier of the chosen positive units against the units of the negative ones of ``docs``."""
        x = self.x
        with_pos = np.zeros(1 << BITS, np.int32)
        for unit in own:
            with_pos[_distinct(x.take(np.array([unit]))[0])] += 1
        negative = docs[self.y[docs] == 0]
        ratio = ratios(with_pos, x.documents_with(negative), len(own), len(negative))
        member = np.zeros(len(self.y), bool)
        member[docs] = True
        times_pos = np.bincount(own, minlength=len(x.size))
        seeded = np.zeros(len(x.size), bool)
        seeded[x.unit[self.seed[x.doc]]] = True
        times_neg = np.bincount(x.unit[member[x.doc] & (self.y[x.doc] == 0)], minlength=len(x.size))
        negative = np.flatnonzero(times_neg)
        order = np.random.default_rng(5).permutation(len(negative))
        order = order[np.argsort(-(np.minimum(times_neg[negative], 3) + 4 * seeded[negative])[order], kind="stable")]  # seeds and repeated ones first
        negative = negative[order][:NEGATIVE_UNITS]
        positive = np.flatnonzero(times_pos)
        rows = np.concatenate([positive, negative])
        y = np.repeat([1, 0], [len(positive), len(negative)])
        times = np.concatenate([times_pos[positive] + 2 * seeded[positive], times_neg[negative] + 2 * seeded[negative]])
        return fit_linear(x, rows, y, ratio, np.minimum(times, MOST_TIMES).astype(np.float64))

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """By (doc, unit) the score of the unit."""
        return (self.x.sums(weights.astype(np.float32)) / np.sqrt(self.x.size) + bias)[self.x.unit]


def threshold(top: np.ndarray, y: np.ndarray) -> float:
    """The threshold of held-out documents' scores with the best F1 by the reviews, of about equal ones the middle; 0 where one label is missing."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    steps = np.linspace(-1.5, 3, 46)
    f1 = np.array([2 * ((top > t) & (y == 1)).sum() / max(1, (top > t).sum() + (y == 1).sum()) for t in steps])
    good = np.flatnonzero(f1 >= f1.max() - 0.002)
    return float(steps[good[len(good) // 2]])


def train(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """(weights, bias) from (text, 0 or 1) of reviewed documents and the seeds; scores over 0 are cases.

    Positive units are chosen out of fold: in each of FOLDS folds a classifier of the other folds' supported units scores the fold, and its
    positive documents give the units that have evidence and are over the threshold, which is the one that fits all held-out reviews
    best. Reviews may err: a positive document without such a unit gives none.
    """
    own = Labels(labelled)
    every = np.arange(len(own.y))
    held = np.full(len(own.x.doc), -np.inf)
    for k in range(FOLDS):
        docs = every[own.fold != k]
        inside = own.fold[own.x.doc] == k
        if inside.any():
            held[inside] = own.scores(*own.fitted(docs, own.supported(own.evidence(docs))))[inside]
    top = own.x.worst(held, len(own.y))[1]
    real = np.isfinite(top) & ~own.seed
    limit = threshold(top[real], own.y[real])
    evidence = own.evidence(every)
    weights, bias = own.fitted(every, own.supported(np.where(evidence > 0, held - limit, -np.inf)))
    return weights.astype(np.float32), float(bias - limit)


def reviewed(documents: DataFrame, reviews: DataFrame) -> list[tuple[str, int]]:
    """(text, verdict) of reviewed documents: the majority of the reviewers, ties and missing verdicts left out. At most REVIEWED documents and REVIEWED_RUNES runes, by hash of the id."""
    votes = reviews.where("verdict in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("verdict").alias("mean")).where("mean <> 0.5")
    some = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(REVIEWED)
    texts = documents.where("text is not null").select("doc_id", "text")
    known = texts.join(F.broadcast(some), "doc_id").select("doc_id", F.length("text").alias("n"), (F.col("mean") > 0.5).cast("int").alias("y"))
    order = W.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id", "n")  # REVIEWED rows at most
    bounded = known.withColumn("so_far", F.sum("n").over(order)).where(F.col("so_far") <= REVIEWED_RUNES).select("doc_id", "y").distinct()
    rows = texts.join(F.broadcast(bounded), "doc_id").select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["y"]) for r in rows]


def scored(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """``doc_id, source, score`` (0 to 1; over 0.5 is a case) of every document; a null or blank text has score 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array(text_scores(b.column(2).to_pylist(), weights, bias))
            p = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], ["doc_id", "source", "score"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source").cast("string")).alias("source"), "text").mapInArrow(score, "doc_id bigint, source string, score double")


def classify(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Trains on the reviewed documents and scores all documents."""
    return scored(documents, *train(reviewed(documents, reviews)))


def rates(scores: DataFrame) -> DataFrame:
    """``source, documents, cases, rate``; one source, however written, is one source; documents without a source are together under null."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") > 0.5).alias("cases")).withColumn("rate", F.round(F.col("cases") / F.col("documents"), 9))
