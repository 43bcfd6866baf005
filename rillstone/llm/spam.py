"""Pages of repeated keywords, bare link lists, tags and offers.

Method: the lines of a page are labelled prose, link list, tag list or menu by a
hidden Markov model, and a page is flagged when lines of the last three hold more
than half of its words. Seven hidden states carry the four labels. Prose has one
for sentences, one for work (code, its results, logs) and one for lists of values in
code, which read quite differently but are all what a notebook is for; tag list has
one for bare tags, phrases and offers, and one for sentences stuffed with them.

The model sees a line as a few small numbers (``observe``): how its words are
spread over lists and other lines, how much of it the page repeats, links, ends of
sentences, code marks, separators, prices and the like. They are counted for all
lines at once by array operations (``lines``).

Training is on a sample of at most ``sample_docs`` pages and ``sample_bytes``, those
with the least hashed ids. ``seeds`` gives labels to the lines of the sample that are
clear by themselves; from these come the words' odds and first counts, and Viterbi
rounds over the sample add the other lines. Seeds are used in training alone: the
model has no feature that says what they said, and labels all lines of all pages,
seeded ones too, by itself. It is a few thousand numbers and goes to the tasks with
the code.

Defined results
    * null, empty and blank texts, texts without words: not flagged.
    * broken notebook JSON: its strings are taken as far as they go. JSON that is
      no notebook is text.
    * embedded images and other long encoded runs are no words.
    * copies and repeated rows: each gets the same result. Empty tables: no rows.
      Very long texts and lines: whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm import lines as L
from rillstone.llm.tokens import bounded
from rillstone.scratch import cut

PROSE, LINKS, TAGS, MENU = range(4)
#: Hidden states, and the label that each carries.
SENTENCES, WORK, VALUES, LINK_LIST, TAG_LIST, STUFFED, MENU_LIST = range(7)
STATES = 7
LABEL = np.array([PROSE, PROSE, PROSE, LINKS, TAGS, TAGS, MENU])
#: States that only seeds speak for in training; other lines would make them wider than they are meant.
NARROW = (VALUES, STUFFED, MENU_LIST)
#: Share of the words in list lines from which a page is flagged.
SHARE = 0.5
SAMPLE_DOCS = 3000
#: The sample's bytes that the driver takes.
SAMPLE_BYTES = 48 << 20
#: A page of more than this part of the sample's bytes isn't sampled.
LARGE_SHARE = 16
#: Times that a page has two words side by side from which it repeats them.
OFTEN = 5
#: Words of an ordinary line.
LINE_WORDS = 12
#: Bytes of text whose lines are labelled at once.
TEXT_BYTES = 8 << 20


@dataclass
class Words:
    """Words of lines once each, with how often; and what the page repeats."""

    line: np.ndarray
    word: np.ndarray
    times: np.ndarray
    distinct: np.ndarray
    top: np.ndarray
    repeat: np.ndarray


def words_of(x: L.Lines) -> Words:
    """Per line its distinct words, the count of its commonest that isn't short, and the share of its word pairs that the page has OFTEN or more times (of a single word: whether it stands alone as often)."""
    n = len(x.doc)
    here = x.word ^ L.mixed(x.line.astype(np.uint64) + np.uint64(1))
    _, at, times = np.unique(here, return_index=True, return_counts=True)
    line, word = x.line[at], x.word[at]
    distinct = np.bincount(line, minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, line, np.where(x.short[at], np.minimum(times, 1), times))
    repeat = np.zeros(n)
    both = np.flatnonzero(x.line[1:] == x.line[:-1])
    if len(both):
        pair = L.mixed(x.word[both] * np.uint64(3) + x.word[both + 1]) ^ L.mixed(x.doc[x.line[both]].astype(np.uint64) + np.uint64(1))
        _, which, often = np.unique(pair, return_inverse=True, return_counts=True)
        repeat = np.bincount(x.line[both], often[which] >= OFTEN, n) / np.maximum(1, x.words - 1)
    alone = np.flatnonzero(x.words[x.line] == 1)
    if len(alone):
        _, which, often = np.unique(x.word[alone] ^ L.mixed(x.doc[x.line[alone]].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        repeat[x.line[alone]] = often[which] >= OFTEN
    return Words(line, word, times, distinct, top, repeat)


def variety(x: L.Lines, w: Words) -> np.ndarray:
    """How varied the words of a line are, whatever its length: 1 if all differ."""
    return np.log(np.maximum(w.distinct, 1)) / np.log(np.maximum(x.words, 2))


def seeds(x: L.Lines, w: Words) -> np.ndarray:
    """The state of lines that are clear by themselves, else -1. For training."""
    n, plain = x.words, np.maximum(0, x.code - 2 * x.links)
    ends = x.ends > 0
    phrases, varied = x.quotes < 1.4 * n, variety(x, w)  # not each word in quotes of its own
    stuffed = (n >= 12) & ((w.top >= 0.19 * n) & (varied < 0.9) | (w.distinct <= 0.4 * n) & ~ends)
    offer = (x.prices > 0) & (x.goods > 0)
    phrase = (w.repeat == 1) & (plain + x.numbers + x.links + x.ends + x.quotes + x.gaps == 0)
    cases = [
        (x.links > 0) & (n <= 4 * x.links), (x.links > 0) & (n >= 6 * x.links) & ends, x.links > 0, (x.gaps > 0) & ~offer, (x.traces >= 3) & (x.tags == 0) & ~offer, (x.tags >= 4) | offer & (plain <= 1),
        (x.quotes >= 12) & phrases & (varied < 0.75), (x.quotes >= 12) & phrases & (varied < 0.9), x.quotes >= 12, stuffed & (plain <= 1) & ~ends, stuffed & (plain <= 1), (plain >= 2) | (x.numbers > n),
        (n >= 6) & ends & (w.top < np.maximum(2, 0.17 * n)) & (x.marks <= 3 + 2 * x.ends), (x.marks >= 3) & (n > 0) & (n <= 3 * (x.marks + 1)) & ~ends & (w.distinct > 0.8 * n),
        (x.marks >= 3) & (n > 0) & (n <= 3 * (x.marks + 1)) & ~ends, phrase,
    ]
    return np.select(cases, [LINK_LIST, SENTENCES, -1, WORK, WORK, TAG_LIST, TAG_LIST, -1, VALUES, TAG_LIST, STUFFED, WORK, SENTENCES, MENU_LIST, TAG_LIST, TAG_LIST], -1)


SIZES = (7, 5, 4, 5, 4, 4, 3, 5, 5, 6, 6, 4, 2, 3, 3)


def observe(x: L.Lines, w: Words, odds: Odds) -> np.ndarray:
    """The features of each line as small numbers, a row a line."""
    n, lines = x.words, len(x.doc)
    some = np.maximum(n, 1)
    own = odds.of(w.word)
    mean = np.bincount(w.line, own * w.times, lines) / some
    strong = np.bincount(w.line, (own > 1.0) * w.times, lines) / some
    plain = np.maximum(0, x.code - 2 * x.links)
    varied = variety(x, w)
    cut_ = lambda v, *edges: np.searchsorted(np.array(edges), v, "right")
    features = (
        np.where(n == 0, 0, 1 + cut_(mean, -1.0, -0.3, 0.3, 1.0, 1.8)),
        cut_(strong, 1e-9, 0.15, 0.34, 0.6),
        np.where(x.links == 0, 0, 1 + cut_(n / np.maximum(x.links, 1), 4.0, 6.0)),
        cut_(w.repeat, 1e-9, 0.25, 0.5, 0.75),
        np.where(x.ends == 0, 0, 1 + cut_(n / np.maximum(x.ends, 1), 4.0, 30.0)),
        cut_(plain / np.maximum(1, n + x.numbers), 1e-9, 0.1, 0.35),
        np.where(n == 0, 0, 1 + (x.numbers > n)),
        np.where((x.prices > 0) & (x.goods > 0), 4, np.where(x.tags >= 3, 3, np.where((x.marks >= 3) & (n <= 4 * (x.marks + 1)), 2, (x.marks >= 3) * 1))),
        cut_(n, 1, 3, 6, 12),
        np.where(n < 6, 0, 1 + cut_(w.top / some, 0.1, 0.15, 0.2, 0.3)),
        np.where(n < 6, 0, 1 + cut_(varied, 0.65, 0.75, 0.85, 0.93)),
        np.where(x.quotes < 4, 0, np.where(x.quotes >= 1.4 * n, 1, 2 + (varied < 0.75))),
        (x.gaps > 0) * 1,
        np.where(x.hosts == 0, 0, 1 + (3 * x.hosts >= n)),
        cut_(np.where(x.tags > 0, 0, x.traces), 1, 3),
    )
    return np.stack(features, 1).astype(np.int64)


@dataclass
class Odds:
    """Log odds of words (by hash, in order) of standing in lists; 0 for others."""

    word: np.ndarray
    value: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        return np.where(self.word[at] == words, self.value[at], 0.0)


def odds_of(x: L.Lines, w: Words, state: np.ndarray) -> Odds:
    """From the pages in which a word stands in list lines, and in others; words of fewer than three pages are left out."""
    y = state[w.line]
    doc = L.mixed(x.doc[w.line].astype(np.uint64) + np.uint64(1))
    counts = []
    for side in ((y >= LINK_LIST), (y >= 0) & (y < LINK_LIST)):
        _, at = np.unique(w.word[side] ^ doc[side], return_index=True)  # once a page
        counts.append(np.unique(w.word[side][at], return_counts=True))
    word = np.union1d(counts[0][0], counts[1][0])
    inside, outside = np.zeros(len(word)), np.zeros(len(word))
    for (own, k), to in zip(counts, (inside, outside), strict=True):
        to[np.searchsorted(word, own)] = k
    kept = inside + outside >= 3
    value = np.log((inside + 0.5) / max(1, inside.sum()) * max(1, outside.sum()) / (outside + 0.5))
    return Odds(word[kept], value[kept])


class Model:
    """Word odds, and log probabilities of features, transitions and first lines."""

    def __init__(self, odds: Odds, emit: list[np.ndarray], move: np.ndarray, first: np.ndarray):
        self.odds, self.emit, self.move, self.first = odds, emit, move, first

    def costs(self, x: L.Lines, seen: np.ndarray) -> np.ndarray:
        """Log likelihood of each line's features in each state; a long line says as much as several."""
        cost = np.zeros((len(seen), STATES))
        for i, e in enumerate(self.emit):
            cost += e.T[seen[:, i]]
        return cost * (1 + 0.5 * np.log2(np.maximum(1, x.weight / LINE_WORDS)))[:, None]

    def states(self, x: L.Lines, seen: np.ndarray) -> np.ndarray:
        """The likeliest states of the lines of each page (Viterbi, all pages in step)."""
        out = np.empty(len(seen), np.int64)
        if not len(seen):
            return out
        cost = self.costs(x, seen)
        at = np.concatenate([[0], np.flatnonzero(x.doc[1:] != x.doc[:-1]) + 1])
        size = np.diff(np.concatenate([at, [len(seen)]]))
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        live = np.searchsorted(-size, -np.arange(size[0]), "left")  # pages with more than t lines stand first
        best = self.first + cost[at]
        back = np.zeros((len(cost), STATES), np.int8)
        for t in range(1, int(size[0])):
            k = live[t]
            step = best[:k, :, None] + self.move
            back[at[:k] + t] = step.argmax(1)
            best[:k] = step.max(1) + cost[at[:k] + t]
        now = best.argmax(1)
        out[at + size - 1] = now
        for t in range(int(size[0]) - 1, 0, -1):
            k = live[t]
            now[:k] = back[at[:k] + t, now[:k]]
            out[at[:k] + t - 1] = now[:k]
        return out

    def label(self, texts: list[str | None]) -> tuple[L.Lines, np.ndarray]:
        """The lines of the texts and their labels."""
        x = L.read(texts)
        return x, LABEL[self.states(x, observe(x, words_of(x), self.odds))]

    def shares(self, texts: list[str | None]) -> list[float]:
        """Share of each page's words that stand in lists; 0 without words."""
        x, label = self.label(texts)
        total = np.bincount(x.doc, x.weight, len(texts))
        lists = np.bincount(x.doc, np.where(label != PROSE, x.weight, 0.0), len(texts))
        return np.where(total > 0, lists / np.where(total > 0, total, 1), 0.0).tolist()


def train(texts: list[str | None], rounds: int = 3) -> Model:
    """A model from the pages given; without any, one that knows only its priors."""
    x = L.read(list(texts))
    w = words_of(x)
    sure = seeds(x, w)
    odds = odds_of(x, w, sure)
    seen = observe(x, w, odds)
    logs = lambda m: np.log(m / m.sum(-1, keepdims=True))
    begins = np.ones(len(sure), bool)
    begins[1:] = x.doc[1:] != x.doc[:-1]
    state, model = sure, None
    for _ in range(rounds):
        known = state >= 0
        emit = [np.full((STATES, k), 0.5) for k in SIZES]
        for i, e in enumerate(emit):
            np.add.at(e, (state[known], seen[known, i]), 1)
        move, first = np.full((STATES, STATES), 1.0) + 20 * np.eye(STATES), np.full(STATES, 1.0)
        on = known[1:] & known[:-1] & ~begins[1:]
        np.add.at(move, (state[:-1][on], state[1:][on]), 1)
        np.add.at(first, state[known & begins], 1)
        model = Model(odds, [logs(e) for e in emit], logs(move), logs(first))
        found = model.states(x, seen)
        state = np.where(sure >= 0, sure, np.where(np.isin(found, NARROW), -1, found))
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample_docs`` pages of together at most ``sample_bytes``, the same ones each time: those with the least hashed ids.

    Pages of more than 1/LARGE_SHARE of the bytes are passed over, so that no few
    of them are the whole sample. The number of pages tells below which hash the
    sample lies, so one pass over the texts writes it out, and the driver takes it
    from there. Where that has too few small pages, the sample is smaller.
    """
    h, size = F.xxhash64(doc_id), F.coalesce(F.octet_length(text), F.lit(0))
    pages = docs.where(F.col(doc_id).isNotNull()).select(doc_id).count()
    near = h / F.lit(float(1 << 64)) + 0.5 <= F.lit(2.0 * sample_docs / max(1, pages))
    held = cut(docs.where(F.col(doc_id).isNotNull() & near & (size <= sample_bytes // LARGE_SHARE)).select(h.alias("h"), size.alias("n"), F.col(doc_id).alias("id"), F.col(text).alias("t")), "sample")
    taken = total = 0
    for r in held.df.select("h", "n", "id").orderBy("h", "n", "id").limit(sample_docs).collect():
        total += r["n"]
        if total > sample_bytes:
            break
        taken += 1
    rows = held.df.orderBy("h", "n", "id", "t").limit(taken).select("t").collect() if taken else []  # ids need not be unique
    held.drop()
    return train([r["t"] for r in rows])


def list_shares(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, list_share``: the share of each page's words that stand in lists."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(whole, 1, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.shares(b.column(1).to_pylist()), pa.float64())], names=[doc_id, "list_share"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, list_share double")


def flag(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, list_share`` of the pages with more than ``share`` of their words in lists."""
    return list_shares(docs, fit(docs, doc_id, text, sample_docs), doc_id, text).where(F.col("list_share") > share)
