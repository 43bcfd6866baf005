"""A whole corpus as token ids of a public byte-level BPE vocabulary.

Method: code points become classes by one table lookup; the pre-tokenisation
rule is an automaton over these classes, and each class is a function from state
to state. Functions compose associatively, so the state at every character of a
batch of documents comes from a blocked prefix scan over composition-table
lookups, without any regular expression. State and class tell where a slice
begins. Slices of a batch are grouped by their bytes, merged once, and kept in a
cache; their offsets can be returned, so ids can be decoded back to the text.

Pre-tokens are those of the vocabularies' published pattern
``'(?:[sdmt]|ll|ve|re)| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined results
    * null and empty texts: an empty list. Strings that look like special tokens
      are ordinary text. Texts that aren't valid UTF-8: each bad sequence is
      U+FFFD. Very long texts and slices: whole; merging is O(n log n).
    * repeated rows: each has its own list. Empty tables: no rows. Other columns
      are kept only if named.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# The letters after an apostrophe that the published pattern splits off.
CONTRACTION_ONE = "sdmt"
CONTRACTION_TWO = ("ll", "ve", "re")
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of characters. ONE and TWO are letters that may continue a contraction.
LETTER, ONE, TWO, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK = range(8)
#: Added to the class of the first character of a document: its function forgets the state.
FIRST = 8
# States: what the slice at hand is so far.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_BLANK, AFTER_APOSTROPHE, CONTRACTED, CONTRACTING = range(9)
STATES = 9


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this character (for white space: unless the scan says otherwise)."""
    if kind in (LETTER, ONE, TWO):
        if state == CONTRACTING:
            return CONTRACTED, False
        if state == AFTER_APOSTROPHE and kind == ONE:
            return CONTRACTED, False
        if state == AFTER_APOSTROPHE and kind == TWO:
            return CONTRACTING, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if kind == OTHER:
        return IN_OTHER, state not in (IN_OTHER, AFTER_SPACE, AFTER_APOSTROPHE)
    if kind == APOSTROPHE:
        inside = state in (IN_OTHER, AFTER_SPACE, AFTER_APOSTROPHE)
        return (IN_OTHER, False) if inside else (AFTER_APOSTROPHE, True)
    return (AFTER_SPACE if kind == SPACE else AFTER_BLANK), state not in (AFTER_SPACE, AFTER_BLANK)


@cache
def classes() -> np.ndarray:
    """Class of each code point, from Unicode's general categories."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    first = np.frombuffer("".join(category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    kinds[first == ord("L")] = LETTER
    kinds[first == ord("N")] = NUMBER
    kinds[list(WHITE_SPACE)] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = APOSTROPHE
    kinds[[ord(c) for c in CONTRACTION_ONE]] = ONE
    return kinds


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions that runs of characters can be: of each class, their composition table, their images, and where slices begin."""
    made = [tuple(_step(s, k)[0] for s in range(STATES)) for k in range(8)]
    made += [(f[BEGIN],) * STATES for f in made]
    number: dict[tuple[int, ...], int] = {}
    for f in made:
        number.setdefault(f, len(number))
    todo = list(number)
    while todo:
        f = todo.pop()
        for g in list(made):
            h = tuple(g[x] for x in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    table = np.array([[number.get(tuple(g[x] for x in f), 0) for g in every] for f in every], np.int16)
    begins = np.array([[_step(s, k)[1] for k in range(8)] for s in range(STATES)] + [], bool)
    return np.array([number[f] for f in made], np.int16), table, np.array(every, np.uint8), begins


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition: element i is what characters 0..i do together."""
    _, table, _, _ = monoid()
    m, flat = len(table), table.ravel()
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = flat[int(out[i - 1]) * m + int(out[i])]
        return out
    width = max(8, min(512, int(n**0.5)))
    rows = -(-n // width)
    block = np.zeros(rows * width, np.int16)
    block[:n] = functions
    block[n:] = functions[-1]
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    for j in range(1, width):
        block[j] = flat[block[j - 1].astype(np.int32) * m + block[j]]
    before = scan(block[-1])
    block[:, 1:] = flat[before[:-1].astype(np.int32)[None, :] * m + block[:, 1:]]
    return np.ascontiguousarray(block.T).ravel()[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions of ``points`` (code points of documents end to end) where slices begin.

    ``firsts`` are the positions of the documents' first characters.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    generators, _, images, begins = monoid()
    kind = classes()[points]
    starts = np.zeros(n + 1, bool)
    starts[firsts] = True
    starts[n] = True
    for pair in CONTRACTION_TWO:
        kind[np.flatnonzero((points[:-1] == ord(pair[0])) & (points[1:] == ord(pair[1])) & ~starts[1:n])] = TWO
    function = generators[kind + FIRST * starts[:n].astype(np.uint8)]
    state = images[scan(function), BEGIN]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BEGIN, state[:-1]
    before[starts[:n]] = BEGIN
    out = begins[before, kind]
    # The last of several blanks before something else begins a slice of its own.
    blank = kind >= SPACE
    ends = np.zeros(n, bool)
    ends[:-1] = ~blank[1:]
    ends &= ~starts[1:]
    return np.flatnonzero(out | (blank & ends))


@cache
def file_of(vocabulary: str, folder: str) -> bytes:
    """A vocabulary's file as it is: one line per byte string, a megabyte or two. Read by the driver, which sends it along."""
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        return f.read()


def parse(file: bytes) -> dict[bytes, int]:
    """Byte strings and ids of a vocabulary given as ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}


@cache
def ranks(vocabulary: str, folder: str) -> dict[bytes, int]:
    return parse(file_of(vocabulary, folder))


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one slice: adjacent parts are merged, lowest rank first, leftmost among equals."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 64:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]
    ends, after, prior = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[i] < n:
            prior[after[i]] = i
        offer(i)
        if prior[i] >= 0:
            offer(prior[i])
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : ends[i]]])
        i = after[i]
    return out


class Pairs:
    """Which two adjacent ids merge into which: a hash table over arrays, asked for many pairs at once."""

    NONE = np.int32(np.iinfo(np.int32).max)
    BITS = 21

    def __init__(self, rank: dict[bytes, int]):
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for word, r in rank.items():
            for k in range(1, len(word)):
                a = rank.get(word[:k])
                if a is not None and (b := rank.get(word[k:])) is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        left, value = np.array(keys, np.int64), np.array(made, np.int32)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.made = np.full(1 << self.BITS, self.NONE, np.int32)
        slot = self._slot(left)
        while len(left):  # one key takes each free slot; the others go on to the next
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[taken], self.made[taken] = left[put], value[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, value, slot = left[rest], value[rest], (slot[rest] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where the two don't merge."""
        key = (a.astype(np.int64) << 32) | b
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.made[slot], self.NONE)
        left = np.flatnonzero((there != key) & (there >= 0))
        slot = slot.ravel()[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.BITS) - 1)
            there, own = self.keys[slot], key.ravel()[left]
            hit = there == own
            out.ravel()[left[hit]] = self.made[slot[hit]]
            more = ~hit & (there >= 0)
            left, slot = left[more], slot[more]
        return out


def merge_many(pieces: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merges all rows of ``pieces`` (bytes, one slice a row, equal length) at once: ids padded to that length, and how many count."""
    n, width = pieces.shape
    ids = pairs.single[pieces]
    out, lens = np.zeros((n, width), np.int32), np.full(n, width, np.int32)
    rows, rank = np.arange(n), pairs.get(ids[:, :-1], ids[:, 1:])
    while len(rows):
        if width == 1:
            out[rows, :1], lens[rows] = ids, 1
            break
        at = rank.argmin(1)
        best = rank[np.arange(len(rows)), at]
        over = best == Pairs.NONE
        if over.any():
            out[rows[over], :width], lens[rows[over]] = ids[over], width
            go = ~over
            rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            if not len(rows):
                break
        each, col = np.arange(len(rows)), np.arange(width - 1)
        ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
        ids[each, at] = best
        col = np.arange(width - 2)
        rank = np.take_along_axis(rank, col + (col >= at[:, None]), 1)
        width -= 1
        one = at > 0
        rank[each[one], at[one] - 1] = pairs.get(ids[each[one], at[one] - 1], best[one])
        two = at < width - 1
        rank[each[two], at[two]] = pairs.get(best[two], ids[each[two], at[two] + 1])
    return out, lens


#: Slices up to this length are merged many at once; longer ones are rare and go one by one.
TOGETHER = 32


class Encoder:
    """Encodes batches of texts; keeps merged slices between batches, at most ``limit`` of them."""

    def __init__(self, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, limit: int = 600_000, rank: dict[bytes, int] | None = None):
        self.rank, self.limit = rank or ranks(vocabulary, folder), limit
        self.pairs = Pairs(self.rank)
        self._forget()

    def _forget(self) -> None:
        self.known: tuple[dict, dict, dict] = ({}, {}, {})
        self.ids, self.lens, self.offs = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int64)
        self.used, self.count = 0, 0

    def _store(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Puts merged slices (ids end to end) into the cache; their numbers."""
        while self.count + len(lens) > len(self.lens):
            self.lens, self.offs = (np.concatenate([a, np.empty_like(a)]) for a in (self.lens, self.offs))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        where = slice(self.count, self.count + len(lens))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lens[where], self.offs[where] = lens, self.used + np.cumsum(lens) - lens
        self.used, self.count = self.used + len(ids), self.count + len(lens)
        return np.arange(where.start, where.stop)

    def _number(self, tier: int, keys: list, pieces) -> np.ndarray:
        """Numbers in the cache of ``keys``; ``pieces(i)`` gives the bytes of the i-th, asked only if it is new."""
        known = self.known[tier]
        out = np.array([known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        texts = [pieces(i) for i in new.tolist()]
        size = np.array([len(t) for t in texts])
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            group = [texts[i] for i in own.tolist()]
            if k <= TOGETHER:
                ids, lens = merge_many(np.frombuffer(b"".join(group), np.uint8).reshape(len(group), k), self.pairs)
                whole = [self.rank.get(t, -1) for t in group]  # a slice that is a word of the vocabulary is that word
                as_one = np.array(whole) >= 0
                ids[as_one, 0], lens[as_one] = np.array(whole, np.int32)[as_one], 1
                flat = ids[np.arange(k) < lens[:, None]]
            else:
                merged = [merge(t, self.rank) for t in group]
                lens = np.array([len(m) for m in merged], np.int32)
                flat = np.array([i for m in merged for i in m], np.int32)
            out[new[own]] = self._store(flat, lens)
        known.update(zip([keys[i] for i in new.tolist()], out[new].tolist(), strict=True))
        return out

    def slices(self, raw: np.ndarray, doc_bytes: np.ndarray) -> np.ndarray:
        """Byte positions where slices begin in ``raw`` (UTF-8, documents end to end, beginning at ``doc_bytes``)."""
        text = raw.tobytes().decode("utf-8")
        if len(text) == len(raw):  # ASCII
            return boundaries(raw, doc_bytes[doc_bytes < len(raw)])
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        firsts = np.searchsorted(place, doc_bytes[doc_bytes < len(raw)])
        return place[boundaries(points, firsts)]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents ``raw[offsets[i]:offsets[i+1]]``: ids end to end, their offsets by document, slices' byte positions, and how many ids each slice has."""
        if self.count > self.limit:
            self._forget()
        begin = self.slices(raw, offsets[:-1])
        length = np.diff(begin, append=len(raw))
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        words = np.ndarray((len(raw) + 8,), np.dtype("<u8"), padded.data, strides=(1,))
        keep = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
        number = np.empty(len(begin), np.int64)

        short = length < 8
        at, n = begin[short], length[short]
        code, found = pd.factorize((words[at] & keep[n]) | (n.astype(np.uint64) << np.uint64(56)))
        keys = found.tolist()
        number[short] = self._number(0, keys, lambda i: keys[i].to_bytes(8, "little")[: keys[i] >> 56])[code] if len(keys) else 0

        middle = (length >= 8) & (length < 16)
        at, n = begin[middle], length[middle] - 8
        if len(at):
            one, a = pd.factorize(words[at])
            two, b = pd.factorize((words[at + 8] & keep[n]) | (n.astype(np.uint64) << np.uint64(56)))
            code, pair = pd.factorize(one * len(b) + two)
            pairs = list(zip(a[pair // len(b)].tolist(), b[pair % len(b)].tolist(), strict=True))
            number[middle] = self._number(1, pairs, lambda i: pairs[i][0].to_bytes(8, "little") + pairs[i][1].to_bytes(8, "little")[: pairs[i][1] >> 56])[code]

        long = length >= 16
        if long.any():
            data = raw.tobytes()
            pieces = [data[i : i + k] for i, k in zip(begin[long].tolist(), length[long].tolist(), strict=True)]
            own = list(dict.fromkeys(pieces))
            of = dict(zip(own, self._number(2, own, own.__getitem__).tolist(), strict=True))
            number[long] = [of[p] for p in pieces]

        lens = self.lens[number].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.offs[number] - (ends - lens), lens)
        first = np.searchsorted(begin, offsets)
        by_doc = np.concatenate([[0], ends])[first]
        return self.ids[source], by_doc, begin, lens


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: str, folder: str, file) -> Encoder:
    """The process's encoder, made once; ``file`` is a broadcast of ``file_of``."""
    key = (vocabulary, folder)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, folder, rank=parse(file.value))
    return _encoders[key]


def valid_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and their offsets; null is empty, bad UTF-8 is replaced."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    else:
        texts, width = texts.cast(pa.large_string()), np.int64
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    try:
        raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        parts = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return raw, offsets


def bounded(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with some ``limit`` bytes of text each; one document is never split."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] if len(part) else 0)).tolist()
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, what: str = "ids") -> DataFrame:
    """``keep`` and, by ``what``: ``ids`` (array<int>), ``n_tokens`` (bigint), or ``offsets`` (ids and ``starts``, the byte position of each id's slice)."""
    fields = [df.select(k).schema[0] for k in keep]
    columns = {"ids": "ids array<int>", "n_tokens": "n_tokens bigint", "offsets": "ids array<int>, starts array<int>"}[what]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), columns])

    file = df.sparkSession.sparkContext.broadcast(file_of(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = _encoder(vocabulary, folder, file)
        for whole in batches:
            for batch in bounded(whole, len(keep)):
                raw, offsets = valid_bytes(batch.column(len(keep)))
                ids, by_doc, begin, lens = enc.encode(raw, offsets)
                out = [batch.column(i) for i in range(len(keep))]
                if what == "n_tokens":
                    out.append(pa.array(np.diff(by_doc)))
                else:
                    ends = pa.array(by_doc.astype(np.int32))
                    out.append(pa.ListArray.from_arrays(ends, pa.array(ids)))
                    if what == "offsets":
                        base = np.repeat(offsets[:-1], np.diff(by_doc))
                        out.append(pa.ListArray.from_arrays(ends, pa.array((np.repeat(begin, lens) - base).astype(np.int32))))
                names = [*keep, *(["n_tokens"] if what == "n_tokens" else ["ids"] + ["starts"] * (what == "offsets"))]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` and ``text``: the texts whose ids these are; null ids give null."""
    fields = [df.select(k).schema[0] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])

    file = df.sparkSession.sparkContext.broadcast(file_of(vocabulary, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {v: k for k, v in parse(file.value).items()}
        for b in batches:
            texts = [None if x is None else b"".join(piece[i] for i in x).decode("utf-8", "replace") for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return df.select(*keep, ids).mapInArrow(run, schema)
