"""What can be counted in the lines of texts, for all lines of many texts at once.

Texts are laid end to end as arrays of code points; a table gives the kinds of each
code point, and every count is taken from the positions of some kinds by array
operations. No line and no word becomes a Python object, and there are no regular
expressions. Words are known by a hash of their lower-case letters.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cache

import numpy as np

#: Letters of a word that may well be an article or the like.
SHORT = 3
#: Characters worked on at once; texts are cut there at line ends, a longer line at a blank.
BLOCK = 1 << 20

LETTER, DIGIT, SPACE, UPPER, LOWER, WIDE, CODE, QUOTE, MARK, END, DELIM, RUN, HOST, NEWLINE, MONEY, SIGN = (1 << i for i in range(16))

# Characters by the part they play in a line.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
CODE_MARKS = "=(){}[]^\\~&"
QUOTES = "'\"`"
SEPARATORS = "|;•·»›\t"
SENTENCE_ENDS = ".?!。？！"
FULL_STOPS = "。？！"
CURRENCIES = "$€£¥₽"
CHUNK_ENDS = "'\"`<>()[]{}|,"
#: Scripts written without spaces: first and last code points.
UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


@cache
def kinds() -> np.ndarray:
    """The kinds of each code point, as bits."""
    cat = unicodedata.category
    first = np.frombuffer("".join(cat(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    out = np.zeros(0x110000, np.uint16)
    out[(first == ord("L")) | (first == ord("M"))] |= LETTER
    out[first == ord("N")] |= DIGIT
    for i in range(0x250):
        out[i] |= UPPER * chr(i).isupper() | LOWER * chr(i).islower()
    for i in [*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[i] |= SPACE | DELIM
    for chars, kind in ((LINE_ENDS, NEWLINE), (CODE_MARKS, CODE), (QUOTES, QUOTE), (SEPARATORS, MARK), (SENTENCE_ENDS, END), (CHUNK_ENDS, DELIM), (CURRENCIES, MONEY)):
        out[[ord(c) for c in chars]] |= kind
    for a, b in UNSPACED:
        out[a : b + 1] |= np.where(out[a : b + 1] & LETTER, WIDE, 0).astype(np.uint16)
    for i in range(128):
        out[i] |= RUN * (chr(i).isalnum() or chr(i) in "+/=") | HOST * (chr(i).isalnum() or chr(i) in "-.")
    out[(out & (LETTER | DIGIT | SPACE)) == 0] |= SIGN
    return out


@cache
def lower() -> np.ndarray:
    """A number for each code point and its other case: the lower case, where it is one code point, plus one."""
    out = np.arange(0x110000, dtype=np.uint64)
    for i in range(0x20000):
        if len(s := chr(i).lower()) == 1:
            out[i] = ord(s)
    return out + np.uint64(1)


#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 64), np.uint64(base))
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes over all 64 bits."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cell_texts(x) -> Iterator[str]:
    """Strings of sources and outputs of a notebook, in order; without recursion, as notebooks may be nested deeply."""
    stack = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, list):
            if x and all(isinstance(v, str) for v in x):
                yield "".join(x)
            else:
                stack.extend(reversed(x))
        elif isinstance(x, dict):
            stack.extend(x[k] for k in reversed(x) if k in ("cells", "source", "outputs", "text", "data", "text/plain", "text/html", "traceback", "evalue"))


def _strings(text: str) -> Iterator[str]:
    """The strings of a JSON text that is cut short or damaged, as far as they go; names of fields are left out."""
    at, decode = 0, json.decoder.scanstring
    while (at := text.find('"', at)) >= 0:
        try:
            s, at = decode(text, at + 1, False)
            if text[at : at + 1] != ":":
                yield s
        except ValueError:
            yield text[at + 1 :]
            return


def page_text(text: str) -> str:
    """The readable text of a page: a notebook's JSON becomes the text of its cells, any other text stays."""
    if text.lstrip()[:1] != "{":
        return text
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return "\n".join(_strings(text)) if '"cells"' in text or '"source"' in text else text
    return "\n".join(_cell_texts(x)) if isinstance(x, dict) and "cells" in x else text


@dataclass
class Lines:
    """Counts for each line that holds something, and its words: ``doc`` of each line; ``word`` and ``line`` of each word, and whether it is ``short`` (up to SHORT letters)."""

    doc: np.ndarray
    words: np.ndarray
    wide: np.ndarray
    numbers: np.ndarray
    links: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    quotes: np.ndarray
    marks: np.ndarray
    tags: np.ndarray
    prices: np.ndarray
    goods: np.ndarray
    gaps: np.ndarray
    hosts: np.ndarray
    traces: np.ndarray
    word: np.ndarray
    line: np.ndarray
    short: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        """The size of a line in words: an address has some five, and a pair of characters of an unspaced script 0.6."""
        return self.words - 0.4 * self.wide + self.numbers + 5.0 * self.links


def _at(a: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """``a[i]``, 0 outside of it."""
    out = a.take(i, mode="clip")
    if len(i) and (i.min() < 0 or i.max() >= n):
        out[(i < 0) | (i >= n)] = 0
    return out


def _inside(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which positions lie in one of the spans, which don't overlap and are in order."""
    if not len(begin):
        return np.zeros(len(at), bool)
    k = np.searchsorted(begin, at, "right") - 1
    return (k >= 0) & (at < end[np.maximum(k, 0)])


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and ends of the runs of a mask."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(mask)]])
    return edge[::2], edge[1::2]


def _links(p: np.ndarray, k: np.ndarray, n: int, char) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of addresses, and first positions of what has only the form of a host's name.

    An address is a run up to a blank, quote, bracket or comma that has ``://``,
    or begins with ``www.``, or begins with the name of a host (labels joined by
    dots, the last one of letters) and a slash.
    """
    begin, end = _spans((k & DELIM) == 0)
    if not len(begin):
        return begin, end, begin
    chunk = lambda at: np.searchsorted(begin, at, "right") - 1
    is_link = np.zeros(len(begin), bool)
    colon = char(":")
    is_link[chunk(colon[(_at(p, colon + 1, n) == 47) & (_at(p, colon + 2, n) == 47)])] = True
    w = begin[(p[begin] | 32) == 119]
    is_link[chunk(w[((_at(p, w + 1, n) | 32) == 119) & ((_at(p, w + 2, n) | 32) == 119) & (_at(p, w + 3, n) == 46)])] = True
    dots, other, slash = char("."), np.flatnonzero((k & (HOST | DELIM)) == 0), char("/")
    c = chunk(dots)
    c = np.unique(c[(c >= 0) & (dots > begin[c]) & (dots < end[c] - 1)])  # runs with a dot inside
    stop = np.searchsorted(slash, begin[c])
    stop = np.minimum(np.concatenate([slash, [n]])[stop], end[c])  # up to the first slash
    first_dot = np.concatenate([dots, [n]])[np.searchsorted(dots, begin[c])]
    first_other = np.concatenate([other, [n]])[np.searchsorted(other, begin[c])]
    letters = LETTER | HOST
    named = (first_dot < stop) & (first_other >= stop) & ((k[stop - 1] & letters) == letters) & ((_at(k, stop - 2, n) & letters) == letters) & ((k[begin[c]] & (LETTER | DIGIT)) > 0)
    path = named & (stop < end[c])
    is_link[c[path]] = True
    bare = c[named & ~path & ((k[begin[c]] & UPPER) == 0)]
    return begin[is_link], end[is_link], begin[bare[~is_link[bare]]]


def _encoded(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of long runs that are encoded data: digits and both cases without a break. A path or a word hasn't those."""
    a, b = _spans((k & RUN) > 0)
    long = b - a >= 60
    a, b = a[long], b[long]
    if not len(a):
        return a, b
    has = np.ones(len(a), bool)
    for kind in (DIGIT, UPPER, LOWER):
        at = np.flatnonzero((k & kind) != 0)
        has &= np.searchsorted(at, b) > np.searchsorted(at, a)
    return a[has], b[has]


def _block(text: str, doc_at: list[int], docs: list[int]) -> Lines:
    """Lines of a text that ends with a line end; document ``docs[i]`` begins at ``doc_at[i]``."""
    p = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    k = kinds()[p]
    n = len(p)
    stop = np.flatnonzero((k & NEWLINE) != 0)
    begin = np.concatenate([[0], stop[:-1] + 1])
    total = len(begin)
    line_at = lambda at: np.searchsorted(stop, at)
    count = lambda at: np.bincount(line_at(at), minlength=total)
    is_ = lambda at, kind: (_at(k, at, n) & kind) > 0
    edge = lambda at: is_(at, SPACE) | (at < 0)

    blank = (k & SPACE) != 0
    filled = np.flatnonzero(~blank)
    first = np.concatenate([filled, [n]])[np.searchsorted(filled, begin)]
    sign = np.flatnonzero((k & SIGN) != 0)
    sign_p, sign_k = p[sign], k[sign]
    char = lambda c: sign[sign_p == ord(c)]
    of = lambda kind: sign[(sign_k & kind) != 0]
    link, link_end, host = _links(p, k, n, char)
    code_begin, code_end = _encoded(k)
    plain = lambda at: at[~(_inside(at, link, link_end) | _inside(at, code_begin, code_end))]

    # Words: runs of letters; in unspaced scripts each character with the next.
    ws, we = _spans((k & (LETTER | WIDE)) == LETTER)
    there = ~(_inside(ws, link, link_end) | _inside(ws, code_begin, code_end))
    ws, we = ws[there], we[there]
    folded = lower()[p]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(folded * _power(_BASE, n), out=sums[1:])
    h = (sums[we] - sums[ws]) * _power(_INVERSE, n)[ws]
    short = we - ws <= SHORT
    wide = plain(np.flatnonzero((k & WIDE) != 0))
    if len(wide):
        pair = folded[wide] * np.uint64(_BASE) + np.where(is_(wide + 1, WIDE), _at(folded, wide + 1, n), 0).astype(np.uint64)
        order = np.argsort(np.concatenate([ws, wide]), kind="stable")
        h, ws, short = np.concatenate([h, pair])[order], np.concatenate([ws, wide])[order], np.concatenate([short, np.zeros(len(wide), bool)])[order]
    line = line_at(ws)

    digit = np.flatnonzero((k & DIGIT) != 0)
    digit = plain(digit[~is_(digit - 1, DIGIT)])
    end = of(END)
    after = is_(end + 1, SPACE | QUOTE) | np.isin(_at(p, end + 1, n), (41, 93))
    end = plain(end[after | np.isin(p[end], [ord(c) for c in FULL_STOPS])])
    end = end[~((p[end] == 46) & is_(end - 1, DIGIT) & (end - first[line_at(end)] < 5))]  # the number of an item
    code = of(CODE)
    code = plain(code[~(np.isin(code, link - 1) | np.isin(code, link_end))])
    quote = of(QUOTE)
    quote = quote[~(is_(quote - 1, LETTER) & is_(quote + 1, LETTER))]
    mark = plain(np.flatnonzero((k & MARK) != 0))
    comma = char(",")
    dash = sign[(sign_p == 45) | (sign_p == 47)]
    marks = np.concatenate([mark, comma[is_(comma + 1, SPACE)], dash[is_(dash - 1, SPACE) & is_(dash + 1, SPACE)]])
    tag = sign[(sign_p == 35) | (sign_p == 64)]
    tag = tag[is_(tag + 1, LETTER) & (edge(tag - 1) | is_(tag - 1, DELIM | MARK))]
    point = sign[(sign_p == 44) | (sign_p == 46)]
    price = point[is_(point - 1, DIGIT) & is_(point + 1, DIGIT) & is_(point + 2, DIGIT) & ~is_(point + 3, DIGIT)]
    percent = char("%")
    price = plain(np.concatenate([price, percent[is_(percent - 1, DIGIT)]]))
    hyphen, money = char("-"), of(MONEY)
    goods = plain(np.concatenate([hyphen[is_(hyphen - 1, UPPER) & is_(hyphen + 1, DIGIT)], money[is_(money - 1, DIGIT) | is_(money + 1, DIGIT) | is_(money - 1, SPACE) & is_(money - 2, DIGIT)]]))
    # What machines write: numbers after a colon, paths, capitals inside words.
    colon, slash = char(":"), char("/")
    inner = np.flatnonzero(((k[1:] & UPPER) != 0) & ((k[:-1] & LOWER) != 0))
    trace = plain(np.sort(np.concatenate([colon[is_(colon + 1, DIGIT)], slash[is_(slash + 1, LETTER) & ~is_(slash - 1, DELIM) & (_at(p, slash - 1, n) != 60)], inner])))
    gap = np.flatnonzero(~blank[2:] & blank[1:-1] & blank[:-2]) + 2
    gap = gap[~is_(gap - 1, NEWLINE)]
    gap = gap[gap > first[line_at(gap)]]

    words = np.bincount(line, minlength=total)
    # Marks of a notebook's form: cell headings and prompts.
    heads = [[_at(p, first + i, n) == ord(c) for i, c in enumerate(s)] for s in ("# %%", "In [", "In[", "Out[")]
    frame = np.all(heads[0], 0) | (np.any([np.all(x, 0) for x in heads[1:]], 0) & (words <= 1))
    kept = np.flatnonzero((first < stop) & ~frame)
    number = np.full(total, -1, np.int64)
    number[kept] = np.arange(len(kept))
    line = number[line]
    there = line >= 0
    doc = np.array(docs, np.int64)[np.searchsorted(np.array(doc_at), begin[kept], "right") - 1]
    each = (words, count(wide), count(digit), count(link), count(end), count(code), count(quote), count(marks), count(tag), count(price), count(goods), count(gap), count(host), count(trace))
    return Lines(doc, *(x[kept].astype(np.float64) for x in each), mixed(h[there]), line[there], short[there])


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of at most BLOCK characters, cut after line ends, else after blanks."""
    a = 0
    while len(text) - a > BLOCK:
        b = text.rfind("\n", a, a + BLOCK) + 1 or text.rfind(" ", a, a + BLOCK) + 1 or a + BLOCK
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def read(texts: list[str | None]) -> Lines:
    """The lines of all texts, in order."""
    out: list[Lines] = []
    held: list[str] = []
    at, docs, size = [], [], 0

    def flush() -> None:
        nonlocal held, at, docs, size
        if held:
            out.append(_block("".join(held), at, docs))
        held, at, docs, size = [], [], [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        for piece in _pieces(page_text(t)):
            if size + len(piece) > BLOCK:
                flush()
            at.append(size)
            docs.append(i)
            held += [piece, "\n"]
            size += len(piece) + 1
    flush()
    if not out:
        empty = np.empty(0)
        return Lines(np.empty(0, np.int64), *[empty] * 14, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))
    base = np.cumsum([0, *(len(x.doc) for x in out[:-1])])
    for x, b in zip(out, base, strict=True):
        x.line = x.line + b
    return Lines(*(np.concatenate([getattr(x, f.name) for x in out]) for f in fields(Lines)))
