"""Encoding against the public library, on awkward texts, all code points, and random ones."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import tokens as T

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=T.ranks(T.VOCABULARY, T.TOKENIZERS), special_tokens={})


def encode(texts, enc=None):
    raw, offsets = T.valid_bytes(pa.array(texts, pa.string()))
    ids, by_doc, _, _ = (enc or T.Encoder()).encode(raw, offsets)
    return [ids[a:b].tolist() for a, b in zip(by_doc[:-1], by_doc[1:], strict=True)]


AWKWARD = [
    "", " ", "  ", "\n", "a", "don't I'LL we've 'S 's's's ''s  's\n's \t's", "it's'll've're'd'm't'x", "  two  spaces \n\n x", "trailing   ", "x" * 5000, "ab" * 300 + "1" * 100,
    "<|endoftext|> <|startoftext|>", "１２٣ Ⅷ½²", "減肥茶 한국어 ไทย", "é‍\U0001f468‍\U0001f469", " a b　c\u0085d\x1ce\x00f", "a\r\n\r\n b", "'", "' ", " '", "l'", "'l", "'r", "'v l", "'ll", "'lll", "'re's",
    "A" * 40 + " " * 40 + "=" * 40, "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAB" * 20,
]


def test_awkward(library):
    assert encode(AWKWARD) == [library.encode_ordinary(t) for t in AWKWARD]


def test_null_and_slices():
    arr = pa.array(["x", None, "hello world", ""], pa.string()).slice(1)
    raw, offsets = T.valid_bytes(arr)
    assert raw.tobytes() == b"hello world" and offsets.tolist() == [0, 0, 11, 11]
    assert encode([None, None]) == [[], []] and encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("'sdmtlvrea 1²\n\t.,-é漢 "), max_size=30), max_size=6))
def test_random(texts):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=T.ranks(T.VOCABULARY, T.TOKENIZERS), special_tokens={})
    assert encode(texts) == [enc.encode_ordinary(t) for t in texts]


def test_every_code_point(library):
    """Each code point between a letter, a digit and blanks. Differences can only come from another version of Unicode: there must be few."""
    every = [f"a{chr(c)}1 {chr(c)}x" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    got, enc = [], T.Encoder()
    for i in range(0, len(every), 100_000):
        got += encode(every[i : i + 100_000], enc)
    wrong = [t for t, g in zip(every, got, strict=True) if g != library.encode_ordinary(t)]
    import unicodedata

    assert [t for t in wrong if unicodedata.category(t[1]) != "Cn"] == [] and len(wrong) < 12_000


def test_scan_is_composition():
    rng = np.random.default_rng(0)
    generators, table, images, _ = T.monoid()
    f = generators[rng.integers(0, 16, 3000)]
    got, state = T.scan(f), 0
    for i, g in enumerate(f):
        state = images[g][state]
        assert images[got[i]][0] == state


def test_merge_alone_equals_merge_together(library):
    rank = T.ranks(T.VOCABULARY, T.TOKENIZERS)
    rng = np.random.default_rng(1)
    pairs = T.Pairs(rank)
    for width in (1, 2, 7, 31, 80, 200):
        pieces = rng.integers(97, 103, (20, width)).astype(np.uint8)
        ids, lens = T.merge_many(pieces, pairs)
        for row, n, p in zip(ids, lens, pieces, strict=True):
            assert row[:n].tolist() == T.merge(p.tobytes(), rank) == library._encode_single_piece(p.tobytes())


def test_cache_is_bounded():
    enc = T.Encoder(limit=50)
    first = encode([" ".join(map(str, range(500)))], enc)
    assert encode(["x"], enc) and enc.count < 10 and encode([" ".join(map(str, range(500)))], enc) == first


def test_frames(spark):
    rows = [(i, t, "c") for i, t in enumerate([*AWKWARD, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = T.encode(df)
    assert out.columns == ["doc_id", "ids"]
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == encode([t for _, t, _ in rows])
    back = {r["doc_id"]: r["text"] for r in T.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in T.encode(df, what="n_tokens").collect()} == {k: len(v) for k, v in got.items()}
    o = T.encode(df, what="offsets").where("doc_id = 5").collect()[0]
    assert len(o["ids"]) == len(o["starts"]) and o["starts"][0] == 0 and o["starts"] == sorted(o["starts"])
    assert T.encode(df.limit(0)).collect() == []


def test_bad_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text")
    assert T.encode(df).collect()[0]["ids"] == encode(["a�b"])[0]
