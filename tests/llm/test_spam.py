"""Planted pages: lists of all kinds must be found, what only looks like them must not."""

import itertools
import json
import random

import numpy as np
import pytest

from rillstone.llm import lines as L
from rillstone.llm import spam as S

GOODS = ["garden lamp", "phone case", "running shoes", "slim tea", "vpn offer"]
MORE = ["cheap", "buy", "free", "best", "online", "discount", "shop"]
NOUNS = ["sensor", "matrix", "window", "record", "ledger", "curve", "signal", "batch"]


def sentence(r):
    return f"Note that the {r.choice(NOUNS)} drifts when the {r.choice(NOUNS)} is noisy, so we load it again before step {r.randrange(90)}."


def code(r):
    n = r.choice(NOUNS)
    return f"df = rows[rows['{n}'] > 0.{r.randrange(999)}]\nprint(len(df), df.shape)"


def url(r):
    return f"https://my-{r.choice(NOUNS)}.example/{r.choice(NOUNS)}/{r.choice(NOUNS)}?id={r.randrange(9999)}"


def bad(r, kind):
    n = r.randrange(25, 60)
    g = r.choice(GOODS)
    if kind == "keywords":
        return "\n".join(f"{r.choice(MORE)} {g} {r.choice(MORE)}" for _ in range(n))
    if kind == "repeat":
        return "\n".join(" ".join([g] * 5) for _ in range(n))
    if kind == "links":
        return "\n".join(f"{i}. {r.choice(NOUNS)}: {url(r)}" for i in range(n))
    if kind == "anchors":
        return " ".join(f'<b><a href="{url(r)}">{r.choice(GOODS)}</a></b>,' for _ in range(n))
    if kind == "tags":
        return "tags = " + " ".join("#" + g.replace(" ", "") for g in r.choices(GOODS + MORE, k=n))
    if kind == "offers":
        return "\n".join(f"{g} K-{r.randrange(9999)} | XL | {r.randrange(400)}.{r.randrange(10, 99)} USD" for _ in range(n))
    return " | ".join(f"{r.choice(MORE)} {g}" for _ in range(n))


def good(r, kind):
    if kind == "prose":
        return "\n".join(sentence(r) for _ in range(12))
    if kind == "code":
        return "\n".join(code(r) for _ in range(8))
    if kind == "log":
        return "\n".join(f"/srv/env/core_{r.randrange(3)}.py:84: SlowPathWarning: {r.choice(NOUNS)} is read twice" for _ in range(60))
    if kind == "table":
        return "\n".join(f"{i}        {r.uniform(-99, 99):.4f}      {r.uniform(-99, 99):.4f}" for i in range(40))
    if kind == "words":
        return "stop = {" + ", ".join(f"'{w}'" for w in r.choices(MORE + NOUNS, k=40)) + "}\nrows = [x for x in rows if x not in stop]"
    return "\n".join(f"* [{r.choice(NOUNS)}]({url(r)}) {sentence(r)}" for _ in range(12))


BAD = ["keywords", "repeat", "links", "anchors", "tags", "offers", "phrases"]
GOOD = ["prose", "code", "log", "table", "words", "linked"]


def notebook(parts):
    return json.dumps({"cells": [{"cell_type": "markdown", "source": p.splitlines(keepends=True)} for p in parts], "nbformat": 4}, indent=1)


def pages(seed, n):
    r = random.Random(seed)
    for i in range(n):
        spam = i % 4 == 0
        parts = [bad(r, r.choice(BAD)) if spam else good(r, r.choice(GOOD)) for _ in range(r.randrange(1, 4))] + [sentence(r)]
        form = i % 3
        yield (notebook(parts) if form == 0 else "\n\n".join(parts) if form == 1 else "# %% [markdown]\n" + "\n".join("# " + x for p in parts for x in p.splitlines())), spam


@pytest.fixture(scope="module")
def model():
    return S.train([t for t, _ in pages(1, 400)])


def test_held_out_accuracy(model):
    held = list(pages(2, 400))
    flagged = [s > S.SHARE for s in model.shares([t for t, _ in held])]
    wrong = [(t[:80], y) for (t, y), f in zip(held, flagged, strict=True) if f != y]
    assert len(wrong) <= 8, wrong


def test_odd_texts(model):
    assert model.shares([None, "", "  \n ", "123", "\x00", "{", '{"cells": [', '{"cells": 5}']) == pytest.approx([0, 0, 0, 0, 0, 0, 0, 0])
    broken = notebook([bad(random.Random(0), "keywords")])[:-40]
    assert model.shares([broken])[0] > S.SHARE
    assert model.shares(["buy cheap garden lamp " * 50_000])[0] > S.SHARE
    assert model.shares(["iVBORw0KGgoAAAANSUhEUgAAB1" * 50]) == [0.0] and L.read(["iVBORw0KGgoAAAANSUhEUgAAB1" * 50]).weight.tolist() == [0.0]
    assert S.train([]).shares(["a b c"]) is not None


def test_viterbi_is_the_best_path(model):
    done = 0
    for text, _ in pages(3, 60):
        x = L.read([text])
        seen = S.observe(x, S.words_of(x), model.odds)
        if not 0 < len(seen) <= 6:
            continue
        done += 1
        cost = model.costs(x, seen)
        score = lambda path: model.first[path[0]] + cost[0][path[0]] + sum(model.move[a, b] + c[b] for a, b, c in zip(path, path[1:], cost[1:], strict=False))  # noqa: E731, B023
        best = max(score(q) for q in itertools.product(range(S.STATES), repeat=len(cost)))
        assert np.isclose(score(model.states(x, seen).tolist()), best)
    assert done >= 3


def test_a_page_is_labelled_alike_in_any_company(model):
    texts = [t for t, _ in pages(4, 40)] + [None, ""]
    assert model.shares(texts) == pytest.approx([model.shares([t])[0] for t in texts])


def test_nothing_depends_on_a_beginning(model):
    """A notebook is one however much stands before its cells, and a long tag or address is taken whole."""
    cells = json.loads(notebook([bad(random.Random(1), "keywords"), sentence(random.Random(1))]))
    plain, late = json.dumps(cells), json.dumps({"about": "x " * 4000} | cells)
    assert L.page_text(late) == L.page_text(plain) and model.shares([late]) == model.shares([plain])
    long = "https://shop.example/" + "cheap/" * 2000
    x = L.read([f"<a href='{long}'>buy</a>"])
    assert x.links.tolist() == [1] and x.words.tolist() == [4]


def test_seeds_are_no_feature(model):
    """The model takes lines that no seed speaks of, and overrules seeds."""
    x = L.read([t for t, _ in pages(6, 200)])
    w = S.words_of(x)
    seed, state = S.seeds(x, w), model.states(x, S.observe(x, w, model.odds))
    assert (S.LABEL[state[seed < 0]] != S.PROSE).any() and (S.LABEL[state[seed >= 0]] != S.LABEL[seed[seed >= 0]]).any()


def test_counts_of_lines():
    x = L.read(["see http://a.b/c, [x](shop.example/y) and name-one.com\n#tag @tag a-b\n\n  \n# %% [x]\nprice K-123 | 12.50 USD. Don't 5%\ndf = f(x) + [1]", None, "", "日本語の文。", "1. a.  12\n  b"])
    assert x.doc.tolist() == [0, 0, 0, 0, 3, 4, 4]
    assert x.words.tolist() == [6, 4, 5, 3, 5, 1, 1] and x.wide.tolist() == [0, 0, 0, 0, 5, 0, 0]
    assert x.links.tolist() == [2, 0, 0, 0, 0, 0, 0] and x.hosts.tolist() == [1, 0, 0, 0, 0, 0, 0]
    assert x.tags.tolist() == [0, 2, 0, 0, 0, 0, 0] and x.prices.tolist() == [0, 0, 2, 0, 0, 0, 0] and x.goods.tolist() == [0, 0, 1, 0, 0, 0, 0]
    assert x.ends.tolist() == [0, 0, 1, 0, 1, 1, 0] and x.gaps.tolist() == [0, 0, 0, 0, 0, 1, 0] and x.code.tolist()[3] == 5


def test_long_texts_are_read_in_parts(monkeypatch):
    texts = ["\n".join(sentence(random.Random(i)) for i in range(60)), "word " * 500, "x" * 900]
    whole = L.read(texts)
    monkeypatch.setattr(L, "BLOCK", 400)
    parts = L.read(texts)
    assert parts.weight.sum() >= whole.weight.sum() and parts.doc[parts.doc == 0].size == 60
    assert sorted(parts.word[parts.line < 60]) == sorted(whole.word[whole.line < 60])


def test_frames(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(pages(5, 120))] + [(1000, None, "x"), (None, "buy cheap " * 50, "x"), (0, next(pages(5, 1))[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, list_share string")
    got = S.flag(df).collect()
    assert {r["doc_id"] for r in got} >= {i for i in range(0, 120, 8)} and sum(r["doc_id"] == 0 for r in got) == 2
    assert S.flag(df.limit(0)).collect() == []
    few = S.fit(df, sample_docs=5)
    assert few.odds is not None and S.fit(df, sample_bytes=10).shares(["a"]) == [0.0]
