"""Search by max-sketches against scoring every document in plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import lexical


def plain_terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def plain_search(docs, items, k=10):
    counted = [(i, plain_terms(t)) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in counted:
            m = 100 - 75 + ((75 * c.total() * n) // length)
            score = sum(
                many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, many in plain_terms(text).items()
                if c[t]
            )
            if score > 0 and doc is not None:
                rows.append((-score, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def drawn(seed, many):
    draw = random.Random(seed)
    pool = [f"{a}{b}" for a in ("the", "Été", "9x", "语", "z") for b in range(60)]
    weights = [1 / (i + 1) for i in range(len(pool))]
    text = lambda size: draw.choice([" ", "-", "\x7f", ", "]).join(draw.choices(pool, weights, k=size))
    docs = [(i, text(draw.randint(1, 80))) for i in range(many)]
    docs += [(many + i, docs[i % 5][1]) for i in range(30)]  # many copies: ties
    docs += [(5000, None), (5001, ""), (5002, "--- !"), (None, text(9)), (5003, docs[1][1].upper()), (5004, " ".join([text(2000)] * 3))]
    docs += [docs[3], docs[3]]  # repeated rows
    items = [(i, text(draw.randint(1, 25))) for i in range(15)] + [(20, None), (21, " "), (22, "unknownword"), (23, docs[0][1]), (23, docs[2][1]), (None, text(4))]
    return docs, items


@pytest.mark.parametrize("width", [1 << 16, 8])
def test_the_result_is_the_plain_one(spark, monkeypatch, width):
    """Also where most terms collide, and items come in several blocks."""
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    docs, items = drawn(width, 200)
    table = spark.createDataFrame([(*d, "a", 1, 2) for d in docs], "doc_id long, text string, term string, q int, n int").repartition(4)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    found = sorted((tuple(r) for r in lexical.search(table, asked, width=width, counted=40).collect()), key=str)
    assert found == plain_search(docs, items)
    assert lexical.search(table.limit(0), asked).count() == lexical.search(table, asked.limit(0)).count() == 0


def test_bounds_are_bounds():
    docs, items = drawn(5, 60)
    counted = [c for c in (lexical.term_counts((t or "").encode()) for _, t in docs) if c]
    total = sum(c.total() for c in counted)
    block = lexical.Block(
        [(i, lexical.term_counts((t or "").encode())) for i, t in items],
        Counter(t for c in counted for t in c), len(counted), total,
    )
    sketches = [lexical.sketch(c) for c in counted]
    sizes = block.sizes(np.array([c.total() for c in counted]))
    bounds = block.bounds(sizes, [a.tobytes() for a, _ in sketches], [lexical._packed(t) for _, t in sketches])
    exact = np.array([[block.score(c, q) for q in range(len(items))] for c in counted])
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.9


def test_long_texts_are_read_in_parts(monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choices("aBÉ语 -.\x7f9", k=draw.randint(0, 300))) for _ in range(100)]
    whole = [lexical.term_counts(t.encode()) for t in texts]
    monkeypatch.setattr(lexical, "AT_ONCE", 9)
    assert [lexical.term_counts(t.encode()) for t in texts] == whole == [Counter({w.encode(): n for w, n in plain_terms(t).items()}) for t in texts]
