"""Quotient filters, and phrases against counting them in plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import collocations as c


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 4), st.integers(1, 32), st.integers(0, 6), st.data())
def test_filters_lose_nothing(n, bits, skip, data):
    shape = c.Shape(n, bits)
    skip = min(skip, shape.low)
    seed = data.draw(st.integers(0, 1 << 30))
    draw = np.random.default_rng(seed)
    codes = draw.integers(0, 1 << bits, data.draw(st.integers(0, 300)), dtype="u8").astype("u4")
    low, high, at = shape.pack(codes)
    wanted = Counter(tuple(codes[i : i + n].tolist()) for i in range(len(codes) - n + 1) if codes[i : i + n].all())
    low, high, counts, _ = shape.counted(low, high)
    counts = counts * data.draw(st.sampled_from([1, 254, 255, 10**12]))
    found = Counter()
    for prefix, a, b in c._cuts(low, shape, skip):
        part = c.filter_bytes(shape, skip, low[a:b], high[a:b], counts[a:b])
        x, y, many = c.filter_entries(shape, skip, prefix, part)
        assert (x == low[a:b]).all() and (y == high[a:b]).all() and (many == counts[a:b]).all()
        twice = c.merged(shape, skip, prefix, [part, part])
        assert (twice[2] == 2 * many).all() and (twice[0] == x).all() and (twice[1] == y).all()
        found.update({tuple(p): int(m) for p, m in zip(shape.unpack(x, y).tolist(), many)})
    factor = counts.sum() // max(wanted.total(), 1)
    assert found == Counter({k: v * factor for k, v in wanted.items()})


def test_steps_are_one_to_one():
    for width in (1, 2, 3, 8):
        shape = c.Shape(2, 4)
        every = np.arange(1 << width, dtype="u8")
        assert sorted(shape._step(every, width, 0).tolist()) == every.tolist()


def plain(docs, least, top, longest=4):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items()):
                continue
            score, _, l, r = min(((2000000 * a) // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def drawn(seed):
    draw = random.Random(seed)
    pool = ["The", "of", "Été", "x\x1f", "语", "a-b", "\x85"] + [f"w{i}" for i in range(25)]
    fixed = ["new york city", "of the first", "Été x\x1f 语 w1", "w2 w2 w2 w2 w2", "on the other hand"]
    docs = []
    for _ in range(120):
        words = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(pool) + draw.choice(["", "", "", ".", "!", "\n", "\t", "\x0b", "  "]) for _ in range(draw.randint(0, 60))]
        docs.append((draw.choice(["en", "fr", None, "und"]), " ".join(words)))
    return [*docs, ("en", None), (None, ""), ("fr", " . "), docs[0], docs[0], ("es", "once only")]


@pytest.mark.parametrize("chunk,size,top", [(1 << 21, 1 << 19, 2000), (100, 32, 7)])
def test_phrases_are_the_plain_ones(spark, monkeypatch, chunk, size, top):
    """In one chunk and range, and in many."""
    monkeypatch.setattr(c, "RANGE", size)
    docs = drawn(size)
    table = spark.createDataFrame([(*d, 1, "x", 5) for d in docs], "lang string, text string, a long, word string, code int").repartition(3)
    found = sorted(tuple(r) for r in c.collocations(table, least=4, top=top, chunk=chunk).collect())
    assert found == plain(docs, 4, top)
    assert len(found) > 20


def test_lengths_and_empty_tables(spark):
    docs = drawn(1)
    table = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in c.collocations(table, least=5, longest=2).collect()) == plain(docs, 5, 2000, 2)
    assert c.collocations(table.limit(0)).count() == 0
    assert c.collocations(table, least=10_000).count() == 0
    with pytest.raises(ValueError):
        c.collocations(table, longest=5)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(t or "" for _, t in drawn(3)).encode()
    whole = c.Chunk()
    whole.add(text)
    monkeypatch.setattr(c, "AT_ONCE", 11)
    parts = c.Chunk()
    parts.add(text)
    assert parts.row() == whole.row()
