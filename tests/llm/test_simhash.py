"""SimHash fingerprints, pivot tables and components against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(len(words), 3)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The least position of each one's component."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def planted(draw, groups, steps):
    """Fingerprints in chains of up to two changed bits, some bits changed often, and strangers."""
    out = []
    for _ in range(groups):
        x = draw.getrandbits(64)
        out.append(x)
        for _ in range(steps):
            for b in draw.sample(range(64), draw.randint(0, 3)):
                x ^= 1 << b
            out.append(x)
    return list(dict.fromkeys([*out, 0, 1, 3, (1 << 64) - 1, *(draw.getrandbits(64) for _ in range(60))]))


def test_fingerprints_by_the_letter(monkeypatch):
    draw = random.Random(2)
    words = ["The", "ÉTÉ", "x", "été", "语言", "\x1f", "a.b", "\x85", "Z" * 40]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 12))) + draw.choice(["", "\n", "\t\x0b "]) for _ in range(300)]
    for size in (1 << 20, 7):  # whole, and in parts of few bytes
        monkeypatch.setattr(simhash, "AT_ONCE", size)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_close_pairs_are_all_pairs():
    draw = random.Random(3)
    prints = np.array(planted(draw, 12, 8), "u8")
    prints = prints[np.argsort(simhash.pivot_rows(prints)[:, 0], kind="stable")]
    found = {(int(a), int(b)) for i, j in simhash.close_pairs(prints, simhash.pivot_rows(prints)) for a, b in zip(i, j)}
    wanted = {(i, j) for j in range(len(prints)) for i in range(j) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert found == wanted and len(wanted) > 30


@pytest.mark.parametrize("cell", [2048, 3])
def test_no_link_is_lost(spark, monkeypatch, cell):
    """Also with cells so small that most are dealt out again and again."""
    monkeypatch.setattr(simhash, "CELL", cell)
    draw = random.Random(cell)
    base = draw.getrandbits(64)
    crowd = [base ^ x for x in range(64)] if cell == 3 else []  # one crowded spot
    prints = list(dict.fromkeys(planted(draw, 6, 6) + crowd))
    frame = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    stars = {(r.a, r.b) for r in simhash.links(frame).collect()}
    place = {signed(p): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for a, b in stars:
        x, y = root[place[a]], root[place[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == plain_groups(prints)


def test_documents(spark):
    draw = random.Random(9)
    pool = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "One", "one two", "ONE TWO"]
    for _ in range(12):
        words = draw.choices(pool, k=draw.randint(30, 400))
        texts.append(" ".join(words))
        for _ in range(4):
            words = list(words)
            words[draw.randrange(len(words))] = draw.choice(pool)
            texts.append(" ".join(words))
    draw.shuffle(texts)
    rows = [(i + 1, t, "k", 7) for i, t in enumerate(texts)] + [(None, texts[3], "k", 7), (1, texts[0], "k", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, cell int").repartition(3)
    found = simhash.fingerprint_groups(docs).collect()
    prints = [plain_fingerprint(t) for t in texts]
    root = plain_groups(prints)
    wanted = {(i + 1, f"{p:016x}", root[i] + 1) for i, p in enumerate(prints)}
    assert len(found) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert simhash.fingerprint_groups(docs.where(F.lit(False))).count() == 0
