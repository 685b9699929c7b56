"""The methods inside the operators against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tablewright.llm import decontaminate, languages, licenses, lm, mixing, neardup, secrets, tokens, topk, toxicity


# -- tokens -------------------------------------------------------------------------


def test_counts_are_the_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        ours = tokens.Counter(file.read())
    draw = random.Random(1)
    letters = "aAbB zÉé́ΣσςİIß'sTre 12３一二\x1c\x1f\x85\xa0　​\n\t<|startoftext|>é가ﬁ#$%😀👍🏽\x00"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) + draw.choice(["", "<|endoftext|>", "<|startoftext|> a"])
        assert ours.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert ours.count("ab" * 9000) == len(library.encode("ab" * 9000, add_special_tokens=False).ids)


# -- languages ----------------------------------------------------------------------


def _path_by_trial(scores, switch):
    best = max(
        itertools.product(range(scores.shape[1]), repeat=len(scores)),
        key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:])),
    )
    return sum(scores[i, k] for i, k in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:]))


def test_paths_are_the_best_ones():
    draw = np.random.default_rng(3)
    scores = draw.normal(size=(40, 3)).astype("f4") * 3
    lengths = np.array([5, 1, 6, 3])
    starts = np.cumsum(lengths) - lengths
    ids = draw.integers(0, 40, lengths.sum())
    for switch in (0.5, 2.0, 9.0):
        path = languages.best_paths(ids, starts, lengths, scores, switch)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        single, fixed = languages.settled(scores[ids], starts, owner, switch)
        for k, (a, n) in enumerate(zip(starts, lengths)):
            own, p = scores[ids[a : a + n]], path[a : a + n]
            value = own[np.arange(n), p].sum() - switch * (np.diff(p) != 0).sum()
            assert math.isclose(value, _path_by_trial(own, switch), rel_tol=1e-5, abs_tol=1e-5)
            if fixed[k]:
                assert math.isclose(own[:, single[k]].sum(), value, rel_tol=1e-5, abs_tol=1e-5)


def test_settled_texts_have_no_better_path():
    each = np.array([[-10, 0, -100], [-10, -100, 0]], "f4")
    _, fixed = languages.settled(each, np.array([0]), np.zeros(2, int), 12.0)
    assert not fixed[0]
    draw = np.random.default_rng(12)
    settled = 0
    for langs in (3, 4, 5):
        for _ in range(150):
            lengths = draw.integers(1, 6, 4)
            starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(4), lengths)
            each = draw.normal(size=(lengths.sum(), langs)).astype("f4") * 6
            each[:, 0] += draw.choice([0, 2, 4])  # often second best everywhere
            switch = float(draw.choice([4.0, 8.0, 12.0]))
            best, fixed = languages.settled(each, starts, owner, switch)
            for k in np.flatnonzero(fixed):
                own = each[starts[k] : starts[k] + lengths[k]]
                assert own[:, best[k]].sum() >= _path_by_trial(own, switch) - 1e-3
            settled += fixed.sum()
    assert settled > 100


def test_mixed_text_has_spans(spark):
    en, de = "the cat sat with that other cat on the mat and then it went", "der hund und die katze sind nicht auf dem schönen weg"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.fit_languages(docs)
    mixed = spark.createDataFrame([(1, f"{en} {de}"), (2, "γράμμα και λόγος")], "doc_id long, text string")
    found = {r.doc_id: r.language for r in languages.label_languages(mixed, model).collect()}
    assert [(s.first, s.stop, s.lang) for s in found[1].spans] == [(0, 14, "en"), (14, 25, "de")]
    assert found[2].score > 0  # no language is written so; no evidence, but letters


# -- mixing -------------------------------------------------------------------------


def test_targets_and_taken_words(spark):
    draw = random.Random(2)
    rows = [(i, "w " * int(draw.paretovariate(1.1) * 5), f"s{i % 7}" if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs).collect()
    sizes: dict = {}
    for r in mixed:
        sizes.setdefault(r.source, [0, r.target, 0])
        sizes[r.source][0] += r["size"]
        sizes[r.source][2] += r.taken
    names = sorted([s for s in sizes if s is not None]) + [None]
    goal, left = 1.5 * sum(v[0] for v in sizes.values()), dict(zip(names, itertools.cycle((3, 1, 2))))
    target = {}
    while True:  # the excess is shared again until nobody is above the limit
        level = (goal - sum(target.values())) / sum(left.values())
        above = [s for s in left if left[s] * level > 2 * sizes[s][0]]
        if not above:
            break
        for s in above:
            target[s] = 2 * sizes[s][0]
            del left[s]
    target |= {s: w * level for s, w in left.items()}
    for s in names:
        assert math.isclose(sizes[s][1], target[s], rel_tol=1e-9)
        assert abs(sizes[s][2] - target[s]) <= 0.02 * target[s]
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mixed)


# -- secrets and licenses -----------------------------------------------------------


def test_examples_and_owners(spark):
    rows = [(i, 'api_key = "abcdEFGH12345678"', f"org{i}/repo") for i in range(5)]
    rows += [(10, "x Zq8kPmT4vLw9RtYb3NsD y", "org9/r"), (11, "é😀 TOKEN: deadbeefdeadbeefdeadbeefdeadbeef.", "org9/q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    assert all((found[i].n_live, found[i].n_example) == (0, 1) for i in range(5))
    assert found[10].spans == "mixed:2:22" and found[10].n_assign == 0
    assert found[11].spans == "assign:3:43,hex:10:42"
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert clean[0] == rows[0][1] and clean[10] == "x <secret> y" and clean[11] == "é😀 <secret>"


def test_bands_miss_no_notice(spark):
    texts = licenses.wordings(licenses.NOTICES)
    rows = [(k, f"some words before {text} and after it", ) for k, (_, text) in enumerate(texts)]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in found if r.containment == 1.0} >= {(k, n) for k, (n, _) in enumerate(texts)}
    for r in found:  # of a family only the license that is meant
        meant = texts[r.doc_id][0]
        assert r.license == meant or licenses.FAMILIES.get(r.license, r.license) != licenses.FAMILIES.get(meant, meant)
    for size, longest in licenses.template_groups():
        assert (1 - licenses.least_similarity(longest)) ** licenses.bands_for(longest) <= licenses.MISSED


def test_containment_is_the_plain_one(spark):
    """Wordings with words left out or changed, anywhere in a text, against every wording."""
    draw, texts = random.Random(21), licenses.wordings(licenses.NOTICES)
    rows = []
    for k in range(120):
        name, text = draw.choice(texts)
        words = text.split()
        for _ in range(draw.choice([0, 0, 1, 2])):
            words[draw.randrange(len(words))] = draw.choice(["", "other", "The"])
        filler = lambda: " ".join(draw.choices(["plain", "filler", "words", "stand", "here"], k=draw.randint(0, 400)))
        rows.append((k, f"{filler()} {' '.join(words)} {filler()}", name))

    def share(text, wording):
        own, words = licenses.plain_words(wording), licenses.plain_words(text)
        size = min(5, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        return len(wanted & {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}) / len(wanted)

    found = {}
    for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3)).collect():
        found[(r.doc_id, r.license)] = r.containment
    for k, text, _ in rows:
        held = {}
        for name, wording in texts:
            held[name] = max(held.get(name, 0), share(text, wording))
        for name, value in held.items():
            family = [n for n in held if licenses.FAMILIES.get(n, n) == licenses.FAMILIES.get(name, name)]
            if value >= 0.75 and value >= max(held[n] for n in family):
                assert math.isclose(found[(k, name)], value), (k, name)
            elif value < 0.75:
                assert (k, name) not in found, (k, name)


def test_versions_are_told_apart(spark):
    standard = dict(licenses.wordings({n: t[1:2] for n, t in licenses.NOTICES.items() if n.startswith(("GPL", "LGPL", "AGPL"))}))
    rows = [(0, standard["GPL-2.0"]), (1, standard["GPL-3.0"]), (2, standard["AGPL-3.0"]), (3, standard["LGPL-2.1"])]
    rows += [(4, "licensed under the GNU General Public License, version 2"), (5, f"{standard['GPL-2.0']} {'x ' * 300} {standard['GPL-3.0']}")]
    rows += [(6, "# SPDX-License-Identifier: GPL-2.0-or-later"), (7, "// SPDX-License-Identifier: MIT")]
    found = {}
    for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {0: {"GPL-2.0"}, 1: {"GPL-3.0"}, 2: {"AGPL-3.0"}, 3: {"LGPL-2.1"}, 4: {"GPL-2.0"}, 5: {"GPL-2.0", "GPL-3.0"}, 6: {"GPL-2.0"}, 7: {"MIT"}}


# -- top-k --------------------------------------------------------------------------


def test_max_score_is_exact():
    draw = np.random.default_rng(5)
    for _ in range(30):
        columns = np.floor(draw.normal(size=(9, 3000)) * 20)
        columns[:, draw.integers(0, 3000, 400)] = 7.0  # ties
        query, ids = np.floor(draw.normal(size=9) * 20), draw.permutation(3000)
        high, low = np.maximum(columns.max(1), 0), np.minimum(columns.min(1), 0)
        skip = int(draw.integers(0, 3000))
        at, score = topk.max_score(query, columns, high, low, ids, 10, skip)
        plain = query @ columns
        want = [i for i in np.lexsort((ids, -plain)) if i != skip][:10]
        assert at.tolist() == want and np.array_equal(score, plain[want])


# -- near copies --------------------------------------------------------------------


@pytest.mark.parametrize("pairwise", [8192, 12])
def test_links_of_planted_copies(spark, monkeypatch, pairwise):
    """In whole bands, and in pairs of blocks."""
    monkeypatch.setattr(neardup, "PAIRWISE", pairwise)
    draw = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    shared = " ".join(draw.choice(words) for _ in range(60))
    texts = []
    for g in range(30):
        base = [draw.choice(words) for _ in range(draw.choice([3, 6, 20, 80, 300]))]
        for _ in range(draw.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 40))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [f"{shared} {' '.join(draw.choice(words) for _ in range(150))}" for _ in range(80)]
    # a crowd of which most are near, but not near enough, to each other
    crowd = [draw.choice(words) for _ in range(120)]
    for _ in range(60):
        copy = list(crowd)
        for _ in range(draw.randint(2, 5)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [texts[0]] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in neardup.similar_groups(docs).collect()}
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) or {tuple(t.split())} for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert [found[i] for i in range(len(texts))] == root


def test_large_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRWISE", 16)
    draw = random.Random(9)
    rows = [(1, k, 0 if k < 70 else draw.choice([0, 70, 71, 72]), 10, b"same" * 31 + b"xx", 0) for k in range(100)]
    rows += [(2, k, k % 2, 10, b"same" * 31 + b"xx", 0) for k in range(200, 210)]
    members = spark.createDataFrame(rows, neardup.MEMBER).drop("band").repartition(5)
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] != b[2]}
    pairs, dealt = [], neardup._dealt(members).toPandas()
    for _, group in dealt.groupby("key"):
        group = neardup._in_order(group)
        node = group["node"].to_numpy()
        pairs += [tuple(sorted(p)) for i, j, _ in neardup._likely(group) for p in zip(node[i].tolist(), node[j].tolist())]
    assert len(pairs) == len(want) and set(pairs) == want  # each pair once
    groups = neardup._block_pairs(members.where("key = 1").withColumn("band", F.lit(0))).groupBy("key").agg(F.count_distinct("root").alias("roots"), F.count("*").alias("rows"))
    assert groups.where("rows > 16 OR roots < 2").isEmpty()


def test_texts_that_share_an_id_are_decided_singly(spark):
    draw = random.Random(10)
    text = lambda: " ".join(f"w{draw.randint(0, 9999)}" for _ in range(60))
    copied, clean, near = text(), text(), text()
    rows = [(1, copied), (2, f"{copied} more"), (2, clean), (3, near), (3, f"{near} more"), (4, text()), (4, text()), (5, clean.upper())]
    rows += [(6, rows[5][1]), (None, copied), (7, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in neardup.drop_near_copies(docs).collect()]
    one = [r for r in kept if r[0] == 3]
    assert len(one) == 1 and one[0] in rows
    want = [rows[k] for k in (0, 2, 5, 6, 9, 10, 11)]
    assert sorted((r for r in kept if r[0] != 3), key=str) == sorted(want, key=str)


# -- language model -----------------------------------------------------------------


def test_probabilities_sum_to_one():
    """Over all words and the unknown one, after every word."""
    counts = {("a", "a"): 4, ("a", "b"): 1, ("a", "."): 2, ("b", "a"): 3, ("b", "c"): 1, ("c", "."): 2}
    words = ["a", "b", "c", ".", "?"]  # the last is unknown
    n = np.array([7, 4, 2, 5, 0])
    kinds = np.array([3, 2, 1, 0, 0])
    left, right = (x.ravel() for x in np.meshgrid(range(5), range(5), indexing="ij"))
    pairs = np.array([counts.get((words[i], words[j]), 0) for i, j in zip(left, right)])
    model = lm.Automaton(18, 4, n, kinds, left, right, pairs)
    assert math.isclose((10**model.single).sum(), 1.0)
    after = (10**model.arc).reshape(5, 5).sum(1)
    assert np.allclose(after[[0, 1, 2, 4]], 1.0)  # nothing follows the end
    codes = np.array([0, 1, 4, 0, 3])  # a b ? a .
    arcs = model.arc.reshape(5, 5)
    steps = model.steps(codes, np.arange(4), codes[:4] * 5 + codes[1:])
    assert np.allclose(steps, [model.single[0], arcs[0, 1], arcs[1, 4], arcs[4, 0], arcs[0, 3]])
    assert math.isclose(arcs[4, 0], model.single[0]) and arcs[0, 1] > model.single[1] + math.log10(0.75 * 3 / 7)


def test_packed_numbers():
    draw = random.Random(8)
    for _ in range(50):
        x = np.array([draw.choice([0, 1, 254, 255, 256, 65534, 65535, 65536, 10**9]) for _ in range(draw.randint(0, 40))], "i8")
        assert (lm._unpack_codes(lm._pack_codes(x)) == x).all()
        reader = lm._Reader(lm._small(x * 1000) + lm._small(x))
        assert (reader.small() == x * 1000).all() and (reader.small() == x).all()


@pytest.mark.parametrize("chunk,size,hot", [(1 << 21, 1 << 19, 2000), (100, 64, 20), (1, 16, 3)])
def test_all_pairs_of_words_count(spark, monkeypatch, chunk, size, hot):
    """In one chunk and range; in many, with words whose pairs are dealt out."""
    monkeypatch.setattr(lm, "RANGE", size)
    monkeypatch.setattr(lm, "HOT", hot)
    draw = random.Random(6)
    texts = [" ".join(f"w{min(int(draw.paretovariate(0.7)), 60)}" for _ in range(draw.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, i % 5 > 0) for i, x in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    single, pairs = {}, {}
    for i, x in enumerate(texts):
        words = [*x.split(), None]
        for w in words if i % 5 else []:
            single[w] = single.get(w, 0) + 1
        for pair in zip(words, words[1:]) if i % 5 else []:
            pairs[pair] = pairs.get(pair, 0) + 1
    total, d = sum(single.values()), lm.DISCOUNT
    alone = lambda w: (single[w] - d) / total if w in single else d * len(single) / total

    def after(h, w):
        if h not in single:
            return alone(w)
        kinds = sum(a == h for a, _ in pairs)
        return (max(pairs.get((h, w), 0) - d, 0) + d * kinds * alone(w)) / single[h]

    rows = lm.fit_and_score(docs, "learn", chunk=chunk).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*texts[r.doc_id].split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in single for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((single.get(w, 0) + 1) / (total + len(single) + 1)) for w in words), rel_tol=1e-9)
        want = math.log10(alone(words[0])) + sum(math.log10(after(h, w)) for h, w in zip(words, words[1:]))
        assert math.isclose(r.score, want, rel_tol=1e-9), r.doc_id


# -- toxicity -----------------------------------------------------------------------


def test_gradients():
    draw = np.random.RandomState(0)
    net = toxicity.Network(toxicity.Evidence(draw.randn(toxicity.WORD_PLACES), draw.randn(toxicity.GRAM_PLACES)))
    for name in net.p:
        net.p[name] = net.p[name].astype("f8") * 3
    inputs = net.inputs(["alpha", "beta", "gamma!", "x"])
    ids, labels = np.array([[0, 1, 2, -1], [3, 3, -1, -1], [2, 1, 0, 3]]), np.array([1.0, 0, 1])

    def loss() -> float:
        both = net.vectors(inputs).astype("f8") @ net.p["in"] + net.p["bias"]
        logits = net.forward((both[:, : 3 * toxicity.HIDDEN], both[:, 3 * toxicity.HIDDEN :]), ids)
        return float(np.mean(np.log1p(np.exp(logits)) - labels * logits))

    for name, g in net.gradients(inputs, ids, labels).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = net.p[name][at]
        ends = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = kept + step
            ends.append(loss())
        net.p[name][at] = kept
        assert math.isclose(g[at], (ends[0] - ends[1]) / 2e-3, rel_tol=1e-2), name


# -- decontamination ----------------------------------------------------------------


def test_search_finds_all_above_the_limit():
    draw = random.Random(4)
    words = [f"v{int(draw.paretovariate(0.6))}" for _ in range(30_000)]
    take = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(k, take(draw.randint(6, 90))) for k in range(60)]
    df: dict = {}
    entries, total = 0, 0
    for _, text in items:
        ids = np.array(decontaminate.words_of(text), dtype=object)
        total += len(ids)
        for part in np.array_split(ids, max(1, math.ceil(len(ids) / decontaminate.HALF))):
            entries += 1
            for w in set(part):
                df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, entries, total / entries)
    for _ in range(300):
        words_ = take(100).split() + draw.choice(items)[1].split()[: draw.randint(0, 40)]
        terms = sorted({index.terms[w] for w in words_ if w in index.terms})
        score: dict = {}
        for t in terms:
            for k in range(index.start[t], index.start[t + 1]):
                score[int(index.entry[k])] = score.get(int(index.entry[k]), 0.0) + index.weight[k]
        for least in (0.2, 0.5):
            got = decontaminate.block_max_wand(terms, index, least)
            assert {e for e, _ in got} == {e for e, s in score.items() if s >= least}
    texts = [f"{take(200)} {text} {take(200)}".encode() for _, text in items]
    found = decontaminate._search(texts, index)
    assert all(k in {h["item_id"] for h in hits} for k, hits in enumerate(found))


def test_unicode_spaces_part_words(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "uno\u3000dos tres\u00a0cuatro cinco seis siete\u202focho")], "item_id long, text string")
    texts = [item.replace(" ", space) for space in ("\u00a0", "\u2003", "\u202f", "\u3000", "\u2028", "\x1f", "\x85")]
    texts += [item.replace("four ", "four\u3000").replace("eight ", "eight\u00a0"), "uno dos tres cuatro cinco seis siete ocho"]
    docs = spark.createDataFrame([(i, f"before\u00a0{x}\u3000after") for i, x in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {(i, 1, 1.0, 1.0) for i in range(8)} | {(8, 2, 1.0, 1.0)}
    assert decontaminate.drop_contaminated(docs, items).isEmpty()


def test_question_and_answer():
    assert decontaminate.question_words("What is it? A cat.") == 3
    assert decontaminate.question_words("One two three. Four five.") == 3
    assert decontaminate.question_words("one two three four") == 3
    assert decontaminate.question_words("one") == 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    try:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
    except Exception:  # the tables are not everywhere
        pytest.skip("no test tables")
    found = languages.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    scored = lm.lm_digest(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]
