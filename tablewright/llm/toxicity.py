"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A text is cut into windows of 48 words, each 32 on from the last, and every window is
scored; the text's score is that of its worst window. A word enters as characters and as a
word: learned vectors of its letters' three- and four-grams (their mean) and of the word,
and four numbers, its evidence, namely the log-odds of the word and the greatest and mean
log-odds of its grams among toxic and other training texts, and whether it has letters. One
recurrent layer reads the window forwards, one backwards; attention weighs the states, and
a logistic unit scores their weighted sum. Words and grams have places in tables of fixed
size by hash, so the model's size does not depend on the corpus.

The network is trained in numpy, on the driver, on a bounded sample: about ``FIT_ROWS``
labelled texts of each class, taken by hash, of at most ``FIT_BYTES`` each, and never over
twice as many, whatever rows share an id. Labels belong to
texts, not windows, so each pass trains on the windows that score highest in their text.
The input's part of the recurrent layers is computed once per distinct word and remembered.

Defined results: null and empty texts, and those of white space, are one empty window and
get the network's score for it; texts are scored whole; rows with equal ids are scored each
for itself, their labels count as toxic if any does; without labels of both classes the
score is the share of toxic ones (0 without any); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import remainder, text_of
from tablewright.llm.languages import NOT_LETTERS

FIT_ROWS, FIT_BYTES = 1_500, 16_384
WINDOW, STRIDE = 48, 32
HIDDEN, WORD_DIM, GRAM_DIM = 8, 6, 6
WORD_PLACES, GRAM_PLACES = 1 << 16, 1 << 17
TRAINED_PLACES = 1 << 12
EVIDENCE = 4
#: counts added to both classes before log-odds are taken
PRIOR = 3.0
PASSES, STEPS, BATCH, RATE = 8, 60, 128, 0.02
THRESHOLD = 0.7
AT_ONCE = 4096
REMEMBERED = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def word_parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word's letters (0 without any), and of its grams: the word's number, the hash."""
    line = NOT_LETTERS.sub("", f" {' '.join(words)}  ".lower())
    codes = np.frombuffer(line.encode("utf-32-le"), "u4").astype("u8")
    blank = codes == 32
    at = np.flatnonzero(~blank)
    owner = np.cumsum(blank)[at] - 1
    three = _hash((codes[at - 1] << np.uint64(42)) | (codes[at] << np.uint64(21)) | codes[at + 1])
    longer = ~blank[at + 1]
    four = _hash(three[longer] + codes[at[longer] + 2])
    value = np.zeros(len(words), "u8")
    if len(at):
        # a word's hash adds up those of its letters with their places
        place = np.arange(len(at)) - np.searchsorted(owner, owner)
        np.add.at(value, owner, _hash(codes[at] * np.uint64(1_000_003) + place.astype("u8") + np.uint64(7)))
    return value, np.concatenate([owner, owner[longer]]), np.concatenate([three, four])


class Evidence:
    """Log-odds of word and gram places among toxic and other texts."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.words, self.grams = words.astype("f4"), grams.astype("f4")

    def of(self, value: np.ndarray, owner: np.ndarray, grams: np.ndarray) -> np.ndarray:
        n = len(value)
        each = self.grams[(grams % np.uint64(GRAM_PLACES)).astype("i8")]
        top, total, count = np.zeros(n, "f4"), np.zeros(n), np.bincount(owner, minlength=n)
        np.maximum.at(top, owner, each)
        total = np.bincount(owner, each, n) / np.maximum(count, 1)
        some = value != 0
        word = np.where(some, self.words[(value % np.uint64(WORD_PLACES)).astype("i8")], 0)
        return np.stack([word, top, total, some], 1).astype("f4")


def log_odds(rows: list[tuple[np.ndarray, int]], places: int) -> np.ndarray:
    """``rows``: distinct places in a text, its label."""
    seen = np.zeros((2, places))
    for found, label in rows:
        seen[label, found] += 1
    texts = np.array([[sum(1 - label for _, label in rows)], [sum(label for _, label in rows)]])
    share = (seen + PRIOR) / (texts + PRIOR)
    return np.log(share[1] / share[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, evidence: Evidence, seed: int = 7):
        draw = np.random.RandomState(seed)
        wide = EVIDENCE + WORD_DIM + GRAM_DIM
        small = lambda *shape: (draw.randn(*shape) * 0.1).astype("f4")
        self.evidence, self.name = evidence, uuid.uuid4().hex
        self.p = {
            "word": small(TRAINED_PLACES, WORD_DIM), "gram": small(TRAINED_PLACES, GRAM_DIM),
            "in": small(wide, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, "f4"),
            "forth": small(HIDDEN, 3 * HIDDEN), "back": small(HIDDEN, 3 * HIDDEN),
            "attend": small(2 * HIDDEN, HIDDEN), "focus": small(HIDDEN),
            "out": small(2 * HIDDEN), "shift": np.zeros(1, "f4"),
        }

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Evidence, word places, and (word's number, gram place) of each gram."""
        value, owner, grams = word_parts(words)
        place = lambda h: (_hash(h) % np.uint64(TRAINED_PLACES)).astype("i4")
        return self.evidence.of(value, owner, grams), place(value), owner, place(grams)

    def vectors(self, inputs) -> np.ndarray:
        evidence, word, owner, gram = inputs
        many = np.maximum(np.bincount(owner, minlength=len(word)), 1)[:, None]
        mean = np.stack([np.bincount(owner, self.p["gram"][gram, k], len(word)) for k in range(GRAM_DIM)], 1) / many
        return np.concatenate([evidence, self.p["word"][word], mean], 1).astype("f4")

    def projected(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates of either layer."""
        both = (vectors @ self.p["in"] + self.p["bias"]).astype("f4")
        return np.ascontiguousarray(both[:, : 3 * HIDDEN]), np.ascontiguousarray(both[:, 3 * HIDDEN :])

    def _layer(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, name: str, keep: list | None):
        steps = range(ids.shape[1]) if name == "forth" else range(ids.shape[1] - 1, -1, -1)
        own, weights = table, self.p[name]
        state = np.zeros((len(ids), HIDDEN), "f4")
        states = np.zeros((ids.shape[1], len(ids), HIDDEN), "f4")
        for t in steps:
            given, known = own[ids[:, t]] if len(own) else np.zeros((len(ids), 3 * HIDDEN), "f4"), state @ weights
            gates = sigmoid(given[:, : 2 * HIDDEN] + known[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(given[:, 2 * HIDDEN :] + r * known[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, state, z, r, fresh, known[:, 2 * HIDDEN :], m))
            state = state + m * (1 - z) * (fresh - state)
            states[t] = state
        return states

    def forward(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ``ids``: rows of ``tables``, -1 for no word."""
        mask = (ids >= 0).astype("f4")
        trace: dict[str, list] = {"forth": [], "back": []}
        layers = [self._layer(t, ids, mask, n, trace[n] if keep is not None else None) for t, n in zip(tables, ("forth", "back"))]
        states = np.concatenate(layers, 2)
        looks = np.tanh(states @ self.p["attend"])
        marks = looks @ self.p["focus"]
        marks = np.where(mask.T > 0, marks, -1e9)
        share = np.exp(marks - marks.max(0)) * mask.T
        share = share / np.maximum(share.sum(0), 1e-9)
        pooled = (share[:, :, None] * states).sum(0)
        logits = pooled @ self.p["out"] + self.p["shift"]
        if keep is not None:
            keep.update(mask=mask, trace=trace, states=states, looks=looks, share=share, pooled=pooled)
        return logits

    def gradients(self, inputs, ids: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        vectors = self.vectors(inputs)
        kept: dict = {}
        logits = self.forward(self.projected(vectors), ids, kept)
        g = {name: np.zeros_like(value) for name, value in self.p.items()}
        off = ((sigmoid(logits) - labels) / len(ids)).astype("f4")
        g["out"], g["shift"] = kept["pooled"].T @ off, off.sum(keepdims=True)
        pooled = off[:, None] * self.p["out"]
        states, share, looks = kept["states"], kept["share"], kept["looks"]
        to_states = share[:, :, None] * pooled
        to_share = (states * pooled).sum(2)
        to_marks = share * (to_share - (share * to_share).sum(0))
        g["focus"] = (looks * to_marks[:, :, None]).sum((0, 1))
        to_looks = to_marks[:, :, None] * self.p["focus"] * (1 - looks**2)
        g["attend"] = np.tensordot(states, to_looks, ([0, 1], [0, 1]))
        to_states = to_states + to_looks @ self.p["attend"].T
        to_gates = np.zeros((ids.shape[1], len(ids), 6 * HIDDEN), "f4")
        for name, half in (("forth", 0), ("back", 1)):
            weights, carried = self.p[name], np.zeros((len(ids), HIDDEN), "f4")
            for t, before, z, r, fresh, known, m in reversed(kept["trace"][name]):
                here = to_states[t, :, half * HIDDEN : (half + 1) * HIDDEN] + carried
                kept_on, here = here * (1 - m), here * m
                to_fresh = here * (1 - z) * (1 - fresh**2)
                to_z = here * (before - fresh) * z * (1 - z)
                to_r = to_fresh * known * r * (1 - r)
                gates = np.concatenate([to_z, to_r, to_fresh * r], 1)
                g[name] += before.T @ gates
                carried = kept_on + here * z + gates @ weights.T
                to_gates[t, :, half * 3 * HIDDEN : (half + 1) * 3 * HIDDEN] = np.concatenate([to_z, to_r, to_fresh], 1)
        flat = ids.T.ravel()
        order = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0) :]
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        to_table = np.zeros((len(vectors), 6 * HIDDEN), "f4")
        if len(first):
            to_table[flat[order][first]] = np.add.reduceat(to_gates.reshape(len(flat), -1)[order], first)
        g["in"], g["bias"] = vectors.T @ to_table, to_table.sum(0)
        to_vectors = to_table @ self.p["in"].T
        _, word, owner, gram = inputs
        many = np.maximum(np.bincount(owner, minlength=len(word)), 1)[:, None]
        for name, place, each in (("word", word, to_vectors[:, EVIDENCE : EVIDENCE + WORD_DIM]), ("gram", gram, (to_vectors[:, EVIDENCE + WORD_DIM :] / many)[owner])):
            g[name] = np.stack([np.bincount(place, column, TRAINED_PLACES) for column in each.T], 1).astype("f4")
        return g


def windows_of(n: int) -> np.ndarray:
    """Where the windows of ``n`` words begin: none has only words that the last one has too."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def window_ids(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of word numbers (-1: none) for each window of all texts, and the text of each."""
    starts = [windows_of(len(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    flat = np.concatenate([*texts, np.zeros(0, "i4")]).astype("i4")
    lengths = np.array([len(t) for t in texts])
    begin = (np.cumsum(lengths) - lengths)[owner][:, None]
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    inside = at < lengths[owner][:, None]
    found = flat[np.minimum(begin + at, len(flat) - 1)] if len(flat) else -1
    return np.where(inside, found, -1).astype("i4"), owner


def train(texts: list[str], labels: list[int], passes: int = PASSES, seed: int = 7) -> Network | float:
    """A network, or the share of toxic texts where one class is missing."""
    if not texts or len(set(labels)) < 2:
        return float(np.mean(labels)) if texts else 0.0
    draw = np.random.RandomState(seed)
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], "i4") for t in texts]
    words = list(numbers)
    value, owner, grams = word_parts(words)
    order = np.argsort(owner, kind="stable")
    owner_sorted, gram_places = owner[order], (grams[order] % np.uint64(GRAM_PLACES)).astype("i8")
    bounds = np.searchsorted(owner_sorted, np.arange(len(words) + 1))
    word_places = (value % np.uint64(WORD_PLACES)).astype("i8")

    def text_places(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.unique(doc)
        many = bounds[own + 1] - bounds[own]
        at = np.repeat(bounds[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.unique(word_places[own[value[own] != 0]]), np.unique(gram_places[at])

    places = [text_places(d) for d in docs]
    evidence = Evidence(
        log_odds([(w, y) for (w, _), y in zip(places, labels)], WORD_PLACES),
        log_odds([(g, y) for (_, g), y in zip(places, labels)], GRAM_PLACES),
    )
    network = Network(evidence, seed)
    inputs = network.inputs(words)
    ids, owner_of = window_ids(docs)
    y = np.array(labels, "f4")
    hint = np.append(inputs[0][:, 0] + inputs[0][:, 1], 0)
    score = np.sort(hint[ids], 1)[:, -3:].sum(1)  # before the network knows anything
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for turn in range(passes):
        if turn:
            tables = network.projected(network.vectors(inputs))
            score = np.concatenate([network.forward(tables, ids[a : a + AT_ONCE]) for a in range(0, len(ids), AT_ONCE)])
        # the highest window of each text, and the second of texts that are not toxic
        ranked = np.lexsort((-score, owner_of))
        rank = np.arange(len(ranked)) - np.searchsorted(owner_of[ranked], owner_of[ranked])
        chosen = ranked[(rank == 0) | ((rank == 1) & (y[owner_of[ranked]] == 0))]
        sides = [chosen[y[owner_of[chosen]] == label] for label in (0, 1)]
        for _ in range(STEPS):  # as many windows of either class
            part = np.concatenate([draw.choice(side, BATCH // 2) for side in sides])
            used, local = np.unique(ids[part], return_inverse=True)
            none = int(len(used) > 0 and used[0] < 0)
            used, local = used[none:], local.reshape(len(part), WINDOW) - none
            g = network.gradients(_some(inputs, used, bounds, order), local, y[owner_of[part]])
            step += 1
            for name, value_ in network.p.items():
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
                rate = RATE * (1 - turn / passes)
                value_ -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return network


def _some(inputs, used: np.ndarray, bounds: np.ndarray, order: np.ndarray):
    """The inputs of some of the words."""
    evidence, word, _, gram = inputs
    many = bounds[used + 1] - bounds[used]
    at = np.repeat(bounds[used] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return evidence[used], word[used], np.repeat(np.arange(len(used)), many), gram[order[at]]


class Words(dict):
    """Row of each word in a growing table of what it adds to the gates."""

    def __init__(self, network: Network):
        super().__init__()
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.tables = tuple(np.zeros((0, 3 * HIDDEN), "f4") for _ in range(2))

    def learn(self, words: list[str]) -> None:
        self.update(zip(words, range(len(self), len(self) + len(words))))
        fresh = self.network.projected(self.network.vectors(self.network.inputs(words)))
        self.tables = tuple(np.concatenate(x) for x in zip(self.tables, fresh))


_words: dict[str, Words] = {}


def score_texts(texts: list[str], words: Words) -> np.ndarray:
    """The highest window's probability for each text."""
    out = np.zeros(len(texts))
    begin = 0
    while begin < len(texts):
        end, held, parts = begin, 0, []
        while end < len(texts) and (held < 200_000 or end == begin):
            parts.append(texts[end].split())
            held += len(parts[-1])
            end += 1
        words.learn([w for w in set().union(*parts) if w not in words])
        docs = [np.fromiter(map(words.__getitem__, p), "i4", len(p)) for p in parts]
        ids, owner = window_ids(docs)
        logits = np.concatenate([words.network.forward(words.tables, ids[a : a + AT_ONCE]) for a in range(0, len(ids), AT_ONCE)])
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, owner, logits)
        out[begin:end] = sigmoid(best)
        begin = end
        if len(words) > REMEMBERED:
            words.forget()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | float:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); see the bounds above."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, rows / max(counts.get(1, 0), 1)).otherwise(rows / max(counts.get(0, 0), 1))
    chosen = known.where(uniform < rate)
    found = (
        docs.join(F.broadcast(chosen), "doc_id")  # about twice FIT_ROWS ids
        .where(F.octet_length(text_of()) <= FIT_BYTES)
        .select("doc_id", text_of().alias("text"), "toxic")
    )
    # an id may be on any number of rows: of each class at most so many come to the driver
    drawn = [found.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", "text")).limit(2 * rows) for k in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).toPandas().sort_values(["doc_id", "text"])
    return train(sample["text"].tolist(), sample["toxic"].tolist())


def score_toxicity(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """``docs`` with ``score``."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = shared.value
        if network.name not in _words:
            _words.clear()
            _words[network.name] = Words(network)
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), _words[network.name]))

    return docs.withColumn("score", score(text_of(text)))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learns labels where the id's remainder by 3 is not 1."""
    fold = remainder(3)
    model = fit_toxicity(docs.select("doc_id", "text"), labels.where((fold != 1) & (fold >= 0)).select("doc_id", "toxic"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
