"""Benchmark items in training texts, by BM25 search from every passage.

The test items are the index. An item is cut into entries of at most 64 words; a posting of
a term holds the entry and the term's BM25 weight in it, as a share of the entry's score for
itself. Every text is cut into passages of 128 words, each 64 on from the last, and every
passage is a query: all entries that score at least ``LEAST`` are retrieved.

Two steps prune. Common terms whose weights together stay under ``SLACK`` in every entry
cannot carry an entry over the limit, so only the postings of the other terms are summed,
for all passages of a batch at once and by the largest weight in each block of entries; a
passage in which no block can reach the limit has no result. The passages left are searched
by block-max WAND: list maxima choose the next entry that can reach the limit, block maxima
skip where it cannot, and what remains is scored in full.

A hit is verified on the whole text: the words of the item that lie in five-word shingles
which the text has as well must be at least 75 % of its words, and half of those of its
question. The question ends with the last question mark; without one, the last sentence, or
the last quarter of a single one, is the answer.

The index is broadcast. Items of over ``SHARD_WORDS`` words altogether are searched in
several passes, each with a part of them, so that the broadcast stays bounded; term
statistics are those of all items in either case.

Defined results: null and empty texts, and items without a word, match nothing; texts are
searched whole; equal rows of the benchmark count once; rows with equal ids are searched
each for itself; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored

HALF, SHINGLE = 64, 5
LEAST, SLACK = 0.5, 0.2
CONTAINED, QUESTION = 0.75, 0.5
K1, B = 1.2, 0.75
ENTRY_BLOCK, POSTING_BLOCK = 2, 8
SHARD_WORDS = 4_000_000
REMEMBERED = 300_000
#: half passages times entry blocks that are summed together
AT_ONCE = 2_000_000

HIT = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,first_word:int>>"


def plain(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def parted(text: str) -> list[str]:
    """The raw words of texts and of items: any Unicode space ends one."""
    return text.split()


def words_of(text: str) -> list[str]:
    return [p for w in parted(text) if (p := plain(w))]


def question_words(text: str) -> int:
    """How many of the item's words are its question."""
    ends = [m.end() for m in re.finditer(r"\?(?=\s|$)", text)]
    if not ends or not words_of(text[ends[-1] :]):
        body = text.rstrip()
        ends = [m.end() for m in re.finditer(r"[.!\n](?=\s|$)|\n", body[:-1])]
    total = len(words_of(text))
    asked = len(words_of(text[: ends[-1]])) if ends else 0
    return asked if 0 < asked < total else max(1, total - max(1, total // 4))


class Index:
    """Entries, postings and bounds of one part of the items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], entries: int, mean: float):
        self.terms: dict[str, int] = {}
        self.items = [(item, np.array([self._term(w) for w in words_of(text)], "i4"), question_words(text)) for item, text in items]
        owners, lists = [], []
        for number, (_, ids, _) in enumerate(self.items):
            for part in np.array_split(ids, max(1, math.ceil(len(ids) / HALF))):
                owners.append(number)
                lists.append(part)
        self.owner = np.array(owners, "i4")
        names = list(self.terms)
        idf = np.array([math.log(1 + (entries - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in names])
        term, entry, weight = [], [], []
        for number, part in enumerate(lists):
            ids, tf = np.unique(part, return_counts=True)
            w = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean))
            term.append(ids)
            entry.append(np.full(len(ids), number))
            weight.append(w / w.sum())
        term, entry, weight = map(np.concatenate, (term, entry, weight))
        order = np.lexsort((entry, term))
        term, self.entry, self.weight = term[order], entry[order].astype("i4"), weight[order]
        self.start = np.searchsorted(term, np.arange(len(names) + 1))
        self.top = np.maximum.reduceat(self.weight, self.start[:-1]) if len(names) else np.zeros(0)
        self.name = uuid.uuid4().hex
        self.read: dict[int, tuple[list[int], list[float], float, list[float]]] = {}
        self._split(term)

    def postings(self, t: int) -> tuple[list[int], list[float], float, list[float]]:
        """Entries, weights, the largest weight of all and of each block of a term's list."""
        if t not in self.read:
            a, b = int(self.start[t]), int(self.start[t + 1])
            weights = self.weight[a:b].tolist()
            tops = [max(weights[i : i + POSTING_BLOCK]) for i in range(0, b - a, POSTING_BLOCK)]
            self.read[t] = (self.entry[a:b].tolist(), weights, float(self.top[t]), tops)
        return self.read[t]

    def _term(self, word: str) -> int:
        return self.terms.setdefault(word, len(self.terms))

    def _split(self, term: np.ndarray) -> None:
        """Common terms, as many as leave every entry under the slack, are not essential."""
        mass = np.zeros(len(self.owner))
        essential = np.ones(len(self.top), bool)
        for t in np.argsort(-np.diff(self.start), kind="stable"):
            at = slice(self.start[t], self.start[t + 1])
            raised = mass[self.entry[at]] + self.weight[at]
            if (raised <= SLACK).all():
                mass[self.entry[at]] = raised
                essential[t] = False
        self.blocks = math.ceil(len(self.owner) / ENTRY_BLOCK)
        self.rest = np.maximum.reduceat(mass, np.arange(0, len(mass), ENTRY_BLOCK))
        keep = essential[term]
        key = term[keep].astype("i8") * self.blocks + self.entry[keep] // ENTRY_BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_term = term[keep][first]
        self.block = (self.entry[keep] // ENTRY_BLOCK)[first]
        self.block_top = np.maximum.reduceat(self.weight[keep], first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(self.block_term, np.arange(len(self.top) + 1))


class Terms(dict):
    """Term of each raw word, -1 for words that no item has; made when first met."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, raw: str) -> int:
        found = self.index.terms.get(plain(raw), -1)
        if len(raw) <= 64:
            self[raw] = found
        return found


def promising(ids: np.ndarray, half: np.ndarray, last: np.ndarray, index: Index) -> np.ndarray:
    """Which half passages begin a passage that can reach the limit. ``half``: the half passage
    of each word; ``last``: whether a half passage is its text's last."""
    known = ids >= 0
    pairs = np.unique(half[known].astype("i8") * len(index.top) + ids[known])
    term, at = pairs % len(index.top), pairs // len(index.top)
    many = index.block_start[term + 1] - index.block_start[term]
    ends = np.cumsum(many)
    posting = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(index.block_start[term], many)
    key = np.repeat(at, many) * index.blocks + index.block[posting]
    own = np.bincount(key, index.block_top[posting], len(last) * index.blocks).reshape(len(last), index.blocks)
    following = np.zeros_like(own)
    following[:-1] = own[1:]
    following[last] = 0
    return ((own + following + index.rest) >= LEAST - 1e-9).any(1)


def block_max_wand(terms: list[int], index: Index, least: float) -> list[tuple[int, float]]:
    """All entries that score at least ``least``, with their scores."""
    lists = [[p[0][0], 0, *p] for p in map(index.postings, terms)]
    found = []
    while lists:
        lists.sort(key=lambda x: x[0])
        bound, pivot = 0.0, -1
        for i, x in enumerate(lists):
            bound += x[4]
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            break
        target = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
            pivot += 1
        bound, skip = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
        for x in lists[: pivot + 1]:
            _, at, entries, _, _, tops = x
            k = at // POSTING_BLOCK  # shallow: whole blocks are passed by their last entry
            while k < len(tops) and entries[min((k + 1) * POSTING_BLOCK, len(entries)) - 1] < target:
                k += 1
            if k < len(tops):
                bound += tops[k]
                skip = min(skip, entries[min((k + 1) * POSTING_BLOCK, len(entries)) - 1] + 1)
        if bound >= least:
            if lists[0][0] == target:
                score = sum(x[3][x[1]] for x in lists[: pivot + 1])
                if score >= least:
                    found.append((target, score))
                skip = target + 1
            else:
                skip = target
        skip = max(skip, lists[0][0] + (bound < least))
        for x in lists[: pivot + 1]:
            at, entries = x[1], x[2]
            while at < len(entries) and entries[at] < skip:
                at += 1
            x[1] = at
            x[0] = entries[at] if at < len(entries) else 1 << 62
        lists = [x for x in lists if x[0] < 1 << 62]
    return found


def _runs(ids: np.ndarray, size: int, terms: int) -> np.ndarray:
    """One integer for each run of ``size`` known terms; -1 for runs with an unknown one."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, "u8")
    value = np.zeros(n, "u8")
    for k in range(size):
        value = value * np.uint64(terms + 1) + ids[k : k + n].astype("i8").astype("u8")
        value ^= value >> np.uint64(31)
        value *= np.uint64(0x9E3779B97F4A7C15)
    known = np.ones(n, bool)
    for k in range(size):
        known &= ids[k : k + n] >= 0
    return value[known]


def overlaps(ids: np.ndarray, item: np.ndarray, asked: int, terms: int) -> tuple[float, float, float]:
    """Shares of the item's words, of its question's and of its answer's, that lie in shingles
    which the text has too."""
    size = min(SHINGLE, len(item))
    hit = np.isin(_runs(item, size, terms), _runs(ids, size, terms))
    covered = np.zeros(len(item), bool)
    for k in range(size):
        covered[k : k + len(hit)] |= hit
    return float(covered.mean()), float(covered[:asked].mean()), float(covered[asked:].mean()) if asked < len(item) else 1.0


_terms: dict[str, Terms] = {}


def _search(texts: list[bytes | None], index: Index) -> list[list[dict]]:
    if index.name not in _terms:
        _terms.clear()
        _terms[index.name] = Terms(index)
    terms = _terms[index.name]
    out: list[list[dict]] = [[] for _ in texts]
    todo: list[tuple[int, np.ndarray]] = []

    def run() -> None:
        lengths = np.array([len(i) for _, i in todo])
        halves = np.maximum(1, -(-lengths // HALF))
        ids = np.concatenate([i for _, i in todo])
        first = np.cumsum(halves) - halves
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        last = np.zeros(int(halves.sum()), bool)
        last[first + halves - 1] = True
        chosen = np.flatnonzero(promising(ids, np.repeat(first, lengths) + place // HALF, last, index))
        owner = np.searchsorted(first, chosen, side="right") - 1
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for h, k in zip(chosen.tolist(), owner.tolist()):
            at = (h - int(first[k])) * HALF
            passage = todo[k][1][at : at + 2 * HALF]
            for entry, score in block_max_wand(np.unique(passage[passage >= 0]).tolist(), index, LEAST - 1e-9):
                key = (k, int(index.owner[entry]))
                if key not in best or score > best[key][0]:
                    best[key] = (score, at)
        for (k, item), (score, at) in best.items():
            row, own = todo[k]
            name, words, asked = index.items[item]
            share, question, answer = overlaps(own, words, asked, len(index.top))
            if share >= CONTAINED and question >= QUESTION:
                out[row].append({"item_id": name, "score": min(score, 1.0), "question_overlap": question, "answer_overlap": answer, "first_word": at})
        todo.clear()

    size = 0
    for row, text in enumerate(texts):
        if text is None:
            continue
        raw = parted(text.decode("utf-8", "replace").lower())
        if not raw:
            continue
        todo.append((row, np.fromiter(map(terms.__getitem__, raw), "i4", len(raw))))
        size += (len(raw) // HALF + 1) * index.blocks
        if size >= AT_ONCE:
            run()
            size = 0
    if todo:
        run()
    if len(terms) > REMEMBERED:
        terms.clear()
    return out


def indexes(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The items' index, in parts of at most about ``SHARD_WORDS`` words."""
    items = benchmark.select(F.col(id).cast("long").alias("item"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()

    @F.udf("array<string>", useArrow=True)
    def entry_words(text: str) -> list[str]:
        ids = words_of(text)
        parts = np.array_split(np.array(ids, dtype=object), max(1, math.ceil(len(ids) / HALF))) if ids else []
        return [w for part in parts for w in sorted(set(part))]

    @F.udf("int", useArrow=True)
    def n_words(text: str) -> int:
        return len(words_of(text))

    items = stored(items.withColumn("n", n_words("text")).where("n > 0"))
    words, entries = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n") / HALF)), F.lit(0))).first()
    if not words:
        return
    parts = math.ceil(words / SHARD_WORDS)
    df = stored(items.select(F.explode(entry_words("text")).alias("word")).groupBy("word").count())
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = [(r["item"], r["text"]) for r in own.select("item", "text").orderBy("item", "text").toLocalIterator()]
        if rows:
            needed = own.select(F.explode(entry_words("text")).alias("word")).distinct()
            counts = {r["word"]: r["count"] for r in df.join(needed, "word").toLocalIterator()}
            yield Index(rows, counts, entries, words / entries)


def _searching(shared):
    @F.pandas_udf(HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_search(texts.tolist(), shared.value))

    return search


def leaks_by_part(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Iterator[Column]:
    """For each part of the items' index a column of the part's items that are verified in each
    text. A part is broadcast when it is asked for, so that a scan holds one."""
    for index in indexes(benchmark):
        yield _searching(docs.sparkSession.sparkContext.broadcast(index))(F.col(text).cast("binary"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that it holds: ``doc_id``, ``item_id``, ``score`` (of the best
    passage, as a share of the item's own), ``question_overlap``, ``answer_overlap``, ``first_word``."""
    found = [docs.select("doc_id", leaks.alias("leaks")) for leaks in leaks_by_part(docs, benchmark)]
    if not found:
        found = [docs.limit(0).select("doc_id", F.array().cast(HIT).alias("leaks"))]
    return functools.reduce(DataFrame.unionByName, found).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a test item."""
    left, before = docs, 0
    for leaks in leaks_by_part(docs, benchmark):
        left = stored(left) if before else left  # a scan per part
        left = left.withColumn("_tw_leaks", leaks).where(F.size("_tw_leaks") == 0).select(*docs.columns)
        before += 1
    return left
