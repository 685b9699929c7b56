"""Token counts of a byte-pair vocabulary, without making tokens.

Merging keeps a linked list of symbols and a heap of adjacent pairs; the pair of the lowest
rank, leftmost first, is merged until none is left that the vocabulary knows. The count of a
piece is its symbols less its merges, so no token ids are looked up. Merges never cross
white space, so counts are remembered by what stands between white space; the memory is
bounded and cleared when full. The vocabulary file is read once, on the driver, and sent to
the tasks: its size is that of one vocabulary.

Texts are counted whole. Defined results: a null text is empty and has no bytes and no
tokens; every row is counted for itself; columns other than id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import text_of

#: remembered pieces per task, and the longest piece that is remembered
REMEMBERED, LONGEST = 1 << 20, 64
#: control characters at which Python's split() parts but the tokenizer does not
ODD = re.compile(r"[\x1c-\x1f]")
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when all known pairs are merged by rank."""
    n = len(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [
        (rank, i, symbols[i], symbols[i + 1])
        for i in range(n - 1)
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (m := after[k]) >= 0 and (rank := ranks.get((symbols[k], symbols[m]))) is not None:
                heapq.heappush(heap, (rank, k, symbols[k], symbols[m]))
    return left


class Counter(dict):
    """Token counts of what stands between white space, computed when first met."""

    def __init__(self, vocabulary: str):
        super().__init__()
        read = json.loads(vocabulary)
        model = read["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        split = next(p for p in read["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in read.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, part: str) -> int:
        plain = unicodedata.normalize("NFC", part)
        # letter by letter: the form of a letter does not depend on its place in the word
        plain = "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()
        count = 0
        for piece in self.pieces.findall(plain):
            symbols = [self.letters[b] for b in piece.encode()]
            symbols[-1] += self.end
            count += merged_count(symbols, self.ranks)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = count
        return count

    def count(self, text: str) -> int:
        if self.special is not None and "<" in text and (n := len(self.special.findall(text))):
            return n + sum(self.count_plain(p) for p in self.special.split(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        parts = SPACES.split(text) if ODD.search(text) else text.split()
        return sum(map(self.__getitem__, parts))


_counters: dict[int, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """One per vocabulary and worker; later tasks of the worker find its memory filled."""
    key = hash(vocabulary)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    with open(path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary.value)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    counted = docs.select(
        F.col(id).alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), tokens(text_of(text)).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
