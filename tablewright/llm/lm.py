"""Log-probabilities of texts from a weighted backoff automaton.

The model is a hierarchy of smoothed n-grams, each interpolated with the next lower one by
absolute discounting, so that probabilities sum to one: a word (or the end) after the word
before it, and a word by itself, what is taken off all words being the probability of the
unknown word. A state is the word before; every counted pair is an arc that holds its
interpolated log-probability, and where a state has no arc for what comes next its failure
arc is taken, which costs the state's backoff weight and leads to the empty history. A text
is read once from left to right, its end being a token; log-probabilities are added up.

Every word and every pair of adjacent words of the training texts is counted, however rare.
Texts are read once into chunks, as numbers of the chunk's own words. A chunk asks for the
counts it needs: it deals its distinct words and pairs, with its own counts of them, by hash
into ranges, as sorted packed arrays. The arrays of a range are merged, which counts its
words, pairs and what follows each word, and each chunk is sent the totals of what it asked
for, in the same order. With these the chunk builds the part of the automaton that its texts
can reach, and scores them. So the corpus is shuffled once as words and pairs, already
counted per chunk, and once as chunks; no task holds more than a chunk or a range.

Pairs go to the range of their first word, so that what follows a word is counted in one
place; first words of more than a ``HOT``-th of all tokens are dealt by the whole pair and
their few counts are added up apart. Words are told apart by 64 bits of hash, words after
one and the same word by 48 bits.

Defined results: a null text is empty and has the end token alone; texts are scored whole;
rows with equal ids are scored each for itself; a null id is neither held out nor learned
from; without training rows every count is zero and every score 0; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import remainder, stored, text_of

DISCOUNT = 0.75
#: tokens of a chunk, tokens of the corpus per range, bytes of a text read together
CHUNK, RANGE, AT_ONCE = 1 << 20, 1 << 19, 1 << 22
#: first words with a larger share of all tokens than one in so many have their pairs dealt out
HOT = 2000
#: most frequent words of a chunk among which hot ones are looked for
LOOKED = 256

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    """The end of a text is the empty word."""
    return xxhash.xxh3_64_intdigest(word)


# -- packed numbers -------------------------------------------------------------------


def _small(x: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, 255 standing for one of the larger at the end."""
    over = x[x >= 255].astype("<i8")
    return np.array([len(x), len(over)], "<i8").tobytes() + np.minimum(x, 255).astype("u1").tobytes() + over.tobytes()


class _Reader:
    def __init__(self, data: bytes):
        self.raw, self.at = np.frombuffer(data, "u1"), 0

    def take(self, kind: str, many: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * many
        self.at += size
        return self.raw[self.at - size : self.at].view(kind)

    def small(self) -> np.ndarray:
        many, over = self.take("<i8", 2).tolist()
        out = self.take("u1", many).astype("i8")
        out[out == 255] = self.take("<i8", over)
        return out


def _pack_codes(codes: np.ndarray) -> bytes:
    """Numbers of words: two bytes each, 65,535 standing for one of the larger at the end."""
    over = codes[codes >= 65535].astype("<u4")
    return np.array([len(codes), len(over)], "<i8").tobytes() + np.minimum(codes, 65535).astype("<u2").tobytes() + over.tobytes()


def _unpack_codes(data: bytes) -> np.ndarray:
    reader = _Reader(data)
    many, over = reader.take("<i8", 2).tolist()
    out = reader.take("<u2", many).astype("i8")
    out[out == 65535] = reader.take("<u4", over)
    return out


# -- chunks ---------------------------------------------------------------------------


class _Texts:
    """Texts of a chunk as numbers of words, and whether they are learned from."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b""]
        self.parts: list[np.ndarray] = []
        self.ids: list = []
        self.learned: list[bool] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, name, learned: bool, text: bytes) -> None:
        begin, number, size, text = 0, self.numbers, 1, text.lower()
        while begin < len(text):
            cut = _BLANK.search(text, begin + AT_ONCE)
            end = cut.start() if cut else len(text)
            self.parts.append(np.array([number[w] for w in text[begin:end].split()], "i4"))
            size += len(self.parts[-1])
            begin = end
        self.parts.append(np.zeros(1, "i4"))
        self.ids.append(name)
        self.learned.append(learned)
        self.lengths.append(size)
        self.size += size

    def row(self) -> list:
        """Words are numbered anew, the most frequent first."""
        codes = np.concatenate(self.parts)
        times = np.bincount(codes, minlength=len(self.numbers))
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        hashes = np.fromiter(map(word_hash, self.numbers), "u8", len(order))[order]
        top = min(LOOKED, len(order))
        return [
            [x or 0 for x in self.ids], [x is None for x in self.ids], self.learned, self.lengths, hashes.tobytes(), _pack_codes(place[codes]),
            hashes[:top].view("i8").tolist(), times[order[:top]].tolist(), len(codes),
        ]


CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("unnamed", pa.list_(pa.bool_())), ("learned", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
        ("hashes", pa.binary()), ("codes", pa.binary()), ("top", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("size", pa.int64()),
    ]
)


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Texts()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip([number, *held.row()], CHUNKS.types)], schema=CHUNKS)

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for name, learned, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    held.add(name, learned, text)
                    if held.size >= size:
                        yield given()
                        number, held = number + 1, _Texts()
        if held.ids:
            yield given()

    return run


class _Asked:
    """What a chunk asks for: its words and pairs, each with the range it goes to, in order of
    range, first word's hash and following word's hash."""

    def __init__(self, lengths: np.ndarray, learned: np.ndarray, hashes: np.ndarray, codes: np.ndarray, bits: int, hot: np.ndarray):
        words = len(hashes)
        self.codes = codes
        ends = np.cumsum(lengths) - 1
        self.learns = np.repeat(learned, lengths)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        self.after = np.flatnonzero(inner)  # tokens that another follows
        key = (codes[self.after].astype("u8") << np.uint64(32)) | codes[self.after + 1].astype("u8")
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
        #: distinct pairs, their training counts, and of each token that another follows its pair
        left, right = (key[first] >> np.uint64(32)).astype("i8"), (key[first] & np.uint64(0xFFFFFFFF)).astype("i8")
        taught = self.learns[self.after][order].astype("i8")
        counts = np.add.reduceat(taught, first) if len(first) else first
        pair = np.empty(len(key), "i8")
        pair[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))

        shift = np.uint64(64 - bits) if bits else None
        ranged = lambda x: (x >> shift).astype("i8") if bits else np.zeros(len(x), "i8")
        home = ranged(hashes)
        is_hot = np.isin(hashes, hot)
        mixed = (hashes[left] ^ (hashes[right] * _ODD)) * _ODD
        where = np.where(is_hot[left], ranged(mixed ^ (mixed >> np.uint64(29))), home[left])
        place = np.lexsort((hashes[right], hashes[left], where))
        where, left, right, self.counts = where[place], left[place], right[place], counts[place]
        self.pair = np.empty(len(place), "i8")
        self.pair[place] = np.arange(len(place))
        self.pair = self.pair[pair]
        self.left, self.right = left, right

        # heads: a chunk's words at home, and hot first words wherever their pairs go
        new = np.concatenate([[True], (where[1:] != where[:-1]) | (left[1:] != left[:-1])]) if len(where) else np.zeros(0, bool)
        head_range = np.concatenate([home, where[new]])
        head_word = np.concatenate([np.arange(words), left[new]])
        many = np.concatenate([np.zeros(words, "i8"), np.diff(np.flatnonzero(new), append=len(where))])
        order = np.lexsort((many, hashes[head_word], head_range))
        head_range, head_word, many = head_range[order], head_word[order], many[order]
        same = np.concatenate([[False], (head_range[1:] == head_range[:-1]) & (head_word[1:] == head_word[:-1])])
        keep = np.append(~same[1:], True)  # of a word that stands twice the one with its pairs
        self.head_range, self.head_word, self.many = head_range[keep], head_word[keep], many[keep]
        own = np.bincount(codes[self.learns], minlength=words)
        self.own = np.where(self.head_range == home[self.head_word], own[self.head_word], 0)
        self.head_hash, self.follow = hashes[self.head_word], hashes[right] >> np.uint64(16)
        cuts = np.flatnonzero(np.diff(self.head_range, prepend=-1))
        self.ranges = self.head_range[cuts].tolist()
        self.cuts = np.append(cuts, len(self.head_range)).tolist()
        self.pair_cuts = np.concatenate([[0], np.cumsum(self.many)])[self.cuts].tolist()

    def data(self, k: int) -> bytes:
        """What goes to the k-th of the chunk's ranges."""
        a, b, p, q = self.cuts[k], self.cuts[k + 1], self.pair_cuts[k], self.pair_cuts[k + 1]
        follow = self.follow[p:q].astype("<u8").view("u1").reshape(-1, 8)[:, :6]
        return b"".join(
            [
                np.array([b - a, q - p], "<i8").tobytes(), self.head_hash[a:b].astype("<u8").tobytes(), np.ascontiguousarray(follow).tobytes(),
                _small(self.own[a:b]), _small(self.many[a:b]), _small(self.counts[p:q]),
            ]
        )


def _asked(row, bits: int, hot: np.ndarray) -> _Asked:
    return _Asked(np.array(row.lengths, "i8"), np.array(row.learned, bool), np.frombuffer(row.hashes, "u8"), _unpack_codes(row.codes), bits, hot)


def _questions(bits: int, hot: np.ndarray):
    """(range, chunk, data) of each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                asked = _asked(row, bits, hot)
                yield pd.DataFrame({"range": asked.ranges, "chunk": row.chunk, "data": [asked.data(k) for k in range(len(asked.ranges))]})

    return run


# -- ranges ---------------------------------------------------------------------------


def _answers(bits: int, hot: np.ndarray):
    """The questions of one range: per chunk the totals of what it asked for; without a chunk the
    range's tokens and distinct words, and how many words follow each hot one here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["range"].iloc[0])
        heads, follows, owns, manies, counts = [], [], [], [], []
        for data in group["data"]:
            reader = _Reader(data)
            many, pairs = reader.take("<i8", 2).tolist()
            heads.append(reader.take("<u8", many))
            six = np.zeros((pairs, 8), "u1")
            six[:, :6] = reader.take("u1", 6 * pairs).reshape(-1, 6)
            follows.append(six.view("<u8").ravel())
            owns.append(reader.small())
            manies.append(reader.small())
            counts.append(reader.small())
        head, follow, own, many, count = (np.concatenate(x) for x in (heads, follows, owns, manies, counts))
        words, place = np.unique(head, return_inverse=True)
        n = np.bincount(place, own, len(words)).astype("i8")
        first = np.repeat(place, many)
        order = np.lexsort((follow, first))
        a, b = first[order], follow[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        total = np.add.reduceat(count[order], start) if len(start) else start
        kinds = np.bincount(a[start][total > 0], minlength=len(words))
        of_pair = np.empty(len(a), "i8")
        of_pair[order] = np.cumsum(new) - 1
        rows, h, p = [], 0, 0
        for chunk, one, pairs in zip(group["chunk"], heads, follows):
            mine = place[h : h + len(one)]
            rows.append((number, chunk, _small(n[mine]) + _small(kinds[mine]) + _small(total[of_pair[p : p + len(pairs)]]), None, None, None, None))
            h, p = h + len(one), p + len(pairs)
        home = (words >> np.uint64(64 - bits)) == number if bits else np.ones(len(words), bool)
        shared = np.isin(words, hot)
        rows.append((number, None, None, int(n[home].sum()), int((n[home] > 0).sum()), words[shared].view("i8").tolist(), kinds[shared].tolist()))
        out = pd.DataFrame(rows, columns=["range", "chunk", "data", "tokens", "distinct", "hot", "kinds"])
        return out.astype({"chunk": "Int64", "tokens": "Int64", "distinct": "Int64"})

    return run


ANSWER = "range long, chunk long, data binary, tokens long, distinct long, hot array<long>, kinds array<long>"


# -- the automaton --------------------------------------------------------------------


class Automaton:
    """The states and arcs that some texts can reach.

    ``n``: training count of each word, ``kinds``: how many different words follow it, ``left``,
    ``right``, ``pairs``: the words of each arc and its count (0: no arc).
    """

    def __init__(self, tokens: int, distinct: int, n: np.ndarray, kinds: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray):
        self.known = n > 0
        if not tokens:
            self.base = self.single = np.zeros(len(n))
            self.arc = np.zeros(len(left))
            return
        self.base = np.log10((n + 1) / (tokens + distinct + 1))
        self.single = np.log10(np.where(self.known, n - DISCOUNT, DISCOUNT * distinct) / tokens)
        # what is taken off a word's arcs; nothing is known to follow an unknown word
        weight = np.where(self.known, DISCOUNT * kinds / np.maximum(n, 1), 1.0)
        lower = weight[left] * 10 ** self.single[right]
        own = np.where(pairs > 0, (pairs - DISCOUNT) / np.maximum(n[left], 1), 0.0)
        # with an arc its interpolated probability, without one the failure arc and what follows
        self.arc = np.log10(np.maximum(own + lower, 1e-300))

    def steps(self, codes: np.ndarray, after: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Log-probability of each token: the first of a text by itself, others by an arc of the
        token before (``after``: tokens that another follows, ``pair``: the arc taken)."""
        out = self.single[codes]
        out[after + 1] = self.arc[pair]
        return out


def _scores(bits: int, shared):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tokens, distinct, hot, hot_kinds = shared.value
        said = dict(zip(answers["range"], answers["data"]))
        out = []
        for row in chunk.itertuples():
            asked = _asked(row, bits, hot)
            read = [_Reader(said[r]) for r in asked.ranges]
            parts = [(r.small(), r.small(), r.small()) for r in read]
            n_head, kinds_head, pairs = (np.concatenate(x) for x in zip(*parts))
            words = len(np.frombuffer(row.hashes, "u8"))
            n, kinds = np.zeros(words, "i8"), np.zeros(words, "i8")
            # a hot word has heads in several ranges: its count is at home, its kinds are added up
            np.maximum.at(n, asked.head_word, n_head)
            np.maximum.at(kinds, asked.head_word, kinds_head)
            hashes = np.frombuffer(row.hashes, "u8")
            if len(hot):
                at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                kinds = np.where(hot[at] == hashes, hot_kinds[at], kinds)
            model = Automaton(tokens, distinct, n, kinds, asked.left, asked.right, pairs)
            codes, lengths = asked.codes, np.array(row.lengths, "i8")
            first = np.cumsum(lengths) - lengths
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.Series(np.array(row.ids, "i8"), dtype="Int64").mask(np.array(row.unnamed, bool)), "learned": np.array(row.learned, bool), "n_tokens": lengths,
                        "n_known": np.add.reduceat(model.known[codes].astype("i8"), first),
                        "base_score": np.add.reduceat(model.base[codes], first),
                        "score": np.add.reduceat(model.steps(codes, asked.after, asked.pair), first),
                    }
                )
            )
        return pd.concat(out)

    return run


def fit_and_score(docs: DataFrame, learn: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Learns from the rows whose column ``learn`` is true and scores all of them: ``doc_id``,
    ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one counts) and
    ``score`` (the automaton's log10 probability, all unknown words being one token, as in the
    base)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(learn).alias("learned"), text_of(text).cast("binary").alias("text"))
    chunks = stored(
        texts.mapInArrow(
            _chunks(chunk),
            "chunk long, ids array<long>, unnamed array<boolean>, learned array<boolean>, lengths array<int>, hashes binary, codes binary, top array<long>, times array<long>, size long",
        )
    )
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(-(-size // RANGE) - 1, 0).bit_length()
    most = chunks.select(F.explode(F.arrays_zip("top", "times")).alias("t")).groupBy("t.top").agg(F.sum("t.times").alias("n"))
    hot = np.sort(np.array([r["top"] for r in most.where(F.col("n") > size / HOT).collect()], "i8").view("u8"))  # HOT at most

    held = chunks.select("chunk", "ids", "unnamed", "learned", "lengths", "hashes", "codes")
    sent = held.mapInPandas(_questions(bits, hot), "range long, chunk long, data binary")
    answers = stored(sent.groupBy("range").applyInPandas(_answers(bits, hot), ANSWER))
    facts = answers.where("chunk IS NULL")
    tokens, distinct = facts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    found = facts.select(F.explode(F.arrays_zip("hot", "kinds")).alias("h")).groupBy("h.hot").agg(F.sum("h.kinds").alias("kinds"))
    kinds = {r["hot"]: r["kinds"] for r in found.collect()}  # HOT at most
    shared = context.broadcast((tokens, distinct, hot, np.array([kinds.get(h, 0) for h in hot.view("i8").tolist()], "i8")))
    said = answers.where("chunk IS NOT NULL").select(F.col("chunk").alias("owner"), "range", "data")
    scored = held.groupBy("chunk").cogroup(said.groupBy("owner")).applyInPandas(
        _scores(bits, shared), "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def lm_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: learns where the id's remainder by 7 is not 2."""
    fold = remainder(7)
    marked = docs.select("doc_id", "text", ((fold != 2) & (fold >= 0)).alias("learn"))
    scored = fit_and_score(marked, "learn")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
