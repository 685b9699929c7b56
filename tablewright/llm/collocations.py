"""Phrases of two to four words that occur together more than their parts do, mined with
counting quotient filters.

Texts are read once and cut into chunks of word numbers, a chunk holding one language and a
vocabulary of its own. Words that occur often enough in all get ids, dense and in bits as few
as their number needs; all others end a phrase as punctuation does, as no phrase with a rare
word can be frequent. A phrase's ids are packed into an integer, which an invertible
permutation spreads evenly. Its first bits name a range, the next are the quotient and the
rest is the remainder, kept in full: a filter stores how many entries each quotient has,
remainders, and counts in a byte where they fit, and gives back every phrase and count
exactly. A chunk sends one filter per range; the filters of a range, sorted alike, are merged
and their counts added up. An entry stands for all of a chunk's occurrences, so a phrase that
is everywhere is as many entries as there are chunks, and ranges have about ``RANGE`` entries.

Lengths are counted one after another. A chunk hears which of its entries are frequent and
keeps only words inside such phrases for the next length, since a phrase is no more frequent
than its parts; nothing that could reach the least count is left out. From the frequent
phrases on everything is joins and aggregates of exact counts.

Defined results: words are what spaces and tabs separate within pieces between ``.,;:!?`` and
line ends, A-Z lower-cased; a null text is empty; a null language is ``und``; repeated rows
count each; ids take no part; texts of any length are read a part at a time, and a chunk ends
only between pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored, text_of

LEAST, TOP, LONGEST = 30, 2000, 4
#: a longer phrase with this many percent of the occurrences makes a shorter one needless
COVERED = 80
#: words of a chunk, entries of a range, bytes of a text read together
CHUNK, RANGE, AT_ONCE = 1 << 21, 1 << 19, 1 << 22

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_BREAKS + bytes(range(65, 91)), b"." * len(_BREAKS) + bytes(range(97, 123)))
_END = re.compile(b"[" + re.escape(_BREAKS) + b" \t]")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


# -- chunks of word numbers -----------------------------------------------------------


class Chunk:
    """Texts of one language as numbers of words; 0 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."]  # a full stop is never in a word: number 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        begin, number = 0, self.numbers
        while begin < len(text):
            cut = _END.search(text, begin + AT_ONCE)
            end = cut.start() if cut else len(text)
            words = text[begin:end].translate(_PLAIN).replace(b".", b" . ").split()
            self.parts.append(np.array([number[w] for w in words], "i4"))
            self.size += len(words)
            begin = end
        self.parts.append(np.zeros(1, "i4"))

    def row(self) -> tuple[list[bytes], list[int], bytes]:
        codes = np.concatenate(self.parts)
        return list(self.numbers)[1:], np.bincount(codes, minlength=len(self.numbers))[1:].tolist(), codes.tobytes()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """From (lang, text): chunks with their words, the words' counts, and the texts as numbers."""
    number = TaskContext.get().partitionId() << 32
    held: dict[str, Chunk] = {}

    def given(langs: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang in langs:
            words, counts, codes = held.pop(lang).row()
            number += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary()),
                ],
                ["chunk", "lang", "words", "counts", "codes"],
            )

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                chunk = held.setdefault(lang, Chunk())
                chunk.add(text)
                if chunk.size >= size:
                    yield from given([lang])
            if sum(c.size for c in held.values()) >= 2 * size:
                yield from given(list(held))
    yield from given(list(held))


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Without breaks that follow breaks."""
    word = codes != 0
    return codes[word | np.concatenate([[False], word[:-1]])] if len(codes) else codes


def _coded(chunk: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """A chunk's numbers replaced by ids of frequent words, 0 for all others."""
    out = []
    for number, blob in zip(chunk["chunk"], chunk["codes"]):
        codes = np.frombuffer(blob, "i4")
        ids = np.zeros(int(codes.max()) + 1, "u4")
        ids[words["local"].to_numpy()] = words["code"].to_numpy()
        codes = _squeezed(ids[codes])
        out.append((number, codes.tobytes(), len(codes)))
    return pd.DataFrame(out, columns=["chunk", "codes", "size"])


# -- packed phrases -------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class Shape:
    """Phrases of ``n`` ids of ``bits`` bits each: the last two ids are the low part of the
    packed integer, those before them the high part."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.low, self.high = 2 * bits, (n - 2) * bits

    def pack(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed phrases without a break, and where they begin."""
        many = max(len(codes) - self.n + 1, 0)
        word = codes != 0
        whole = np.ones(many, bool)
        for k in range(self.n):
            whole &= word[k : k + many]
        at = np.flatnonzero(whole)
        low, high = np.zeros(len(at), "u8"), np.zeros(len(at), "u8")
        for k in range(self.n):
            part = low if k >= self.n - 2 else high
            part <<= np.uint64(self.bits)
            part |= codes[at + k]
        return *self.permuted(low, high), at

    def unpack(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low, high = self.restored(low, high)
        one, parts = np.uint64((1 << self.bits) - 1), []
        for k in range(self.n):
            after = (self.n - 1 - k) * self.bits if k >= self.n - 2 else (self.n - 3 - k) * self.bits
            parts.append(((low if k >= self.n - 2 else high) >> np.uint64(after)) & one)
        return np.stack(parts, 1).astype("i8")

    def _step(self, x: np.ndarray, width: int, k: int) -> np.ndarray:
        """One to one on integers of ``width`` bits."""
        mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
        x = (x * _ODD[k]) & mask
        x = x ^ (x >> half)
        return (x * _ODD[3]) & mask

    def _back(self, x: np.ndarray, width: int, k: int) -> np.ndarray:
        mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
        inverse = lambda odd: np.uint64(pow(int(odd), -1, 1 << 64))
        x = (x * inverse(_ODD[3])) & mask
        x = x ^ (x >> half)
        return (x * inverse(_ODD[k])) & mask

    def permuted(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self._step(low, self.low, 0)
        if self.high:
            high = self._step(high ^ (_mixed(low) & np.uint64((1 << self.high) - 1)), self.high, 1)
        low = low ^ (_mixed(high) & np.uint64((1 << self.low) - 1))
        return self._step(low, self.low, 2), high

    def restored(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self._back(low, self.low, 2)
        low = low ^ (_mixed(high) & np.uint64((1 << self.low) - 1))
        if self.high:
            high = self._back(high, self.high, 1) ^ (_mixed(low) & np.uint64((1 << self.high) - 1))
        return self._back(low, self.low, 0), high

    def counted(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray | None = None):
        """Distinct packed phrases in order, their counts summed, and of each given one its place."""
        if self.low + self.high <= 64:
            order = np.argsort((low << np.uint64(self.high % 64)) | high, kind="stable")
        else:
            order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        if counts is None:
            counts = np.diff(first, append=len(low))
        elif len(first):
            counts = np.add.reduceat(counts[order], first)
        place = np.empty(len(low), "i8")
        place[order] = np.cumsum(new) - 1
        return low[first], high[first], counts.astype("i8"), place


# -- counting quotient filters --------------------------------------------------------


def _bytes_of(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, : (width + 7) // 8]).tobytes()


def _from_bytes(raw: np.ndarray, width: int) -> np.ndarray:
    size = (width + 7) // 8
    out = np.zeros((len(raw) // size if size else 0, 8), "u1")
    out[:, :size] = raw.reshape(-1, size) if size else 0
    return out.view("<u8").ravel()


def filter_bytes(shape: Shape, skip: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of distinct packed phrases in order, all of one range of ``skip`` bits."""
    free = shape.low - skip
    quotient = min(free, max(len(low).bit_length() - 1, 0))
    rest = free - quotient
    inside = low & np.uint64((1 << free) - 1)
    runs = np.bincount((inside >> np.uint64(rest % 64)).astype("i8") if rest < 64 else np.zeros(len(low), "i8"), minlength=1 << quotient)
    wide = int(runs.max()) > 255
    many = np.minimum(counts, 255).astype("u1")
    over = counts[counts >= 255].astype("<i8")
    head = np.array([len(low), quotient, wide, len(over)], "<i8")
    return b"".join(
        [
            head.tobytes(), runs.astype("<u4" if wide else "u1").tobytes(), _bytes_of(inside & np.uint64((1 << rest) - 1), rest),
            _bytes_of(high, shape.high), many.tobytes(), over.tobytes(),
        ]
    )


def filter_entries(shape: Shape, skip: int, prefix: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`filter_bytes` was made of."""
    raw = np.frombuffer(data, "u1")
    n, quotient, wide, over = raw[:32].view("<i8").tolist()
    free = shape.low - skip
    rest = free - quotient
    at = 32

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return raw[at - size : at]

    runs = take((1 << quotient) * (4 if wide else 1)).view("<u4" if wide else "u1")
    low = np.repeat(np.arange(1 << quotient, dtype="u8"), runs)
    low = (low << np.uint64(rest)) if rest < 64 else np.zeros(n, "u8")
    if rest:
        low = low | _from_bytes(take(n * ((rest + 7) // 8)), rest)
    if skip:
        low = low | np.uint64(prefix << free)
    high = _from_bytes(take(n * ((shape.high + 7) // 8)), shape.high) if shape.high else np.zeros(n, "u8")
    counts = take(n).astype("i8")
    counts[counts == 255] = take(8 * over).view("<i8")
    return low, high, counts


def merged(shape: Shape, skip: int, prefix: int, filters: list[bytes]):
    """One filter's entries from several of a range, and where each of theirs went."""
    entries = [filter_entries(shape, skip, prefix, data) for data in filters]
    return shape.counted(*(np.concatenate(x) for x in zip(*entries)))


def _cuts(low: np.ndarray, shape: Shape, skip: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the ranges that sorted phrases fall in."""
    ranges = (low >> np.uint64(shape.low - skip)).astype("i8") if skip else np.zeros(len(low), "i8")
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    return list(zip(ranges[first].tolist(), first.tolist(), [*first[1:].tolist(), len(low)]))


def _sent(shape: Shape, skip: int):
    """A chunk's filter of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                low, high, _ = shape.pack(np.frombuffer(blob.as_py(), "u4"))
                low, high, counts, _ = shape.counted(low, high)
                cuts = _cuts(low, shape, skip)
                data = [filter_bytes(shape, skip, low[a:b], high[a:b], counts[a:b]) for _, a, b in cuts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _, _ in cuts], pa.int64()), pa.array([chunk] * len(cuts), pa.int64()), pa.array(data, pa.binary())],
                    ["range", "chunk", "data"],
                )

    return run


def _frequent(shape: Shape, skip: int, least: int):
    """From a range's filters: the filter of what is frequent (no chunk), and for each chunk
    which of its entries are."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        prefix = int(group["range"].iloc[0])
        low, high, counts, place = merged(shape, skip, prefix, group["data"].to_list())
        often = counts >= least
        ends = np.cumsum([np.frombuffer(d, "<i8", 1)[0] for d in group["data"]])
        flags = [np.packbits(x).tobytes() for x in np.split(often[place], ends[:-1])]
        rows = [(prefix, chunk, data) for chunk, data in zip(group["chunk"], flags)]
        if often.any():
            rows.append((prefix, None, filter_bytes(shape, skip, low[often], high[often], counts[often])))
        return pd.DataFrame(rows, columns=["range", "chunk", "data"]).astype({"chunk": "Int64"})

    return run


def _decoded(shape: Shape, skip: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for prefix, data in zip(batch["range"], batch["data"]):
                low, high, counts = filter_entries(shape, skip, int(prefix), data)
                yield pd.DataFrame({"codes": list(shape.unpack(low, high)), "a": counts})

    return run


def _kept(shape: Shape, skip: int):
    """A chunk with only the words inside frequent phrases that overlap by all but a word."""

    def run(chunk: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        often = dict(zip(flags["range"], flags["data"]))
        out = []
        for number, blob in zip(chunk["chunk"], chunk["codes"]):
            codes = np.frombuffer(blob, "u4")
            low, high, at = shape.pack(codes)
            low, _, _, place = shape.counted(low, high)
            flag = [np.unpackbits(np.frombuffer(often[r], "u1"), count=b - a) for r, a, b in _cuts(low, shape, skip)]
            good = np.zeros(len(codes) + 1, bool)
            good[at] = np.concatenate(flag)[place] == 1 if flag else False
            begin = np.flatnonzero(good[:-1] & good[1:])  # both parts of a phrase one word longer
            inside = np.zeros(len(codes) + 1, "i8")
            np.add.at(inside, begin, 1)
            np.add.at(inside, begin + shape.n + 1, -1)
            codes = _squeezed(np.where(np.cumsum(inside[:-1]) > 0, codes, 0).astype("u4"))
            out.append((number, codes.tobytes(), len(codes)))
        return pd.DataFrame(out, columns=["chunk", "codes", "size"])

    return run


# -- phrases and scores ---------------------------------------------------------------

CODED = "chunk long, codes binary, size long"


def _numbered(words: DataFrame) -> DataFrame:
    """Rows with a dense ``code`` from 1: their place in their partition after those before it."""
    placed = stored(words.withColumn("part", F.spark_partition_id()).withColumn("code", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, rows = 1, []
    for r in placed.groupBy("part").count().orderBy("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    offsets = words.sparkSession.createDataFrame(rows, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").select("lang", "word", "a", (F.col("code") + F.col("before")).alias("code"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words of each language that are frequent (``lang``, ``word``, ``a``, ``code``), the number of
    all words (``lang``, ``n``), and for each length from two on the frequent phrases (``codes``, ``a``)."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases of two to four words are counted")
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))
    chunks = stored(read.mapInArrow(functools.partial(_chunks, size=chunk), "chunk long, lang string, words array<binary>, counts array<long>, codes binary"))
    totals = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    said = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    said = said.select("chunk", "lang", (F.col("at") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    words = stored(_numbered(said.groupBy("lang", "word").agg(F.sum("c").alias("a")).where(F.col("a") >= least)))
    bits = max(int(words.agg(F.coalesce(F.max("code"), F.lit(1))).first()[0]).bit_length(), 1)
    if bits > 32:
        raise ValueError("more than 2^32 frequent words")

    ids = said.select("chunk", "local", "lang", "word").join(words.select("lang", "word", "code"), ["lang", "word"]).select(F.col("chunk").alias("owner"), "local", "code")
    coded = stored(chunks.select("chunk", "codes").groupBy("chunk").cogroup(ids.groupBy("owner")).applyInPandas(_coded, CODED))
    found = []
    for n in range(2, longest + 1):
        shape = Shape(n, bits)
        entries = coded.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        skip = min(max(-(-entries // RANGE) - 1, 0).bit_length(), shape.low)
        sent = coded.select("chunk", "codes").mapInArrow(_sent(shape, skip), "range long, chunk long, data binary")
        ranges = stored(sent.groupBy("range").applyInPandas(_frequent(shape, skip, least), "range long, chunk long, data binary"))
        common = ranges.where("chunk IS NULL").select("range", "data")
        found.append(stored(common.mapInPandas(_decoded(shape, skip), "codes array<long>, a long")))
        if n < longest:
            flags = ranges.where("chunk IS NOT NULL")
            coded = stored(coded.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(_kept(shape, skip), CODED))
    return words, totals, found


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, text: str = "text", lang: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    words, totals, found = frequent_phrases(docs, least, longest, text, lang, chunk)
    phrases = functools.reduce(DataFrame.unionByName, found)
    counts = stored(words.select(F.array("code").alias("codes"), "a").unionByName(phrases))
    cut = phrases.select("codes", "a", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("codes", F.lit(1), F.col("k")), "rest": F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k"))})
    scored = (
        cut.join(counts.select(F.col("codes").alias("first"), F.col("a").alias("l")), "first")
        .join(counts.select(F.col("codes").alias("rest"), F.col("a").alias("r")), "rest")
        .withColumns({"wa": _wide("a"), "parts": _wide("l") + _wide("r")})
        .withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7, 0)) * wa DIV parts"))
        .groupBy("codes", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("codes", "a", "cut.*")
    )
    inner = [
        rows.select("a", F.explode(F.array(*(F.slice("codes", i + 1, size) for size in range(2, n) for i in range(n - size + 1)))).alias("codes"))
        for n, rows in enumerate(found, 2)
        if n > 2
    ]
    if inner:
        covers = functools.reduce(DataFrame.unionByName, inner).groupBy("codes").agg(F.max("a").alias("cover"))
        covered = F.lit(100) * _wide("cover") >= F.lit(COVERED) * _wide("a")
        scored = scored.join(covers, "codes", "left").where(~F.coalesce(covered, F.lit(False)))
    named = stored(
        scored.withColumn("code", F.get("codes", F.lit(0)))
        .join(words.select("code", "lang"), "code")
        .select("lang", "codes", "a", "l", "r", "score")
    )
    order = [F.desc("score"), F.desc("a")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("codes"), F.lit(64))).orderBy(*order)
    few = named.withColumn("place", F.rank().over(part)).where(F.col("place") <= top)
    few = stored(few.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place"))
    spelled = (
        few.select("codes", F.posexplode("codes").alias("at", "code"))
        .join(words.select("code", F.col("word").cast("string").alias("word")), "code")
        .groupBy("codes")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return (
        few.join(spelled, "codes").join(totals, "lang").withColumn("rank", rank).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM p),
o AS (
  SELECT lang, s.size, array_to_string(t[i:i + s.size - 1], ' ') AS phrase
  FROM (SELECT lang, t, unnest(range(1, len(t) + 1)) AS i FROM w) JOIN (SELECT unnest(range(1, {LONGEST + 1})) AS size) s ON i + s.size - 1 <= len(t)
), f AS (SELECT lang, size, phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(t))::BIGINT AS n FROM w GROUP BY lang),
c AS (
  SELECT f.lang, f.size, f.phrase, f.a, k, string_split(f.phrase, ' ') AS t
  FROM f JOIN (SELECT unnest(range(1, {LONGEST})) AS k) ON k < f.size
), s AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(t[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(t[k + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (
  SELECT g.lang, array_to_string(t[i:i + m - 1], ' ') AS phrase, max(g.a) AS cover
  FROM (SELECT lang, size, a, string_split(phrase, ' ') AS t FROM f WHERE size > 2) g,
    (SELECT unnest(range(2, {LONGEST})) AS m), (SELECT unnest(range(1, {LONGEST})) AS i)
  WHERE m < g.size AND i + m - 1 <= g.size GROUP BY 1, 2
), d AS (
  SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase
  WHERE v.cover IS NULL OR 100::HUGEINT * v.cover < {COVERED}::HUGEINT * b.a
)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, d.phrase) AS rank, d.phrase, a, l, r, n.n, score
FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= {TOP}
"""
