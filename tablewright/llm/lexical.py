"""Ranked lexical search by hashed max-sketches.

Indexing reads every text once. A term's hash names one of ``WIDTH`` coordinates, and a
document's sketch holds for each coordinate the largest impact of the terms that fall there.
For a document of given length the impact only rises with a term's occurrences, so the
occurrences are what is folded and kept, sparsely; the corpus's length and the document's
turn them into impacts later, without another pass. Beside the sketches stand, counted per
task, the documents that hold each term.

Items are searched a block at a time. The block's weights are summed per coordinate and item
and sent to the tasks; looking up a sketch's coordinates there and adding up gives, for all
items of the block at once, a bound that no score exceeds, as a coordinate's maximum is at
least the impact of each of its terms. The texts with the highest bounds of an item are read
again and scored exactly; the k-th best exact score then is the threshold, and only texts
whose bound reaches it (at an equal bound: with an id that can still win) are scored besides.
So no text that belongs to the result is missed, whatever collides.

Blocks are cut by items and bytes, so the broadcasts have a fixed size; candidates are joined
back to their texts by id and hash, by broadcast only up to a counted number.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased; texts without terms, and null texts, are no documents, and such items have no
rows; only scores above 0 are given; rows with equal ids are documents (items) of their own
that share an id, equal rows are each ranked; equal scores go by id, then by a hash of the
text; documents with a null id count in the statistics but are not ranked; texts of any
length are read a part at a time; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored, text_of

K = 10
WIDTH = 1 << 16
#: texts of an item that are scored to find the threshold
FIRST = 40
#: items of a block, and bytes of their texts
BLOCK_ITEMS, BLOCK_BYTES = 2048, 8 << 20
#: terms that a task counts before it hands them on
COUNTED = 300_000
#: bounds that are held at once
BOUNDS = 1 << 21
#: candidate pairs up to this many are broadcast to their texts
BROADCAST_PAIRS = 1_000_000
#: bytes of a text that are read together
AT_ONCE = 1 << 20
#: doubles count exactly up to here
EXACT = 2.0**53

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
INDEX = pa.schema(
    [("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("coords", pa.binary()), ("folded", pa.binary()), ("term", pa.binary()), ("df", pa.int64())]
)


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a UTF-8 text."""
    found: Counter = Counter()
    begin, text = 0, text or b""
    while begin < len(text):
        cut = _BREAK.search(text, begin + AT_ONCE)
        end = cut.start() if cut else len(text)
        found.update(_TERM.findall(text[begin:end].lower()))
        begin = end
    return found


def coordinate(term: bytes, width: int = WIDTH) -> int:
    return xxhash.xxh3_64_intdigest(term) % width


def sketch(counts: Counter, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a document and the most occurrences of a term at each."""
    at = np.fromiter((coordinate(t, width) for t in counts), "i8", len(counts))
    times = np.fromiter(counts.values(), "i8", len(counts))
    order = np.argsort(at, kind="stable")
    at, times = at[order], times[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first].astype("u2"), np.maximum.reduceat(times, first) if len(at) else times


def _packed(times: np.ndarray) -> bytes:
    return times.astype("u1" if times.max() < 256 else "u4").tobytes()


def _indexed(batches: Iterator[pa.RecordBatch], width: int, counted: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, hash, text): a row per document with its sketch, and rows (term, df)."""
    held: Counter = Counter()

    def dictionary() -> pa.RecordBatch:
        n = len(held)
        empty = [pa.nulls(n, kind) for kind in INDEX.types[:5]]
        out = pa.RecordBatch.from_arrays([*empty, pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=INDEX)
        held.clear()
        return out

    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            rows = []
            for doc, mark, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                counts = term_counts(text)
                if counts:
                    held.update(counts.keys())
                    coords, times = sketch(counts, width)
                    rows.append((doc, mark, counts.total(), coords.tobytes(), _packed(times)))
                if len(held) > counted:
                    yield dictionary()
            columns = list(zip(*rows)) or [()] * 5
            none = [pa.nulls(len(rows), kind) for kind in INDEX.types[5:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, INDEX.types)), *none], schema=INDEX)
    yield dictionary()


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"), text_of(text).cast("binary").alias("text"))


def lexical_index(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, counted: int = COUNTED) -> DataFrame:
    """Sketches of all documents and counts of their terms, as one table."""
    run = functools.partial(_indexed, width=width, counted=counted)
    return stored(_texts(docs, id, text).mapInArrow(run, "doc_id long, hash long, n long, coords binary, folded binary, term binary, df long"))


def impact(times, size):
    """Of a term's occurrences in a document of length measure ``size``; integers or arrays."""
    return (1_000_000_000 * times) // (1000 * times + 8 * size)


def length_measure(n: int, documents: int, total: int) -> int:
    return 100 - 75 + (75 * n * documents) // total


class Block:
    """Items that are searched together."""

    def __init__(self, items: list[tuple[int | None, Counter]], frequency: dict[bytes, int], documents: int, total: int, width: int = WIDTH):
        self.documents, self.total = documents, total
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in frequency.items()}
        #: per item its terms that occur, with weight times repeats
        self.terms = [[(t, c * weight[t]) for t, c in counts.items() if t in weight] for _, counts in items]
        summed: dict[tuple[int, int], int] = {}
        for q, terms in enumerate(self.terms):
            for term, w in terms:
                key = (coordinate(term, width), q)
                summed[key] = summed.get(key, 0) + w
        entries = sorted(summed)
        self.item = np.array([q for _, q in entries], "i8")
        self.weight = np.array([summed[key] for key in entries], "f8")
        used, self.many = np.unique(np.array([c for c, _ in entries], "i8"), return_counts=True)
        self.first = np.cumsum(self.many) - self.many
        self.column = np.full(width, -1, "i4")
        self.column[used] = np.arange(len(used))
        self.exact = max((sum(w for _, w in terms) for terms in self.terms), default=0) * 1e6 < EXACT

    def bounds(self, sizes: np.ndarray, coords: list[bytes], folded: list[bytes]) -> np.ndarray:
        """A row per document, a column per item."""
        at = [np.frombuffer(c, "u2") for c in coords]
        times = [np.frombuffer(f, "u1" if len(f) == len(a) else "u4").astype("i8") for f, a in zip(folded, at)]
        document = np.repeat(np.arange(len(at)), [len(a) for a in at])
        column = self.column[np.concatenate(at)]
        hit = np.flatnonzero(column >= 0)
        column, document = column[hit], document[hit]
        value = impact(np.concatenate(times)[hit], sizes[document])
        many = self.many[column]
        entry = np.arange(many.sum()) + np.repeat(self.first[column] - (np.cumsum(many) - many), many)
        cell = np.repeat(document, many) * len(self.terms) + self.item[entry]
        out = np.bincount(cell, np.repeat(value, many) * self.weight[entry], len(at) * len(self.terms))
        out = out.reshape(len(at), len(self.terms))
        return out if self.exact else np.ceil(out * (1 + 1e-9))

    def sizes(self, n: np.ndarray) -> np.ndarray:
        return np.array([length_measure(x, self.documents, self.total) for x in n.tolist()], "i8")

    def score(self, counts: Counter, q: int) -> int:
        size = length_measure(counts.total(), self.documents, self.total)
        return sum(w * impact(counts[t], size) for t, w in self.terms[q] if t in counts)


FOUND = "q int, doc_id long, hash long, bound double"


def _rows(q: np.ndarray, batch: pd.DataFrame, at: np.ndarray, bound: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"q": q.astype("i4"), "doc_id": batch["doc_id"].to_numpy()[at], "hash": batch["hash"].to_numpy()[at], "bound": bound})


def _bounded(batches: Iterator[pd.DataFrame], block: Block) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, BOUNDS // max(1, len(block.terms)))
    for batch in batches:
        for start in range(0, len(batch), step):
            part = batch.iloc[start : start + step]
            yield part, block.bounds(block.sizes(part["n"].to_numpy()), part["coords"].to_list(), part["folded"].to_list())


def _highest(shared, first: int):
    """Per item the ``first`` documents of a task with the highest bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        best = None
        for part, bounds in _bounded(batches, block):
            limit = np.zeros(len(block.terms))
            if best is not None:
                held = best.groupby("q")["bound"].agg(["size", "min"])
                held = held[held["size"] >= first]
                limit[held.index.to_numpy()] = held["min"].to_numpy()
            if len(part) > first:
                limit = np.maximum(limit, np.partition(bounds, -first, axis=0)[-first])
            at, q = np.nonzero((bounds > 0) & (bounds >= limit))
            rows = _rows(q, part, at, bounds[at, q])
            rows = rows if best is None else pd.concat([best, rows], ignore_index=True)
            rows = rows.sort_values(["q", "bound", "doc_id"], ascending=[True, False, True], kind="stable")
            best = rows[rows.groupby("q").cumcount() < first]
        if best is not None:
            yield best

    return run


def _reaching(shared, limits):
    """Documents whose bound reaches their item's threshold (score, id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, least = limits.value
        for part, bounds in _bounded(batches, shared.value):
            own = part["doc_id"].to_numpy()[:, None]
            at, q = np.nonzero((bounds > 0) & ((bounds > score) | ((bounds == score) & (own <= least))))
            yield _rows(q, part, at, bounds[at, q])

    return run


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, mark, text, asked in zip(batch["doc_id"], batch["hash"], batch["text"], batch["asked"]):
                counts = term_counts(text)
                rows += [(int(q), doc, mark, shared.value.score(counts, q)) for q in asked]
            out = pd.DataFrame(rows, columns=["q", "doc_id", "hash", "score"]).astype({"q": "i4", "doc_id": "i8", "hash": "i8", "score": "i8"})
            yield out[out["score"] > 0]

    return run


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` best rows of each ``q``, first within parts of it: ``rank`` from 1."""
    order = [F.desc(by), "doc_id", "hash"]
    part = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def _exact(docs: DataFrame, candidates: DataFrame, shared) -> DataFrame:
    """(q, doc_id, hash, score) of the candidates (q, doc_id, hash) with a score above 0."""
    pairs = stored(candidates.select("q", "doc_id", "hash").distinct())
    wanted = pairs.groupBy("doc_id", "hash").agg(F.collect_list("q").alias("asked"))
    wanted = F.broadcast(wanted) if pairs.count() <= BROADCAST_PAIRS else wanted
    return docs.join(wanted, ["doc_id", "hash"]).select("doc_id", "hash", "text", "asked").mapInPandas(_scored(shared), "q int, doc_id long, hash long, score long")


def _blocks(items: DataFrame, id: str, text: str) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with terms, some at a time."""
    block, size = [], 0
    for row in items.select(F.col(id).cast("long").alias("id"), text_of(text).cast("binary").alias("text")).toLocalIterator():
        counts = term_counts(bytes(row.text))
        if not counts:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(row.text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row.id, counts))
        size += len(row.text)
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = WIDTH, counted: int = COUNTED,
) -> DataFrame:
    """For every item its ``k`` best documents: ``item_id``, ``rank``, ``doc_id``, ``score``. Sketches have
    ``width`` coordinates, 65,536 at most."""
    spark = docs.sparkSession
    index = lexical_index(docs, id, text, width, counted)
    sketches = index.where("doc_id IS NOT NULL").select("doc_id", "hash", "n", "coords", "folded")
    documents, total = index.where("n IS NOT NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = _texts(docs, id, text)
    out = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for items_now in _blocks(items, item_id, item_text) if documents else ():
        asked = spark.createDataFrame([(t,) for t in set().union(*(c for _, c in items_now))], "term binary")
        frequency = index.where("term IS NOT NULL").select("term", "df").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df"))
        block = Block(items_now, {bytes(r.term): r.df for r in frequency.collect()}, documents, total, width)
        shared = spark.sparkContext.broadcast(block)

        first = max(FIRST, k)
        highest = _best(sketches.mapInPandas(_highest(shared, first), FOUND), "bound", first)
        threshold = _best(_exact(texts, highest, shared), "score", k).where(F.col("rank") == k).collect()
        score, least = np.zeros(len(items_now)), np.full(len(items_now), np.iinfo("i8").max)
        for row in threshold:
            score[row.q], least[row.q] = row.score, row.doc_id
        limits = spark.sparkContext.broadcast((score, least))

        found = _best(_exact(texts, sketches.mapInPandas(_reaching(shared, limits), FOUND), shared), "score", k)
        names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(items_now)], "q int, item_id long")
        out.append(stored(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")))
    return functools.reduce(DataFrame.unionByName, out)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), s AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
o AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM o GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), r AS (
  SELECT item_id, doc_id, sum(
      CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))
    )::BIGINT AS score
  FROM i JOIN g USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY item_id, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
