"""Near copies by SimHash fingerprints, found with tables of distances to pivots.

A text's three-word shingles, repeats included, are hashed by XXH64 with seed 42; a bit of
the fingerprint is set if it is set in over half of the hashes. Texts with equal
fingerprints are one node from the start, so copies cost nothing further on.

Each fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints are computed once
and kept as its row of the pivot table. Two fingerprints that differ in d bits have
distances to any reference that differ by d at most, so a pair whose largest difference is
above the limit is discarded unseen; what survives all references is verified bit by bit.

Not every two rows of the table are held against each other. The bits that may differ are
cut into blocks, two more than a link may have differing bits; a link then leaves at least
two blocks untouched. Fingerprints are dealt to one cell per pair of blocks by the bits of
these, so linked ones share a cell. Within a cell, in order of the first distance, each row
of the table meets those behind it up to the limit. A cell of more than ``CELL`` members
is dealt out again by the bits it leaves free, with the same guarantee; as every dealing
fixes half of the free bits, cells of few free bits are small however many texts there are,
and no limit drops a link. A task sends out a star for each group it finds, not the pairs.

Defined results: texts without words, and null texts, have fingerprint zero and link like
any other; fewer than three words are one shingle; rows with equal ids are documents of
their own that share an id; a null id has a fingerprint, takes no part in links and has a
null component; texts of any length are read a part at a time; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored
from tablewright.llm.graph import components

SHINGLE, SEED, BITS = 3, 42, 64
#: bits in which linked fingerprints may differ
LIMIT = 2
#: reference fingerprints of the table
PIVOTS = 24
#: members of a cell that are compared with each other; larger cells are dealt out again
CELL = 2048
#: cells with as few free bits as this hold so few different fingerprints that none is dealt out again
FEW_BITS = 11
#: bytes of text, and pairs, that are looked at together
AT_ONCE, COMPARED = 1 << 20, 1 << 20

_BLANK = b" \t\n\r\x0b\x0c"
REFERENCES = np.random.RandomState(7).randint(0, 1 << 32, (2, PIVOTS), dtype="u8")
REFERENCES = (REFERENCES[0] << np.uint64(32)) | REFERENCES[1]


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    begin = 0
    while begin < len(text):
        end = min(begin + AT_ONCE, len(text))
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[begin:end]
        begin = end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, joined by single spaces."""
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :])], "u8")


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of one UTF-8 text."""
    ones, many, tail = np.zeros(BITS, "i8"), 0, []
    for part in _parts((text or b"").lower()):
        words = tail + part.split()
        if len(words) >= SHINGLE:
            found = _hashes(words, SHINGLE)
            ones += np.unpackbits(found.view("u1"), bitorder="little").reshape(-1, BITS).sum(0, dtype="i8")
            many += len(found)
            words = words[1 - SHINGLE :]
        tail = words
    if not many and tail:
        return int(_hashes(tail, len(tail))[0])
    return int(np.packbits(2 * ones > many, bitorder="little").view("u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], "u8").view("i8"))


def pivot_rows(prints: np.ndarray) -> np.ndarray:
    """Distances of fingerprints (rows) to the references."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype("i1")


def _table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for prints in batches:
        yield pd.Series([row.tobytes() for row in pivot_rows(prints.to_numpy().view("u8"))], dtype="object")


def close_pairs(prints: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs that differ in ``limit`` bits at most. Rows come in order of the
    first distance."""
    first = table[:, 0].astype("i4")
    reach = np.searchsorted(first, first + limit, side="right")
    many = reach - np.arange(len(first)) - 1
    ends = np.cumsum(many)
    begin = 0
    while begin < len(first):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COMPARED)), begin + 1)
        part = many[begin:end]
        i = np.repeat(np.arange(begin, end), part)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        for column in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, column] - table[j, column]) <= limit
            i, j = i[near], j[near]
        same = np.bitwise_count(prints[i] ^ prints[j]) <= limit
        yield i[same], j[same]
        begin = end


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after joining the ends of links."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (cell, print, pivots) in order of cell: a star (a, b) for each group that the cell's
    links make."""
    left: pd.DataFrame | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            left = batch if left is None else pd.concat([left, batch], ignore_index=True)
            cells = left["cell"].to_numpy()
            if not len(cells) or cells[0] == cells[-1]:
                continue
            cut = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            ready, left = left.iloc[:cut], left.iloc[cut:]
        elif left is None or not len(left):
            return
        else:
            ready = left
        table = np.frombuffer(b"".join(ready["pivots"]), "i1").reshape(len(ready), -1)
        cells = np.unique(ready["cell"].to_numpy(), return_inverse=True)[1]
        order = np.lexsort((table[:, 0], cells))
        prints, table, cells = ready["print"].to_numpy().view("u8")[order], table[order].copy(), cells[order]
        root = np.arange(len(prints))
        # cells lie behind each other in the first distance, out of one another's reach
        apart = np.column_stack([table[:, 0].astype("i8") + cells * (BITS + LIMIT + 1), table[:, 1:]])
        for i, j in close_pairs(prints, apart):
            root = _joined(root, i, j)
        member = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"a": prints[root[member]].view("i8"), "b": prints[member].view("i8")})


def blocks(free: list[int], limit: int = LIMIT) -> list[list[int]]:
    """The free bits in ``limit`` + 2 blocks of about one size."""
    return [list(map(int, part)) for part in np.array_split(free, limit + 2)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _dealt(members: DataFrame, fixed: list[int], kinds: list[list[int]]) -> DataFrame:
    """``members`` in one cell for each pair of blocks of the bits that are not yet fixed; ``kinds``
    gets the bits that each pair fixes."""
    cells = []
    for one, other in itertools.combinations(blocks([b for b in range(BITS) if b not in fixed]), 2):
        kinds.append(sorted(fixed + one + other))
        kind = F.lit(len(kinds) - 1)
        bits = F.col("print").bitwiseAND(F.lit(_mask(kinds[-1])).cast("long"))
        cells.append(F.struct(kind.alias("kind"), F.xxhash64(kind, bits).alias("cell")))
    return members.select("print", "pivots", F.inline(F.array(*cells)))


def links(prints: DataFrame) -> DataFrame:
    """Stars (a, b) of fingerprints (``print``) that tie together whatever is linked."""
    table = F.pandas_udf(_table, "binary")
    dealing: list[tuple[DataFrame, list[int]]] = [(stored(prints.select("print", table("print").alias("pivots"))), [])]
    kinds: list[list[int]] = []
    found = []
    while dealing:
        parts = [_dealt(members, fixed, kinds) for members, fixed in dealing]
        dealt = functools.reduce(DataFrame.unionByName, parts)
        sizes = dealt.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = stored(dealt.join(sizes, ["kind", "cell"]))
        few = [kind for kind, fixed in enumerate(kinds) if BITS - len(fixed) <= FEW_BITS]
        small = (F.col("size") <= CELL) | F.col("kind").isin(few)
        compared = met.where(small).select("cell", "print", "pivots").repartition("cell").sortWithinPartitions("cell")
        found.append(compared.mapInPandas(_cells, "a long, b long"))
        large = met.where(~small)
        dealing = [
            (large.where(F.col("kind") == r.kind).select("print", "pivots"), kinds[r.kind])
            for r in large.select("kind").distinct().orderBy("kind").collect()
        ]
    return stored(functools.reduce(DataFrame.unionByName, found).distinct())


def fingerprint_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the least id that links reach."""
    udf = F.pandas_udf(_fingerprints, "long")
    drawn = stored(docs.select(F.col(id).alias("doc_id"), udf(F.col(text).cast("binary")).alias("print")))
    nodes = stored(drawn.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(nodes.select("print")))
    grouped = stored(nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "doc_id", F.coalesce("root", "print").alias("root")))
    least = stored(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = stored(grouped.join(least, "root").select(F.col("print").alias("_print"), "component_id"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return drawn.join(named, F.col("print") == F.col("_print"), "left").select(
        "doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
