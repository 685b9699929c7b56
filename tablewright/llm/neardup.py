"""Near copies by HyperMinHash.

A text's set is its distinct shingles of five words, hashed to 64 bits. The first six bits
of a hash name one of 64 buckets, and of the least hash in each bucket a register of 16 bits
is kept: the number of its leading zeros and the ten bits after its first one. A bucket
without a hash takes the register of another, in an order of its own, so that short texts
have full signatures too. Registers are cut into 21 bands of three; two texts that agree in
a band are a candidate pair, which at a similarity of 0.75 fails to happen with a
probability of 1e-5. The share of equal registers, corrected for those that are equal by
accident, estimates the similarity; pairs far below the limit end there, all others are
confirmed on the full sets.

Texts with equal sets are one node from the start. Of a band's texts not all pairs are
made. First each is paired with the least of them, in a sorted and split table that needs
no group in one task; what is confirmed joins components. Only bands that still hold
several components are looked at again. Their texts of different components are compared
register by register within a task, a pair in the first band in which it agrees, and a text
that looks similar enough to another leaves the task, once, whatever the number of pairs. The
sets of these texts are brought together by band, where pairs are confirmed on the sets and
join components at once, so that a task sends out fewer links than it holds texts. Bands
of over ``PAIRWISE`` texts are cut into blocks, in order of component, and each pair of blocks
that holds several components is compared for itself, so that no task holds more and no link is
lost to a limit.

Defined results: a text without words, or null, is empty: no shingles, linked with nothing;
fewer than five words are one shingle; rows with equal ids are documents of their own that
share an id; a null id takes no part, its component is null and it is kept; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored
from tablewright.llm.graph import components

SHINGLE = 5
PERCENT = 75
BUCKET_BITS, MANTISSA_BITS = 6, 10
BUCKETS = 1 << BUCKET_BITS
ROWS, BANDS = 3, BUCKETS // 3
#: an estimate below this is more than five deviations under the limit
LEAST_ESTIMATE = 0.45
#: the texts of a band that are compared with each other at once; larger bands are cut into blocks
PAIRWISE = 8192
#: pairs that are compared together
COMPARED = 200_000
#: hashes of sets that a task holds unpacked
HELD_HASHES = 4_000_000
#: ids up to this many are broadcast (16 MB); more are joined by a shuffle
BROADCAST_IDS = 1_000_000
#: bytes of text that are hashed together
AT_ONCE = 1 << 20

_ORDERS = np.stack([np.random.RandomState(i).permutation(BUCKETS) for i in range(BUCKETS)])
_EDGES = np.arange(BUCKETS, dtype="u8") << np.uint64(64 - BUCKET_BITS)
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(1 << max(n - 1, 1).bit_length(), base, "u8")
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a lower-cased text, and where it begins: the polynomial of its
    bytes, as a difference of running sums, moved to the word's beginning."""
    codes = np.frombuffer(raw, "u1")
    blank = _BLANK[codes]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = edges[::2], edges[1::2]
    up, down = _powers_to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, "u8")
    np.cumsum(np.where(blank, 0, codes.astype("u8") + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[end] - sums[begin]) * down[begin]), begin


def _long_hashes(raw: bytes) -> np.ndarray:
    """As :func:`_word_hashes` for texts too long to be read at once."""
    parts = []
    while raw:
        cut = AT_ONCE
        while cut < len(raw) and not _BLANK[raw[cut]]:
            cut += 1
        parts.append(_word_hashes(raw[:cut])[0])
        raw = raw[cut:]
    return np.concatenate(parts)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _combined(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(words) - size + 1
    value = np.full(max(n, 0), size, "u8")
    for k in range(size if n > 0 else 0):
        value = (value * _MULTIPLIERS[0]) ^ words[k : k + n]
        value = value ^ (value >> np.uint64(29))
    return _mixed(value)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of UTF-8 texts, read about a megabyte at a time."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at] or b"") <= AT_ONCE):
            part.append((texts[at] or b"").lower())
            size += len(part[-1]) + 1
            at += 1
        if size > 2 * AT_ONCE:  # one long text
            words, first = _long_hashes(part[0]), np.zeros(1, int)
        else:
            words, begin = _word_hashes(b" ".join(part))
            first = np.searchsorted(begin, np.cumsum([0] + [len(x) + 1 for x in part[:-1]]))
        each = _combined(words, SHINGLE)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(words)]):
            yield _distinct(each[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _combined(words[a:b], b - a) if b > a else each[:0]


def registers(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Registers of texts (rows) from the least hash of each bucket, bucket bits cut off."""
    least = least << np.uint64(BUCKET_BITS)
    zeros = (53 - np.frexp((least >> np.uint64(11)).astype("f8"))[1]).astype("u8")
    mantissa = ((least << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    found = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype("u2")
    short = np.flatnonzero(~filled.all(1))
    for part in np.array_split(short, max(1, len(short) // 2000)):
        if len(part):
            source = _ORDERS[np.arange(BUCKETS), filled[part][:, _ORDERS].argmax(2)]
            borrowed = np.take_along_axis(found[part], source, 1)
            found[part] = np.where(filled[part], found[part], borrowed)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """The registers of each band, and its number, as one integer."""
    parts = found[:, : BANDS * ROWS].reshape(len(found), BANDS, ROWS).astype("i8")
    return (np.arange(BANDS, dtype="i8") << 48) | (parts[:, :, 0] << 32) | (parts[:, :, 1] << 16) | parts[:, :, 2]


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that are equal though their hashes are not, for sets of
    ``n`` and ``m``: the closed form of the HyperMinHash paper for large sets."""
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919487159739093975 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA_BITS)


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        least = np.zeros((len(texts), BUCKETS), "u8")
        filled = np.zeros((len(texts), BUCKETS), bool)
        sizes, digests = [], []
        for row, found in enumerate(shingle_sets(texts.tolist())):
            sizes.append(len(found))
            digests.append(_digest(found))
            if len(found):
                at = np.searchsorted(found, _EDGES)
                filled[row] = np.diff(at, append=len(found)) > 0
                least[row] = found[np.minimum(at, len(found) - 1)]
        found = registers(least, filled)
        brief = found[:, : BANDS * ROWS].astype("<u2")
        yield pd.DataFrame(
            {"n_shingles": sizes, "digest": digests, "bands": list(band_keys(found)), "brief": [b.tobytes() for b in brief]}
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, hashes) of texts, some at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            sets = list(shingle_sets(batch.column(0)[start : start + 256].to_pylist()))
            offsets = np.cumsum([0] + [len(x) for x in sets])
            values = np.concatenate(sets).view("i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                ["digest", "hashes"],
            )


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``digest`` of its set, ``bands``; and the
    columns ``keep``."""
    sketch = F.pandas_udf(_sketch, "n_shingles long, digest binary, bands array<long>, brief binary")
    own = keep or []
    return docs.select(F.col(id).alias("doc_id"), *own, sketch(F.col(text).cast("binary")).alias("s")).select("doc_id", *own, "s.*")


def among(docs: DataFrame, ids: DataFrame, how: str, rows: int, id: str = "doc_id") -> DataFrame:
    """``docs`` whose id is (``left_semi``) or is not (``left_anti``) one of ``ids``."""
    return docs.join(F.broadcast(ids) if rows <= BROADCAST_IDS else ids, docs[id] == ids["_id"], how)


def _stars(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From (key, node) in order: each node with its key's first (``center``), for keys of
    several nodes. Keys at the ends of a partition, which may go on in the next, are given
    with ``end`` true and one node each."""
    center, key, alone = -1, -1, True
    ends: list[tuple[int, int]] = []
    for batch in rows:
        if not len(batch):
            continue
        keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not ends:
            ends.append((int(keys[0]), int(nodes[0])))
        first = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        own = np.where(group >= 0, nodes[starts][np.maximum(group, 0)] if len(starts) else center, center)
        yield pd.DataFrame({"key": keys[~first], "center": own[~first], "node": nodes[~first], "end": False})
        key, center = int(keys[-1]), int(own[-1])
    if ends:
        ends.append((key, center))
        yield pd.DataFrame({"key": [k for k, _ in ends], "center": [n for _, n in ends], "node": [n for _, n in ends], "end": True})


class Verifier:
    """Confirms pairs of nodes: an estimate from the bands, then the full sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id: str, text: str):
        self.docs, self.nodes, self.id, self.text = docs, nodes, id, text

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``node, hashes``: the full sets of ``wanted`` nodes."""
        needed = stored(wanted.join(self.nodes.select("node", "doc_id", "digest"), "node"))
        ids = needed.select(F.col("doc_id").alias("_id"))
        chosen = among(self.docs.select(self.id, self.text), ids, "left_semi", needed.count(), self.id)
        sets = chosen.select(F.col(self.text).cast("binary")).mapInArrow(_sets, "digest binary, hashes array<long>")
        return needed.select("node", "digest").join(sets, "digest").select("node", "hashes").dropDuplicates(["node"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b) those whose sets are similar enough."""
        facts = self.nodes.select("node", F.col("n_shingles").alias("n"), "bands")
        left = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ka"))
        right = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("kb"))

        @F.pandas_udf("double")
        def estimate(ka: pd.Series, kb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
            if not len(ka):
                return pd.Series([], dtype="float64")
            a, b = np.stack(ka.to_list()), np.stack(kb.to_list())
            same = sum(((a ^ b) >> shift) & 0xFFFF == 0 for shift in (0, 16, 32)).sum(1) / (BANDS * ROWS)
            chance = accidental(na.to_numpy(), nb.to_numpy())
            return pd.Series((same - chance) / (1 - chance))

        likely = stored(
            pairs.join(left, "a")
            .join(right, "b")
            .where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
            .where(estimate("ka", "kb", "na", "nb") >= LEAST_ESTIMATE)
            .select("a", "b", "na", "nb")
        )
        sets = stored(self.sets(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        shared = F.size(F.array_intersect("ha", "hb"))
        return (
            likely.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
            .select("a", "b", (F.col("na") + F.col("nb")).alias("sum"), shared.alias("shared"))
            .where((100 + PERCENT) * F.col("shared") >= PERCENT * F.col("sum"))
            .select("a", "b")
        )


def _groups(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of key, some whole keys at a time."""
    left: pd.DataFrame | None = None
    for batch in rows:
        left = batch if left is None else pd.concat([left, batch], ignore_index=True)
        keys = left["key"].to_numpy()
        if not len(keys) or keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        yield left.iloc[:cut]
        left = left.iloc[cut:]
    if left is not None and len(left):
        yield left


def _likely(ready: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of members in order of key and root: places of pairs of one key and different roots that are
    similar enough by size and by their registers and agree in no band before the key's, and
    their estimates. Of texts of sides 1 and 2 only those of different sides are paired, those
    of side 0 with each other."""
    keys, roots, n, side, band = (ready[c].to_numpy() for c in ("key", "root", "n", "side", "band"))
    brief = np.frombuffer(b"".join(ready["brief"]), "<u2").reshape(len(ready), -1)
    # a text meets those of its key that come after its own component
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (roots[1:] != roots[:-1])]))
    own_end = np.append(starts[1:], len(keys))[np.searchsorted(starts, np.arange(len(keys)), side="right") - 1]
    later = np.searchsorted(keys, keys, side="right") - own_end
    ends = np.cumsum(later)
    begin = 0
    while begin < len(keys):
        end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COMPARED)), begin + 1)
        many = later[begin:end]
        i = np.repeat(np.arange(begin, end), many)
        j = own_end[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        fits &= (side[i] == 0) | (side[i] != side[j])
        i, j = i[fits], j[fits]
        equal = brief[i] == brief[j]
        chance = accidental(n[i], n[j])
        close = (equal.mean(1) - chance) / (1 - chance)
        good = (close >= LEAST_ESTIMATE) & (equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i])
        yield i[good], j[good], close[good]
        begin = end


def _in_order(ready: pd.DataFrame) -> pd.DataFrame:
    return ready.sort_values(["key", "root", "node"], kind="stable", ignore_index=True)


def _active(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of members in order of key: those that look similar enough to one of another component."""
    for ready in _groups(rows):
        ready = _in_order(ready)
        met = np.zeros(len(ready), bool)
        for i, j, _ in _likely(ready):
            met[i] = met[j] = True
        yield ready[met]


def _narrow(hashes: np.ndarray) -> bytes:
    """A set as the first six bytes of its sorted hashes."""
    kept = (hashes >> np.uint64(16)).astype("<u8").view("u1").reshape(-1, 8)[:, :6]
    return np.ascontiguousarray(kept).tobytes()


def _narrowed(sets: pd.Series) -> pd.Series:
    return pd.Series([_narrow(np.asarray(x, "i8").view("u8")) for x in sets], dtype="object")


def _widened(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, "u1").reshape(-1, 6)
    out = np.zeros((len(six), 8), "u1")
    out[:, :6] = six
    return out.view("<u8").ravel()


def _confirmed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of active members with their sets, in order of key: links (a, b) that join components, as
    many as it takes. The likeliest pairs of a key come first; a pair that others have joined
    already is not looked at."""
    for ready in _groups(rows):
        ready = _in_order(ready)
        nodes, sets, held = ready["node"].to_numpy(), {}, [0]
        # components within a key, by the place of their first member
        same = (ready["key"].to_numpy()[1:] == ready["key"].to_numpy()[:-1]) & (ready["root"].to_numpy()[1:] == ready["root"].to_numpy()[:-1])
        first = np.concatenate([[True], ~same])
        up = np.flatnonzero(first)[np.cumsum(first) - 1].tolist()

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def hashes(x: int) -> np.ndarray:
            if x not in sets:
                if held[0] > HELD_HASHES:
                    sets.clear()
                    held[0] = 0
                sets[x] = _widened(ready["hashes"].iat[x])
                held[0] += len(sets[x])
            return sets[x]

        found = []
        for i, j, close in _likely(ready):
            for k in np.argsort(-close, kind="stable").tolist():
                a, b = int(i[k]), int(j[k])
                if top(a) == top(b):
                    continue
                x, y = hashes(a), hashes(b)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if (100 + PERCENT) * shared >= PERCENT * (len(x) + len(y)):
                    up[max(top(a), top(b))] = min(top(a), top(b))
                    found.append((nodes[a], nodes[b]))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])


MEMBER = "key long, node long, root long, n long, brief binary, band int"


def _numbered(size: int):
    """Rows in order of key and root with the block they fall in: ``size`` rows of a key, or fewer."""

    def number(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, key, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in rows:
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            first = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            at = np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(first, at, -held))
            place = at - begin
            ends = first | (place % size == 0)
            blocks = block + np.cumsum(ends)
            yield batch.assign(block=blocks)
            block, key, held = int(blocks[-1]), keys[-1], int(place[-1]) + 1

    return number


def _block_pairs(large: DataFrame) -> DataFrame:
    """The members of large bands, dealt to the pairs of blocks that hold several components."""
    ordered = large.repartitionByRange("key", "root", "node").sortWithinPartitions("key", "root", "node")
    blocked = stored(ordered.select("key", "node", "root", "n", "brief", "band").mapInPandas(_numbered(max(PAIRWISE // 2, 1)), f"{MEMBER}, block long"))
    facts = blocked.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    other = facts.select("key", F.col("block").alias("block_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = stored(
        facts.join(other, "key")
        .where("block <= block_b AND NOT (lo = hi AND lo_b = hi_b AND lo = lo_b)")
        .select("block", "block_b")
    )
    one = pairs.select("block", F.xxhash64("block", "block_b").alias("key"), F.when(F.col("block") == F.col("block_b"), 0).otherwise(1).alias("side"))
    two = pairs.where("block <> block_b").select(F.col("block_b").alias("block"), F.xxhash64("block", "block_b").alias("key"), F.lit(2).alias("side"))
    return blocked.drop("key").join(one.unionByName(two), "block").select("key", "node", "root", "n", "brief", "band", "side")


def _dealt(members: DataFrame) -> DataFrame:
    """The members (key, node, root, n, brief) of bands that hold several components, in order of
    key: a band, or a pair of blocks of a large one."""
    facts = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = stored(facts.where("lo != hi").select("key", "size"))
    members = stored(members.join(mixed, "key").withColumn("band", F.shiftright("key", 48).cast("int")))
    groups = members.where(F.col("size") <= PAIRWISE).drop("size").withColumn("side", F.lit(0))
    large = members.where(F.col("size") > PAIRWISE)
    if not large.isEmpty():
        groups = groups.unionByName(_block_pairs(large))
    return groups.select("key", "node", "root", "n", "brief", "band", "side").repartition("key").sortWithinPartitions("key")


def _open_links(members: DataFrame, verifier: Verifier) -> DataFrame:
    """Links that join components within bands that hold several."""
    active = stored(_dealt(members).mapInPandas(_active, f"{MEMBER}, side int"))
    narrow = F.pandas_udf(_narrowed, "binary")
    sets = verifier.sets(active.select("node").distinct()).select("node", narrow("hashes").alias("hashes"))
    return active.join(sets, "node").repartition("key").sortWithinPartitions("key").mapInPandas(_confirmed, "a long, b long")


def similar_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the least id that links
    reach) and ``kept`` (whether that is its own)."""
    drawn = stored(sketches(docs, id, text))
    return _decided(docs, drawn, id, text).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _decided(docs: DataFrame, drawn: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``drawn`` (and what other columns it has) with their ``component_id``."""
    nodes = stored(
        drawn.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("brief").alias("brief"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    starred = stored(
        keyed.repartitionByRange("key", "node")
        .sortWithinPartitions("key", "node")
        .mapInPandas(_stars, "key long, center long, node long, end boolean")
    )
    ends = starred.where("end").select("key", "node").distinct()
    across = ends.join(ends.groupBy("key").agg(F.min("node").alias("center")), "key").where("node != center")
    stars = starred.where("NOT end").select("key", "center", "node").unionByName(across.select("key", "center", "node"))
    verifier = Verifier(docs, nodes, id, text)
    links = stored(verifier.links(stored(stars.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())))
    roots = components(links)

    members = stars.select("key", "node").unionByName(stars.select("key", F.col("center").alias("node"))).distinct()
    sized = nodes.select("node", F.col("n_shingles").alias("n"), "brief")
    members = stored(
        members.join(sized, "node")
        .join(roots, "node", "left")
        .select("key", "node", F.coalesce("root", "node").alias("root"), "n", "brief")
    )
    more = stored(_open_links(members, verifier))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    grouped = nodes.join(roots, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    grouped = stored(grouped)
    least = stored(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    named = stored(grouped.join(least, "root").select(F.col("digest").alias("_digest"), "component_id", "root"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        drawn.drop("bands", "brief")
        .join(named, F.col("digest") == F.col("_digest"), "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
        .withColumn("root", F.when(F.col("doc_id").isNotNull(), F.col("root")))
        .drop("_digest")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked with another of a smaller id, or of the same
    id and a smaller hash of the text: each text is decided for itself, whatever ids are shared;
    of rows with equal ids and texts one stays."""
    hashed = lambda df: F.xxhash64(df["text"].cast("string"))
    drawn = stored(sketches(docs.withColumn("_tw_text", hashed(docs)), keep=["_tw_text"]))
    groups = stored(_decided(docs, drawn, "doc_id", "text").select("doc_id", "_tw_text", "root"))
    linked = groups.where("root IS NOT NULL")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "_tw_text")).alias("first"))
    gone = stored(
        linked.join(first, "root")
        .where(F.struct("doc_id", "_tw_text") != F.col("first"))
        .select(F.col("doc_id").alias("_id"), F.col("_tw_text").alias("_hash"))
        .distinct()
    )
    found = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    stay = docs.join(found, (docs["doc_id"] == found["_id"]) & (hashed(docs) == found["_hash"]), "left_anti")
    again = stored(groups.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")))
    repeated = again.count()
    if not repeated:
        return stay
    once = among(stay, again, "left_semi", repeated).dropDuplicates(["doc_id", "text"])
    return among(stay, again, "left_anti", repeated).unionByName(once)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {SHINGLE} + 2), lambda i: array_to_string(words[i:i+{SHINGLE}-1], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS doc, doc_id AS other FROM w UNION SELECT r.doc, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON doc = w.doc_id GROUP BY w.doc_id, n.n
"""
