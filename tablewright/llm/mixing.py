"""A mix of sources with given shares, by entropy balancing.

Every document gets a rate, how often the mix takes it. Among all rates between 0 and
``most`` that give each source its target of words, those closest to the base rate in
entropy are tilted exponentially: with ``x`` the document's size over its source's mean,
the odds of the rate are ``exp(tilt * x)``. The tilts solve the dual, which is convex and
falls apart into one equation per source; Newton's method solves all of them together, one
aggregate of the corpus for each step, kept inside a bracket so that it cannot run away.

Rates become copies in two parts. Documents with over 1 % of their source's words (at most
100 of a source) are rounded in order of size, each taking on what the ones before left
over. All others take the whole part of their rate, and of the rest those come first whose
hash lies furthest below their fraction, until the target is met: two counts of hash
intervals find where to stop, whatever the size of a source.

Defined results: null and empty texts have size 0 and take nothing; a null source is a
source of its own, last in order; rows with equal ids are documents of their own; a null id
hashes as any other value; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import WORD, kept, stored, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: Newton stops when every source is this close to its target
CLOSE = 1e-6
STEPS = 40
LARGE = 0.01
BINS = 1024


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """``rank`` from 0 in the order of a column, by counting per partition of a sorted table."""
    place = F.monotonically_increasing_id()
    rows = kept(df.orderBy(order).select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_at")))
    before, offsets = 0, []
    for row in rows.groupBy("_part").count().orderBy("_part").collect():  # a row per partition
        offsets.append((row["_part"], before))
        before += row["count"]
    known = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return rows.join(F.broadcast(known), "_part").select("*", (F.col("_at") + F.col("_before")).alias("rank")).drop("_part", "_at", "_before")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (key, total) with ``target``: shares by weight, none above ``most`` times its
    source; the excess of those at the limit is shared among the others again and again."""
    ranked = _ranked(sources, "key")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    weighed = kept(ranked.withColumn("weight", weight))
    goal = (weighed.agg(F.sum("total")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("weight") * level >= most * F.col("total")
        taken, open_weight = weighed.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("total"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if open_weight is None:
            break
        higher = (goal - taken) / open_weight
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return weighed.withColumn("target", F.least(F.col("weight") * level, (most * F.col("total")).cast("double"))).drop("weight", "rank")


def _rate(tilt: Column, x: Column, most: int) -> Column:
    return most / (1 + F.exp(-F.least(F.greatest(tilt * x, F.lit(-500.0)), F.lit(500.0))))


def solve_tilts(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``targets`` (key, total, rows, target) with ``tilt``; ``sizes``: (key, size, rows)."""
    mean = F.greatest(F.col("total") / F.col("rows"), F.lit(1e-9))
    reach = 60.0 * mean
    at_limit = F.col("target") >= most * F.col("total") * (1 - 1e-12)
    state = targets.select("*", mean.alias("mean"), at_limit.alias("full")).select(
        "*", (-reach).alias("low"), reach.alias("high"), F.when(F.col("full"), reach).otherwise(F.lit(0.0)).alias("tilt")
    )
    state = stored(state)
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x, most)
        reached = (
            sizes.select("key", "size", F.col("rows").alias("n"))
            .join(state.select("key", "mean", "tilt"), "key")
            .groupBy("key")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
            )
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = F.col("full") | (F.abs(miss) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0)))
        moved = state.join(reached, "key", "left").select(
            "key", "total", "rows", "target", "mean", "full", low.alias("low"), high.alias("high"),
            F.when(done | miss.isNull(), F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            F.coalesce(done, F.lit(True)).alias("done"),
        )
        moved = stored(moved)
        state = moved.drop("done")
        if moved.where(~F.col("done")).isEmpty():
            break
    return state


def _round_large(group: pd.DataFrame) -> pd.DataFrame:
    """At most ``1 / LARGE`` documents of one source, largest first."""
    group = group.sort_values(["size", "hash", "row"], ascending=[False, True, True])
    carry, copies = 0.0, []
    most = int(group["most"].iloc[0])
    for size, rate in zip(group["size"], group["rate"]):
        n = min(max(round(rate + carry / size), 0), most)
        carry += (rate - n) * size
        copies.append(n)
    return group.assign(copies=copies)[["key", "row", "copies"]].astype({"copies": "int32"})


def _cut(bins: DataFrame, need: DataFrame, bin: str) -> DataFrame:
    """For each source the first interval at which the running sum of sizes passes what is
    needed, and what is needed beyond the intervals before it. ``bins``: (key, bin, size)."""
    running = F.sum("size").over(Window.partitionBy("key").orderBy(bin))  # at most BINS rows of a source
    return (
        bins.withColumn("running", running)
        .join(need, "key")
        .where((F.col("running") > F.col("need")) & (F.col("running") - F.col("size") <= F.col("need")))
        .select("key", F.col(bin), (F.col("need") - (F.col("running") - F.col("size"))).alias("need"))
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """A row per document: id, ``source``, ``size`` (words), ``source_size``, ``target`` (its
    source's), ``rate``, ``copies`` and ``taken`` (words the mix takes)."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sized = kept(
        docs.select(
            F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"),
            F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        ).select("*", key.alias("key"), F.xxhash64("doc_id", "size", "source").alias("hash"), F.monotonically_increasing_id().alias("row"))
    )
    sizes = stored(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("total"), F.sum("rows").alias("rows"))
    tilts = solve_tilts(sizes, source_targets(sources, weights, share, most), most)
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean"), most))
    rated = sized.join(tilts.select("key", "total", "target", "mean", "full", "tilt"), "key").select(
        "doc_id", "source", "size", "key", "hash", "row", "total", "target", rate.alias("rate"),
        (F.col("size") > LARGE * F.col("total")).alias("large"),
    )
    large = (
        rated.where("large")
        .select("key", "row", "size", "hash", "rate", F.lit(most).alias("most"))
        .groupBy("key")
        .applyInPandas(_round_large, "key string, row long, copies int")
    )
    whole = F.least(F.floor("rate"), F.lit(most)).cast("int")
    uniform = F.pmod(F.col("hash"), F.lit(1 << 40)) / float(1 << 40)
    behind = ((uniform - (F.col("rate") - whole) + 1) / 2 * float(BINS * BINS)).cast("long")
    marked = rated.join(large.select(F.col("row").alias("_row"), "copies"), F.col("row") == F.col("_row"), "left").drop("_row")
    marked = stored(
        marked.select(
            "*", whole.alias("whole"),
            F.least(F.greatest(behind, F.lit(0)), F.lit(BINS * BINS - 1)).alias("behind"),
        ).withColumn("coarse", F.floor(F.col("behind") / BINS)).withColumn("fine", F.pmod(F.col("behind"), F.lit(BINS)))
    )
    small = marked.where("copies IS NULL AND size > 0")
    need = marked.groupBy("key").agg(
        (F.first("target") - F.sum(F.col("size") * F.coalesce("copies", "whole"))).alias("need")
    )
    open_to = small.where(F.col("whole") < most)
    cut1 = stored(_cut(open_to.groupBy("key", "coarse").agg(F.sum("size").alias("size")), need, "coarse"))
    edge = open_to.join(cut1.withColumnRenamed("coarse", "edge"), "key").where("coarse = edge")
    cut2 = stored(
        _cut(edge.groupBy("key", "fine").agg(F.sum("size").alias("size")), cut1.select("key", "need"), "fine")
    )
    last = edge.drop("need").join(cut2.select("key", F.col("fine").alias("at"), "need"), "key").where("fine = at")
    order = Window.partitionBy("key").orderBy(F.desc("size"), "hash", "row")
    taken_last = last.withColumn("running", F.sum("size").over(order)).where(F.col("running") - F.col("size") / 2 <= F.col("need"))
    # a source whose need is negative has no cut and takes none; one beyond all has none and takes all
    cuts = stored(
        need.join(cut1.select("key", F.col("coarse").alias("coarse_cut")), "key", "left")
        .join(cut2.select("key", F.col("fine").alias("fine_cut")), "key", "left")
    )
    extras = stored(taken_last.select(F.col("row").alias("_row"), F.lit(1).alias("_last")))
    before = (F.col("coarse") < F.col("coarse_cut")) | ((F.col("coarse") == F.col("coarse_cut")) & (F.col("fine") < F.col("fine_cut")))
    more = (
        F.when(F.col("whole") >= most, 0)
        .when(F.col("coarse_cut").isNull(), (F.col("need") > 0).cast("int"))
        .when(before | F.col("_last").isNotNull(), 1)
        .otherwise(0)
    )
    done = marked.join(cuts, "key").join(extras, F.col("row") == F.col("_row"), "left").withColumn(
        "copies", F.when(F.col("size") == 0, F.col("whole")).otherwise(F.coalesce(F.col("copies"), F.col("whole") + more)).cast("int")
    )
    return done.select(
        "doc_id", "source", "size", F.col("total").alias("source_size"), "target", "rate", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`mix_sources`."""
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
