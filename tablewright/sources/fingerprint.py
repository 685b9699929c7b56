"""Content hash of a dataset's files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a file up to this size is one value of Spark's reader, which allows 2 GiB
ONE_VALUE = 256 << 20
CHUNK = 8 << 20


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each file, read in chunks by the task that holds its name."""
    for batch in batches:
        found = []
        for path in batch["path"]:
            # Spark writes file:/x where the standard has file:///x
            system, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield batch.assign(content_hash=found)


def file_hashes(spark: SparkSession, path: str, one_value: int = ONE_VALUE) -> DataFrame:
    """``path, length, content_hash``: SHA-256 of every file's bytes, files in parallel. Files of
    over ``one_value`` bytes are read in chunks, so that no task holds one whole."""
    listed = spark.read.format("binaryFile").load(path)
    small = listed.where(F.col("length") <= one_value).select("path", "length", F.sha2("content", 256).alias("content_hash"))
    large = listed.where(F.col("length") > one_value).select("path", "length")
    return small.unionByName(large.mapInPandas(_streamed, "path string, length long, content_hash string"))


def dataset_hash(hashes: DataFrame, buckets: int = 4096) -> str:
    """One hash for a dataset: its file's hash, or a hash over all its files' hashes.

    File hashes are folded in two steps, first within buckets by hash prefix, so that
    a dataset of millions of files never has its list in one task.
    """
    count = hashes.count()
    if count == 0:
        raise ValueError("no files found")
    if count == 1:
        return hashes.first()["content_hash"]
    # copies of a file are counted first, so that they make up one entry of a bucket
    entries = hashes.groupBy("content_hash").count().select(
        F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).alias("bucket"),
        F.concat_ws(":", "content_hash", F.col("count").cast("string")).alias("entry"),
    )
    folded = entries.groupBy("bucket").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ""), 256).alias("part")
    )
    return folded.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ""), 256)
    ).first()[0]
