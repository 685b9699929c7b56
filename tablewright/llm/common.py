"""What several of the operators share: words, intermediate tables, columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import ensure_checkpoint_dir, shared_folder

#: ASCII white space separates words; everything else belongs to them
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(by: int, name: str = "doc_id") -> Column:
    """crc32 of the id written out, modulo ``by``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(by)), F.lit(-1)).cast("int")


def kept(df: DataFrame) -> DataFrame:
    """Computed once and read from the shared folder afterwards; Spark removes it with the frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As :func:`kept`, as Parquet: compressed, columns are read singly, and joins may deal
    its rows out anew (and split hot keys) as nothing is known of their placing. The folder
    is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it in a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
