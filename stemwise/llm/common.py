"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder that ``spark.checkpoint.dir`` names.

    A folder is only made up where the session has none and driver and executors are one
    process; a cluster without one is an error, as its machines share no temporary folder.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stemwise-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for results, made distinct from those of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fan(rows: int, least: int = 1024, per_bucket: int = 500_000) -> int:
    """How many hash buckets hold ``rows`` rows at ``per_bucket`` each: a power of two."""
    n = least
    while n * per_bucket < rows:
        n *= 2
    return n


def running_total(df: DataFrame, value: Column, group: Sequence[str], bucket: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the inclusive running total of ``value`` in each group, ordered by (bucket, order).

    No task ever sees a whole group: rows are windowed per (group, bucket), and the
    sums per bucket, a small table, give each bucket its starting offset. ``df`` is
    evaluated twice, so buckets and order must be functions of the row alone. Group
    columns must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__inside", F.sum(value).over(inside))
    return rows.join(starts, keys).withColumn(name, F.col("__start") + F.col("__inside")).drop("__start", "__inside")


def packed(a: np.ndarray) -> bytes:
    """The bytes of an array of 64-bit numbers, compressed place by place."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(key, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64))
