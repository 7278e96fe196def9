"""Sinks: tables, keyed upserts and text reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import exists


def write_json(df: DataFrame, path: str) -> None:
    """JSON arrays, one in each part file; a table in one partition is one array. Overwrites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for row in batch.column(0).to_pylist():
                out.append(before + row)
                before = ","
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def upserted(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("model", "condition")) -> DataFrame:
    """Rows of ``existing`` whose keys ``new`` lacks, and ``new``. Without new rows, all of
    ``existing``."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: tuple[str, ...] = ("model", "condition")) -> None:
    """Upsert into the Parquet table at ``path``: written beside it, then swapped, as a
    path that is being read cannot be overwritten."""
    out = upserted(spark.read.parquet(path), new, keys) if exists(spark, path) else new
    fresh = f"{path}.{uuid.uuid4().hex}"
    out.write.parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop.Path(f"{fresh}.old")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(hadoop.Path(fresh), target)
    fs.delete(old, True)


def report_lines(df: DataFrame, *widths: tuple[str, int]) -> DataFrame:
    """One column ``line`` of fixed-width fields; null shows as '-'."""
    cell = lambda c, w: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ")
    return df.select(F.rtrim(F.concat(*(cell(c, w) for c, w in widths))).alias("line"))


def review_rows(pairs: DataFrame, seed: int, n: int = 30) -> DataFrame:
    """Rejected pairs and a seeded sample of at most ``n`` accepted ones (verdict YES)."""
    rejected = pairs.filter("verdict <> 'YES'").withColumn("section", F.lit("rejected"))
    accepted = pairs.filter("verdict = 'YES'").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("sample_index").cast("string")), 256)).limit(n)
    return rejected.unionByName(accepted.withColumn("section", F.lit("accepted")))
