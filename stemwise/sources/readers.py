"""Sources. All schemas are explicit; every source keeps the position of its rows."""

from __future__ import annotations

import codecs
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import text as T

RECORD = "archive string, file string, bank string, file_pos long, pos long, data string, label string"


def zip_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records of all banks (JSON files, nested folders too) in zip archives."""
    return unzipped(spark.read.format("binaryFile").load(path).select("path", "content"))


_SPACE = re.compile(r"[ \t\n\r]*")


class _Text:
    """A stream of UTF-8 text, of which one stretch is held at a time."""

    def __init__(self, stream: IO[bytes], size: int):
        self.stream, self.size, self.text, self.at, self.ended = stream, size, "", 0, False
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def more(self) -> None:
        got = self.stream.read(max(self.size, len(self.text) - self.at))
        self.text, self.at, self.ended = self.text[self.at :] + self.decoder.decode(got, not got), 0, not got

    def peek(self) -> str:
        """The next character that is no white space; nothing at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.more()

    def take(self, expected: str) -> str:
        c = self.peek()
        if not c or c not in expected:
            raise ValueError(f"one of {expected} expected")
        self.at += 1
        return c

    def value(self):
        """The next value. Where a failure is so near the end of the stretch that what
        follows may mend it, more is read first; so it is for a number, as in 1.5|e+30."""
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
                if end + 3 <= len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError as e:
                if self.ended or e.pos < len(self.text) - 32 and not e.msg.startswith("Unterminated string"):
                    raise
            self.more()


_DECODER = json.JSONDecoder()


def json_elements(stream: IO[bytes], size: int = 1 << 20) -> Iterator[tuple[str | None, object]]:
    """(key, value) of a JSON object's members, (None, value) of an array's elements, one at
    a time, as ``json.loads`` reads them; nothing of any other value. ValueError where the
    text is not JSON, which may come after elements were given."""
    text = _Text(stream, size)
    opening = text.peek()
    if opening in ("[", "{") and opening:
        closing = "]" if opening == "[" else "}"
        text.take(opening)
        sep = text.take(closing) if text.peek() == closing else ","
        while sep == ",":
            key = None
            if opening == "{":
                if text.peek() != '"':
                    raise ValueError("a key expected")
                key = text.value()
                text.take(":")
            yield key, text.value()
            sep = text.take("," + closing)
    else:
        text.value()
    if text.peek():
        raise ValueError("more than one value")


def unzipped(archives: DataFrame) -> DataFrame:
    """The records of archives (path, content).

    Files that are not JSON are skipped; a dict of records counts as the list of its
    values; elements that are no objects are skipped; bytes that are not UTF-8 are
    replaced. One task reads one archive, each file twice as a stream: whether it is JSON
    is known at its end only. Held are the archive, one cell of 2 GB at most, some
    thousand records, and the keys of a dict.
    """

    def records(z: zipfile.ZipFile, name: str) -> Iterator[tuple[int, dict]]:
        last, places = {}, {}
        with z.open(name) as f:
            for n, (key, _) in enumerate(json_elements(f)):
                if key is not None:
                    last[key] = n
                    places.setdefault(key, len(places))
        with z.open(name) as f:
            for n, (key, r) in enumerate(json_elements(f)):
                if isinstance(r, dict) and (key is None or last[key] == n):
                    yield n if key is None else places[key], r

    def batched(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[5] or "") + len(row[6] or "")
            if len(held) == 4096 or size > 1 << 22:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        text = lambda r, k: r.get(k) if isinstance(r.get(k), str) else None
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for file_pos, name in enumerate(n for n in z.namelist() if n.endswith(".json")):
                        rows = ((posixpath.basename(where), name, posixpath.basename(name)[:-5], file_pos, i, text(r, "data"), text(r, "label")) for i, r in records(z, name))
                        try:
                            for held in batched(rows):
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["archive", "file", "bank", "file_pos", "pos", "data", "label"])
                        except ValueError:
                            continue

    return archives.select("path", "content").mapInArrow(run, RECORD)


def from_first_archive(records: DataFrame, bank: str) -> DataFrame:
    """One bank of the first of all archives."""
    first = records.agg(F.min("archive").alias("archive"))
    return load_bank(records.join(F.broadcast(first), "archive", "left_semi"), bank)


def load_bank(records: DataFrame, bank: str) -> DataFrame:
    """One bank: of the archives that have it, the first; of its files there, the first."""
    own = records.filter(F.col("bank") == bank)
    first = own.agg(F.min(F.struct("archive", "file_pos")).alias("f"))
    return own.join(F.broadcast(first), (F.col("archive") == F.col("f.archive")) & (F.col("file_pos") == F.col("f.file_pos"))).drop("f")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text, answer): blank-line separated blocks that have an answer marker."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"(?U)\n\s*\n")).alias("pos", "block"))
    block = files.select("path", F.col("pos").cast("long").alias("pos"), T.trim_ws(F.col("block")).alias("block"))
    marked = block.withColumn("answer", T.first("block", T.ANSWER_ZH)).filter("answer is not null")
    before = F.regexp_replace("block", r"(?s)" + T.ANSWER_ZH + ".*$", "")
    return marked.select("path", "pos", T.trim_ws(before).alias("text"), F.upper("answer").alias("answer"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with header, byte order mark and quoted line breaks; ``row`` from 0.

    One multi-line file is one split, so the row's position within it is its number.
    """
    df = spark.read.csv(path, header=True, schema=schemas.EXAM_CSV, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def json_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array of objects with each row's position; other elements are skipped.
    ``file`` is the file's name, or that of the folder of part files that stands for it."""
    where = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:/part-[^/]*)?$", 1)
    whole = spark.read.text(path, wholetext=True).select(where.alias("file"), F.from_json("value", "array<string>").alias("a"))
    rows = whole.select("file", F.posexplode("a").alias("item_pos", "json")).filter(F.col("json").startswith("{"))
    return rows.select("file", F.col("item_pos").cast("long").alias("item_pos"), F.from_json("json", schema).alias("r")).select("file", "item_pos", "r.*")


def glob_runs(spark: SparkSession, folder: str, prefix: str, schema: StructType) -> DataFrame:
    """Union of ``prefix*.json`` without summaries; ``file`` gives their order."""
    return json_table(spark, f"{folder}/{prefix}*.json", schema).filter(~F.col("file").endswith("_summary.json"))


def exists(spark: SparkSession, path: str) -> bool:
    """By Hadoop's file system, so in any store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def optional_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or no rows where there is no file."""
    if exists(spark, path):
        return json_table(spark, path, schema)
    return spark.createDataFrame([], "file string, item_pos long").crossJoin(spark.createDataFrame([], schema))


def non_empty_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
