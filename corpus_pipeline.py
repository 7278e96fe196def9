"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Nulls, empty and repeated rows, and empty tables are
handled as the operators' docstrings say; texts of which nothing but white space is left
go, with their rows, in the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemwise.llm import mixing, near, packing, rules, suffixes
from stemwise.llm.common import WORD, cut, table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passages of over 50 words go that repeat over so many bytes; 51 words have 315 bytes on
#: average, and under 256 in one case of 76.
REPEAT_BYTES, REPEAT_WORDS = 256, 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a learned rule go."""
    return rules.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 and more) the
    document of least id stays. SimHash links most of them; what its bits cannot see is
    found by an exact join, and every link is verified on the whole texts."""
    return near.keep_one(docs.select(*COLUMNS), words=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of over 50 words that occurs more than once is cut out of all its documents."""
    out = suffixes.dedup(docs.select(*COLUMNS), length=REPEAT_BYTES, characters=True, least_words=REPEAT_WORDS)
    text = F.col("kept").cast("string")
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.size("removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.filter((F.size("removed") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS, word_count(F.col("text")).alias("size")), "size")
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length."""
    return packing.pack(docs.select("doc_id", "text", "lang", "source", word_count(F.col("text")).alias("n_tokens")), "n_tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Rules are learned, and shingles are XXH64: neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
