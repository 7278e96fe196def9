"""Queries of the training-data operators over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, cotraining, ctw, media, mixing, packing, rules, sharding, simhash, suffixes
from .common import cut, table, word_count


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digests, the text that is left; a character cut in part shows as U+FFFD."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(docs, "size")
    return mixed.select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", "taken", "copies", "source")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.prefix_targets(rows.union(more)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.from_media(media.to_media(docs, "doc_id", "text"), "doc_id")
    clip = lambda c: F.concat_ws("-", c["first"], c["frames"], c["mean"])
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("frames").cast("string"), F.concat_ws(",", F.transform("clips", clip))).alias("feature"),
        "clips",
    )


def op7_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return ctw.score(docs, fold != 1)


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = sharding.shard_rows(docs, 24, seed=9)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_tokens")))
    return packing.pack(docs, "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_mix_sources, op3_chat_format, op4_simhash, op5_quality_rules, op6_media, op7_ctw_score, op8_cotraining, op9_shard, op10_pack)}
#: The others have no SQL: they need CRC-32, XXH64, learned or coded forms.
ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(concat_ws('/', coalesce(doc_id::varchar, ''), coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0), coalesce(source, ''), '42')), 1, 13))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((r - 1) % 3 + 1)::int] as w, source_size * 2.0::double as cap from s),
o as (
  select *, sum(cap) over (order by cap / w, r) - cap as cap_before, sum(w) over () - sum(w) over (order by cap / w, r) + w as w_left,
    1.5::double * sum(source_size) over () as budget
  from w),
l as (select *, (budget - cap_before) / w_left as level from o),
t as (
  select source, source_size, r, budget,
    least(cap, coalesce((select level from l where level * w <= cap order by cap / w, r limit 1) * w, cap)) as target
  from l),
q as (
  select d.*, t.source_size, t.r, t.budget, t.target, sum(d.size) over (partition by t.r order by h, doc_id rows unbounded preceding) as own_end
  from d join t on d.source is not distinct from t.source),
e as (
  select *, case when target > 0 then (source_size * p + own_end)::double / target else 0.0 end as v
  from q, (select unnest([0, 1]) as p) where p = 0 or size > 0),
g as (select *, sum(size) over (order by v, r, p, h, doc_id rows unbounded preceding) <= budget as taken from e)
select doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
  sum(case when taken then size else 0 end)::bigint as taken, count(*) filter (taken)::int as copies, any_value(source) as source
from g group by doc_id""",
}
