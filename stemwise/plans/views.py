"""Exam-shaped relations derived from the synthetic tables, and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.items import to_long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models under three conditions answer each item; gold where k < 30, unread where k >= 90."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("key"))
    item = F.expr("event_id div 12")
    gold = T.letter_at(item % 5)
    types = F.create_map(*(F.lit(x) for pair in zip(("click", "error", "purchase", "signup", "view"), T.LETTERS, strict=True) for x in pair))
    return e.select(
        item.alias("item_pos"),
        F.concat(F.lit("m"), F.expr("(event_id % 12) div 3")).alias("model"),
        F.element_at(F.array(F.lit("full"), F.lit("options"), F.lit("shuffle")), (F.col("event_id") % 3 + 1).cast("int")).alias("condition"),
        F.concat(F.lit("bank"), item % 8).alias("bank"),
        gold.alias("gold"),
        F.when(F.col("key") >= 90, None).when(F.col("key") < 30, gold).otherwise(types[F.col("event_type")]).alias("pick"),
    )


ANSWERS = """answers as (
  select e // 12 as item_pos, 'm' || ((e % 12) // 3) as model, ['full', 'options', 'shuffle'][(e % 3) + 1] as condition,
    'bank' || ((e // 12) % 8) as bank, substr('ABCDE', ((e // 12) % 5 + 1)::int, 1) as gold,
    case when k >= 90 then null when k < 30 then substr('ABCDE', ((e // 12) % 5 + 1)::int, 1)
      else case t when 'click' then 'A' when 'error' then 'B' when 'purchase' then 'C' when 'signup' then 'D' when 'view' then 'E' end end as pick
  from (select event_id as e, event_type as t, regexp_extract(props, '([0-9]+)', 1)::int as k from events))"""


def items(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Every six sentences of a document (or benchmark passage): a question and five options.

    The last item's option E takes what is left. A text of under six sentences is one
    item, with empty text for what it lacks; null text counts as empty.
    """
    if name == "documents":
        d = table(spark, sf_dir, name).select("doc_id", "source", "lang", "text")
    else:
        d = table(spark, sf_dir, name).select(F.col("item_id").alias("doc_id"), F.lit("src1").alias("source"), F.lit("en").alias("lang"), "text")
    d = d.withColumn("p", F.filter(F.split(F.coalesce("text", F.lit("")), r"\. "), lambda x: F.trim(x) != ""))
    d = d.withColumn("last", F.greatest(F.floor(F.size("p") / 6), F.lit(1)) - 1)
    rows = d.select("doc_id", "source", "lang", "p", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k"))
    part = lambda i: F.coalesce(F.get("p", (6 * F.col("k") + i).cast("int")), F.lit(""))
    rest = F.array_join(F.slice("p", (6 * F.col("k") + 6).cast("int"), F.greatest(F.size("p"), F.lit(1))), ". ")
    options = F.create_map(*(x for i, letter in enumerate("ABCD", 1) for x in (F.lit(letter), part(i))), F.lit("E"), F.when(F.col("k") == F.col("last"), rest).otherwise(part(5)))
    return rows.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("item_pos"), F.col("source").alias("bank"), "lang", part(0).alias("question"), options.alias("options"), T.letter_at((F.col("doc_id") + F.col("k")) % 5).alias("answer"))


def options(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return to_long(items(spark, sf_dir, name))


def _items_sql(name: str, source: str) -> str:
    return f"""{name}_p as (select *, greatest(1, len(p) // 6) - 1 as last from (
    select {source}, list_filter(string_split(coalesce(text, ''), '. '), lambda x: trim(x) <> '') as p from {'documents' if name == 'items' else 'benchmark'})),
  {name} as (
  select doc_id * 1000000 + k as item_pos, source as bank, lang, coalesce(p[6 * k + 1], '') as question,
    [coalesce(p[6 * k + 2], ''), coalesce(p[6 * k + 3], ''), coalesce(p[6 * k + 4], ''), coalesce(p[6 * k + 5], ''),
     coalesce(case when k = last then array_to_string(p[6 * k + 6:], '. ') else p[6 * k + 6] end, '')] as opts,
    substr('ABCDE', ((doc_id + k) % 5 + 1)::int, 1) as answer
  from (select *, unnest(range(last + 1)) as k from {name}_p))"""


def _options_sql(name: str, rows: str) -> str:
    return f""", {name} as (
  select item_pos, bank, lang, substr('ABCDE', i, 1) as letter, i - 1 as letter_idx, opts[i] as text, substr('ABCDE', i, 1) = answer as is_gold
  from {rows}, (select unnest([1, 2, 3, 4, 5]) as i))"""


ITEMS = _items_sql("items", "doc_id, source, lang")
EVAL_ITEMS = _items_sql("eval_items", "item_id as doc_id, 'src1' as source, 'en' as lang")
OPTIONS = ITEMS + _options_sql("options", "items")
EVAL_OPTIONS = EVAL_ITEMS + _options_sql("eval_options", "eval_items")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records rendered from items; every seventh to thirteenth is broken in some way."""
    i = items(spark, sf_dir)
    n = F.col("item_pos")
    o = lambda x: F.element_at("options", x)
    body = F.concat_ws(" ", F.col("question"), *(F.concat(F.lit(f"{x}. "), o(x)) for x in "ABCD"), F.when(n % 7 == 0, F.concat(F.lit("D. "), o("E"))).when(n % 11 != 0, F.concat(F.lit("E. "), o("E"))))
    data = F.when(n % 9 == 0, F.concat(F.lit("[Shared stem] "), body)).otherwise(body)
    data = F.when(n % 12 == 0, F.concat(F.lit("[Single choice] [multiple-choice questions] "), data)).otherwise(data)
    data = F.when(n % 17 == 0, F.concat(F.lit("QQ: 1234567 "), data)).otherwise(data)
    data = F.when(n % 19 == 0, F.col("question")).otherwise(data)
    label = F.when(n % 13 == 0, "Reference answer: AC").when(n % 23 == 0, "none").otherwise(F.concat(F.lit("Reference answer: "), F.col("answer")))
    return i.select(F.lit("a").alias("archive"), "bank", n.alias("pos"), data.alias("data"), label.alias("label"))


RAW = (
    ITEMS
    + """, raw0 as (select *, item_pos as n, concat_ws(' ', question, 'A. ' || opts[1], 'B. ' || opts[2], 'C. ' || opts[3], 'D. ' || opts[4],
    case when item_pos % 7 = 0 then 'D. ' || opts[5] when item_pos % 11 <> 0 then 'E. ' || opts[5] end) as d0 from items),
  raw1 as (select *, case when n % 9 = 0 then '[Shared stem] ' || d0 else d0 end as d1 from raw0),
  raw2 as (select *, case when n % 12 = 0 then '[Single choice] [multiple-choice questions] ' || d1 else d1 end as d2 from raw1),
  raw as (select 'a' as archive, bank, n as pos, case when n % 19 = 0 then question when n % 17 = 0 then 'QQ: 1234567 ' || d2 else d2 end as data,
    case when n % 13 = 0 then 'Reference answer: AC' when n % 23 = 0 then 'none' else 'Reference answer: ' || answer end as label from raw2)"""
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")


def scratch(spark: SparkSession) -> str:
    """A new folder where all machines of the session can write."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="stemwise-")
    return f"{shared}/scratch-{uuid.uuid4().hex}"
