"""Structural audit of raw records: one projection, then small aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .items import dedupe_first


def classify(raw: DataFrame) -> DataFrame:
    """Records (archive, bank, pos, data, label), deduped, with a column per question."""
    rows = raw.withColumns({"data": F.coalesce("data", F.lit("")), "label": F.coalesce("label", F.lit(""))})
    rows = dedupe_first(rows.withColumn("key", T.norm_lower(F.col("data"))), ["key"], ["archive", "pos"])
    marker = F.coalesce(T.first("label", T.ANSWER), T.first("data", T.ANSWER))
    letters = T.found(F.col("data"), T.OPTION_AUDIT, 1)
    distinct = lambda s, p: F.size(F.array_distinct(T.found(F.col(s), p, 1)))
    rows = rows.withColumns({"letters": letters, "shared": T.matches(F.col("data"), T.SHARED), "leak": T.first_named(F.col("data")), "cjk": T.matches(F.col("data"), T.CJK) | T.matches(F.col("label"), T.CJK)})
    unique = F.array_sort(F.array_distinct("letters"))
    n = F.size(unique)
    prefix = F.slice(F.array(*map(F.lit, "ABCDEFG")), F.lit(1), n)
    shape = (
        F.when(F.size("letters") == 0, "none")
        .when(F.size("letters") != n, "duplicate_letters")
        .when(unique == F.array(*map(F.lit, T.LETTERS)), "clean_ABCDE")
        .when(unique == prefix, F.format_string("clean_%d_options", n))
        .otherwise("gapped_or_odd")
    )
    return rows.withColumns(
        {
            "answerable": F.when(marker.isNull(), "no_answer_marker").when(F.length(marker) > 1, "multi_answer").otherwise("single_answer"),
            "shape": shape,
            "no_options": F.when(
                F.size("letters") == 0,
                F.when(distinct("label", T.OPTION_AUDIT) >= 4, "options stored in the answer field")
                .when(distinct("data", T.OPTION_LOOSE) >= 4, "other punctuation or no space")
                .when(distinct("data", T.OPTION_PAREN) >= 4, "letters in parentheses")
                .otherwise("no option labels found"),
            ),
            "merged": F.when((F.size("letters") != n) & (F.regexp_count("data", F.lit(T.QUESTION_TYPE)) >= 2), F.when(F.col("shared"), "with shared-stem marker").otherwise("without shared-stem marker")),
        }
    ).drop("letters", "key")


def summary(classified: DataFrame) -> DataFrame:
    """(class, value, n) of all classifications in one pass."""
    classes = ["answerable", "leak", "shape", "no_options", "merged"]
    pairs = F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("value")) for c in classes), F.struct(F.lit("shared").alias("class"), F.col("shared").cast("string").alias("value")), F.struct(F.lit("cjk").alias("class"), F.col("cjk").cast("string").alias("value")))
    return classified.select(F.explode(pairs).alias("x")).filter("x.value is not null").groupBy("x.class", "x.value").agg(F.count("*").alias("n"))
