"""Surface cues of options: lengths, ranks, lexical flags, overlap and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def length_rank(options: DataFrame) -> DataFrame:
    """Adds len, rank (longest first, ties by letter), is_longest and is_shortest."""
    w = Window.partitionBy("item_pos")
    rows = options.withColumn("len", F.length(T.norm(F.col("text"))))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("len"), "letter_idx")))
    return rows.withColumns({"is_longest": F.col("rank") == 1, "is_shortest": F.col("rank") == F.count("*").over(w)})


def with_flags(options: DataFrame, flags: dict[str, str] | None = None) -> DataFrame:
    return options.withColumns({name: T.matches(F.col("text"), p) for name, p in (flags or T.FEATURES).items()})


def lift(options: DataFrame, flag: str) -> DataFrame:
    """How much likelier the right option has the flag than any option; null at base 0."""
    rows = options.agg(F.avg(F.when(F.col("is_gold"), F.col(flag).cast("int"))).alias("p_correct"), F.avg(F.col(flag).cast("int")).alias("p_any"))
    return rows.select(F.lit(flag).alias("flag"), "p_correct", "p_any", F.try_divide("p_correct", "p_any").alias("lift"))


def lifts(options: DataFrame) -> DataFrame:
    """``lift`` of all flags, from one pass."""
    means = [F.avg(F.when(F.col("is_gold"), F.col(f).cast("int"))).alias(f"c_{f}") for f in T.FLAGS]
    row = options.agg(*means, *(F.avg(F.col(f).cast("int")).alias(f"a_{f}") for f in T.FLAGS))
    each = F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f"c_{f}").alias("p_correct"), F.col(f"a_{f}").alias("p_any")) for f in T.FLAGS))
    return row.select(F.inline(each)).select("flag", "p_correct", "p_any", F.try_divide("p_correct", "p_any").alias("lift"))


def mean_lengths(options: DataFrame) -> DataFrame:
    """Mean and population deviation (1 if zero) of the lengths of right and wrong options."""
    n = F.length("text")
    return options.groupBy("is_gold").agg(F.avg(n).alias("mean_len"), F.coalesce(F.nullif(F.stddev_pop(n), F.lit(0.0)), F.lit(1.0)).alias("sd"))


def dense_features(options: DataFrame) -> DataFrame:
    """The 16 features of each option, relative to its item.

    The overlap with the other options needs no pairs of rows: each item's word sets
    are five short arrays in one window.
    """
    w = Window.partitionBy("item_pos")
    rows = length_rank(options.withColumn("text", T.norm(F.col("text"))))
    rows = rows.withColumn("words", T.tokens(F.col("text"))).withColumn("all", F.collect_list(F.struct("letter_idx", "words")).over(w))
    others = F.filter("all", lambda x: x["letter_idx"] != F.col("letter_idx"))
    overlap = F.aggregate(F.transform(others, lambda x: T.jaccard(F.col("words"), x["words"])), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(others), F.lit(0))
    deviation = F.coalesce(F.nullif(F.stddev_pop("len").over(w), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"overlap": F.coalesce(overlap, F.lit(0.0)), "len_log": F.log1p("len"), "len_z": (F.col("len") - F.avg("len").over(w)) / deviation, "rank_4": (F.col("rank") - 1) / 4})
    rows = with_flags(rows, T.FLAGS)
    alone = {f"only_{f}": (F.col(f) & (F.sum(F.col(f).cast("int")).over(w) == 1)).cast("int") for f in T.FLAGS}
    rows = rows.withColumns(alone)
    number = {c: F.col(c).cast("int") for c in ("is_longest", "is_shortest", *T.FLAGS)}
    return rows.withColumns(number).drop("words", "all", "len", "rank")


DENSE = ["len_log", "len_z", "rank_4", "is_longest", "is_shortest", "overlap", *T.FLAGS, *(f"only_{f}" for f in T.FLAGS)]


def export_features(items: DataFrame, options: DataFrame) -> DataFrame:
    """Shareable features of each item: nothing in them gives back its text."""
    ranked = with_flags(length_rank(options))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", c)))).alias(name) for c, name in (("len", "opt_len"), *((f, f"feat_{f}") for f in T.FEATURES))]
    per_item = ranked.groupBy("item_pos").agg(*maps, F.max(F.when(F.col("is_gold"), F.col("rank"))).alias("answer_len_rank"))
    q = T.norm(F.col("question"))
    return items.join(per_item, "item_pos").select("item_pos", T.hash_id(q).alias("id"), "bank", "answer", F.length(q).alias("stem_len"), "opt_len", (F.col("answer_len_rank") == 1).alias("longest_is_answer"), "answer_len_rank", T.matches(F.col("question"), T.SHARED).alias("shared_stem"), *(f"feat_{f}" for f in T.FEATURES))


def leak_check(items: DataFrame, exported: DataFrame, n_question: int = 40, n_option: int = 25) -> DataFrame:
    """Fragments of items that the exported texts (column ``blob``) hold: must be none.

    Every window of a fragment's length of the exported text is hashed and joined on
    equality, so no fragment is compared with every text.
    """
    question = items.select(F.substring("question", 1, n_question).alias("fragment"))
    option = items.select(F.explode(F.map_values("options")).alias("o")).filter(F.length("o") >= n_option).select(F.substring("o", 1, n_option).alias("fragment"))
    fragments = question.union(option).filter("fragment <> ''").distinct()
    windows = None
    for n in {r[0] for r in fragments.select(F.length("fragment")).distinct().collect()}:
        at = F.explode(F.expr(f"if(length(blob) < {n}, array(), transform(sequence(1, length(blob) - {n} + 1), i -> substring(blob, i, {n})))"))
        part = exported.select(at.alias("fragment"))
        windows = part if windows is None else windows.union(part)
    if windows is None:
        return fragments.agg(F.count("*").alias("leaks"))
    return fragments.join(windows, "fragment", "left_semi").agg(F.count("*").alias("leaks"))
