"""Aggregations, windows and joins over scored answers (model, condition, bank, gold,
pick, item_pos). ``pick`` is null where no letter could be read and is then wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import stats


def correct() -> Column:
    return F.coalesce(F.col("pick") == F.col("gold"), F.lit(False))


def accuracy(df: DataFrame, *keys: str) -> DataFrame:
    """k right of n, accuracy and unparsed replies for each group."""
    return df.groupBy(*keys).agg(
        F.count_if(correct()).alias("k"),
        F.count("*").alias("n"),
        F.avg(correct().cast("int")).alias("acc"),
        F.count_if(F.col("pick").isNull()).alias("unparsed"),
    )


def first_seen(df: DataFrame, *keys: str) -> DataFrame:
    """Groups with the position of their first row."""
    return df.groupBy(*keys).agg(F.min("item_pos").alias("first_pos"), F.count("*").alias("n"))


def favourite(df: DataFrame, *keys: str, with_null: bool = False) -> DataFrame:
    """The most frequent pick of each group; of equals the one seen first."""
    rows = df if with_null else df.filter("pick is not null")
    counts = rows.groupBy(*keys, "pick").agg(F.count("*").alias("c"), F.min("item_pos").alias("p"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct("pick", "c"), F.struct(F.col("c"), -F.col("p"))).alias("f")).select(*keys, F.col("f.pick").alias("fav"), F.col("f.c").alias("fav_n"))


def always_favourite(df: DataFrame, *keys: str) -> DataFrame:
    """What always answering with the favourite letter would score."""
    golds = df.groupBy(*keys, "gold").agg(F.count("*").alias("g"))
    share = golds.join(favourite(df, *keys), list(keys))
    return share.groupBy(*keys).agg(F.first("fav").alias("fav"), (F.sum(F.when(F.col("gold") == F.col("fav"), F.col("g")).otherwise(0)) / F.sum("g")).alias("fav_rate"))


def score_report(df: DataFrame) -> DataFrame:
    """One line per (model, condition): counts, interval, tests, favourite and rho."""
    base = accuracy(df, "model", "condition")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    full = base.filter("condition = 'full'").select("model", F.col("acc").alias("full_acc"))
    return (
        base.join(always_favourite(df, "model", "condition"), ["model", "condition"], "left")
        .join(full, "model", "left")
        .select("model", "condition", "k", "n", "acc", lo.alias("lo"), hi.alias("hi"), stats.z_score(F.col("k"), F.col("n")).alias("z"), upper_p("k", "n").alias("p"), "unparsed", "fav", "fav_rate", stats.rho(F.col("acc"), F.col("full_acc")).alias("rho"))
    )


def upper_p(k: str, n: str) -> Column:
    """Upper tail at chance, 1 where accuracy does not beat it."""
    return F.when(F.col(k) <= F.lit(stats.CHANCE) * F.col(n), 1.0).otherwise(stats.binom_sf(k, n))


def lower_p(k: str, n: str) -> Column:
    """Lower tail, where accuracy does not beat chance."""
    return F.when(F.col(k) <= F.lit(stats.CHANCE) * F.col(n), stats.binom_cdf(k, n))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, column: str) -> DataFrame:
    """Histogram with ranks: by count, of equals the one seen first, then the lesser value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min("item_pos").alias("p"))
    return counts.select(column, "n", F.row_number().over(Window.orderBy(F.desc("n"), "p", F.col(column).asc_nulls_first())).alias("rank"))


def pivot_accuracy(df: DataFrame, conditions: list[str]) -> DataFrame:
    return df.groupBy("bank").pivot("condition", conditions).agg(F.avg(correct().cast("int")))


def totals(df: DataFrame) -> DataFrame:
    """Accuracy by bank with a row for all (bank null)."""
    return df.rollup("bank").agg(F.count_if(correct()).alias("k"), F.count("*").alias("n"))


def shares(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Share of rows with the flag, in percent, and of the group in all rows."""
    out = df.groupBy(key).agg(F.count_if(flag).alias("k"), F.count("*").alias("n"))
    return out.select(key, "k", "n", (100 * F.col("k") / F.col("n")).alias("share"), (100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("of_total"))


def with_group_size(df: DataFrame, key: str) -> DataFrame:
    """The key, only where more than one row has it, and its rows."""
    size = F.count(key).over(Window.partitionBy(key))
    return df.withColumn("group_size", size).withColumn("case_group", F.when(size > 1, F.col(key)))


def running_accuracy(df: DataFrame, every: int, width: int = 1 << 16) -> DataFrame:
    """Accuracy so far within each (model, condition), at every so many rows.

    Rows are counted within stretches of ``width`` positions; what lies before a stretch
    comes from the small table of their sums, so no task sees a whole run.
    """
    keys = ["model", "condition"]
    rows = df.select(*keys, "item_pos", correct().cast("int").alias("ok"), F.floor(F.col("item_pos") / width).alias("stretch"))
    sums = rows.groupBy(*keys, "stretch").agg(F.count("*").alias("n"), F.sum("ok").alias("k"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"))
    w = Window.partitionBy(*keys, "stretch").orderBy("item_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"n1": F.count("*").over(w), "k1": F.sum("ok").over(w)}).join(starts, [*keys, "stretch"])
    return inside.select(*keys, (F.col("n0") + F.col("n1")).alias("seen"), (F.col("k0") + F.col("k1")).alias("right")).filter(F.col("seen") % every == 0)


def first_per_group(df: DataFrame, key: str, n: int, order: str = "item_pos") -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rn") <= n).drop("rn")


def paired(df: DataFrame, left: str, right: str, by: str, on: list[str]) -> DataFrame:
    """Rows of two runs joined one to one on position and keys."""
    pick = lambda v, p: df.filter(F.col(by) == v).select(*on, F.col("gold").alias(f"{p}_gold"), F.col("bank").alias(f"{p}_bank"), F.col("pick").alias(f"{p}_pick"), correct().alias(f"{p}_right"))
    return pick(left, "a").join(pick(right, "b"), on)


def contingency(pairs: DataFrame, *keys: str) -> DataFrame:
    """2x2 table of two runs' right answers."""
    x, y = F.col("a_right"), F.col("b_right")
    return pairs.groupBy(*keys).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))


def agreement(pairs: DataFrame) -> DataFrame:
    """How often two runs pick alike (two unread replies do), and would by chance."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("a_pick").eqNullSafe(F.col("b_pick"))).alias("same"))
    a = pairs.groupBy(F.col("a_pick").alias("x")).agg(F.count("*").alias("ca"))
    b = pairs.groupBy(F.col("b_pick").alias("y")).agg(F.count("*").alias("cb"))
    chance = a.join(b, F.col("x").eqNullSafe(F.col("y"))).agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    return n.crossJoin(chance).select("n", "same", (F.col("same") / F.col("n")).alias("rate"), (F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))).alias("chance"))


def conditional_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.when(F.col("b_right"), F.col("a_right").cast("int"))).alias("acc_if_right"), F.avg(F.when(~F.col("b_right"), F.col("a_right").cast("int"))).alias("acc_if_wrong"))


def violations(pairs: DataFrame) -> DataFrame:
    """Pairs whose gold letter or bank differ: must be none."""
    return pairs.agg(F.count_if(~F.col("a_gold").eqNullSafe(F.col("b_gold"))).alias("gold"), F.count_if(~F.col("a_bank").eqNullSafe(F.col("b_bank"))).alias("bank"))


def accept_reject(df: DataFrame, *keys: str) -> DataFrame:
    """Right and wrong answers of each group, in one pass; a side may be empty."""
    return df.groupBy(*keys).agg(F.count_if(correct()).alias("accepted"), F.count_if(~correct()).alias("rejected"))


def by_index(left: DataFrame, right: DataFrame, ahead: int) -> DataFrame:
    """(item_pos, other, same): each item beside the one ``ahead`` positions on."""
    theirs = right.select((F.col("item_pos") - ahead).alias("item_pos"), F.col("item_pos").alias("other"), F.col("answer").alias("theirs"))
    return left.select("item_pos", "answer").join(theirs, "item_pos").select("item_pos", "other", (F.col("answer") == F.col("theirs")).alias("same"))


def run_groups(df: DataFrame, left: str, right: str) -> DataFrame:
    """(condition, n0, n1): the conditions that two models share, with their rows."""
    n = df.groupBy("condition").agg(F.count_if(F.col("model") == left).alias("n0"), F.count_if(F.col("model") == right).alias("n1"))
    return n.filter("n0 > 0 and n1 > 0")


def without_positions(df: DataFrame, excluded: tuple[int, ...]) -> DataFrame:
    return df.filter(~F.col("item_pos").isin(*excluded))


def with_file(df: DataFrame, files: dict[str, str]) -> DataFrame:
    """Rows of known banks with the bank's file."""
    entries = F.create_map(*(F.lit(x) for pair in files.items() for x in pair))
    return df.withColumn("file", F.try_element_at(entries, F.col("bank"))).filter("file is not null")


def second_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """The right answers of a first pass with the picks that a second one could read."""
    right = first.filter(correct()).select("item_pos", "model")
    return right.join(second.filter("pick is not null").select("item_pos", "model", F.col("pick").alias("second")), ["item_pos", "model"], "left")


def ordered_shares(df: DataFrame, key: str) -> DataFrame:
    """Groups by share of right answers, highest first, of equals by name, with places."""
    rows = shares(df, key, correct()).select(key, "share")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("share"), key)))


def argmax(scored: DataFrame) -> DataFrame:
    """(item_pos, pick): of (item_pos, letter, letter_idx, score) the letter of the highest
    score; of equals the first."""
    return scored.groupBy("item_pos").agg(F.max_by("letter", F.struct(F.col("score"), -F.col("letter_idx"))).alias("pick"))
