"""Parsing records into items; dedupe, samples, permutations, swaps and prompts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# The prompts' wording.
PROMPTS = {
    ("en", "full"): "{question}\n{options}\n\nAnswer with one letter.",
    ("en", "options"): "{options}\n\nOne of these options is the correct answer to a medical exam question you have not been shown. Answer with one letter.",
    ("en", "question"): "{question}\n\nAnswer with the letter (A-E) of the correct option. The options are not shown.",
    ("zh", "full"): "{question}\n{options}\n\n请只回答一个字母。",
    ("zh", "options"): "{options}\n\n以上选项中有一个是某道医学考试题的正确答案，但题目没有给你看。请只回答一个字母。",
}


def parse_strict(raw: DataFrame) -> DataFrame:
    """Records (data, label, ...) with question, options, answer and ``reject`` (null if sound)."""
    marker = F.coalesce(T.first("label", T.ANSWER), T.first("data", T.ANSWER))
    parts = F.split("data", T.OPTION_SPLIT)
    rows = raw.withColumns({"data": F.coalesce("data", F.lit("")), "label": F.coalesce("label", F.lit(""))})
    rows = rows.withColumns({"marker": marker, "letters": T.found(F.col("data"), T.OPTION_SPLIT, 1), "parts": F.transform(parts, T.trim_ws)})
    rows = rows.withColumns({"question": T.trim_ws(F.col("parts")[0]), "texts": F.slice("parts", F.lit(2), F.greatest(F.size("parts"), F.lit(1))), "answer": F.upper("marker")})
    reject = (
        F.when(F.col("marker").isNull(), "no_marker")
        .when(F.length("marker") > 1, "multi_answer")
        .when(T.matches(F.col("data"), T.CJK) | T.matches(F.col("label"), T.CJK), "cjk")
        .when(F.size("letters") < 1, "no_options")
        .when(F.size(F.array_distinct("letters")) < F.size("letters"), "repeated_letter")
        .when(F.array_sort("letters") != F.array(*map(F.lit, T.LETTERS)), "not_five")
        .when(~F.array_contains(F.array(*map(F.lit, T.LETTERS)), F.col("answer")), "key_not_option")
        .when(F.length("question") < 15, "short_question")
        .when(F.exists("texts", lambda x: x == ""), "empty_option")
    )
    return rows.withColumn("reject", reject).withColumn("options", F.when(F.col("reject").isNull(), F.map_from_arrays("letters", "texts"))).withColumn("shared_stem", T.matches(F.col("data"), T.SHARED)).drop("marker", "letters", "parts", "texts")


def parse_last_run(text: Column) -> Column:
    """struct(question, options) of a text that ends in one A-E run, else null: strict
    separators first, then lenient ones."""

    def by(pattern: str) -> Column:
        letters = T.found(text, pattern, 1)
        parts = F.split(text, pattern)
        n = F.size(letters)
        # split drops the captured letters, so what lies before the run joins them back.
        whole = T.found(text, pattern, 0)
        before = F.concat_ws("", F.flatten(F.transform(F.slice(parts, 1, n - 4), lambda p, i: F.array(p, F.when(i < n - 5, F.get(whole, i)).otherwise("")))))
        texts = F.transform(F.slice(parts, n - 3, 5), T.trim_ws)
        sound = (n >= 5) & (F.slice(letters, -5, 5) == F.array(*map(F.lit, T.LETTERS))) & (T.trim_ws(before) != "") & ~F.exists(texts, lambda x: x == "")
        return F.when(F.when(n >= 5, sound).otherwise(False), F.struct(T.trim_ws(before).alias("question"), F.map_from_arrays(F.array(*map(F.lit, T.LETTERS)), texts).alias("options")))

    return F.coalesce(by(T.OPTION_STRICT_ZH), by(T.OPTION_LENIENT_ZH))


def parse_lines(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, options) of fields with an option per line; a line without a letter goes on
    with the option before it. Options are null where a letter comes twice."""
    lines = df.select(key, F.posexplode(F.split(field, r"\R")).alias("line_no", "line")).filter(T.trim_ws(F.col("line")) != "")
    starts = F.regexp_extract("line", T.OPTION_LINE, 1)
    text = F.when(starts != "", F.regexp_extract("line", T.OPTION_LINE, 2)).otherwise(F.col("line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    segments = lines.select(key, "line_no", starts.alias("letter"), T.trim_ws(text).alias("text")).withColumn("segment", F.sum((F.col("letter") != "").cast("int")).over(w)).filter("segment > 0")
    joined = segments.groupBy(key, "segment").agg(F.max("letter").alias("letter"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    options = joined.select(key, "letter", F.array_join(F.col("x.text"), " ").alias("text"))
    found = options.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("letter").alias("d"), F.collect_list(F.struct("letter", "text")).alias("o"))
    made = found.select(key, F.when(F.col("n") == F.col("d"), F.map_from_entries("o")).alias("options"))
    return df.select(key).distinct().join(made, key, "left")


def to_long(items: DataFrame) -> DataFrame:
    """(item_pos, bank, letter, letter_idx, text, is_gold): five rows an item."""
    out = items.select("item_pos", "bank", "answer", F.explode("options").alias("letter", "text"))
    return out.select("item_pos", "bank", "letter", (F.ascii("letter") - 65).alias("letter_idx"), "text", (F.col("letter") == F.col("answer")).alias("is_gold"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null or empty last key are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.filter(F.coalesce(F.col(keys[-1]), F.lit("")) != "").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def one_per_case(df: DataFrame, group: str = "case_group") -> DataFrame:
    """One item of each case group; items without a group all stay."""
    key = F.coalesce(F.concat(F.lit("g"), F.col(group)), F.concat(F.lit("i"), F.col("item_pos").cast("string")))
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("item_pos"))).filter("rn = 1").drop("rn")


def sample_key(seed: int, *columns: str) -> Column:
    """Order of a seeded draw, independent of row order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)), 256)


def stratified_sample(df: DataFrame, strata: str, n: int, seed: int, key: str = "item_pos") -> DataFrame:
    return df.withColumn("h", sample_key(seed, key)).withColumn("rn", F.row_number().over(Window.partitionBy(strata).orderBy("h"))).filter(F.col("rn") <= n).drop("rn", "h")


def train_split(df: DataFrame, seed: int, tenths: int = 1) -> DataFrame:
    """Adds ``part``: validation for the first tenths of a seeded order, else fit."""
    bucket = F.conv(F.substring(sample_key(seed, "item_pos"), 1, 8), 16, 10).cast("long") % 10
    return df.withColumn("part", F.when(bucket < tenths, "validation").otherwise("fit"))


def hash_order(options: DataFrame, seed: int) -> DataFrame:
    """A permutation for each item: letter_idx of the option that goes to each new letter."""
    w = Window.partitionBy("item_pos").orderBy(sample_key(seed, "item_pos", "letter"))
    return options.withColumn("new_idx", F.row_number().over(w) - 1)


def replayed_orders(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Permutations as one Mersenne Twister draws them for positions 0..n-1; sequential, so
    made on the driver."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        order = list(range(5))
        draw.shuffle(order)
        rows.append((i, order))
    return spark.createDataFrame(rows, "item_pos long, order array<int>")


def apply_order(items: DataFrame) -> DataFrame:
    """Items with ``order``: new letter i gets the option at order[i]; gold moves along."""
    letters = F.array(*map(F.lit, T.LETTERS))
    texts = F.transform("order", lambda i: F.element_at(F.col("options"), F.element_at(letters, i + 1)))
    old = F.ascii("answer") - 65
    gold = F.element_at(letters, F.array_position("order", old).cast("int"))
    return items.withColumn("new_options", F.map_from_arrays(letters, texts)).withColumn("new_answer", gold)


def swap_donor(options: DataFrame, seed: int) -> DataFrame:
    """Each item's right option replaced by a random option of another item of its bank.

    A random neighbour in a seeded ring of the bank's items donates, so no pair of items
    is ever formed. The ring is cut into 4,096 arcs by the seed's hash; only the table of
    the arcs' first items has a window per bank. The join is on donor and letter.
    """
    ring = options.select("item_pos", "bank").distinct().withColumn("h", sample_key(seed, "item_pos"))
    ring = ring.withColumn("arc", F.substring("h", 1, 3))
    w = Window.partitionBy("bank").orderBy("arc")
    arcs = ring.groupBy("bank", "arc").agg(F.min_by("item_pos", "h").alias("first"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    arcs = arcs.select("bank", "arc", F.coalesce(F.lead("first").over(w), F.first("first").over(whole)).alias("next"))
    inside = F.lead("item_pos").over(Window.partitionBy("bank", "arc").orderBy("h"))
    ring = ring.withColumn("inside", inside).join(arcs, ["bank", "arc"]).withColumn("donor", F.coalesce("inside", "next"))
    letter = T.letter_at(F.conv(F.substring(sample_key(seed + 1, "item_pos"), 1, 8), 16, 10).cast("long") % 5)
    ring = ring.filter("donor <> item_pos").select("item_pos", "donor", letter.alias("donor_letter"))
    theirs = options.select(F.col("item_pos").alias("donor"), F.col("letter").alias("donor_letter"), F.col("text").alias("donor_text"))
    return options.filter("is_gold").join(ring, "item_pos").join(theirs, ["donor", "donor_letter"]).select("item_pos", "letter", "donor", "donor_letter", "donor_text")


def options_block(options: Column) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{x}. "), F.element_at(options, x)) for x in T.LETTERS))


def prompt(condition: str, lang: str = "en", options: Column | None = None) -> Column:
    """The prompt of an item (question, options); shuffled items pass theirs."""
    template = PROMPTS[lang, "options" if condition == "shuffle" else condition]
    out = F.lit(template)
    block = options_block(options if options is not None and condition != "full" else F.col("options"))
    for name, value in (("{options}", block), ("{question}", F.col("question"))):
        if name in template:
            out = F.replace(out, F.lit(name), value)
    return out


def whole_text(question: Column, options: Column) -> Column:
    return F.concat_ws("\n", question, options_block(options))


def case_key(question: Column, bank: Column) -> Column:
    """Bank and the numbers of the case description, null with fewer than three."""
    shared = T.matches(question, T.SHARED)
    after = F.when(shared, F.regexp_replace(question, r"(?s)^.*?(?:" + T.SHARED + ")", "")).otherwise(question)
    head = F.when(shared, F.regexp_replace(after, r"(?s)" + T.QUESTION_TYPE + ".*$", "")).otherwise(after)
    nums = T.found(F.substring(T.norm(head), 1, 300), T.NUMBER)
    return F.when(F.size(nums) >= 3, F.concat_ws("|", bank, F.array_join(nums, "|")))


def drop_reasons(df: DataFrame, reason: str = "reject") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
