"""Joins between item sets: exclusion, overlap, prefixes and sequence alignment."""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .items import parse_last_run


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def overlaps(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(item_pos, shared): the most option texts that each item shares with any one
    evaluation item; train options count each, those of an evaluation item once per text.

    An equality join on the text; a text that many items share fans out, so counts are
    summed from distinct (text, item) pairs and never from option pairs.
    """
    text = T.norm_lower(F.col("text"))
    theirs = evaluation.select(text.alias("t"), F.col("item_pos").alias("other")).distinct()
    mine = train.groupBy("item_pos", text.alias("t")).agg(F.count("*").alias("c"))
    pairs = mine.join(theirs, "t").filter("item_pos <> other").groupBy("item_pos", "other").agg(F.sum("c").alias("shared"))
    return pairs.groupBy("item_pos").agg(F.max("shared").alias("shared"))


def overlapping(train: DataFrame, evaluation: DataFrame, least: int) -> DataFrame:
    """(item_pos, shared) of the items that share ``least`` option texts or more with one
    evaluation item, as ``overlaps`` counts.

    An item's commonest texts that make up least - 1 of its options cannot be all that it
    shares, so only its other, rarer texts are joined; the pairs found are then counted. A
    text that very many items have is thus hardly ever joined on.
    """
    text = T.norm_lower(F.col("text"))
    theirs = evaluation.select(text.alias("t"), F.col("item_pos").alias("other")).distinct()
    mine = train.groupBy("item_pos", text.alias("t")).agg(F.count("*").alias("c"))
    often = theirs.groupBy("t").agg(F.count("*").alias("often"))
    ranked = mine.join(often, "t", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    before = F.sum("c").over(Window.partitionBy("item_pos").orderBy(F.desc("often"), "t"))
    rare = ranked.withColumn("weight", before).filter((F.col("weight") >= least) & (F.col("often") > 0))
    pairs = rare.join(theirs, "t").filter("item_pos <> other").select("item_pos", "other").distinct()
    counted = pairs.join(mine, "item_pos").join(theirs, ["t", "other"]).groupBy("item_pos", "other").agg(F.sum("c").alias("shared"))
    return counted.groupBy("item_pos").agg(F.max("shared").alias("shared")).filter(F.col("shared") >= least)


def training_pool(pool: DataFrame, evaluation: DataFrame, options: DataFrame, eval_options: DataFrame, most: int = 3) -> DataFrame:
    """``pool`` (item_pos, bank, question) with the reason an item is dropped (null: kept):
    evaluation bank, known question, too many shared options, repeated question."""
    key = T.norm_lower(F.col("question"))
    banks = evaluation.select("bank").distinct().withColumn("in_bank", F.lit(True))
    known = evaluation.select(key.alias("key")).distinct().withColumn("in_eval", F.lit(True))
    rows = pool.withColumn("key", key).join(banks, "bank", "left").join(known, "key", "left").join(overlapping(options, eval_options, most), "item_pos", "left")
    rows = rows.withColumn("why", F.when(F.col("in_bank"), "bank").when(F.col("in_eval"), "question").when(F.col("shared") >= most, "overlap"))
    first = F.row_number().over(Window.partitionBy("key", F.col("why").isNull()).orderBy("item_pos"))
    return rows.withColumn("first", first).withColumn("why", F.when(F.col("why").isNull() & (F.col("first") > 1), "repeat").otherwise(F.col("why"))).select("item_pos", "bank", "question", "why")


def prefix_match(sample: DataFrame, archive: DataFrame, head_chars: int = 60, key_chars: int = 80) -> DataFrame:
    """(item_pos, archive_pos): for each sampled item the first archive record of its bank
    and answer whose text starts with the question's head; an empty head matches none.

    Heads shorter than the limit are rare, so records are joined on (bank, answer, head
    at each length that occurs), an equality, rather than on a prefix test.
    """
    head = F.substring(T.norm_lower(F.col("question")), 1, head_chars)
    left = sample.select("item_pos", "bank", "answer", head.alias("head")).filter("head <> ''")
    lengths = sorted(r[0] for r in left.select(F.length("head")).distinct().collect())
    key = F.substring(T.norm_lower(F.col("data")), 1, key_chars)
    right = archive.select(F.col("pos").alias("archive_pos"), "bank", "answer", key.alias("key"))
    first_pos = F.min("archive_pos").over(Window.partitionBy("bank", "key"))
    right = right.withColumn("first_pos", first_pos).withColumn("head", F.explode(F.array_distinct(F.array(*(F.substring("key", 1, n) for n in lengths or [0])))))
    w = Window.partitionBy("item_pos").orderBy("first_pos", "archive_pos")
    return left.join(right, ["bank", "answer", "head"]).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("item_pos", "archive_pos")


def alignment_key(answer: Column, text: Column) -> Column:
    """Answer, and the first eight numbers of the NFKC text."""
    return F.concat_ws("|", F.coalesce(answer, F.lit("?")), F.array_join(T.numbers(T.nfkc(text)), ","))


def matching_pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, n): the blocks a[i:i+n] = b[j:j+n] of two sequences of integers that
    ``difflib.SequenceMatcher`` without junk finds: the longest, of equals the first in a and
    then in b, and the same on either side of it.

    Runs have names by doubling: two runs of one length are equal where the names of their
    first and last 2**k elements are. In a pair of stretches the greatest length is found by
    bisection, and one pass from the left takes all blocks of that length, as difflib would
    one by one. What lies between them has shorter blocks only, so an element is looked at
    again at most as often as there are lengths of blocks: the square root of the whole at
    worst, commonly some dozen.
    """
    after, paired = len(a) + 1, lambda x, y: x.astype(np.int64) << 32 | y
    names = [np.unique(np.concatenate([a, [-1], b, [-2]]), return_inverse=True)[1].astype(np.int32)]

    def runs(start: int, stop: int, n: int) -> np.ndarray:
        """A number for each run of n elements within the stretch."""
        k = n.bit_length() - 1
        while len(names) <= k:
            half = 1 << (len(names) - 1)
            names.append(np.unique(paired(names[-1][:-half], names[-1][half:]), return_inverse=True)[1].astype(np.int32))
        first = names[k][start : stop - n + 1]
        return first if n == 1 << k else paired(first, names[k][start + n - (1 << k) : stop - (1 << k) + 1])

    out, todo = [], [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        most = min(most, ahi - alo, bhi - blo)
        if most < 1:
            continue
        if (ahi - alo) * (bhi - blo) <= 256:
            found = difflib.SequenceMatcher(None, names[0][alo:ahi].tolist(), names[0][after + blo : after + bhi].tolist(), autojunk=False).get_matching_blocks()
            out += [(alo + i, blo + j, n) for i, j, n in found if n]
            continue
        shared = lambda n: n <= most and bool(np.isin(runs(alo, ahi, n), runs(after + blo, after + bhi, n)).any())  # noqa: B023, E731
        n, top = 0, 1
        while shared(top):
            n, top = top, 2 * top
        top = min(top, most + 1)
        while n and top - n > 1:
            n, top = (mid, top) if shared(mid := (n + top) // 2) else (n, mid)
        if not n:
            continue
        mine, theirs = runs(alo, ahi, n), runs(after + blo, after + bhi, n)
        order = np.argsort(theirs, kind="stable")
        first, last = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
        at, places = np.flatnonzero(last > first), order.tolist()
        i0, j0 = alo, blo
        for i, x, y in zip((at + alo).tolist(), first[at].tolist(), last[at].tolist(), strict=True):
            if i < i0:
                continue
            x = bisect_left(places, j0 - blo, x, y)
            if x < y:
                j = blo + places[x]
                out.append((i, j, n))
                todo.append((i0, i, j0, j, n - 1))
                i0, j0 = i + n, j + n
        todo.append((i0, ahi, j0, bhi, n - 1))
    return out


def align_sequences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(bank, left_pos, right_pos) of matching blocks of two keyed sequences (bank, pos,
    key) per bank: longest block first, then either side of it, which is not a longest
    common subsequence. One bank is one task; keys go there as 128-bit hashes."""
    digest = F.coalesce(F.md5("key"), F.lit("0" * 32))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    named = lambda df: df.select("bank", "pos", half(1).alias("x"), half(17).alias("y"))

    def columns(rows: pa.Table) -> list[np.ndarray]:
        order = np.argsort(rows["pos"].to_numpy(), kind="stable")
        return [rows[c].to_numpy()[order] for c in ("pos", "x", "y")]

    def blocks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (a, *mine), (b, *theirs) = columns(left), columns(right)
        x, y = (np.unique(np.concatenate(h), return_inverse=True)[1].astype(np.int64) for h in zip(mine, theirs, strict=True))
        keys = x * (len(x) + 1) + y
        del mine, theirs, x, y
        found = np.array(sorted(matching_pairs(keys[: len(a)], keys[len(a) :])), dtype=np.int64).reshape(-1, 3)
        start, n = np.repeat(np.cumsum(found[:, 2]) - found[:, 2], found[:, 2]), int(found[:, 2].sum())
        i, j = (np.repeat(found[:, c], found[:, 2]) + np.arange(n) - start for c in (0, 1))
        return pa.table({"bank": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), n), "left_pos": pa.array(a[i], pa.int64()), "right_pos": pa.array(b[j], pa.int64())})

    return named(left).groupBy("bank").cogroup(named(right).groupBy("bank")).applyInArrow(blocks, "bank string, left_pos long, right_pos long")


def aligned_items(sample: DataFrame, found: DataFrame, mapping: DataFrame, blocks: DataFrame, excluded: tuple[int, ...] = ()) -> DataFrame:
    """(sample_index, bank, question, options, answer, excluded) of the sampled items
    (item_pos, bank, answer) whose archive record (``found``: item_pos, archive_pos) maps to
    a block (``mapping``: bank, left_pos, right_pos; ``blocks``: bank, pos, text, answer)
    with the same answer that ends in one A-E run."""
    zh = blocks.select("bank", F.col("pos").alias("right_pos"), "text", F.col("answer").alias("block_answer"))
    rows = sample.select("item_pos", "bank", "answer").join(found, "item_pos").join(mapping.withColumnRenamed("left_pos", "archive_pos"), ["bank", "archive_pos"])
    rows = rows.join(zh, ["bank", "right_pos"]).filter(F.col("block_answer") == F.col("answer"))
    parsed = rows.withColumn("clean", T.nfkc(F.col("text"))).withColumn("x", parse_last_run(F.col("clean"))).filter("x is not null")
    return parsed.select(F.col("item_pos").alias("sample_index"), "bank", "x.question", "x.options", "answer", F.col("item_pos").isin(*excluded).alias("excluded"))


def drop_excluded(aligned: DataFrame) -> DataFrame:
    return aligned.filter("not excluded").drop("excluded")


def best_candidate(sizes: DataFrame) -> DataFrame:
    """Of (bank, path, order, n) the path with the largest n; of equals the first."""
    return sizes.groupBy("bank").agg(F.max_by("path", F.struct(F.col("n"), -F.col("order"))).alias("path"), F.max("n").alias("n"))
