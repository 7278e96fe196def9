"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queue up, ``repeats`` passes one
after the other. A document's virtual finish time is its source's cumulative size so
far divided by the source's target; all documents are ordered by finish time and taken
until the total budget is used up.

Cases: a null source is a source of its own and sorts last; null sizes count as 0;
documents of size 0 queue once and are taken when their turn comes; a source of total
size 0 has target 0 and finishes at time 0; ties are broken by source, pass, hash, id
and row hash, and wholly equal rows are interchangeable; an empty table gives no rows.
Rows are shuffled by id, size and source together: a common or missing id is no hot key.
One window runs over all sources, so these should be some millions at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, fan, fresh, running_total

WEIGHTS = (5, 2, 1)


def shuffle_key(seed: int, *columns: Column) -> Column:
    """52 bits of md5, which SQL engines share. Size and source stand beside the id, so
    that rows without an id, or with one id, are not one key."""
    text = (F.coalesce(c.cast("string"), F.lit("")) for c in columns)
    digest = F.md5(F.concat_ws("/", *text, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """(s, source_size) per source -> adds r (rank) and target.

    Targets share ``share`` times all sizes by weight; none exceeds ``repeats`` times
    its source's size, and what is over goes to the others by weight. In the order of
    repeats*size/weight the capped sources come first, so two running sums find the
    level. One row per source, so one window over them is small.
    """
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("s").asc_nulls_last()))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(repeats))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "r")
    everything = Window.partitionBy(F.lit(0))
    return (
        sizes.withColumn("r", rank)
        .withColumn("w", w)
        .withColumn("cap", cap)
        .withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("w_left", F.sum("w").over(everything) - F.sum("w").over(by_ratio) + F.col("w"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("cap_before")) / F.col("w_left"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("common", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "r", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))))
        .select("s", "source_size", "r", "target")
    )


def mix_sources(
    df: DataFrame,
    size: str,
    source: str = "source",
    id_column: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Add source_size, target, copies and taken (copies * size) to every row of ``df``.

    Result columns get a trailing underscore where ``df`` has the name already.
    """
    out = fresh(df, "source_size", "target", "copies", "taken")
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = {c: n for c, n in zip(df.columns, names, strict=True)}
    full = df.toDF(*names).withColumns(
        {
            "__size": F.coalesce(F.col(at[size]).cast("long"), F.lit(0).cast("long")),
            "__h": shuffle_key(seed, F.col(at[id_column]), F.col(at[size]), F.col(at[source])),
            "__tie": F.xxhash64(*names),
        }
    )
    slim = cut(full.select(F.col(at[source]).alias("s"), F.col(at[id_column]).alias("__id"), "__size", "__h", "__tie"))
    sources = cut(targets(slim.groupBy("s").agg(F.sum("__size").alias("source_size")), weights, share, repeats))
    rows_in = slim.count()
    buckets = fan(rows_in)

    def queued(rows: DataFrame, s: str, i: str) -> DataFrame:
        rows = rows.join(sources.withColumnRenamed("s", "__s"), F.col(s).eqNullSafe(F.col("__s"))).drop("__s")
        rows = rows.withColumn("__b", F.shiftright("__h", 52 - (buckets - 1).bit_length()))
        return running_total(rows, F.col("__size"), ["r"], "__b", ["__h", i, "__tie"], "__end")

    def finish(p: int) -> Column:
        return F.when(F.col("target") > 0, (F.col("source_size") * p + F.col("__end")).cast("double") / F.col("target")).otherwise(F.lit(0.0))

    def place(p: int, i: str) -> Column:
        return F.struct(finish(p).alias("v"), F.col("r").alias("r"), F.lit(p).alias("p"), F.col("__h").alias("h"), F.col(i).alias("i"), F.col("__tie").alias("t"))

    def tick(p: int) -> Column:
        return F.floor(F.least(finish(p), F.lit(2.0)) * buckets)

    def passes(p: int) -> Column:
        return F.lit(True) if p == 0 else F.col("__size") > 0

    budget = F.lit(float(share)) * F.sum("source_size")
    budget = float(sources.agg(budget).first()[0] or 0.0)
    lined = cut(queued(slim, "s", "__id"))
    entries = lined.select("__size", F.explode(F.filter(F.array(*(F.when(passes(p), F.struct(tick(p).alias("tick"), place(p, "__id").alias("place"))) for p in range(repeats))), lambda x: x.isNotNull())).alias("e"))
    ticks = entries.groupBy("e.tick").agg(F.sum("__size").alias("sum"))
    until = ticks.withColumn("end", F.sum("sum").over(Window.partitionBy(F.lit(0)).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))
    edge = until.filter(F.col("end") > budget).orderBy("tick").select("tick", F.col("end") - F.col("sum")).first()
    last = None
    if edge:
        inside = Window.partitionBy(F.lit(0)).orderBy("e.place").rowsBetween(Window.unboundedPreceding, 0)
        near = entries.filter(F.col("e.tick") == edge[0]).withColumn("end", F.sum("__size").over(inside) + edge[1])
        last = near.filter(F.col("end") <= budget).agg(F.max("e.place")).first()[0]

    final = queued(full, at[source], at[id_column]) if set(df.columns) != {size, source, id_column} else lined.select(
        *({size: F.col("__size"), source: F.col("s"), id_column: F.col("__id")}[c].alias(at[c]) for c in df.columns), "__size", "__h", "__tie", "r", "source_size", "target", "__end"
    )

    def taken(p: int) -> Column:
        if not edge:
            return passes(p)
        at_edge = F.lit(False)
        if last:
            v, h, t = F.lit(last["v"]), F.lit(last["h"]), F.lit(last["t"])
            cut_at = F.struct(v.alias("v"), F.lit(last["r"]).alias("r"), F.lit(last["p"]).alias("p"), h.alias("h"), F.lit(last["i"]).cast(full.schema[at[id_column]].dataType).alias("i"), t.alias("t"))
            at_edge = (tick(p) == edge[0]) & (place(p, at[id_column]) <= cut_at)
        return passes(p) & ((tick(p) < edge[0]) | at_edge)

    copies = sum((taken(p).cast("int") for p in range(repeats)), F.lit(0))
    return final.withColumn("__copies", copies).select(
        *(F.col(n).alias(c) for c, n in at.items()),
        F.col("source_size").alias(out[0]),
        F.col("target").alias(out[1]),
        F.col("__copies").alias(out[2]),
        (F.col("__copies") * F.col("__size")).cast("long").alias(out[3]),
    )
