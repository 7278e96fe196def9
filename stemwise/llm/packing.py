"""Packing into optimal length buckets.

The histogram of lengths over all rows goes to a dynamic programme that chooses the
bucket boundaries with the least padding; inside each bucket, shuffled rows fill
batches of at most ``token_budget`` padded tokens (a row longer than that is a batch of
its own).

Only the histogram reaches the driver. It has one row per distinct length, and m
distinct lengths need m*(m-1)/2 tokens, so it grows with the square root of the corpus
at most.

Cases: a null length counts as 0; rows of length 0 go to the first bucket; ties and
equal rows are ordered by hash and then interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F

from .common import fan, fresh, running_total


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise total padding.

    best[j] = min over i of best'[i] + len[j] * (C[j] - C[i]) - (S[j] - S[i]) is a
    lower envelope of lines with falling slopes, asked at rising lengths: linear time
    for each bucket.
    """
    lengths = sorted(histogram)
    if not lengths:
        return []
    m = len(lengths)
    count, total = [0] * (m + 1), [0] * (m + 1)
    for j, x in enumerate(lengths):
        count[j + 1], total[j + 1] = count[j] + histogram[x], total[j] + x * histogram[x]
    best: list[int | None] = [0, *[None] * m]
    back = []
    for _ in range(min(buckets, m)):
        now: list[int | None] = [None] * (m + 1)
        choice = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                line = (-count[i], best[i] + total[i], i)
                while len(hull) - head >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = lengths[j - 1]
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, intercept, i = hull[head]
            now[j] = slope * x + intercept + x * count[j] - total[j]
            choice[j] = i
        back.append(choice)
        best = now
    cuts, j = [], m
    for choice in reversed(back):
        cuts.append(lengths[j - 1])
        j = choice[j]
    return cuts[::-1]


def pack(df: DataFrame, length: str, buckets: int = 16, token_budget: int = 65_536, seed: int = 7) -> DataFrame:
    """Add bucket, padded_len, batch_id (gapless from 0) and slot to every row of ``df``.

    Result columns get a trailing underscore where ``df`` has the name already.
    """
    out = fresh(df, "bucket", "padded_len", "batch_id", "slot")
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    rows = df.toDF(*names).withColumn("__len", F.coalesce(F.col(at[length]).cast("long"), F.lit(0).cast("long")))
    histogram = {r[0]: r[1] for r in rows.groupBy("__len").agg(F.count("*")).collect()}
    bounds = boundaries(histogram, buckets) or [0]
    sizes = [0] * len(bounds)
    for x, n in histogram.items():
        sizes[bisect_left(bounds, x)] += n
    per = [max(1, token_budget // max(1, b)) for b in bounds]
    first = [0]
    for n, k in zip(sizes, per, strict=True):
        first.append(first[-1] + -(-n // k))
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("__bucket") + 1)
    bucket = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b < F.col("__len")))
    rows = rows.withColumns({"__bucket": bucket, "__h": F.xxhash64(F.lit(seed), *names)})
    rows = rows.withColumn("__b", F.pmod(F.col("__h"), F.lit(fan(sum(sizes)))))
    rows = running_total(rows, F.lit(1), ["__bucket"], "__b", ["__h"], "__n").withColumn("__n", F.col("__n") - 1)
    return rows.select(
        *(F.col(n).alias(c) for c, n in at.items()),
        F.col("__bucket").alias(out[0]),
        pick(bounds).alias(out[1]),
        (pick(first) + F.floor(F.col("__n") / pick(per))).cast("long").alias(out[2]),
        (F.col("__n") % pick(per)).cast("long").alias(out[3]),
    )
