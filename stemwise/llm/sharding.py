"""Reproducible sharding by a Feistel permutation of global row numbers.

Every row gets a row number, the permutation maps it to a position, and the position
gives shard (position mod shards) and slot (position div shards). Shard sizes differ
by one at most, slots are gapless, and ``locate`` computes both for a row number
without touching the data.

Cases: null and repeated keys are numbered like any other; wholly equal rows are
counted first and told apart only by their number, however many they are; an empty table
gives no rows; null text counts as empty.
"""

from __future__ import annotations

import random
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, fan, fresh, running_total

PRIME = 2**31 - 1
#: Copies of a row that one task numbers.
PART = 1_000_000


class Feistel:
    """A bijection of 0..n-1: rounds over mixed radix (a, b) with a*b >= n, walking
    cycles until the value is below n."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        if not 0 <= n <= 2**52:
            raise ValueError("n must be between 0 and 2**52")
        self.n, self.a = n, max(1, isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        draw = random.Random(f"feistel {seed}")
        self.keys = [tuple(draw.randrange(1, PRIME) for _ in range(3)) for _ in range(2 * (rounds // 2))]

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, (k, c, d) in enumerate(self.keys):
            t = ((right if i % 2 == 0 else left) % PRIME * k + c) % PRIME
            t = (t * t + d) % PRIME
            if i % 2 == 0:
                left = (left + t) % self.a
            else:
                right = (right + t) % self.b
        return left * self.b + right

    def __call__(self, x: int) -> int:
        while (x := self.once(x)) >= self.n:
            pass
        return x

    @staticmethod
    def _mixed(v: str, k: str) -> str:
        t = f"(({v} % {PRIME}L * {k}.k + {k}.c) % {PRIME}L)"
        return f"(({t} * {t} + {k}.d) % {PRIME}L)"

    def _pairs(self) -> str:
        keys = lambda k: f"'k', {k[0]}L, 'c', {k[1]}L, 'd', {k[2]}L"
        pairs = zip(self.keys[::2], self.keys[1::2], strict=True)
        return f"array({', '.join(f'named_struct({keys(p)}, {chr(39)}e{chr(39)}, named_struct({keys(q)}))' for p, q in pairs)})"

    def _start(self, x: str) -> str:
        return f"named_struct('l', {x} div {self.b}L, 'r', {x} % {self.b}L)"

    def once_sql(self, x: str) -> str:
        """``once`` as a SQL expression over the expression ``x``."""
        left = f"((s.l + {self._mixed('s.r', 'p')}) % {self.a}L)"
        step = f"transform(array(named_struct('l', {left}, 'r', s.r)), s -> named_struct('l', s.l, 'r', (s.r + {self._mixed('s.l', 'p.e')}) % {self.b}L))[0]"
        return f"aggregate({self._pairs()}, {self._start(x)}, (s, p) -> {step}, s -> s.l * {self.b}L + s.r)"

    def before_sql(self, x: str) -> str:
        """The value that ``once`` maps to ``x``, as a SQL expression."""
        left = f"pmod(t.l - {self._mixed('t.r', 'p')}, {self.a}L)"
        undo = f"transform(array(named_struct('l', s.l, 'r', pmod(s.r - {self._mixed('s.l', 'p.e')}, {self.b}L))), t -> named_struct('l', {left}, 'r', t.r))[0]"
        return f"aggregate(reverse({self._pairs()}), {self._start(x)}, (s, p) -> {undo}, s -> s.l * {self.b}L + s.r)"

    def walks(self, spark: SparkSession) -> int:
        """The most steps that the walk of any x < n takes.

        Only values n..a*b-1 make a walk longer; there are fewer than a of them. A cycle
        that lies wholly among them is never entered, so they are followed only from
        those that some x < n maps to, and each such walk leaves them again.
        """
        outside = spark.range(self.n, self.a * self.b).select(F.col("id").alias("v"))
        left = cut(outside.filter(F.expr(self.before_sql("v")) < self.n))
        most = 1
        while left.count():
            most += 1
            if most > self.a * self.b - self.n + 1:
                raise RuntimeError("a cycle walk does not end")
            step = left.select(F.expr(self.once_sql("v")).alias("v"))
            left = cut(step.filter(F.col("v") >= self.n))
        return most

    def column(self, x: str, walks: int) -> Column:
        one = self.once_sql(x)
        if walks <= 1:
            return F.expr(one)
        return F.expr(f"aggregate(sequence(2, {walks}), {one}, (y, i) -> if(y < {self.n}L, y, {self.once_sql('y')}))")


def locate(row_number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    slot, shard = divmod(Feistel(n, seed)(row_number), shards)
    return shard, slot


def numbered(rows: DataFrame, number: str, most: int) -> DataFrame:
    """The numbers __end - __n .. __end - 1 of each row. A row with more than PART copies
    is cut into parts first, which are dealt anew, so no task makes all of them. ``most``:
    the largest __n."""
    if most > PART:
        starts = F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1, F.lit(PART).cast("long"))
        rows = rows.withColumn("__from", F.explode(starts))
        rows = rows.withColumns({"__n": F.least(F.col("__end") - F.col("__from"), F.lit(PART)), "__end": F.least("__end", F.col("__from") + PART)})
        rows = rows.repartition("__from").drop("__from")
    return rows.withColumn(number, F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1)))


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Add row_number, shard and slot to every row of ``df``.

    Rows are numbered in the order (hash bucket, row hash, columns). All columns of
    ``df`` travel, so select only those wanted; columns must be orderable. Result
    columns get a trailing underscore where ``df`` has the name already.
    """
    number, shard, slot = fresh(df, "row_number", "shard", "slot")
    names = [f"__c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names).groupBy(*names).agg(F.count("*").alias("__n"))
    rows = cut(rows.withColumn("__h", F.xxhash64(F.lit(seed), *names)))
    n, most = (int(x or 0) for x in rows.agg(F.sum("__n"), F.max("__n")).first())
    buckets = fan(n)
    rows = rows.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    rows = running_total(rows, F.col("__n"), [], "__b", ["__h", *names], "__end")
    rows = numbered(rows, number, most)
    permutation = Feistel(n, seed)
    rows = rows.withColumn("__p", permutation.column(f"`{number}`", permutation.walks(df.sparkSession)))
    return rows.select(
        *(F.col(c).alias(old) for c, old in zip(names, df.columns, strict=True)),
        number,
        (F.col("__p") % shards).cast("int").alias(shard),
        F.floor(F.col("__p") / F.lit(shards)).cast("long").alias(slot),
    )
