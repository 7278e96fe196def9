"""Learned decision lists of quality rules.

Sequential covering: each rule is a conjunction of thresholds, grown literal by literal
by information gain on two thirds of the labelled rows and pruned on the rest; rows it
covers leave, and the next rule is learned. The thresholds that rules may use are
quantiles of the labelled rows themselves. Every count comes from an aggregation over all
labelled rows; only those counts (features x thresholds) reach the driver. The list
becomes one ordered conditional expression.

Cases: null text has no words; null ids match no label; labels of a repeated id are
averaged; rows without a label are judged but not learned from; without labels, or
without a rule precise enough, the list is empty and keeps what passes the base test;
a very long text is split into words, lines and windows within one task; result columns
get a trailing underscore where the table has their names; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .common import GAP, cut, fresh

#: What rules may test; each is a ratio, so documents of any length compare.
SIGNALS = {
    "symbol_rate": "n_symbols / n_words",
    "repeat_rate": "n_repeat_words / n_words",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / n_words",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "bang_rate": "n_bangs / n_words",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
}
#: Thresholds of a signal: quantiles of the good labelled rows, and of the bad ones, at these shares.
SHARES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0)
#: Accuracy of a quantile, as a share of the rows, is one in so many.
ACCURACY = 100_000


@dataclass(frozen=True)
class Literal:
    signal: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        x, t = F.expr(SIGNALS[self.signal]), F.lit(self.threshold)
        return x >= t if self.at_least else x < t

    def __str__(self) -> str:
        return f"{self.signal} {'>=' if self.at_least else '<'} {self.threshold:g}"


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts
    that SIGNALS use. ``df`` must not have columns of these names.

    Repeated windows are found by a 64-bit hash of their three words: sorted with
    their positions, equal neighbours repeat, and each adds the words that the one
    before it has not covered.
    """
    typed = "cast(array() as array<bigint>)"
    windows = f"if(n_words < 3, {typed}, transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))"
    pairs = "sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = f"transform(array({pairs}), s -> filter(s, (x, i) -> get(s, i - 1).h <=> x.h or get(s, i + 1).h <=> x.h))[0]"
    covered = (
        f"aggregate(sort_array(transform({twice}, x -> x.i)), named_struct('n', 0L, 'end', 0L), "
        "(a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.end), 'end', cast(p + 3 as bigint)), a -> a.n)"
    )
    blank = " \t\n\x0b\x0c\r"
    without = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    return (
        df.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__w", F.array_remove(F.split("__t", GAP), ""))
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("__h", F.expr(windows))
        .withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, blank, "")) > 0))
        .withColumns(
            {
                "word_chars": F.length(F.translate("__t", blank, "")).cast("long"),
                "n_symbols": without("#*$%&|<>").cast("long"),
                "n_lines": F.size("__l").cast("long"),
                "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
                "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
                "n_bangs": without("!").cast("long"),
                "n_digits": without("0123456789").cast("long"),
                "n_repeat_words": F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0).cast("long")).otherwise(F.expr(covered)),
            }
        )
        .drop("__t", "__w", "__h", "__l")
    )


#: What ``statistics`` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_digits")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def thresholds(signals: DataFrame) -> dict[str, list[float]]:
    """For each signal, the midpoints between neighbouring quantiles of good and bad rows."""
    sides = [F.percentile_approx(F.when(F.col("bad") == y, F.col(n)), list(SHARES), ACCURACY) for n in SIGNALS for y in (0, 1)]
    got = signals.agg(*sides).first()
    out = {}
    for i, n in enumerate(SIGNALS):
        values = sorted({*(got[2 * i] or ()), *(got[2 * i + 1] or ())})
        out[n] = [(a + b) / 2 for a, b in zip(values, values[1:])] or [1.0]
    return out


def learn(labelled: DataFrame, max_rules: int = 8, max_literals: int = 3, precision: float = 0.9, least: int = 3) -> list[list[Literal]]:
    """Rules for rows with ``bad`` = 1. ``labelled``: COUNTS, ``bad`` and ``fold`` (0, 1: grow; 2: prune)."""
    names = list(SIGNALS)
    signals = cut(labelled.filter(~base_failed()).select("bad", (F.col("fold") < 2).alias("grow"), *(F.expr(x).cast("double").alias(n) for n, x in SIGNALS.items())))
    grids = thresholds(signals)

    def bin_of(signal: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grids[signal])), lambda g: g <= F.col(signal)))

    bins = F.array(*map(bin_of, names))
    rows = cut(signals.select("bad", "grow", bins.alias("bins")))

    def test(x: Literal) -> Column:
        b, k = F.col("bins")[names.index(x.signal)], grids[x.signal].index(x.threshold)
        return b > k if x.at_least else b <= k

    def holds(rule: list[Literal]) -> Column:
        out = F.lit(True)
        for x in rule:
            out = out & test(x)
        return out

    def precise(p: int, n: int) -> float:
        return p / (p + n) if p + n else 0.0

    rules: list[list[Literal]] = []
    left = rows
    while len(rules) < max_rules:
        rule: list[Literal] = []
        while len(rule) < max_literals:
            counts = left.filter(F.col("grow") & holds(rule)).select("bad", F.posexplode("bins").alias("signal", "bin")).groupBy("signal", "bin", "bad").count().collect()
            table = {}
            for r in counts:
                table.setdefault(r["signal"], {}).setdefault(r["bin"], [0, 0])[1 - r["bad"]] += r["count"]
            total = [sum(v[i] for v in table.get(0, {}).values()) for i in (0, 1)]
            if not total[0] or not total[1]:
                break
            best = None
            for s, by_bin in sorted(table.items()):
                for k, threshold in enumerate(grids[names[s]]):
                    for at_least in (True, False):
                        p, n = (sum(v[i] for b, v in by_bin.items() if (b > k) == at_least) for i in (0, 1))
                        if p < least or (p, n) == tuple(total):
                            continue
                        gain = p * (log2(p / (p + n)) - log2(total[0] / sum(total)))
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, Literal(names[s], at_least, threshold)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
        if not rule:
            break
        # One job tells what each shortened form of the rule covers in either fold.
        forms = [rule[: i + 1] for i in range(len(rule))]
        sums = [F.sum((holds(f) & (F.col("grow") == g) & (F.col("bad") == y)).cast("int")) for f in forms for g in (False, True) for y in (1, 0)]
        got = [x or 0 for x in left.agg(*sums).first()]
        scored = [(got[4 * i : 4 * i + 2], got[4 * i + 2 : 4 * i + 4]) for i in range(len(forms))]
        keep = max(range(len(forms)), key=lambda i: ((scored[i][0][0] - scored[i][0][1]) / max(1, sum(scored[i][0])), -i))
        (p, n), (gp, gn) = scored[keep]
        if precise(p + gp, n + gn) < precision or (p + n and precise(p, n) < precision):
            break
        rules.append(forms[keep])
        left = left.filter(~holds(forms[keep]))
    return rules


def verdict(rules: list[list[Literal]]) -> Column:
    """kept: false where the base test fails or the first rule that holds rejects."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = F.lit(True)
        for x in rule:
            test = test & x.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def rules_for(counted: DataFrame, labels: DataFrame, id_column: str = "doc_id", **options) -> list[list[Literal]]:
    """Learn from the rows of ``counted`` (id and COUNTS) that ``labels`` (doc_id, quality) covers."""
    bad = labels.groupBy(F.col("doc_id").alias("__id")).agg((F.avg("quality") < 0.5).cast("int").alias("bad")).filter("bad is not null")
    joined = counted.join(bad, F.col(id_column) == F.col("__id"))
    return learn(joined.withColumn("fold", F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(3))), **options)


def judge(df: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """Add COUNTS, base_failed and kept to the rows of ``df``.

    Result columns get a trailing underscore where ``df`` has the name already.
    """
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    out = dict(zip((*COUNTS, "base_failed", "kept"), fresh(df, *COUNTS, "base_failed", "kept"), strict=True))
    counted = statistics(df.toDF(*names), at[text])
    if set(df.columns) == {text, id_column}:
        counted = counted.drop(at[text])
    # Counted once: neither learning nor a filter on kept computes the counts again.
    rows = cut(counted)
    rules = rules_for(rows.select(at[id_column], *COUNTS), labels, at[id_column], **options)
    rows = rows.withColumns({"base_failed": base_failed(), "kept": verdict(rules)})
    return rows.select(*(F.col(n).alias(c) for c, n in at.items() if n in rows.columns), *(F.col(c).alias(n) for c, n in out.items()))
