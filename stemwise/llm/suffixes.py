"""Exact substring dedup by prefix-free parsing.

A byte is removed if some string of ``length`` bytes that covers it also starts anywhere
else in the corpus, in the same text or another.

Prefix-free parsing: a rolling hash triggers phrase boundaries at its local minima, so
equal strings are cut alike. Every suffix of the corpus is then a suffix of a phrase
followed by a suffix of the parse, and two suffixes agree to depth ``length`` exactly if
both parts do. As no depth beyond ``length`` matters, names (hashes of the strings)
stand for ranks in the suffix arrays of dictionary and parse, and groups of equal names
for runs of the corpus order; nothing needs a global sort:

1. Parse entries with the same following context (``need`` bytes that every window of
   the phrase holds) are counted. Where the name is unique, no suffix of the phrase
   repeats to depth ``length``. This drops nearly all text that is not repetitive.
2. The easy runs: entries that agree over the phrase and all its windows. The whole
   phrase repeats.
3. The hard runs: for what is left, the bytes around the phrase go into a small table,
   and the same two steps run over blocks of its suffixes and at last over suffixes one
   by one. An agreeing group of (2) whose context others share takes part by one member
   that stands for two.

Suffixes without a boundary near enough (text of short period) are entries of their own;
those that repeat within one slice of text are known at once and travel as runs.
Names have 128 bits wherever they decide. Each task holds one block of text; what
travels is a few longs for each phrase of about length/4 bytes.

Cases: null text is empty; texts shorter than ``length`` are never touched; wholly equal
rows repeat one another, and share one set of spans, however many they are; null and
repeated ids are told apart by the text's hash; an empty table gives no rows. A text's
spans, one for each phrase of about length/4 bytes at most, are held beside the text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh

GRAM = 16
#: Bytes of text that are worked on at once, and of a block of a longer text.
SLICE = 1 << 19
#: Rows in a batch that Python hands on.
ROWS = 200_000
#: Windows of a known run.
RUN = 4096
#: Windows of a block of a hard entry.
STEP = 16
FIELD = 12


def pack_span(lo: np.ndarray, hi: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First and last window and boundary of an entry in one long."""
    return lo << 2 * FIELD | (hi - lo) << FIELD | (b - lo)


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo, mask = span >> 2 * FIELD, (1 << FIELD) - 1
    return lo, lo + (span >> FIELD & mask), lo + (span & mask)


_draw = random.Random("prefix-free parsing")
BASES = [_draw.getrandbits(64) | 1 for _ in range(2)]
BYTES = [np.array([_draw.getrandbits(64) for _ in range(256)], np.uint64) for _ in range(2)]


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < size (a power of two)."""
    out = []
    for base in (BASES[which], pow(BASES[which], -1, 2**64)):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
        out.append(p)
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Names:
    """Names of any substrings of a text: polynomial prefix sums modulo 2**64."""

    def __init__(self, text: np.ndarray):
        size = 1 << max(10, int(len(text)).bit_length())
        self.parts = []
        for which in (0, 1):
            up, down = _powers(which, size)
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(BYTES[which][text] * up[: len(text)], out=sums[1:])
            self.parts.append((sums, down))

    def raw(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        sums, down = self.parts[which]
        return (sums[start + length] - sums[start]) * down[start]

    def __call__(self, which: int, start: np.ndarray, length: np.ndarray | int, kind: int) -> np.ndarray:
        tag = np.uint64(kind * 0xA24BAED4963EE407 % 2**64) + (np.asarray(length).astype(np.uint64) << np.uint64(3))
        return _mix(self.raw(which, start, length) + tag)


class Parser:
    """Phrases of texts, for windows of ``length`` bytes."""

    def __init__(self, length: int):
        if not 64 <= length <= 2048:
            raise ValueError("length must be between 64 and 2048")
        self.length = length
        self.side = (length - GRAM) // 8
        self.context = 2 * self.side + GRAM
        self.reach = (length - self.context) * 7 // 8  # furthest start of a window before its boundary
        self.need = length - self.reach
        self.halo = 2 * length

    def boundaries(self, text: np.ndarray, names: Names, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of contexts whose middle gram has the least hash (the first of equals)."""
        s, n = self.side, len(text) - GRAM + 1
        if n < 2 * s + 1:
            return np.empty(0, np.int64)
        sums, down = names.parts[0]
        h = (_mix((sums[GRAM:] - sums[:n]) * down[:n]) >> np.uint64(32)).astype(np.uint32)
        low, width = h, 1
        while 2 * width <= s:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < s:
            low = np.minimum(low[: len(low) - (s - width)], low[s - width :])
        at = np.arange(s, n - s)  # low[j]: least of h[j .. j+s-1]
        found = at[(h[s : n - s] < low[: n - 2 * s]) & (h[s : n - s] <= low[s + 1 : n - s + 1])] - s
        doc = np.searchsorted(starts, found, "right") - 1
        return found[found + self.context <= ends[doc]]

    def entries(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: tuple[int, int]) -> dict[str, np.ndarray]:
        """Parse entries of the texts at starts..ends that lie in ``own``: doc, lo and hi
        (first and last window, from the slice's start), and three names."""
        names = Names(text)
        b = self.boundaries(text, names, starts, ends)
        doc = np.searchsorted(starts, b, "right") - 1
        last = ends - self.length  # of each text
        before = np.full(len(b), -1, np.int64)
        before[1:] = b[:-1]
        # Windows of each boundary: from the one before (or its text's start), but
        # not further than ``reach``.
        lo = np.maximum(np.maximum(before + 1, b - self.reach), starts[doc])
        hi = np.minimum(b, last[doc])
        fine = (lo <= hi) & (b >= own[0]) & (b < own[1])
        # All other windows stand alone.
        alone = np.zeros(len(text) + 1, np.int32)
        usable = last >= starts
        np.add.at(alone, starts[usable], 1)
        np.add.at(alone, last[usable] + 1, -1)
        some = lo <= hi
        np.add.at(alone, lo[some], -1)
        np.add.at(alone, hi[some] + 1, 1)
        i = np.flatnonzero(np.cumsum(alone[:-1]) > 0)
        i = i[(i >= own[0]) & (i < own[1])]
        b, doc, lo, hi = b[fine], doc[fine], lo[fine], hi[fine]
        whole = hi - lo + self.length
        one = names(0, i, self.length, 4)
        # Of windows that occur twice here, one is counted as two, and all are known.
        _, at, n = np.unique(one, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        counted = np.zeros(len(i), bool)
        counted[np.unique(at, return_index=True)[1]] = True
        known = i[twice]
        first = np.flatnonzero(np.r_[True, (np.diff(known) > 1) | (np.diff(np.searchsorted(starts, known, "right")) > 0)]) if len(known) else np.empty(0, np.int64)
        run_lo, run_hi = known[first], known[np.r_[first[1:], len(known)] - 1] if len(known) else known
        cuts = (run_hi - run_lo) // RUN + 1  # runs of bounded length
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        run_lo, run_hi = np.repeat(run_lo, cuts) + part * RUN, np.repeat(run_hi, cuts)
        run_hi = np.minimum(run_hi, run_lo + RUN - 1)
        i = i[counted]
        weight = twice[counted] + 1
        i, weight = np.r_[i, run_lo], np.r_[weight, np.zeros(len(run_lo), np.int64)]
        own_name = names(0, i, self.length, 4)
        return {
            "doc": np.r_[doc, np.searchsorted(starts, i, "right") - 1],
            "lo": np.r_[lo, i],
            "hi": np.r_[hi, i[: len(i) - len(run_hi)], run_hi],
            "b": np.r_[b, i],
            "alone": np.r_[np.zeros(len(b), np.int64), np.ones(len(i), np.int64)],
            "weight": np.r_[np.ones(len(b), np.int64), weight],
            "need": np.r_[names(0, b, self.need, 1), own_name],
            "e1": np.r_[names(0, lo, whole, 3), own_name],
            "e2": np.r_[names(1, lo, whole, 3), names(1, i, self.length, 4)],
        }

    def slices(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, np.ndarray, tuple[int, int], int]]:
        """(bytes, text numbers, starts, ends, own range, offset of the slice in its text)."""
        held, size = [], 0
        for k, t in enumerate(texts):
            if len(t) < self.length:
                continue
            if len(t) > SLICE:
                for a in range(0, len(t), SLICE):
                    b = min(len(t), a + SLICE)
                    begin, end = max(0, a - self.halo), min(len(t), b + self.halo)
                    yield t[begin:end], [k], np.array([0]), np.array([end - begin]), (a - begin, b - begin), begin
                continue
            held.append(k)
            size += len(t)
            if size >= SLICE:
                yield self._joined(texts, held)
                held, size = [], 0
        if held:
            yield self._joined(texts, held)

    def _joined(self, texts: list[np.ndarray], held: list[int]):
        sizes = np.array([len(texts[k]) for k in held])
        ends = np.cumsum(sizes)
        return np.concatenate([texts[k] for k in held]), held, ends - sizes, ends, (0, int(ends[-1])), 0


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8) for x in column.cast(pa.large_binary())]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


ENTRY = ["need", "e1", "e2", "k1", "k2", "home", "span", "alone", "weight"]
ENTRIES = ", ".join(f"{c} long" for c in ENTRY)


def parse(keyed: DataFrame, length: int) -> DataFrame:
    """The parse entries of the rows (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)
        for batch in batches:
            texts = _texts(batch.column(2))
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for text, held, starts, ends, own, offset in parser.slices(texts):
                e = parser.entries(text, starts, ends, own)
                which = np.array(held)[e["doc"]]
                start = starts[e["doc"]] - offset
                span = pack_span(e["lo"] - start, e["hi"] - start, e["b"] - start)
                for i in range(0, len(which), ROWS):
                    part = slice(i, i + ROWS)
                    yield pa.RecordBatch.from_arrays([_longs(c[part]) for c in (e["need"], e["e1"], e["e2"], k1[which], k2[which], np.zeros_like(span), span, e["alone"], e["weight"])], names=ENTRY)

    return keyed.select("k1", "k2", "text").mapInArrow(run, ENTRIES)


def contexts(todo: DataFrame, length: int) -> DataFrame:
    """(k1, k2, home, stands, bytes): the bytes that the windows of the hard entries in
    ``spans`` (span * 2, plus 1 for one that stands for a group) of (k1, k2, text, spans) hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, spans in zip(*batch.columns, strict=True):
                spans, text = spans.values.to_numpy(), text.as_buffer()
                lo, hi, _ = unpack_span(spans >> 1)
                data = [text[a:b].to_pybytes() for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]
                ids = (pa.array(np.full(len(lo), k.as_py(), np.int64)) for k in (k1, k2))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(spans >> 1), pa.array(spans & 1), pa.array(data, pa.binary())], names=["k1", "k2", "home", "stands", "bytes"])

    return todo.select("k1", "k2", "text", "spans").mapInArrow(run, "k1 long, k2 long, home long, stands long, bytes binary")


def finer(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Entries for blocks of ``step`` windows, counted from the boundary back, of the
    entries in ``spans`` (span * 2 + stands) of (k1, k2, home, bytes, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k1, k2, home, data, spans in zip(*batch.columns, strict=True):
                names = Names(np.frombuffer(data.as_buffer(), np.uint8))
                base = home.as_py() >> 2 * FIELD
                for span in spans.values.to_numpy().tolist():
                    lo, hi, b = (int(x) for x in unpack_span(np.int64(span >> 1)))
                    far = b - np.arange((b - hi) // step, (b - lo) // step + 1) * step  # last window of each whole block
                    first, last = np.maximum(far - step + 1, lo), np.minimum(far, hi)
                    n = len(far)
                    x, whole = first - base, last - first + length
                    same = lambda v, n=n: np.full(n, v, np.int64)
                    parts.append([names(0, far - base, length - step + 1, 6), names(0, x, whole, 7), names(1, x, whole, 7), same(k1.as_py()), same(k2.as_py()), same(home.as_py()), pack_span(first, last, first if step == 1 else same(b)), same(int(step == 1)), same(1 + (span & 1))])
            if parts:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate([c.view(np.int64) for c in x])) for x in zip(*parts, strict=True)], names=ENTRY)

    return rows.select("k1", "k2", "home", "bytes", "spans").mapInArrow(run, ENTRIES)


def resolve(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Easy (k1, k2, span), whose windows all occur elsewhere, and hard entries (k1, k2,
    home, span2: span * 2 plus 1 for one that stands for a group)."""
    shared = entries.groupBy("need").agg(F.sum("weight").alias("n")).filter("n > 1")
    hopeful = cut(entries.join(shared, "need").drop("need"))
    me = F.struct("k1", "k2", "span")
    runs = hopeful.groupBy("e1", "e2").agg(F.sum("weight").alias("m"), F.min(me).alias("one")).filter("m > 1")
    seen = hopeful.join(runs, ["e1", "e2"], "left")
    easy = F.col("m").isNotNull()
    stands = easy & (F.col("n") > F.col("m")) & (me == F.col("one"))
    seen = cut(
        seen.select("k1", "k2", "home", "span", (easy & (F.col("weight") < 2)).alias("easy"), ((F.col("alone") == 0) & (~easy | stands)).alias("hard"), easy.cast("long").alias("stands")).filter("easy or hard")
    )
    return seen.filter("easy").select("k1", "k2", "span"), seen.filter("hard").select("k1", "k2", "home", (F.col("span") * 2 + F.col("stands")).alias("span2"))


def repeated(keyed: DataFrame, length: int) -> DataFrame:
    """(k1, k2, spans): the windows of each text (k1, k2, text) that occur elsewhere."""
    known, hard = resolve(parse(keyed, length))
    todo = hard.groupBy("k1", "k2").agg(F.collect_set("span2").alias("spans"))
    around = cut(contexts(keyed.join(todo, ["k1", "k2"]), length))
    easy, hard = resolve(finer(around.withColumn("spans", F.array(F.col("home") * 2 + F.col("stands"))), length, STEP))
    known = known.union(easy)
    todo = hard.groupBy("k1", "k2", "home").agg(F.collect_set("span2").alias("spans"))
    easy, _ = resolve(finer(around.join(todo, ["k1", "k2", "home"]), length, 1))
    return known.union(easy).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def removed_spans(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [start, end) of the bytes that the windows cover."""
    start, last, _ = unpack_span(np.sort(spans))
    end = np.maximum.accumulate(last + length)
    first = np.r_[True, start[1:] > end[:-1]]
    return np.stack([start[first], end[np.r_[first[1:], True]]], axis=1)


def whole_characters(data: bytes, runs: list[list[int]]) -> list[list[int]]:
    """The runs without the characters that they hold a part of only."""
    out = []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def whole_words(data: bytes, a: int, b: int) -> int:
    """Words that lie wholly in data[a:b]."""
    n = len(data[a:b].split())
    n -= a > 0 and not data[a - 1 : a].isspace() and not data[a : a + 1].isspace()
    return max(0, n - (b < len(data) and not data[b : b + 1].isspace() and not data[b - 1 : b].isspace()))


def dedup(df: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 400, characters: bool = False, least_words: int = 0) -> DataFrame:
    """The rows of ``df`` with kept (binary: the text without what is removed),
    removed (pairs of start and end) and n_bytes in place of the text.

    With ``characters``, characters that a run covers in part stay, so that what is
    kept is text again. Runs that hold fewer than ``least_words`` whole words stay.

    Result columns get a trailing underscore where ``df`` has the name already.
    """
    others = [c for c in df.columns if c != text]
    out = fresh(df.select(*others), "kept", "removed", "n_bytes")
    names = [f"__c{i}" for i in range(len(others))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(others, names, strict=True)), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(id_column)).alias("k1"), F.xxhash64(F.col(text)).alias("k2"))
    found = repeated(rows.select("k1", "k2", "text"), length)
    schema = rows.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            kept, removed, sizes = [], [], []
            for t, spans in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                data = t.as_py() or b""
                sizes.append(len(data))
                if not spans.is_valid:
                    kept.append(data)
                    removed.append([])
                    continue
                runs = removed_spans(spans.values.to_numpy(), length).tolist()
                if characters:
                    runs = whole_characters(data, runs)
                if least_words:
                    runs = [r for r in runs if whole_words(data, *r) >= least_words]
                parts, at = [], 0
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(runs)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.binary()), pa.array(removed, pairs), pa.array(sizes, pa.int64())], names=[*names, "kept", "removed", "n_bytes"])

    joined = rows.join(found, ["k1", "k2"], "left").select(*names, "text", "spans")
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), "kept binary, removed array<array<long>>, n_bytes long"])
    result = joined.mapInArrow(run, fields)
    return result.select(*(F.col(n).alias(c) for c, n in zip(others, names, strict=True)), *(F.col(c).alias(n) for c, n in zip(("kept", "removed", "n_bytes"), out, strict=True)))
