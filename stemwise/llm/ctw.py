"""Context-tree weighting of bytes.

A text is its lower-cased words, each followed by a space and the last by a line feed;
every byte is coded as eight binary decisions in the context of the ``depth`` bytes
before it. Each context node mixes its own Krichevsky-Trofimov estimate with the product
of its children's, half and half, so all depths take part; the mixture's posterior,
frozen after training, gives each decision's probability.

The model grows with the corpus, so it is never broadcast. One pass over the texts puts
them into chunks, with the distinct (context, byte) strings and words of each chunk and
their counts. These dictionaries travel as packed arrays, dealt into buckets by a
string's two nearest bytes: bucket by bucket they are added up, the trees are weighted,
and every chunk's strings get their code lengths back. Each chunk is then scored by its
own dictionary. Nothing is dealt by a text's or row's value, so no text, word or row is a
hot key; a context tree is split by its two nearest bytes, and only what lies above, at
most 65,280 nodes whatever the corpus, is summed up on the driver.

Words are counted by XXH64, a 64-bit name. Costs travel as multiples of 2**-28.

Cases: null text is empty and costs the end token alone; texts of any length are worked
on in pieces cut at white space; a null id trains; repeated rows count and are scored as
often as they occur; without training rows all estimates are uniform; an empty table
gives no rows; other columns are left out, and results get a trailing underscore where
the id column has their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh, pack_keys, packed, unpack_keys, unpacked

DEPTH = 6
GRAMS, WORDS, TEXTS = 0, 1, 2
#: Bytes of texts that share a dictionary, and that are worked on at once.
CHUNK, PIECE = 32_000_000, 3_000_000
#: Dictionaries of a bucket that one task adds up.
FAN_IN = 256
#: Strings that are weighted at once, if they are not all of one pair of nearest bytes.
BLOCK = 200_000
END = b"\n"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SCALE = 2.0**28
LN10 = float(np.log(10.0))


def stream(text: bytes | None) -> tuple[list[bytes], bytes]:
    """Words of a text, and the bytes that are coded."""
    words = (text or b"").lower().split()
    return words, b" ".join(words) + END


def pieces(text: bytes | None) -> Iterator[tuple[list[bytes], bytes]]:
    """``stream`` of a text, cut at white space into pieces."""
    text, at, begun = (text or b"").lower(), 0, False
    while at <= len(text):
        gap = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        upto = gap.start() if gap else len(text)
        words = text[at:upto].split()
        coded = (b" " if begun and words else b"") + b" ".join(words)
        at, begun = upto + 1, begun or bool(words)
        yield words, coded + (b"" if gap else END)


def gram_keys(coded: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte after the first ``depth``: the bytes before it, nearest first, then
    itself, as one number."""
    a = np.frombuffer(coded, np.uint8).astype(np.uint64)
    n = len(a) - depth
    key = a[depth:].copy()
    for d in range(1, depth + 1):
        key |= a[depth - d : depth - d + n] << np.uint64(8 * (depth + 1 - d))
    return key


class Coded:
    """Coded pieces one after the other, each behind the ``depth`` bytes before it (line
    feeds at the start of a text)."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.parts, self.size, self.sizes = depth, [], 0, []

    def add(self, coded: bytes, before: bytes | None = None) -> bytes:
        """Takes a piece, and returns the last ``depth`` bytes."""
        before = END * self.depth if before is None else before
        self.parts += [before, coded]
        self.size += len(coded)
        self.sizes.append(len(coded))
        return coded[-self.depth :] if len(coded) >= self.depth else (before + coded)[-self.depth :]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all coded bytes, and where each piece's start."""
        key = gram_keys(b"".join(self.parts), self.depth)
        sizes = np.array(self.sizes)
        begin = np.cumsum(sizes + self.depth) - sizes - self.depth
        own = np.ones(len(key), bool)
        gaps = (begin[1:, None] - self.depth + np.arange(self.depth)).ravel()
        own[gaps] = False
        return key[own], np.cumsum(sizes) - sizes


class Tally:
    """Distinct keys and their counts, added up now and then."""

    def __init__(self):
        self.parts, self.held, self.limit = [], 0, 1_500_000

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        if not len(key):
            return
        self.parts.append((key, n))
        self.held += len(key)
        if self.held > self.limit:
            self.parts = [self.total()]
            self.held = len(self.parts[0][0])
            self.limit = 1_500_000 + self.held

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        key = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([n for _, n in self.parts])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(n, first)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def bucket_of(kind: int, key: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """Strings go by their two nearest bytes, words by their names."""
    part = (key >> np.uint64(8 * (depth - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) if kind == GRAMS else key
    return (part % np.uint64(buckets)).astype(np.int64)


class Chunk:
    """Texts with the dictionaries of their strings and words."""

    def __init__(self, depth: int, buckets: int):
        self.depth, self.buckets, self.size, self.slices = depth, buckets, 0, []
        self.found = {GRAMS: Tally(), WORDS: Tally()}
        self.coded = {True: Coded(depth), False: Coded(depth)}
        self.words: Counter = Counter()

    def add(self, trains: bool, text: bytes | None) -> None:
        before = None
        for words, coded in pieces(text):
            self.words.update(words if trains else dict.fromkeys(words, 0))
            before = self.coded[trains].add(coded, before)
            self.size += len(coded)
            if self.coded[trains].size > PIECE:
                self.flush(trains)

    def flush(self, trains: bool) -> None:
        if self.coded[trains].sizes:
            key, n = np.unique(self.coded[trains].keys()[0], return_counts=True)
            self.found[GRAMS].add(key, n if trains else np.zeros(len(n), np.int64))
            self.coded[trains] = Coded(self.depth)
        self.found[WORDS].add(word_names(list(self.words)), np.fromiter(self.words.values(), np.int64, len(self.words)))
        self.words = Counter()

    def rows(self, number: int) -> Iterator[tuple[int, int, int, bytes, bytes | None]]:
        """(chunk, kind, bucket, a, b): keys and counts, and the texts as an Arrow stream."""
        for trains in (True, False):
            self.flush(trains)
        for kind, tally in self.found.items():
            key, n = tally.total()
            bucket = bucket_of(kind, key, self.buckets, self.depth)
            order = np.argsort(bucket, kind="stable")
            first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            for b, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if i < j:
                    yield number, kind, b, pack_keys(key[order[i:j]]), packed(n[order[i:j]])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.slices[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            for part in self.slices:
                out.write_batch(part)
        yield number, TEXTS, 0, sink.getvalue().to_pybytes(), None


ROW = "chunk long, kind int, bucket int, a binary, b binary"
SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def record(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)


def chunks(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """The rows of all chunks of (id, trains, text), numbered by input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk(depth, buckets)
        for batch in batches:
            start = 0
            for i, (trains, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                chunk.add(trains, text.as_py())
                if chunk.size > CHUNK:
                    chunk.slices.append(batch.slice(start, i + 1 - start))
                    for row in chunk.rows(number):
                        yield record(*row)
                    start, number, chunk = i + 1, number + 1, Chunk(depth, buckets)
            if start < batch.num_rows:
                chunk.slices.append(batch.slice(start))
        if chunk.slices:
            for row in chunk.rows(number):
                yield record(*row)

    return rows.mapInArrow(run, ROW)


def merged(rows: DataFrame) -> DataFrame:
    """The dictionaries (chunk, kind, bucket, keys a, counts b) of each kind and bucket of a
    chunk number added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tally = None, Tally()
        for batch in batches:
            for *place, a, b in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns)), strict=True):
                if place != at:
                    if at:
                        key, n = tally.total()
                        yield record(*at, pack_keys(key), packed(n))
                    at, tally = place, Tally()
                tally.add(unpack_keys(a.as_buffer()), unpacked(b.as_buffer()))
        if at:
            key, n = tally.total()
            yield record(*at, pack_keys(key), packed(n))

    place = ["chunk", "kind", "bucket"]
    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, ROW)


# --- the tree -------------------------------------------------------------------------

_SHIFT = 8


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y, down = x + _SHIFT, np.zeros_like(x)
    for i in range(_SHIFT):
        down += np.log(x + i)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


HALF = float(np.log(0.5))


def subtree(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Mixes all depths from ``depth`` up to ``top``. Returns the probability of each
    key's eight bits from depth ``top`` down, and the nodes of depth ``top``."""
    byte = (key & np.uint64(0xFF)).astype(np.int64)
    prob = np.empty((8, len(key)))
    nodes: dict[str, list[np.ndarray]] = {"node": [], "zeros": [], "ones": [], "log_pw": []}
    for k in range(8):
        place = np.uint64(1 << k) | (key & np.uint64(0xFF)) >> np.uint64(8 - k)
        bit = byte >> (7 - k) & 1
        child = log_pw = None
        for d in range(depth, top - 1, -1):
            node = key >> np.uint64(8 * (depth - d + 1)) << np.uint64(8) | place
            name, at = np.unique(node, return_inverse=True)
            ones = np.bincount(at, n * bit, len(name))
            zeros = np.bincount(at, n * (1 - bit), len(name))
            own = log_kt(zeros, ones)
            kt = np.where(bit, ones[at] + 0.5, zeros[at] + 0.5) / (zeros + ones + 1.0)[at]
            if child is None:
                log_pw, p = own, kt
            else:
                first = np.zeros(len(child[0]), np.int64)
                first[child[1]] = at
                below = np.bincount(first, log_pw, len(name))
                log_pw = np.logaddexp(HALF + own, HALF + below)
                stay = np.exp(HALF + own - log_pw)[at]
                p = stay * kt + (1 - stay) * p
            child = name, at
        prob[k] = p
        for c, v in zip(nodes, (name, zeros, ones, log_pw), strict=True):
            nodes[c].append(v)
    return prob, {c: np.concatenate(v) for c, v in nodes.items()}


class Top:
    """Depths 0 and 1, from the summed nodes of depth 1."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.kt = [np.full((1, 256), 0.5), np.full((256, 256), 0.5)]
        self.stay = [np.full((1, 256), 0.5), np.full((256, 256), 0.5)]
        context, place = node >> 8, node & 255
        own = log_kt(zeros, ones)
        log_pw = np.logaddexp(HALF + own, HALF + below)
        self.kt[1][context, place] = (ones + 0.5) / (zeros + ones + 1.0)
        self.stay[1][context, place] = np.exp(HALF + own - log_pw)
        z, o, b = (np.bincount(place, x, 256) for x in (zeros, ones, log_pw))
        own = log_kt(z, o)
        self.kt[0][0] = (o + 0.5) / (z + o + 1.0)
        self.stay[0][0] = np.exp(HALF + own - np.logaddexp(HALF + own, HALF + b))

    def log10(self, key: np.ndarray, prob: np.ndarray, depth: int) -> np.ndarray:
        """log10 probability of each key's byte, given its bits' from depth 2 down."""
        context = (key >> np.uint64(8 * depth)).astype(np.int64)
        byte = (key & np.uint64(0xFF)).astype(np.int64)
        out = np.zeros(len(key))
        for k in range(8):
            place, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            p = prob[k]
            for d, c in ((1, context), (0, np.zeros_like(context))):
                kt = self.kt[d][c, place]
                stay = self.stay[d][c, place]
                p = stay * np.where(bit, kt, 1 - kt) + (1 - stay) * p
            out += np.log(p)
        return out / LN10


def blocks(key: np.ndarray, depth: int) -> Iterator[slice]:
    """Slices of sorted keys that hold all strings of their pairs of nearest bytes."""
    pair = key >> np.uint64(8 * (depth - 1))
    ends = [*(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(key)]
    start = 0
    for end in ends:
        if end - start >= BLOCK or end == len(key) > start:
            yield slice(start, end)
            start = end


def top_of(model: DataFrame, depth: int) -> Top:
    """Depths 0 and 1 of the strings of ``model``."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be between 2 and 7")

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                key, n = unpack_keys(a.as_buffer()), unpacked(b.as_buffer())
                for part in blocks(key, depth):
                    _, nodes = subtree(key[part], n[part], depth, 2)
                    near = nodes["node"] >> np.uint64(16) << np.uint64(8) | nodes["node"] & np.uint64(0xFF)
                    name, at = np.unique(near, return_inverse=True)
                    sums = [np.bincount(at, nodes[c], len(name)) for c in ("zeros", "ones", "log_pw")]
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *map(pa.array, sums)], names=["node", "zeros", "ones", "below"])

    found = model.filter(F.col("kind") == GRAMS).select("a", "b").mapInArrow(upper, "node long, zeros double, ones double, below double")
    summed = found.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()
    node, *sums = (np.array(x) for x in zip(*summed, strict=True)) if summed else (np.empty(0, np.int64), *(np.empty(0),) * 3)
    return Top(node, *sums)


def answers(model: DataFrame, asked: DataFrame, top: Top, depth: int, copies: int) -> DataFrame:
    """``asked`` with, in place of the counts b, what each key has: a string its code length
    (log10 times SCALE), a word its count in training. Each bucket's model comes first, in
    ``copies`` copies where many chunks ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = value = None
        for batch in batches:
            for chunk, kind, bucket, a, b in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns[:5])), strict=True):
                if chunk >= 0:
                    wanted = unpack_keys(a.as_buffer())
                    yield record(chunk, kind, bucket, a.as_py(), packed(value[np.searchsorted(key, wanted)]))
                    continue
                key, value = unpack_keys(a.as_buffer()), unpacked(b.as_buffer())
                if kind == GRAMS:
                    n, value = value, np.empty(len(key), np.int64)
                    for part in blocks(key, depth):
                        prob, _ = subtree(key[part], n[part], depth, 2)
                        value[part] = np.rint(top.log10(key[part], prob, depth) * SCALE).astype(np.int64)

    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    told = model.select(F.lit(-1).cast("long").alias("chunk"), "kind", "bucket", "a", "b", copy)
    both = told.union(asked.select("chunk", "kind", "bucket", "a", F.lit(None).cast("binary").alias("b"), F.pmod("chunk", F.lit(copies)).cast("int").alias("copy")))
    place = ["kind", "bucket", "copy"]
    return both.repartition(*place).sortWithinPartitions(*place, "chunk").mapInArrow(run, ROW)


# --- scoring --------------------------------------------------------------------------


class Lookup:
    """Values of 48-bit keys, all known: open addressing, a whole array at a time."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(10, (2 * len(key)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        owner = np.full(1 << bits, -1, np.int64)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[owner[at[left]] < 0]
            owner[at[free]] = free
            left = left[owner[at[left]] != left]
            at[left] = at[left] + 1 & self.last
        self.key = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.value = np.zeros(1 << bits)
        self.key[at], self.value[at] = key, value

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * self.MULTIPLIER >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        left = np.flatnonzero(self.key[at] != key)
        while len(left):
            at[left] = at[left] + 1 & self.last
            left = left[self.key[at[left]] != key[left]]
        return self.value[at]


class Scorer:
    """Scores a chunk's texts by what its strings and words have."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], ends: int, depth: int):
        self.look = Lookup(grams[0], grams[1] / SCALE)
        order = np.argsort(words[0])
        self.name, self.log = words[0][order], np.log10(words[1][order] + 0.5)
        self.cost_of: dict[bytes, float] = {}
        self.end, self.end_known, self.floor, self.depth = float(np.log10(ends + 0.5)), int(ends > 0), float(np.log10(0.5)), depth

    def logs(self, words: list[bytes]) -> list[float]:
        new = [w for w in set(words) if w not in self.cost_of]
        if new:
            if len(self.cost_of) > 400_000:
                self.cost_of, new = {}, list(set(words))
            self.cost_of.update(zip(new, self.log[np.searchsorted(self.name, word_names(new))].tolist(), strict=True))
        return list(map(self.cost_of.__getitem__, words))

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Tokens, known tokens, sum of log10(c + 0.5) and score of each text."""
        size = len(texts)
        n, known, base, score = np.ones(size, np.int64), np.full(size, self.end_known), np.full(size, self.end), np.zeros(size)
        coded, whose = Coded(self.depth), []

        def flush() -> None:
            nonlocal coded, whose
            keys, starts = coded.keys()
            np.add.at(score, whose, np.add.reduceat(self.look(keys), starts))
            coded, whose = Coded(self.depth), []

        for i, text in enumerate(texts):
            before = None
            for words, piece in pieces(text.as_py()):
                logs = self.logs(words)
                n[i] += len(words)
                base[i] += sum(logs)
                known[i] += len(words) - logs.count(self.floor)
                if not piece:
                    continue
                before = coded.add(piece, before)
                whose.append(i)
                if coded.size > PIECE:
                    flush()
        if whose:
            flush()
        return {"n_tokens": n, "n_known": known, "base": base, "score": score}


def score(df: DataFrame, trains: Column, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(trains, F.lit(True)).alias("trains"), F.col(text).cast("binary").alias("text"))
    size, ends = (x or 0 for x in rows.agg(F.sum(F.octet_length("text")), F.sum(F.col("trains").cast("long"))).first())
    buckets = min(4096, max(64, size // CHUNK))
    dealt = cut(chunks(rows, depth, buckets))
    held = dealt.filter(F.col("kind") != TEXTS)
    texts = dealt.filter(F.col("kind") == TEXTS)
    number, parts = (x or 0 for x in texts.agg(F.count("*"), F.max(F.shiftright("chunk", 32)) + 1).first())

    model, many = held, number
    while many > 0:
        many = -(-many // FAN_IN) if many > FAN_IN else 1
        model = cut(merged(model.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(many)) if many > 1 else F.lit(0).cast("long"))))
        if many == 1:
            break

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                n = unpacked(b.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], names=["tokens", "words"])

    said = model.filter(F.col("kind") == WORDS).select("b").mapInArrow(census, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = (said[0] or 0) + ends, (said[1] or 0) + (ends > 0)
    told = answers(model, held, top_of(model, depth), depth, -(-max(1, number) // 4096))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {GRAMS: [], WORDS: []}
        for batch in batches:
            for kind, a, b in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if kind != TEXTS:
                    got[kind].append((unpack_keys(a.as_buffer()), unpacked(b.as_buffer())))
                    continue
                sides = [tuple(np.concatenate(x) for x in zip(*got[k], strict=True)) if got[k] else (np.empty(0, np.uint64), np.empty(0, np.int64)) for k in (GRAMS, WORDS)]
                got = {GRAMS: [], WORDS: []}
                scorer = Scorer(*sides, ends, depth)
                del sides
                for part in pa.ipc.open_stream(a.as_buffer()):
                    out = scorer(part.column(2))
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], *map(pa.array, out.values())], names=["id", "trains", *out])

    # The first chunks of all input partitions, then the second ones: one chunk a task.
    tasks = max(1, min(number, 20_000))
    task = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit(2**32 - 1)) * F.lit(parts), F.lit(tasks)).cast("int")
    whole = told.union(texts).repartitionById(tasks, task).sortWithinPartitions("chunk", "kind", "bucket")
    kind = df.schema[id_column].dataType.simpleString()
    out = whole.mapInArrow(scored, f"id {kind}, trains boolean, n_tokens long, n_known long, base double, score double")
    names = fresh(df.select(id_column), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    columns = (~F.col("trains"), F.col("n_tokens"), F.col("n_known"), F.lit(tokens).cast("long"), F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (distinct + 1)))), F.col("score"))
    return out.select(F.col("id").alias(id_column), *(c.alias(n) for c, n in zip(columns, names, strict=True)))
