"""Near copies by SimHash, completed to the exact similarity of shingle sets.

Two texts are linked if their sets of shingles (XXH64 of so many words, see
``simhash.shingle_hashes``) have a Jaccard similarity of 0.8 at least. At 0.8 some ten of
64 fingerprint bits differ, so bits alone cannot find all links. Candidates come in rounds:

1. ``simhash.all_links``: fingerprints with at most four differing bits.
2. Prefixes: sets are put in one order of all shingles; two linked ones share a shingle
   among their first n - ceil(0.8 n) + 1 each, so only these are joined. First neighbours
   in each group of texts with a shared shingle, in TURNS orders,
3. then, of texts that have not been linked yet, all pairs of a group. In large groups the
   parities are compared before a pair leaves the task, so that a group of near copies hands
   on few pairs; the comparisons of its unlinked texts still grow with their square.

Every candidate passes two tests: parities of the shingles in as many cells or more, which
differ in no more cells than the sets differ in shingles and so drop no link, and then
the whole texts, each of which travels once to those it is compared with. Nothing linked is missed, and nothing is linked that is not so similar.

Shingles common in a sample of the texts come last in the order. That decides how many
candidates there are, not the result. Prefixes travel as packed arrays; a task holds its
share of them, about a tenth of the texts' size over all tasks.

Cases: null text is empty; texts without words are copies of each other; texts of fewer
words than a shingle's are one shingle; texts of any length are taken whole; ids may
repeat or be null; an empty table gives no rows; columns of any names stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, pack_keys, packed, unpack_keys, unpacked
from .simhash import all_links, components, majority, shingle_hashes

#: One text of so many is sampled; a shingle in so many of them is common; so many at most.
SAMPLE, COMMON, MOST = 8, 8, 100_000
#: Keys of a prefix; keys packed at once; cells of the parities at least; rows that are broadcast.
KEY, HELD, CELLS, FEW = np.uint64(2**48 - 1), 500_000, 1024, 300_000
#: Shingles of the texts that one task compares with one another.
TOGETHER = 4_000_000
#: Rounds of neighbours, and neighbours of a text in each; texts of a group from which on
#: parities are compared before pairs are made; longs of the parities that travel for that.
TURNS, NEIGHBOURS, LARGE, CARRIED = 2, 4, 64, 64
#: Pairs, times longs of parities, that are compared at once.
AT_ONCE = 1 << 20


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    parts = [*shingle_hashes(text or b"", words)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 at least; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def name_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bit c tells whether an odd number of the shingles fall into cell c. There are as many
    cells as shingles, rounded up to a power of two: CELLS to 65,536."""
    many = CELLS
    while many < min(len(shingles), 1 << 16):
        many *= 2
    cells = np.bincount((shingles >> np.uint64(48)) % np.uint64(many), minlength=many)
    return np.packbits(cells & 1, bitorder="little").view(np.int64)


def folded(cells: Column, other: Column) -> Column:
    """``cells`` as of half as many, where ``other`` has fewer."""
    half = F.size(other)
    return F.when(F.size(cells) > half, F.zip_with(F.slice(cells, 1, half), F.slice(cells, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(cells)


def may_be_similar(na: Column, nb: Column, ca: Column, cb: Column) -> Column:
    """False only for sets, by sizes and parities, of a similarity below 0.8."""
    differ = F.zip_with(folded(ca, cb), folded(cb, ca), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    odd = F.aggregate(differ, F.lit(0), lambda s, v: s + v)
    return F.when((5 * na >= 4 * nb) & (5 * nb >= 4 * na), 9 * odd <= na + nb).otherwise(False)


def in_order(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles that are not ``common`` (sorted) first, then these by ``rank``."""
    if not len(common):
        return shingles
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    known = common[at] == shingles
    return np.concatenate([shingles[~known], shingles[known][np.argsort(rank[at[known]])]])


def sampled(rows: DataFrame, words: int, buckets: int) -> DataFrame:
    """(shingle, n) of the shingles in COMMON sampled texts and more, one text of a task's
    equal ones. All sampled shingles are counted, packed: those of a group that is dealt
    over many tasks may be in no task twice."""
    names = ["bucket", "key", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held = set(), [], 0

        def counts() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own = [(i, order[x:y]) for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)) if x < y]
            columns = [pa.array([i for i, _ in own], pa.int64()), pa.array([pack_keys(key[m]) for _, m in own], pa.binary()), pa.array([packed(n[m]) for _, m in own], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                s = shingle_set(t.as_py(), words)
                if not len(s) or (node := name_of(s)) in seen:
                    continue
                seen.add(node)
                parts.append(s)
                held += len(s)
                if held > HELD:
                    yield counts()
                    parts, held = [], 0
        if parts:
            yield counts()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for bucket, *own in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                by_bucket.setdefault(bucket, []).append([unpack_keys(own[0].as_buffer()), unpacked(own[1].as_buffer())])
        for parts in by_bucket.values():
            key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(key)
            key, n = key[order], n[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[first], np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= COMMON].view(np.int64)), pa.array(n[n >= COMMON], pa.int64())], names=["shingle", "n"])

    chosen = rows.filter(F.pmod(F.xxhash64("__text"), F.lit(SAMPLE)) == 0).select("__text")
    return chosen.mapInArrow(count, "bucket long, key binary, n binary").repartition("bucket").mapInArrow(add, "shingle long, n long")


def sketched(rows: DataFrame, words: int, buckets: int, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """For each row (k, h, node, fp, n, cells, number), node naming its set, and a number for
    the first of equal ones in a task; besides, with a null node, prefixes (bucket, key,
    owner, place): packed keys, numbers, and sizes over places."""
    kind = rows.schema["__k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, held, ids, first_number = set(), [], 0, pa.null(), TaskContext.get().partitionId() << 40
        names = ["k", "h", "node", "fp", "n", "cells", "number", "bucket", "key", "owner", "place"]
        longs, blob = pa.int64(), pa.binary()

        def prefixes() -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            key, owner, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts, held = [], 0
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            first = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if i < j:
                    m = order[i:j]
                    own = [pa.array([x], blob) for x in (pack_keys(key[m]), packed(owner[m]), packed(place[m]))]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), *(pa.nulls(1, longs) for _ in range(4)), pa.nulls(1, pa.list_(longs)), pa.nulls(1, longs), pa.array([b], longs), *own], names=names)

        for batch in batches:
            ids, nodes, prints, sizes, cells, numbers = batch.column(0).type, [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                hashes = [*shingle_hashes(t.as_py() or b"", words)]
                s = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
                node, n = name_of(s), len(s)
                nodes.append(node)
                prints.append(int(np.uint64(majority(hashes)).astype(np.int64)))
                sizes.append(n)
                cells.append(parities(s))
                numbers.append(None)
                if not n or node in seen:
                    continue
                numbers[-1] = first_number + len(seen)
                seen.add(node)
                p = n - (4 * n + 4) // 5 + 1
                parts.append((in_order(s, common, rank)[:p] & KEY, np.full(p, numbers[-1], np.int64), n << 32 | np.arange(p)))
                held += p
                if held > HELD:
                    yield from prefixes()
            none = (pa.nulls(len(nodes), x) for x in (longs, blob, blob, blob))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, longs) for x in (nodes, prints, sizes)), pa.array(cells, pa.list_(longs)), pa.array(numbers, longs), *none], names=names)
        if parts:
            yield from prefixes()

    return rows.select("__k", "__hash", "__text").mapInArrow(run, f"k {kind}, h long, node long, fp long, n long, cells array<long>, number long, bucket long, key binary, owner binary, place binary")


def shared(blobs: DataFrame) -> DataFrame:
    """(key, number, n, at) of the prefix keys that another number has too, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for bucket, *own in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                by_bucket.setdefault(bucket, []).append([unpack_keys(own[0].as_buffer()), *(unpacked(x.as_buffer()) for x in own[1:])])
        for parts in by_bucket.values():
            key, node, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((node, key))
            key, node, place = key[order], node[order], place[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, place = key[once], node[once], place[once]
            same = key[1:] == key[:-1]
            many = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            for i in range(0, len(many), 1 << 17):
                m = many[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(key[m].view(np.int64)), pa.array(node[m]), pa.array((place[m] >> 32).astype(np.int32)), pa.array((place[m] & (2**32 - 1)).astype(np.int32))], names=["key", "number", "n", "at"])

    return blobs.select("bucket", "key", "owner", "place").repartition("bucket").mapInArrow(run, "key long, number long, n int, at int")


def mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Another order of the numbers ``x`` for each turn."""
    x = (x.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_cells(cells: np.ndarray, start: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many cells the parities of the rows x and y differ, both folded to the fewer
    cells; 0 if one has none. Row i has cells[start[i]:][:width[i]]."""
    out, least = np.zeros(len(x), np.int64), np.minimum(width[x], width[y])

    def of(rows: np.ndarray, w: int) -> np.ndarray:
        got = cells[start[rows][:, None] + np.arange(w)]
        for k in range(w, int(width[rows].max()), w):
            more = np.flatnonzero(width[rows] > k)
            got[more] ^= cells[start[rows[more]][:, None] + np.arange(k, k + w)]
        return got

    for w in np.unique(least[least > 0]).tolist():
        own = np.flatnonzero(least == w)
        for i in range(0, len(own), AT_ONCE // w):
            m = own[i : i + AT_ONCE // w]
            out[m] = np.bitwise_count(of(x[m], w) ^ of(y[m], w)).sum(axis=1, dtype=np.int64)
    return out


def candidates(groups: DataFrame, turn: int | None) -> DataFrame:
    """(a, b), a < b: pairs of nodes with a common key and different labels that sizes and
    places (and parities, if ``groups`` has cells) let be similar; of each group only
    neighbours in the order of the ``turn``, or all if there is none."""
    held_cells = ["cells"] if "cells" in groups.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, flat, widths = [], [], []
        for b in batches:
            parts.append(tuple(c.to_numpy() for c in b.columns[:5]))
            if held_cells:
                flat.append(b.column(5).flatten().to_numpy().view(np.uint64))
                widths.append(b.column(5).value_lengths().fill_null(0).to_numpy().astype(np.int64))
        if not parts:
            return
        key, node, n, at, label = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((node, label, key) if turn is None else (mixed(node, turn), key))
        once = np.r_[True, (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1])]
        order = order[once]
        key, node, label, n, at = key[order], node[order], label[order], n[order].astype(np.int64), at[order].astype(np.int64)
        if held_cells:
            cells, width = np.concatenate(flat), np.concatenate(widths)
            start, width = (np.cumsum(width) - width)[order], width[order]
            flat.clear()
        new = np.r_[True, key[1:] != key[:-1]]
        ends = lambda starts: np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
        end = ends(np.flatnonzero(new))
        other = ends(np.flatnonzero(new | np.r_[True, label[1:] != label[:-1]]))

        def batch(found):
            low, high = np.unique(np.concatenate(found), axis=0).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(low)), pa.array(np.ascontiguousarray(high))], names=["a", "b"])

        x, step, found, held = np.arange(len(key)), 0, [], 0
        while (turn is None or step < NEIGHBOURS) and len(x := x[other[x] + step < end[x]]):
            y = other[x] + step
            most = np.minimum(n[x] - at[x], n[y] - at[y])
            good = np.flatnonzero((9 * most >= 4 * (n[x] + n[y])) & (label[x] != label[y]))
            u, v = x[good], y[good]
            if held_cells:
                good = 9 * odd_cells(cells, start, width, u, v) <= n[u] + n[v]
                u, v = u[good], v[good]
            u, v = node[u], node[v]
            found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
            held += len(u)
            if held > 1_000_000:
                yield batch(found)
                found, held = [], 0
            step += 1
        if held:
            yield batch(found)

    return groups.select("key", "node", "n", "at", "label", *held_cells).repartition("key").mapInArrow(run, "a long, b long").distinct()


def all_candidates(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``candidates`` without a turn. In groups of LARGE texts and more parities are compared
    first, so that pairs are made of such as pass only; a text's parities go with its rows
    there, if they are of CARRIED longs at most."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("open")).filter("open")
    sized = cut(groups.join(sizes.drop("open"), "key"))
    few, many = sized.filter(F.col("size") < LARGE), sized.filter(F.col("size") >= LARGE)
    wanted = cut(many.select("node").distinct())
    cells = cut(nodes.filter(F.size("cells") <= CARRIED).join(broadcast_if_few(wanted), "node", "left_semi").select("node", "cells"))
    return candidates(few, None).union(candidates(many.join(cells, "node", "left"), None)).distinct()


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """A table that is cut already, to be broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def checked_together(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The similar ones of ``pairs`` (root, a, b), but for those between texts that the links
    found before them join already. texts: (root, node, text). One root, one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, up = None, {}, {}

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            good = []
            for root, a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                if root != at:
                    at, sets, up = root, {}, {}
                if b is None:
                    sets[a], up[a] = shingle_set(text.as_py(), words), a
                elif find(a) != find(b) and similar(sets[a], sets[b]):
                    up[find(a)] = find(b)
                    good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*good, strict=True)], names=["a", "b"])

    held = texts.select("root", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    both = held.union(pairs.select("root", "a", "b", F.lit(None).cast("string")))
    return both.repartition("root").sortWithinPartitions("root", F.col("b").asc_nulls_first(), "a").mapInArrow(run, "a long, b long")


def checked_apart(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The similar ones of ``pairs`` (a, b), with both texts beside each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, s = None, None
            good = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if a != last:
                    last, s = a, shingle_set(x.as_py(), words)
                good.append(similar(s, shingle_set(y.as_py(), words)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that join what the similar ones of ``pairs`` (a, b) join. nodes: (node,
    k, h, n, cells).

    Pairs that pass the parities are put together by what they reach, and each text
    travels once to its group's task; groups of over TOGETHER shingles go pair by pair.
    """
    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select("b")).distinct()
    asked = cut(nodes.join(broadcast_if_few(cut(ends(pairs))), "node"))
    side = lambda x: asked.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_be_similar(*map(F.col, ("na", "nb", "ca", "cb"))))
    close = cut(close.select("a", "b"))
    roots = components(close)
    roots = roots.union(roots.select("root", "root").distinct())
    wanted = asked.join(roots, "node").select("node", "root", "n", "k", "h")
    large = wanted.groupBy("root").agg((F.sum("n") > TOGETHER).alias("large"))
    wanted = cut(wanted.join(large, "root").select("node", "root", "large", "k", "h"))
    texts = keyed.join(broadcast_if_few(wanted), F.col("__k").eqNullSafe(F.col("k")) & (F.col("__hash") == F.col("h"))).select("node", "root", "large", F.col("__text").alias("text"))
    texts = cut(texts.dropDuplicates(["node"]))
    whose = close.join(wanted.select(F.col("node").alias("a"), "root", "large"), "a")
    small = checked_together(whose.filter("not large"), texts.filter("not large"), words)
    if texts.filter("large").isEmpty():
        return small
    return small.union(checked_apart(whose.filter("large").select("a", "b"), texts.filter("large"), words))


def by_bits(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes whose fingerprints SimHash links, one node for each of these."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(prints, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    found = all_links(prints.select("fp"), 4, 4096)
    ends = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}"))
    linked = found.join(ends("a"), "a").join(ends("b"), "b").select(F.col("na").alias("x"), F.col("nb").alias("y"))
    return equal.union(linked).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``df`` without those whose class, all that links reach, has a row of
    lower (id, hash of the row). Of wholly equal rows one stays. A null id comes last."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    rows = df.toDF(*names).withColumn("__hash", F.xxhash64(*names))
    keyed = rows.select(F.col(at[id_column]).alias("__k"), "__hash", F.col(at[text]).alias("__text"))
    place = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("h").alias("h"))

    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = sampled(keyed, words, buckets)
    often = sorted((r.n, r.shingle) for r in often.orderBy(F.desc("n"), "shingle").limit(MOST).collect())
    common = np.array([x for _, x in often], np.int64).view(np.uint64)
    rank = np.argsort(common)
    both = cut(sketched(keyed, words, buckets, common[rank], rank))
    sets = both.filter("node is not null").select("k", "h", "node", "fp", "n", "cells")
    numbers = cut(both.filter("number is not null").select("number", "node"))
    groups = cut(shared(both.filter("node is null")).join(broadcast_if_few(numbers), "number").select("key", "node", "n", "at"))
    nodes = cut(sets.groupBy("node").agg(F.min(place).alias("p"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("cells").alias("cells")).select("node", "p.k", "p.h", "fp", "n", "cells"))

    tried = cut(by_bits(nodes))
    links = cut(verified(tried, nodes, keyed, words))
    for turn in (*range(TURNS), None):
        labelled = groups.join(broadcast_if_few(components(links)), "node", "left").withColumn("label", F.coalesce("root", "node"))
        found = all_candidates(labelled, nodes) if turn is None else candidates(labelled, turn)
        pairs = cut(found.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        links = cut(links.union(verified(pairs, nodes, keyed, words)))

    roots = components(links)
    classes = sets.select("k", "h", "node").join(roots, "node", "left").select("k", "h", F.coalesce("root", "node").alias("class"))
    first = classes.groupBy("class").agg(F.min(place).alias("first"))
    gone = classes.join(first, "class").filter(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("h") == F.col("first.h"))))
    gone = cut(gone.select("k", "h").distinct())
    stay = rows.join(broadcast_if_few(gone), F.col(at[id_column]).eqNullSafe(F.col("k")) & (F.col("__hash") == F.col("h")), "left_anti")
    repeated = sets.groupBy("k", "h").count().filter("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([at[id_column], "__hash"])
    return stay.select(*(F.col(n).alias(c) for c, n in at.items()))
