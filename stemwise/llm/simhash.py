"""SimHash near-duplicates by deletion-variant signatures.

64 bits are cut into m segments, and t of them taken together; m is so chosen that among
fingerprints with at most d differing bits some choice of t segments differs in one bit
at most (see ``plan``). Every choice is indexed with each of its bits wildcarded in
turn, so two linked fingerprints share a signature; equal signatures are joined and
verified by counting bits.

Only distinct fingerprints are indexed, so exact copies cost nothing. Tasks hand on a
spanning forest of the links they find, never all pairs of a group. Signatures are counted
within each task before any shuffle; the members of those that may have more than ``hot``
are not joined on them but indexed anew by a plan with longer signatures, and where the last
plan's are still too common, a signature's members are dealt into blocks of about ``hot``
and compared block against block, each pair of blocks in a group of its own.

Cases: null text is empty; texts without words have fingerprint 0 and link like any
other; a text is hashed in blocks of shingles, so only its words are held beside it,
however long; ids may repeat or be null (a null id loses against any other as component
id, and a component without other ids has none); result columns get a trailing underscore
where the table has their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh

BITS = 64
#: Plans tried one after the other; signatures a task compares; hot keys that are broadcast (8 bytes each).
LEVELS, SIGNED, MOST_KEYS = 4, 2_000_000, 1_000_000
#: Edges (16 bytes each) that one task joins up.
FEW = 200_000
#: Shingles hashed at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of the lower-cased text, in blocks."""
    said = text.lower().split()
    if not said:
        return
    if len(said) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(said), 42)], np.uint64)
        return
    joined = b" ".join(said)
    sizes = np.fromiter(map(len, said), np.int64, len(said))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(said) - words + 1]
    ends = ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), BLOCK):
        part = zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes."""
    return majority(shingle_hashes(text, words))


def majority(hashes: Iterable[np.ndarray]) -> int:
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = 4) -> DataFrame:
    """Replace the column ``text`` by the fingerprint (a signed long)."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            out = [np.int64(np.uint64(fingerprint(t.as_py() or b"", words)).astype(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.int64())], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields)
    return df.select(*kept, text).mapInArrow(run, f"{fields}, `{name}` long" if kept else f"`{name}` long")


def plan(distance: int, level: int) -> tuple[int, int]:
    """(segments m, taken together t): the t segments with the fewest differing bits
    differ in one bit at most together.

    If they differed in two, the others would have two each (t = 1), or one each
    (t > 1), at least: more than ``distance`` bits in all. Level 0 has t = 1.
    """
    t = level + 1
    return (distance // 2 + 1 if t == 1 else distance + t - 1), t


def signature_masks(segments: int, together: int) -> list[tuple[int, list[int]]]:
    """For each choice of segments: its mask, and the masks with one bit wildcarded."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    whole = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(whole, together):
        mask = sum(chosen)
        out.append((mask, [mask & ~(1 << k) for k in range(BITS) if mask >> k & 1]))
    return out


def signatures(prints: DataFrame, distance: int, level: int) -> DataFrame:
    """(key, fp): every signature of every fingerprint. The key is a hash, and two
    signatures that collide are told apart when pairs are verified."""
    masks = [m for _, variants in signature_masks(*plan(distance, level)) for m in variants]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(prints), 4096):
                fp = prints[i : i + 4096]
                keys = np.empty((len(masks), len(fp)), np.uint64)
                for j, mask in enumerate(masks):
                    x = (fp & np.uint64(mask)) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    keys[j] = x ^ (x >> np.uint64(31))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fp, len(masks)).view(np.int64))], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node but the roots of the graph with edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def hot_keys(todo: DataFrame, distance: int, level: int, hot: int) -> DataFrame:
    """Signatures that some task of ``todo`` has over hot / tasks times: those with over
    ``hot`` members are among them. Nothing is shuffled; ``todo`` must be cut."""
    tasks = max(1, todo.select(F.spark_partition_id()).distinct().count())
    least = max(1, hot // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches]
        if parts:
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > least])], names=["key"])

    return cut(signatures(todo, distance, level).select("key").mapInArrow(run, "key long").distinct())


def in_blocks(common: DataFrame, hot: int) -> DataFrame:
    """Members (key, fp) of common signatures, each dealt into one of enough blocks, and
    there once for every block: equal keys are now those of a pair of blocks."""
    sizes = cut(common.groupBy("key").agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("blocks")))
    common = common.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("blocks")).cast("int"))
    paired = common.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")


def links(signed: DataFrame, distance: int, tasks: int = 1) -> DataFrame:
    """(a, b): per task, a forest of the links among fingerprints with equal signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order].view(np.uint64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        end = np.repeat(first + size, size)
        alive = np.arange(len(key))
        a, b, held = [], [], 0
        step = 1
        while len(alive := alive[alive + step < end[alive]]):
            near = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= distance]
            a.append(fp[near])
            b.append(fp[near + step])
            held += len(near)
            if held > 1_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
            step += 1
        x, y = forest(np.concatenate(a), np.concatenate(b)) if held else (fp[:0], fp[:0])
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    dealt = signed.repartition(tasks, "key") if tasks > 1 else signed.repartition("key")
    return dealt.mapInArrow(run, "a long, b long")


def all_links(prints: DataFrame, distance: int, hot: int, levels: int = LEVELS) -> DataFrame:
    """A forest of the links among distinct fingerprints (fp)."""
    todo, found = prints.select("fp"), None
    for level in range(levels):
        masks = sum(len(v) for _, v in signature_masks(*plan(distance, level)))
        tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), todo.count() * masks // SIGNED)
        signed = signatures(todo, distance, level)
        keys = hot_keys(todo, distance, level, hot)
        few = keys.count()
        rest = signed.join(F.broadcast(keys) if few < MOST_KEYS else keys, "key", "left_anti") if few else signed
        out = cut(links(rest, distance, tasks))
        found = out if found is None else found.union(out)
        if not few:
            break
        common = signed.join(F.broadcast(keys) if few < MOST_KEYS else keys, "key", "left_semi")
        if level == levels - 1:
            found = found.union(cut(links(in_blocks(common, hot), distance, tasks)))
        else:
            todo = cut(common.select("fp").distinct())
    return found


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the least node reachable.

    Up to FEW edges are joined up in one task. Beyond, large and small stars alternate;
    each round is a grouped minimum and a join, and is cut, so that neither a hot node nor
    a lost executor matters.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.count() <= FEW:
        return cut(edges.repartition(1).mapInArrow(_whole_forest, "node long, root long"))
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        star = both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hung = star.join(low, star["a"] == low["u"])
        edges = cut(hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = 4, words: int = 4, hot: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id, ``df``'s other columns, __class): component_id is the
    least id among the documents reachable over links of at most ``distance`` bits."""
    others = [c for c in df.columns if c not in (id_column, text)]
    named = fresh(df.select(id_column, *others), "fingerprint", "component_id")
    slim = df.select(F.col(id_column).alias("__id"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(others)), F.col(text).alias("__t"))
    rows = cut(with_fingerprint(slim, "__t", "fp", words))
    prints = cut(rows.groupBy("fp").agg(F.min("__id").alias("least")))
    roots = components(all_links(prints, distance, hot))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    classes = rooted.join(lowest, rooted["root"] == lowest["r"]).select(F.col("fp").alias("f"), "component_id", F.col("r").alias("__root"))
    joined = rows.join(classes, rows["fp"] == classes["f"], "left")
    return joined.select(F.col("__id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(named[0]), F.col("component_id").alias(named[1]), *(F.col(f"__o{i}").alias(c) for i, c in enumerate(others)), F.col("__root").alias("__class"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without those whose class has a row of lower (id, hash of the
    row). Of wholly equal rows one stays. A null id comes after all others."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    rows = df.toDF(*names).withColumn("__hash", F.xxhash64(*names))
    place = F.struct(F.col("__k").isNull().alias("none"), F.col("__k").alias("k"), F.col("__hash").alias("h"))
    keyed = rows.select(F.col(at[id_column]).alias("__k"), "__hash", F.col(at[text]).alias("__text"))
    classes = cut(near_duplicates(keyed, "__k", "__text", **options).select("__k", "__hash", "__class"))
    first = classes.groupBy("__class").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    kept = first.select(F.col("first.k").alias("__key"), F.col("first.h").alias("__fh"))
    stay = rows.join(kept, F.col(at[id_column]).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__fh")), "left_semi")
    repeated = classes.groupBy("__k", "__hash").count().filter("count > 1")
    if not repeated.isEmpty():
        stay = stay.dropDuplicates([at[id_column], "__hash"])
    return stay.select(*(F.col(n).alias(c) for c, n in at.items()))
