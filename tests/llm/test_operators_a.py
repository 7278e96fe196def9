"""Operators 2, 3, 4, 5, 6, 9 and 10 against brute force on whole small tables and odd cases."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from stemwise.llm import chat, media, mixing, packing, rules, sharding, simhash
from stemwise.llm.queries import ORACLES, QUERIES

ODD = [
    (1, "one two three four five", "a"),
    (1, "one two three four five", "a"),
    (2, None, None),
    (None, "", "b"),
    (3, "word " * 30_000, "a"),
    (4, "\u4e2d\u6587 \U00020000 x\n\nx\n", "b"),
    (5, " \t\r\n\x0b\x0c ", None),
    (None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, repeated rows, ties, empty and long texts, and an extra column of a clashing name."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns({"taken": F.lit(1), "Slot": F.lit(2), "kept": F.lit("x")})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def test_mix(spark, sf_dir, docs, odd):
    got = QUERIES["op2_mix_sources"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    size = {r.doc_id: len(words(r.text)) for r in docs.itertuples()}
    assert all(size[r.doc_id] == r.size and r.taken in (0, r.size, 2 * r.size) for r in got.itertuples(index=False))
    by = docs.assign(n=docs.doc_id.map(size)).groupby("source").n.sum()
    names = sorted(by.index)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        left = 1.5 * by.sum() - sum(2 * by[s] for s in capped)
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * by[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 2.0 * by[s] if s in capped else left * weight[s] / sum(weight[x] for x in rest) for s in names}
    for s, part in got.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(target[s])
        assert abs(part.taken.sum() - target[s]) <= 2 * part["size"].max()
    assert got.taken.sum() <= 1.5 * by.sum()
    again = QUERIES["op2_mix_sources"](spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    mixed = mixing.mix_sources(odd.withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), " "))), "size")
    rows = mixed.toPandas()
    assert len(rows) == len(ODD) and {"taken", "taken_"} <= set(rows.columns)
    assert mixing.mix_sources(odd.withColumn("size", F.lit(1)).limit(0), "size").count() == 0


def test_mix_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLES["op2_mix_sources"]).df()
    got = QUERIES["op2_mix_sources"](spark, sf_dir).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_mix_follows_virtual_time(spark):
    """The whole order, by hand: finish times decide, and the budget cuts."""
    rows = [(i, "ab"[i % 2], 3 + i % 5) for i in range(40)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), "size", weights=(3, 1), share=1.0).toPandas()
    total = sum(r[2] for r in rows)
    by = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    target = {"a": min(2.0 * by["a"], total * 0.75)}
    target["b"] = total - target["a"]
    key = lambda d: int(hashlib.md5("/".join([str(d), str(rows[d][2]), rows[d][1], "42"]).encode()).hexdigest()[:13], 16)
    entries = []
    for s in "ab":
        end = 0
        for p in range(2):
            for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: key(r[0])):
                end += n
                entries.append((end / target[s], s, p, key(d), d, n))
    taken, used = Counter(), 0
    for _, _, _, _, d, n in sorted(entries):
        if used + n > total:
            break
        used += n
        taken[d] += n
    assert {r.doc_id: r.taken for r in got.itertuples()} == {d: taken[d] for d, _, _ in rows}


def test_mix_many_rows_without_an_id(spark):
    """Rows without an id fall into many buckets, and targets still hold."""
    rows = [(None, "a" if i % 3 else "b", i % 97 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(df, "size").toPandas()
    assert len(got) == 3000 and (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 2 * 97 * 97
    keys = df.select(mixing.shuffle_key(42, *(F.col(c) for c in ("doc_id", "size", "source"))).alias("h")).distinct().count()
    assert keys == len({(s, n) for _, s, n in rows})


def test_chat(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas()
    said = "</s>[INST] ok [/INST]"
    rows = [*table[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = QUERIES["op3_chat_format"](spark, sf_dir).toPandas().set_index("conv_id")
    by = {}
    for c, t, role, text in sorted(rows):
        by.setdefault(c, []).append((role, text or ""))
    assert set(got.index) == set(by)
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got.n_turns[c] == len(turns) and got.loss_chars[c] == len(loss)
        assert got.turns_sha256[c] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got.loss_sha256[c] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_examples_and_odd_cases(spark):
    rows = [(1, 0, "user", "a </s> \\[INST]"), (1, 1, "assistant", "  b <s> "), (1, 2, None, None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (None, 0, "to[TEXT]ol", "\\0\n"), (2, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    out = chat.prefix_targets(df).toPandas()
    one = out[out.conv_id == 1].sort_values("example")
    assert len(one) == 3 and one["last"].tolist() == [False, False, True]
    for r, want in zip(one.itertuples(), ["  b <s> ", "", ""], strict=True):
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == want
        assert chat.parse(r.text) == [("user", "a </s> \\[INST]"), ("assistant", "  b <s> "), ("", ""), ("assistant", ""), ("assistant", "")][: r.example + 2 + (r.example > 0)]
    for c in chat.CONTROL:
        assert c not in chat.escape(c * 3) and chat.unescape(chat.escape(c * 3 + "\\7")) == c * 3 + "\\7"
    back = chat.read_back(chat.prefix_targets(df)).toPandas()
    assert sorted(back.n_turns) == [1, 1, 5]
    mixed = chat.read_back(chat.prefix_targets(df).orderBy(F.rand(3)).repartition(7)).toPandas()
    assert sorted(map(str, mixed.values.tolist())) == sorted(map(str, back.values.tolist()))
    many = spark.createDataFrame([(None, i, "assistant", f"t{i % 2}") for i in range(50)], "conv_id string, turn long, role string, text string")
    assert chat.read_back(chat.prefix_targets(many)).filter("n_turns = 1 and loss_chars = 2").count() == 50
    long = spark.createDataFrame([("c", i, "user" if i % 2 else "assistant", f"text {i}") for i in range(400)], "conv_id string, turn long, role string, text string")
    r = chat.read_back(chat.prefix_targets(long)).first()
    assert (r.n_turns, r.n_examples, r.loss_chars) == (400, 201, sum(len(f"text {i}") for i in range(0, 400, 2)))
    assert chat.read_back(chat.prefix_targets(df.limit(0))).count() == 0


def brute_print(text, n):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute_components(prints, distance):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_simhash(spark, sf_dir, docs, odd):
    got = QUERIES["op4_simhash"](spark, sf_dir).toPandas().set_index("doc_id")
    prints = {r.doc_id: brute_print(r.text, 4) for r in docs.itertuples()}
    assert {d: f"{f:016x}" for d, f in prints.items()} == got.fingerprint.to_dict()
    root = brute_components(set(prints.values()), 4)
    least = {}
    for d, f in sorted(prints.items()):
        least.setdefault(root[f], d)
    assert {d: least[root[f]] for d, f in prints.items()} == got.component_id.to_dict()
    out = simhash.near_duplicates(odd.withColumn("fingerprint_", F.lit(0))).toPandas()
    assert len(out) == len(ODD)
    empty = out[out.fingerprint == "0" * 16]
    assert len(empty) == 4 and set(empty.component_id) == {2}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(kept.toPandas().doc_id) == [1, 2, 3, 4]


@pytest.mark.parametrize("level", range(4))
def test_signature_plans_lose_no_link(level):
    import random

    draw = random.Random(level)
    m, t = simhash.plan(4, level)
    masks = [v for _, vs in simhash.signature_masks(m, t) for v in vs]
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for k in draw.sample(range(64), draw.randrange(5)):
            b ^= 1 << k
        assert any((a & x) == (b & x) for x in masks)


def test_simhash_hot_signatures(spark):
    """A tight ball of fingerprints goes through every level and comes out whole."""
    import random

    draw = random.Random(1)
    prints = {0}
    while len(prints) < 300:
        x = draw.choice(sorted(prints))
        for k in draw.sample(range(64), 3):
            x ^= 1 << k
        prints.add(x)
    prints |= {draw.getrandbits(64) for _ in range(100)}
    signed = [(x - 2**64 if x >> 63 else x,) for x in sorted(prints)]
    df = spark.createDataFrame(signed, "fp long")
    want = brute_components(prints, 4)
    groups = lambda f: sorted(sorted(x for x in prints if f(x) == r) for r in {f(x) for x in prints})
    for levels in (1, 2):
        found = simhash.all_links(df, 4, 16, levels)
        roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(found).collect()}
        assert groups(lambda x: roots.get(x, x)) == groups(want.get)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    """Chains, stars and cycles, with negative names, in one task and by stars."""
    monkeypatch.setattr(simhash, "FEW", few)
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(-5, -9), (-9, -7), (-7, -5), (300, 300)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 9)} | {-5: -9, -7: -9}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_hot_signatures_are_dealt_into_blocks(spark):
    """No pair of a hot key's members is lost, and no group stays large."""
    signed = spark.range(1000).selectExpr("id % 2 as key", "id as fp")
    out = simhash.in_blocks(signed, 50).toPandas()
    assert out.groupby("key").size().max() < 200
    met = {p for _, g in out.groupby("key") for p in combinations(sorted(g.fp), 2)}
    assert met == {p for k in (0, 1) for p in combinations(range(k, 1000, 2), 2)}


def test_hot_keys_miss_none(spark):
    """Every signature with over ``hot`` members is named, however the rows are dealt."""
    prints = spark.range(400).selectExpr("if(id < 300, id, id * 7919123456789) as fp").repartition(5).checkpoint()
    counted = simhash.signatures(prints, 4, 0).groupBy("key").count().filter("count > 60")
    named = {r.key for r in simhash.hot_keys(prints, 4, 0, 60).collect()}
    assert named and {r.key for r in counted.collect()} <= named


def test_simhash_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, 8)], "doc_id long, text string, Fingerprint int, component_id int")
    out = simhash.near_duplicates(df)
    assert out.columns[:3] == ["doc_id", "fingerprint_", "component_id_"] and out.first()["Fingerprint"] == 7


def brute_counts(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, sf_dir, docs, odd):
    got = QUERIES["op5_quality_rules"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        n = brute_counts(r.text)
        assert tuple(got.loc[r.doc_id, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert got.base_failed[r.doc_id] == failed and not (failed and got.kept[r.doc_id])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    out = rules.judge(odd, labels).toPandas()
    assert len(out) == len(ODD) and "kept_" in out and "Slot" in out
    assert out.set_index("n_words").loc[30_000].base_failed
    assert rules.judge(odd.limit(0), labels.limit(0)).count() == 0


def test_rules_hold_out(spark):
    """Rules learned on part of the labels reject junk and keep clean rows elsewhere."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = rules.judge(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0"))
    far = out.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = far[(far.quality == 1) & (far.n_words >= 50)], far[far.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.1


def test_media(spark, sf_dir, docs, odd):
    got = QUERIES["op6_media"](spark, sf_dir).toPandas().set_index("doc_id")
    for r in docs.itertuples():
        data = (r.text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        x = got.loc[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = media.write_avi(media.encode_frames(payload))
        assert (x.media_bytes, x.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    out = media.from_media(media.to_media(odd, "doc_id", "text"), "doc_id").toPandas()
    assert sorted(map(len, out.payload)) == sorted(len(media.pad((t or "").encode())) for _, t, _ in ODD)
    assert media.from_media(media.to_media(odd.limit(0), "doc_id", "text"), "doc_id").count() == 0


def test_media_round_trip_and_shots():
    import os

    noise = os.urandom(64 * 200)
    samples, frame = media.decode_frames(media.read_avi(media.write_avi(media.encode_frames(noise)))[1])
    assert samples.tobytes() == noise and frame[-1] == 12
    scene = bytes([10]) * 64 * 160 + bytes([200]) * 64 * 160
    fps, frames = media.read_avi(media.write_avi(media.encode_frames(scene)))
    assert fps == 25 and [x[:2] for x in media.shots(*media.decode_frames(frames))] == [(0, 10), (10, 10)]
    lines, counts, values, data = media._scan(frames[0])
    assert (media._bitwise(lines * 64, counts, values, data) == media.BACK[media.np.frombuffer(data, ">u2")]).all()
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")


def test_sharding(spark, sf_dir, docs, odd):
    got = QUERIES["op9_shard"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and sorted(got.row_number) == list(range(len(docs)))
    by = {r.doc_id: (r.text or "").encode() for r in docs.itertuples()}
    for r in got.itertuples():
        assert (r.size if False else got.at[r.Index, "size"], r.text_crc32) == (len(by[r.doc_id]) + 8, zlib.crc32(by[r.doc_id]))
        assert sharding.locate(r.row_number, len(docs), 24, seed=9) == (r.shard, r.slot)
    counts = got.shard.value_counts()
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    out = sharding.shard_rows(odd.drop("text"), 3).toPandas()
    assert sorted(out.row_number) == list(range(len(ODD))) and {"Slot", "slot_"} <= set(out.columns)
    assert sharding.shard_rows(odd.limit(0), 3).count() == 0


@pytest.mark.parametrize("n", [0, 3, 8, 97, 1226])
def test_walks_end(n, spark):
    """For these counts some seeds have cycles wholly outside 0..n-1."""
    for seed in range(10):
        p = sharding.Feistel(n, seed)
        most = 1
        for x in range(n):
            v, steps = p.once(x), 1
            while v >= n:
                v, steps = p.once(v), steps + 1
            most = max(most, steps)
        assert p.walks(spark) == most


def test_copies_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 10)
    df = spark.range(45).selectExpr("if(id < 37, 0, id) as doc_id")
    out = sharding.shard_rows(df, 4, seed=1).toPandas()
    assert sorted(out.row_number) == list(range(45)) and (out.doc_id == 0).sum() == 37
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


@pytest.mark.parametrize("n, seed", [(1, 1), (2, 2), (3, 3), (8, 0), (10, 10), (97, 97), (1000, 1000), (1226, 9), (4097, 4097)])
def test_feistel_is_a_permutation(n, seed, spark):
    p = sharding.Feistel(n, seed)
    want = [p(i) for i in range(n)]
    assert sorted(want) == list(range(n))
    got = spark.range(n).select("id", p.column("id", p.walks(spark)).alias("p")).toPandas().sort_values("id").p.tolist()
    assert got == want


def brute_padding(histogram, buckets):
    lengths = sorted(histogram)
    cost = lambda cuts: sum(histogram[x] * (next(c for c in cuts if c >= x) - x) for x in lengths)
    return min(cost([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)), cost


def test_boundaries_are_optimal():
    import random

    draw = random.Random(3)
    for _ in range(60):
        h = {draw.randrange(60): draw.randrange(1, 9) for _ in range(draw.randrange(1, 11))}
        k = draw.randrange(1, 6)
        best, cost = brute_padding(h, k)
        cuts = packing.boundaries(h, k)
        assert len(cuts) <= k and cost(cuts) == best


def test_pack(spark, sf_dir, docs, odd):
    got = QUERIES["op10_pack"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    n = {r.doc_id: len(words(r.text)) for r in docs.itertuples()}
    assert all(n[r.doc_id] == r.n_tokens <= r.padded_len for r in got.itertuples())
    assert sorted(got.batch_id.unique()) == list(range(got.batch_id.nunique()))
    for _, g in got.groupby("batch_id"):
        assert g.bucket.nunique() == 1 and sorted(g.slot) == list(range(len(g)))
        assert len(g) == 1 or len(g) * g.padded_len.iloc[0] <= 65_536
    cuts = packing.boundaries(Counter(n.values()), 16)
    assert sorted(got.padded_len.unique()) == cuts
    out = packing.pack(odd.withColumn("n", F.length("text")), "n", buckets=3).toPandas()
    assert len(out) == len(ODD) and {"Slot", "slot_"} <= set(out.columns)
    assert packing.pack(odd.withColumn("n", F.lit(1)).limit(0), "n").count() == 0
