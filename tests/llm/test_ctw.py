"""Operator 7 against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemwise.llm import common, ctw
from stemwise.llm.queries import QUERIES


def brute_model(texts, depth):
    """Context-tree weighting by recursion over suffixes, in plain floats."""
    counts = {}
    for t in texts:
        t = b"\n" * depth + t
        for i in range(depth, len(t)):
            for k in range(8):
                place, bit = 1 << k | t[i] >> (8 - k), t[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((t[i - d : i], place), [0, 0])[bit] += 1
    children = {}
    for c, place in counts:
        if c:
            children.setdefault((c[1:], place), []).append(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(c, place):
        if (c, place) not in memo:
            own = kt(*counts.get((c, place), (0, 0)))
            if len(c) == depth:
                memo[c, place] = own, 1.0
            else:
                low = sum(weighted(x, place)[0] for x in children.get((c, place), []))
                both = math.log(0.5) + np.logaddexp(own, low)
                memo[c, place] = both, math.exp(math.log(0.5) + own - both)
        return memo[c, place]

    def cost(t):
        t, total = b"\n" * depth + t, 0.0
        for i in range(depth, len(t)):
            for k in range(8):
                place, bit = 1 << k | t[i] >> (8 - k), t[i] >> (7 - k) & 1
                p = 0.0
                for d in range(depth, -1, -1):
                    c = t[i - d : i]
                    n = counts.get((c, place), (0, 0))
                    own = (n[bit] + 0.5) / (n[0] + n[1] + 1)
                    stay = weighted(c, place)[1]
                    p = stay * own + (1 - stay) * p
                total += math.log10(p)
        return total

    return cost


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)


def test_score_small(spark):
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the cat\tran  on", None, "", "a mat the cat sat on", "zebra été", "the cat sat"])] + [(None, "null id"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    trains = F.col("doc_id") != 5
    got = ctw.score(df, trains, depth=3).collect()
    coded = lambda t: ctw.stream((t or "").encode())[1]
    cost = brute_model([coded(t) for d, t in rows if d != 5], 3)
    want = sorted((d is None, d or 0, round(cost(coded(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 6)) for r in got) == want
    assert ctw.score(df.limit(0), trains).count() == 0
    alone = ctw.score(df, F.lit(False)).collect()
    assert all(r.score == pytest.approx(-8 * len(coded(dict(rows)[r.doc_id])) * math.log10(2)) for r in alone if r.doc_id in (0, 1))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = QUERIES["op7_ctw_score"](spark, sf_dir).toPandas().set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs.doc_id}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), None] for r in docs.itertuples()}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    # Held-out texts take less than 3.3 bits a byte.
    size = sum(len(" ".join(ws[:-1]).encode()) + 1 for d, ws in tokens.items() if held[d])
    assert -got[got.held_out].score.sum() / math.log10(2) < 3.3 * size


def test_pieces(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 7)
    for text in (None, b"", b" ", b"one", b"  \n a bb   ccc dddd eeeee ffffffffffffff g \t  ", b"x" * 50, b"a b " * 20):
        parts = list(ctw.pieces(text))
        assert ([w for ws, _ in parts for w in ws], b"".join(c for _, c in parts)) == ctw.stream(text)


def test_buffers_and_packing(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE", 9)
    whole, cut, text = ctw.Coded(3), ctw.Coded(3), b"The quick brown fox jumps over it"
    whole.add(ctw.stream(text)[1])
    before = None
    for _, coded in ctw.pieces(text):
        before = cut.add(coded, before)
    assert len(cut.sizes) > 2 and (whole.keys()[0] == cut.keys()[0]).all()
    key = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    assert (common.unpack_keys(common.pack_keys(key)) == key).all() and (common.unpacked(common.packed(-key.view(np.int64))) == -key.view(np.int64)).all()


def test_chunks_do_not_matter(spark, monkeypatch):
    """Many chunks, partitions, merges and blocks give what one chunk gives."""
    rows = [(i, " ".join(f"w{(i * k) % 17} t{k % 5}" for k in range(i % 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "score long, text string").repartition(5)
    one = ctw.score(df.coalesce(1), F.col("score") % 5 != 1, "score", depth=4)
    assert one.columns[-1] == "score_"
    want = {r.score: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score_, 9)) for r in one.collect()}
    for name, value in {"CHUNK": 100, "FAN_IN": 3, "BLOCK": 10}.items():
        monkeypatch.setattr(ctw, name, value)
    got = ctw.score(df, F.col("score") % 5 != 1, "score", depth=4).collect()
    assert {r.score: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score_, 9)) for r in got} == want and len(want) == 60


def test_held_out_texts_beat_the_base(spark):
    got = QUERIES["op7_ctw_score"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
