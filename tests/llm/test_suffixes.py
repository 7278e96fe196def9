"""Operator 1 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemwise.llm import suffixes
from stemwise.llm.queries import QUERIES


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def brute_runs(texts, length):
    """Maximal removed runs [start, end) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out


def corpus(seed):
    """Texts that share passages of all lengths, with edits, runs and short periods."""
    draw = random.Random(seed)
    word = lambda n: bytes(draw.choice(b"abcdefgh ") for _ in range(n))
    pool = [word(draw.randrange(20, 300)) for _ in range(12)] + [b"x" * 150, b"ab" * 90, b"spam " * 40]
    out = []
    for _ in range(40):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            p = draw.choice(pool) if draw.random() < 0.6 else word(draw.randrange(5, 200))
            a = draw.randrange(len(p)) if draw.random() < 0.4 else 0
            p = bytearray(p[a:])
            if p and draw.random() < 0.3:
                p[draw.randrange(len(p))] = 33
            parts.append(bytes(p))
        out.append(b"".join(parts))
    return [*out, out[0], out[1], b"", b"y" * 64, b"z" * 65, b"z" * 65]


@pytest.mark.parametrize("seed, size", [(1, 1 << 20), (2, 500)])
def test_dedup_small(spark, monkeypatch, seed, size):
    monkeypatch.setattr(suffixes, "SLICE", size)
    texts = corpus(seed)
    df = spark.createDataFrame([(i // 2, t.decode(), 5) for i, t in enumerate(texts)], "doc_id long, text string, Kept int").coalesce(2)
    got = suffixes.dedup(df, length=64).collect()
    want = Counter((d // 2, *x) for d, x in enumerate(brute(texts, 64)))
    assert Counter((r.doc_id, bytes(r.kept_), sum(b - a for a, b in r.removed), len(r.removed)) for r in got) == want


def test_slices_do_not_matter():
    """Blocks of a long text give the entries that the whole gives."""
    p = suffixes.Parser(64)
    text = np.frombuffer(b"".join(corpus(3)), np.uint8)
    old, found = suffixes.SLICE, []
    for size in (1 << 20, 700):
        suffixes.SLICE = size
        rows = set()
        for t, _, starts, ends, own, offset in p.slices([text]):
            e = p.entries(t, starts, ends, own)
            entries = zip(*(e[c].tolist() for c in ("lo", "hi", "alone", "need", "e1", "e2")))
            rows |= {(lo + offset, hi + offset, *k) for lo, hi, *k in entries if not k[0]}
        found.append(rows)
    suffixes.SLICE = old
    assert found[0] == found[1]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    want = brute([(t or "").encode() for t in docs.text], 400)
    got = QUERIES["op1_suffix_dedup"](spark, sf_dir).toPandas().sort_values("doc_id")
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in docs.text]
    assert list(zip(got.kept_sha256, got.n_removed, got.n_spans)) == [(hashlib.sha256(k).hexdigest(), n, r) for k, n, r in want]
    assert got.n_removed.sum() > 0


def test_odd_cases(spark):
    long = "".join(random.Random(5).choices("abc def", k=3000))
    rows = [(None, None), (None, ""), (1, long), (1, long), (2, long[500:1200]), (3, "q" * 399), (4, "q" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("x"))
    got = suffixes.dedup(df).collect()
    assert Counter((r.doc_id, r.n_bytes_, bytes(r.kept)) for r in got) == Counter([(None, 0, b""), (None, 0, b""), (1, 3000, b""), (1, 3000, b""), (2, 700, b""), (3, 399, b"q" * 399), (4, 401, b"")])
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_thousands_of_equal_rows(spark):
    """Equal rows share one set of spans; planted passages go, shorter ones stay."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    copy, planted, short = word(900), word(400), word(399)
    rows = [(7, copy)] * 3000 + [(i, word(300) + planted + word(200)) for i in range(8, 20)] + [(i, word(300) + "#" + short + "#" + word(200)) for i in range(20, 30)]
    got = suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "removed").collect()
    by = Counter((r.doc_id, tuple(map(tuple, r.removed))) for r in got)
    assert by[7, ((0, 900),)] == 3000
    want = {i: [list(map(tuple, runs))] for (i, _), runs in zip(rows, brute_runs([t.encode() for _, t in rows], 400))}
    assert all([list(map(tuple, r.removed))] == want[r.doc_id] for r in got)
