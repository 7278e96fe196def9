"""The pipeline's near copies against brute force over all pairs of shingle sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemwise.llm import near
from tests.llm.test_operators_a import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = words((text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}


def brute(docs):
    """Least id of every component of pairs with a similarity of 0.8 and more."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values()))


def made(changes, n=300, seed=0):
    """A text of n words and, for each number, a copy with so many scattered words new."""
    rng = np.random.default_rng(seed)
    said = [f"w{x}" for x in rng.integers(0, 10**6, n)]
    out = [" ".join(said)]
    for c in changes:
        copy = list(said)
        for k, at in enumerate(np.linspace(5, n - 6, c).astype(int) if c else []):
            copy[at] = f"new{seed}x{c}x{k}"
        out.append(" ".join(copy))
    return out


def kept(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in enumerate(texts)], SCHEMA)
    return sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect())


def test_recall_between_080_and_089(spark):
    texts = [t for s in range(30) for t in made([6], seed=s)]  # 30 of 296 + 30 shingles differ: 0.816
    assert kept(spark, texts) == brute(enumerate(texts)) == list(range(0, 60, 2))


def test_less_similar_texts_stay(spark):
    texts = [t for s in range(30) for t in made([7], seed=s)]  # 35 of 296 + 35 shingles differ: 0.789
    assert kept(spark, texts) == brute(enumerate(texts)) == list(range(60))


@pytest.mark.parametrize("common", [near.COMMON, 1])
def test_documents_by_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(near, "COMMON", common)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") < 20_000).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("together", [near.TOGETHER, 500])
def test_copies_and_large_groups(spark, monkeypatch, together):
    monkeypatch.setattr(near, "TOGETHER", together)
    texts = made([0, 0, 1, 2, 3, 4, 5, 6]) * 5 + ["", None, "few words", "Few  words"] + made([1] * 3, seed=1)
    assert kept(spark, texts) == brute(enumerate(texts))


def test_parities_drop_no_link(spark):
    rng = np.random.default_rng(2)
    rows, similar = [], []
    for i in range(80):
        both = rng.integers(0, 2**64, rng.integers(1, 800) if i % 2 else rng.integers(800, 9000), np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 2**64, rng.integers(0, max(60, len(both) // 5)), np.uint64)]) for _ in "ab")
        rows.append((i, len(a), len(b), near.parities(a).tolist(), near.parities(b).tolist()))
        similar.append(near.similar(a, b))
    df = spark.createDataFrame(rows, "i long, na long, nb long, ca array<long>, cb array<long>")
    kept_ = {r.i for r in df.filter(near.may_be_similar(*map(F.col, ("na", "nb", "ca", "cb")))).collect()}
    assert {i for i, x in enumerate(similar) if x} <= kept_ and len(kept_) < 80
    assert {len(r[3]) for r in rows} >= {16, 64, 128}


def test_recall_by_similarity(spark):
    """All links of copies with so many changes; by four bits alone most would be lost."""
    texts = [t for changes in range(1, 7) for s in range(20) for t in made([changes], seed=100 * changes + s)]
    assert kept(spark, texts) == list(range(0, 240, 2))
    prints = [near.majority(near.shingle_hashes(t.encode(), 5)) for t in texts[200:]]
    assert sum((a ^ b).bit_count() <= 4 for a, b in zip(prints[::2], prints[1::2])) < 5


def variants(many, n=150, seed=3):
    """Copies of one text, each with scattered words new: up to a quarter of the shingles."""
    rng = np.random.default_rng(seed)
    said = [f"w{x}" for x in rng.integers(0, 10**6, n)]
    out = []
    for i in range(many):
        copy = list(said)
        for at in rng.integers(0, n, rng.integers(1, 9)):
            copy[at] = f"new{i}x{at}"
        out.append(" ".join(copy))
    return out


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    texts, made_pairs, verified = variants(500), [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *rest: made_pairs.append(pairs.count()) or verified(pairs, *rest))
    want = brute(enumerate(texts))
    assert kept(spark, texts) == want and 10 < len(want) < 490
    assert sum(made_pairs) < 20 * len(texts)  # of 124,750


@pytest.mark.parametrize("carried", [near.CARRIED, 0])
def test_all_pairs_without_turns(spark, monkeypatch, carried):
    monkeypatch.setattr(near, "TURNS", 0)
    monkeypatch.setattr(near, "LARGE", 4)
    monkeypatch.setattr(near, "CARRIED", carried)
    texts = variants(80) + variants(20, 1500, 4) + variants(20, 3, 5)
    assert kept(spark, texts) == brute(enumerate(texts))


def test_odd_cells(monkeypatch):
    monkeypatch.setattr(near, "AT_ONCE", 100)
    rng = np.random.default_rng(5)
    both = rng.integers(0, 2**64, 900, np.uint64)
    sets = [np.unique(np.r_[both[: rng.integers(500, 900)], rng.integers(0, 2**64, rng.integers(0, 1800), np.uint64)]) for _ in range(30)]
    rows = [near.parities(s).view(np.uint64) for s in sets] + [np.empty(0, np.uint64)]
    width = np.array([len(r) for r in rows])
    x, y = (i.ravel() for i in np.meshgrid(np.arange(31), np.arange(31)))
    got = near.odd_cells(np.concatenate(rows), np.cumsum(width) - width, width, x, y)
    for i, j, odd in zip(x, y, got, strict=True):
        w = min(width[i], width[j])
        want = np.bitwise_xor.reduce(rows[i].reshape(-1, w)) ^ np.bitwise_xor.reduce(rows[j].reshape(-1, w)) if w else np.empty(0, np.uint64)
        assert odd == np.bitwise_count(want).sum()
        assert i == 30 or j == 30 or odd <= len(np.setxor1d(sets[i], sets[j]))


def test_common_shingles_of_many_tasks(spark):
    """A passage that each task has once is common all the same."""
    texts = [f"one passage that is in each of these texts {i} {i + 1}" for i in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "__text string").repartition(300)
    found = {r.shingle for r in near.sampled(rows, 5, 8).collect()}
    assert found == set(near.shingle_set(b"one passage that is in each of these texts", 5).view(np.int64).tolist())
