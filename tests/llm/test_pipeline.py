"""The pipeline's stages against brute force, one after the other; operator 8 by held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemwise.llm import cotraining, suffixes
from stemwise.llm.queries import QUERIES
from tests.llm.test_near import brute as all_pairs
from tests.llm.test_operators_a import brute_counts, words
from tests.llm.test_suffixes import brute_runs

ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "w " * 60, "en", None, 120), *[(3, "some text that is kept " + " ".join(f"x{i}" for i in range(60)), "en", "a", None)] * 2]


@pytest.fixture(scope="module")
def ran(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, as pandas."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        before = docs.toPandas()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.toPandas()))
    return out


def test_quality_stage(ran, spark, sf_dir):
    before, after = ran[0]
    kept = set(after.doc_id)
    for r in before.itertuples():
        n = brute_counts(r.text)
        assert not (n[0] < 50 or 100 * n[4] > 50 * n[0]) or r.doc_id not in kept
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().merge(before, on="doc_id")
    good = labels[(labels.quality == 1) & labels.text.map(lambda t: len(words(t)) >= 50)]
    assert good.doc_id.isin(kept).mean() > 0.97
    assert list(before.columns) == list(after.columns)


def test_simhash_stage(ran):
    """One document of each group stays: groups by five-word similarity over all pairs."""
    before, after = ran[1]
    assert sorted(after.doc_id) == all_pairs(list(zip(before.doc_id, before.text)))


def test_suffix_stage(ran):
    before, after = ran[2]
    length = corpus_pipeline.REPEAT_BYTES
    data = [t.encode() for t in before.text]
    want = {}
    for d, t, runs in zip(before.doc_id, data, brute_runs(data, length)):
        runs = suffixes.whole_characters(t, runs)
        runs = [r for r in runs if suffixes.whole_words(t, *r) > 50]
        at = [0, *(x for r in runs for x in r), len(t)]
        kept = b"".join(t[a:b] for a, b in zip(at[::2], at[1::2]))
        if words(kept.decode()) or not runs:
            want[d] = kept.decode()
    assert dict(zip(after.doc_id, after.text)) == want
    assert (after.n_chars == after.text.map(len)).all()


def test_whole_words():
    data = b"one two  three"
    assert [suffixes.whole_words(data, a, b) for a, b in [(0, 14), (1, 14), (0, 13), (3, 9), (4, 7), (5, 6), (7, 9)]] == [3, 2, 2, 1, 1, 0, 0]


def test_mix_stage(ran):
    before, after = ran[3]
    size = {r.doc_id: len(words(r.text)) for r in before.itertuples()}
    copies = Counter(after.doc_id)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    total = sum(size.values())
    assert 1.5 * total - 2 * max(size.values()) <= sum(size[d] * c for d, c in copies.items()) <= 1.5 * total


def test_pack_stage(ran):
    before, after = ran[4]
    assert Counter(before.doc_id) == Counter(after.doc_id)
    assert (after.n_tokens <= after.padded_len).all()
    assert sorted(after.batch_id.unique()) == list(range(after.batch_id.nunique()))


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(k, spark, sf_dir):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    _, stage = corpus_pipeline.STAGES[k]
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, sf_dir)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        n = out.count()
    assert n == 0


def test_cotraining(spark, sf_dir):
    got = QUERIES["op8_cotraining"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out & (labels.quality.notna())]
    assert len(got) == 1000 and (held.kept == (held.quality == 1)).mean() > 0.93
    assert labels[labels.quality == 1].kept.mean() > 0.95


def test_cotraining_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = cotraining.classify(df, none, rounds=0).collect()
    assert len(out) == len(ROWS) and all(r.score == 0.5 and r.kept for r in out)
    assert cotraining.classify(df.limit(0), none, rounds=0).count() == 0


def test_whole_characters():
    data = "aéb中c".encode()
    assert suffixes.whole_characters(data, [[0, 2], [5, 7]]) == [[0, 1]]
    assert suffixes.whole_characters(data, [[2, 4]]) == [[3, 4]]
    assert suffixes.whole_characters(data, [[0, len(data)]]) == [[0, len(data)]]


def test_newton_by_brute_force(spark):
    """The distributed steps give what the whole table gives at once."""
    rng = np.random.default_rng(4)
    x = np.c_[np.ones(300), rng.normal(size=(300, 3))]
    y = (x @ [0.3, 1.0, -2.0, 0.0] + rng.normal(size=300) > 0).astype(float)
    weight = rng.choice([0.0, 0.5, 1.0], 300)
    df = spark.createDataFrame([(r.tolist(), a, w) for r, a, w in zip(x, y.tolist(), weight.tolist())], "x array<double>, y double, w double").repartition(7)
    samples = lambda b: [(b.column(0).flatten().to_numpy().reshape(-1, 4), b.column(1).to_numpy(), b.column(2).to_numpy())]
    got = cotraining.newton(df, samples, [np.zeros(4)])[0]
    want = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ want))
        want = want + np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.eye(4), x.T @ (weight * (y - p)) - want)
    assert got == pytest.approx(want, abs=1e-3)


def test_views_are_apart():
    """Content knows no metadata, metadata no text."""
    assert len(cotraining.content(b"some words\nmore")) == cotraining.CONTENT and len(cotraining.content(b"")) == cotraining.CONTENT
    a, b = cotraining.metadata("en", "s", 100, "https://a.org/x/y?z"), cotraining.metadata(None, None, None, None)
    assert len(a) == len(b) == cotraining.METADATA and sum(a[1:-3]) == sum(b[1:-3]) == 4


def test_cotraining_takes_pages(spark):
    df = spark.createDataFrame([(i, "some words " * i, "en", "a", i, f"https://h{i % 3}.org/p/{i}") for i in range(9)], "content_score long, text string, lang string, source string, n_chars long, url string")
    out = cotraining.classify(df, spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int"), "content_score", rounds=1)
    assert out.count() == 9 and out.columns[:2] == ["content_score", "content_score_"]
