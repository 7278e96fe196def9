"""Operators on inputs where an earlier form took too long, held too much or lost digits."""

import difflib
import io
import json
import random
import time
import zipfile

import numpy as np
import pytest

from stemwise.functions import stats
from stemwise.operators import matching, scoring
from stemwise.plans import registry
from stemwise.sources import readers


def test_fisher_of_large_tables():
    began = time.time()
    got = stats.fisher_value(45_000, 62_000, 61_500, 86_000)
    assert time.time() - began < 2
    from math import exp, lgamma

    row, col, n = 107_000, 106_500, 254_500
    f = lambda x: lgamma(x + 1)
    weights = [exp(f(row) + f(n - row) + f(col) + f(n - col) - f(n) - f(x) - f(row - x) - f(col - x) - f(n - row - col + x)) for x in range(43_000, 47_000)]
    assert got == pytest.approx(sum(w for w in weights if w <= weights[2_000] * (1 + 1e-7)), rel=1e-7)


def test_tails_below_the_normal_doubles(spark):
    """Each term is rounded once, as the SQL's are, and digits are those of the exact value."""
    df = spark.createDataFrame([(2576, 6250), (2574, 6250), (2578, 6250), (1300, 6250), (0, 9)], "k long, n long").withColumn("p", stats.binom_sf("k", "n"))
    got = [r.t for r in df.select("k", registry.significant("p").alias("t")).orderBy("k").collect()]
    assert got == ["1.00000e+00", "5.92796e-02", "6.85239e-319", "8.71581e-320", "1.10572e-320"]


def test_exact_tail_of_many_answers():
    """By sixty digits: equal to the last bit to integers, and not slower as the square of n."""
    from fractions import Fraction
    from math import comb

    for k, n in ((10_100, 50_000), (9_900, 50_000), (12_000, 50_000)):
        term, total = comb(n, k) * 4 ** (n - k), 0
        for i in range(k, n + 1):
            total, term = total + term, term * (n - i) // ((i + 1) * 4)
            if term.bit_length() < total.bit_length() - 200:
                break
        assert stats.binom_sf_exact_value(k, n) == float(Fraction(total, 5**n))
    began = time.time()
    assert 0 < stats.binom_sf_exact_value(400_900, 2_000_000) < 0.1
    assert time.time() - began < 2


def test_alignment_is_that_of_difflib():
    draw = random.Random(5)
    for n, kinds in [(n, v) for n in (0, 5, 40, 150, 400) for v in (1, 2, 3, 6, 30)] * 4:
        a = [draw.randrange(kinds) for _ in range(n)]
        b = [x if draw.random() < 0.85 else draw.randrange(kinds) for x in a][draw.randrange(n + 1) // 3 :]
        pairs = lambda found: sorted((i + k, j + k) for i, j, m in found for k in range(m))
        want = pairs(difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert pairs(matching.matching_pairs(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))) == want


def test_alignment_of_a_long_bank_with_few_keys(spark):
    n = 60_000
    left = spark.range(n).selectExpr("'x' as bank", "id as pos", "cast(id % 5 as string) as key")
    right = spark.range(n).selectExpr("'x' as bank", "id as pos", "case when id % 7 = 0 then '0' else cast(id % 5 as string) end as key")
    began = time.time()
    got = matching.align_sequences(left, right.union(spark.createDataFrame([("y", 0, None)], "bank string, pos long, key string"))).collect()
    assert time.time() - began < 60 and got
    assert all(r.bank == "x" and r.right_pos % 7 and r.left_pos % 5 == r.right_pos % 5 or r.left_pos % 5 == 0 for r in got)


def test_breaker_of_the_job_is_that_of_one_client(spark, tmp_path):
    """The same rows as from one partition, with no task that reads them all."""
    draw = random.Random(2)
    for case in range(6):
        down = [draw.random() < (1, 0.9, 0.75, 0.6, 0.3, 0)[case] for _ in range(60)]
        make = scoring.flaky(scoring.stub(1), lambda prompt, attempt, down=down: down[int(prompt)])
        df = spark.range(60, numPartitions=7).selectExpr("id as item_pos", "cast(id as string) as prompt")
        want = scoring.score(spark.range(60, numPartitions=1).selectExpr("id as item_pos", "cast(id as string) as prompt"), make, wait=lambda s: None)
        got = scoring.score_as_one(df, make, str(tmp_path / str(case)), wait=lambda s: None)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_json_elements_are_those_of_the_whole():
    """However the text is cut, and where it is no JSON."""
    good = [b'[1, -1.5e+30, "x\\u00e9", {"data": "q"}, [], null]', b' {"a": {"data": "d"}, "b": 3} ', b"7", b"[]", b"{}", '["é😀"]'.encode(), b'["\xff"]']
    bad = [b"", b"{", b"[1,]", b"[1 2]", b'{"a" 1}', b'{1: 2}', b"[1] 2", b'["x', b"[nul]", b"\xef\xbb\xbf[1]", b"1.5e+", b"[1]\xc3"]
    for size in (1, 2, 3, 7, 1 << 20):
        for text in good:
            whole = json.loads(text.decode(errors="replace"))
            got = list(readers.json_elements(io.BytesIO(text), size))
            assert got == (list(whole.items()) if isinstance(whole, dict) else [(None, x) for x in whole] if isinstance(whole, list) else [])
        for text in bad:
            with pytest.raises(ValueError):
                list(readers.json_elements(io.BytesIO(text), size))


def test_archive_is_read_as_a_stream(spark, tmp_path):
    """A file that breaks off gives nothing, of a repeated key the last value counts."""
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("late.json", json.dumps([{"data": "x" * 50}] * 50_000)[:-1])
        z.writestr("twice.json", '{"k": {"data": "1"}, "m": {"data": "2"}, "k": {"data": "3"}}')
        z.writestr("many.json", json.dumps([{"data": f"d{i}"} for i in range(10_000)]))
    rows = readers.zip_records(spark, f"{tmp_path}/*.zip").collect()
    assert sorted((r.pos, r.data) for r in rows if r.bank == "twice") == [(0, "3"), (1, "2")]
    assert [r.data for r in rows if r.bank == "many"] == [f"d{i}" for i in range(10_000)] and len(rows) == 10_002


def test_reading_an_archive_holds_little():
    """64 MB of records in pieces of the stream's size."""
    import tracemalloc

    text = io.BytesIO(json.dumps([{"data": "x" * 1000}] * 64_000).encode())
    tracemalloc.start()
    assert sum(1 for _ in readers.json_elements(text)) == 64_000
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
