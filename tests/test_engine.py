"""Fixtures, published figures and properties of the engine's operators."""

import json
import zipfile
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stemwise import schemas
from stemwise.functions import stats, text as T
from stemwise.operators import audit, items as I, matching, results as R, scoring
from stemwise.sources import readers, sinks

#: Published figures: correct, n, lower and upper Wilson bound, upper p.
PUBLISHED = [
    (48, 200, 0.1861, 0.3037, 9.440e-02),
    (62, 200, 0.2500, 0.3772, 1.518e-04),
    (217, 800, 0.2416, 0.3031, 7.433e-07),
    (199, 800, 0.2200, 0.2799, 4.512e-04),
    (229, 800, 0.2560, 0.3185, 3.460e-09),
    (261, 800, 0.2947, 0.3595, 3.357e-17),
    (350, 800, 0.4035, 0.4721, 2.982e-52),
    (203, 727, 0.2478, 0.3129, 1.854e-07),
    (399, 727, 0.5125, 0.5847, 1.729e-95),
    (1676, 6405, 0.2511, 0.2726, 5.121e-33),
    (1936, 6405, 0.2911, 0.3136, 4.245e-84),
    (115, 727, 0.1335, 0.1865, 1.0),
]


def test_published_figures(spark):
    df = spark.createDataFrame([(k, n) for k, n, *_ in PUBLISHED], "k long, n long")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = {(r.k, r.n): r for r in df.select("k", "n", lo.alias("lo"), hi.alias("hi"), R.upper_p("k", "n").alias("p"), stats.binom_sf_exact("k", "n").alias("exact"), stats.binom_sf("k", "n").alias("native")).collect()}
    for k, n, low, high, p in PUBLISHED:
        r = got[k, n]
        assert (r.lo, r.hi) == (pytest.approx(low, abs=6e-5), pytest.approx(high, abs=6e-5))
        assert r.p == pytest.approx(p, rel=6e-4) and r.native == pytest.approx(r.exact, rel=1e-7)


def test_tails_and_tests(spark):
    cases = [(0, 9), (9, 9), (10, 9), (1, 9), (5, 9), (0, 0), (136, 800)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", stats.binom_sf("k", "n").alias("sf"), stats.binom_cdf("k", "n").alias("cdf"), stats.mcnemar("k", "n").alias("m"), stats.mcnemar_exact("k", "n").alias("me"), stats.fisher_exact("k", "n", "n", "k").alias("f"), stats.fisher_exact("k", "n", "n", "k").alias("ft"), stats.z_score(F.col("k"), F.col("n")).alias("z"))
    for r in df.collect():
        assert r.sf == pytest.approx(stats.binom_sf_exact_value(r.k, r.n), rel=1e-9)
        assert r.cdf == pytest.approx(1 - stats.binom_sf_exact_value(r.k + 1, r.n), rel=1e-9, abs=1e-12)
        assert r.m == pytest.approx(r.me, rel=1e-9) and 0 < r.f <= 1
        if (r.k, r.n) == (136, 800):
            assert r.cdf == pytest.approx(1.748e-02, rel=1e-3) and r.z == pytest.approx(-2.12, abs=5e-3)
    assert stats.fisher_value(3, 0, 0, 3) == pytest.approx(0.1) and stats.fisher_value(0, 0, 4, 5) == 1.0
    assert stats.fisher_value(8, 2, 1, 5) == stats.fisher_value(8, 1, 2, 5)
    assert stats.binom_sf_exact_value(2, 3, Fraction(1, 2)) == 0.5


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "reply, pick",
    [("", None), (" ", None), (None, None), ("b", "B"), ("Answer: C", "C"), ("a dog", "A"), ("ABC", None), ("答案A", None), ("答案: A", "A"), ("_A_", None), ("　d ", "D")],
)
def test_extract_letter(spark, reply, pick):
    assert one(spark, reply, T.extract_letter) == pick


@pytest.mark.parametrize("x, want", [("a", "A"), (" A ", "A"), ("AB", "AB"), ("A、C", "AC"), ("", "")])
def test_normalize_answer(spark, x, want):
    assert one(spark, x, T.normalize_answer) == want


@pytest.mark.parametrize("x, want", [("[Shared stem] x", True), ("【SHARED  Questions stem】", True), ("[shared topic]", True), ("共用题干", True), ("共享题干", False), ("【共享题干】", True), ("shared stem", False)])
def test_shared_marker(spark, x, want):
    assert one(spark, x, lambda c: T.matches(c, T.SHARED)) == want


@pytest.mark.parametrize("x, want", [("Haoxiang qq: 1234567", "watermark_edu"), ("QQ 1234567", "watermark_qq"), ("see Unit 3", None), ("Unit 3", "unit_header"), ("页码 5", "page_marker")])
def test_leaks(spark, x, want):
    assert one(spark, x, T.first_named) == want


Q = "What is the longest river here?"
GOOD = f"{Q} A. one B. two C. three D. four E. five"
STRICT = [
    (GOOD, "Reference answer: C", None),
    (GOOD, "none", "no_marker"),
    (GOOD + " Reference answer: b", None, None),
    (GOOD, "参考答案：AB", "multi_answer"),
    (GOOD, "Reference answer: A 中", "cjk"),
    (f"{Q} A. one B. two C. three D. four D. five", "Reference answer: A", "repeated_letter"),
    (f"{Q} A. one B. two C. three D. four", "Reference answer: A", "not_five"),
    (GOOD, "Reference answer: F", "key_not_option"),
    ("Fourteen chars A. one B. two C. three D. four E. five", "Reference answer: A", "short_question"),
    ("Fifteen chars!! A. one B. two C. three D. four E. five", "Reference answer: A", None),
    (f"{Q} A. one B. C. three D. four E. five", "Reference answer: A", "not_five"),
    (f"{Q} A. one B. two C. three D. four E. ", "Reference answer: A", "empty_option"),
    (f"{Q} A.one B.two C.three D.four E.five", "Reference answer: A", None),
    (None, None, "no_marker"),
]


def test_parse_strict(spark):
    df = spark.createDataFrame([(i, d, a) for i, (d, a, _) in enumerate(STRICT)], "pos int, data string, label string")
    got = {r.pos: r for r in I.parse_strict(df).collect()}
    assert [got[i].reject for i in range(len(STRICT))] == [w for *_, w in STRICT]
    assert got[0].options == dict(zip("ABCDE", ["one", "two", "three", "four", "five"])) and got[0].question == Q and got[0].answer == "C"


def test_parse_last_run(spark):
    texts = ["题目 A. 一 B. 二 C. 三 D. 四 E. 五", "A. x B. y 题 A. 一 B. 二 C. 三 D. 四 E. 五", "B超检查 A.一 B.二 C.三 D.四 E.五", "题 A. 一 B. 二 C. 三 D. 四", "题 A. 一 B. C. 三 D. 四 E. 五", "题目A.一B.二C.三D.四E.五"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(I.parse_last_run(F.col("t"))).collect()]
    assert got[0].question == "题目" and got[0].options["E"] == "五"
    assert got[1].question == "A. x B. y 题" and got[2].question == "B超检查" and got[3] is None and got[4] is None
    assert got[5].question == "题目" and got[5].options["A"] == "一"


def test_parse_lines(spark):
    fields = ["A 一\nB. 二\n续行\nC：三", "前言\nA 一\nB超 不是\nF 六", "A 一\nA 二", ""]
    df = spark.createDataFrame(list(enumerate(fields)), "pos int, f string")
    got = {r.pos: r.options for r in I.parse_lines(df, "pos", "f").collect()}
    assert got == {0: {"A": "一", "B": "二 续行", "C": "三"}, 1: {"A": "一 B超 不是", "F": "六"}, 2: None, 3: None}


def test_audit(spark):
    rows = [("a", "x", 0, GOOD, "Reference answer: A"), ("a", "x", 1, GOOD.upper(), None), ("a", "x", 2, "[single choice] [multiple choices] [shared stem] q A. a A. b", ""), ("a", "y", 3, "q (A) 1 (B) 2 (C) 3 (D) 4", ""), ("a", "y", 4, "q A.a B.b C.c D.d", ""), ("a", "y", 5, "q", "A. a B. b C. c D. d "), ("a", "y", 6, "q A. a B. b C. c", ""), ("a", "y", 7, "q A. a C. c", ""), ("a", "y", 8, "", ""), ("a", "y", 9, None, None)]
    got = {r.pos: r for r in audit.classify(spark.createDataFrame(rows, "archive string, bank string, pos int, data string, label string")).collect()}
    assert sorted(got) == [0, 2, 3, 4, 5, 6, 7]
    assert [got[i]["shape"] for i in (0, 2, 3, 6, 7)] == ["clean_ABCDE", "duplicate_letters", "none", "clean_3_options", "gapped_or_odd"]
    assert got[2].merged == "with shared-stem marker"
    assert [got[i].no_options for i in (3, 4, 5)] == ["letters in parentheses", "other punctuation or no space", "options stored in the answer field"]


def test_case_key(spark):
    rows = [("b", "[shared stem] 35 years, 120 and 80.5 [single choice] 9"), ("b", "1 and 2"), ("b", "x" * 295 + " 1 2 3 4 5 6 7 8"), ("b", "[single choice] 1 2 3")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, q string").select(I.case_key(F.col("q"), F.col("b"))).collect()]
    assert got == ["b|35|120|80.5", None, None, "b|1|2|3"]


def test_permutation(spark):
    item = [(0, {"A": "v", "B": "w", "C": "v", "D": "y", "E": "z"}, "C", [2, 0, 4, 1, 3])]
    r = I.apply_order(spark.createDataFrame(item, "item_pos int, options map<string,string>, answer string, order array<int>")).first()
    assert r.new_options == {"A": "v", "B": "v", "C": "z", "D": "w", "E": "y"} and r.new_answer == "A"
    first = I.replayed_orders(spark, 3, 20260910).collect()
    assert all(sorted(x.order) == [0, 1, 2, 3, 4] for x in first)


def test_favourite(spark):
    rows = [("m", 0, "B"), ("m", 1, "A"), ("m", 2, "A"), ("m", 3, "B"), ("m", 4, None), ("m", 5, None), ("m", 6, None), ("n", 0, None)]
    df = spark.createDataFrame(rows, "model string, item_pos int, pick string")
    assert [tuple(r) for r in R.favourite(df, "model").collect()] == [("m", "B", 2)]
    assert R.favourite(df, "model", with_null=True).filter("model = 'm'").first().fav is None


def test_zip_source(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("x/bank1.json", json.dumps([{"data": "q", "label": "l", "more": 1}, 5, {"data": None}]))
        z.writestr("bank2.json", json.dumps({"k": {"data": "d"}}))
        z.writestr("bad.json", "{")
        z.writestr("bank3.json", b'[{"data": "\xff"}]')
    rows = readers.zip_records(spark, f"{tmp_path}/*.zip")
    assert sorted((r.bank, r.pos, r.data) for r in rows.collect()) == sorted([("bank1", 0, "q"), ("bank1", 2, None), ("bank2", 0, "d"), ("bank3", 0, "�")], key=str)
    assert readers.load_bank(rows, "bank2").count() == 1 and readers.load_bank(rows, "none").count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "zh.txt").write_text("第一题\n参考答案：B 解析\n\n没有答案\n \n第二题\n参考答案: ac\n", encoding="utf-8")
    got = readers.text_blocks(spark, str(tmp_path / "zh.txt")).orderBy("pos").collect()
    assert [(r.text, r.answer) for r in got] == [("第一题", "B"), ("第二题", "AC")]
    (tmp_path / "t.csv").write_text('﻿Question,Options,Answer,Medical Discipline\n"q ""x""","A 1\nB 2",a,m\nq2,"",B,m\n', encoding="utf-8")
    got = readers.csv_rows(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.Question, r.Options, r.row) for r in got] == [('q "x"', "A 1\nB 2", 0), ("q2", None, 1)] or got[1].Options == ""
    (tmp_path / "extended_a.json").write_text('[{"bank": "b", "gold": "A"}, 3, {"bank": "c", "pick": "B", "correct": true}]')
    (tmp_path / "extended_a_summary.json").write_text("[{}]")
    got = readers.glob_runs(spark, str(tmp_path), "extended_", schemas.RUN_RESULT).collect()
    assert sorted((r.item_pos, r.bank, r.pick) for r in got) == [(0, "b", None), (2, "c", "B")]
    assert readers.optional_table(spark, str(tmp_path / "none.json"), schemas.RESULT).count() == 0


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = lambda *rows: spark.createDataFrame(rows, "model string, condition string, n int")
    sinks.upsert(spark, df(("a", "x", 1), ("a", "x", 2), ("b", "x", 3)), path)
    for _ in range(2):
        sinks.upsert(spark, df(("a", "x", 9)), path)
    sinks.upsert(spark, df(("c", "y", 4)), path)
    spark.createDataFrame([], "model string, condition string, n int").createOrReplaceTempView("none")
    sinks.upsert(spark, spark.table("none"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "x", 9), ("b", "x", 3), ("c", "y", 4)]


def test_scorer(spark, tmp_path):
    def flaky():
        calls = {}

        def ask(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "bad" or prompt == "slow" and calls[prompt] < 3:
                raise ValueError("x")
            return "The answer is B"

        return ask

    df = spark.createDataFrame([(0, "fine"), (1, "slow"), *((i, "bad") for i in range(2, 10))], "item_pos long, prompt string").coalesce(1)
    got = {r.item_pos: r for r in scoring.score(df, flaky, wait=lambda s: None).collect()}
    assert got[0].reply == got[1].reply == "The answer is B" and got[2].error.startswith("ValueError") and got[9].error == "stopped"
    assert scoring.score_twice(df, flaky, str(tmp_path / "s"), wait=lambda s: None) is None
    done = scoring.score_twice(df.filter("item_pos < 2"), flaky, str(tmp_path / "t"), wait=lambda s: None)
    assert [r.pick for r in done.collect()] == ["B", "B"]
    assert scoring.is_local("qwen2.5:7b") and not scoring.is_local("glm-5.2")


def test_alignment(spark):
    a = spark.createDataFrame([("x", i, k) for i, k in enumerate("abcdefg")], "bank string, pos long, key string")
    b = spark.createDataFrame([("x", i, k) for i, k in enumerate("abXdeg")], "bank string, pos long, key string")
    got = sorted((r.left_pos, r.right_pos) for r in matching.align_sequences(a, b).collect())
    assert got == [(0, 0), (1, 1), (3, 3), (4, 4), (6, 5)]


def test_overlap(spark):
    rows = lambda *x: spark.createDataFrame([(p, t) for p, ts in x for t in ts], "item_pos long, text string")
    got = matching.overlaps(rows((1, ["a", "b", "c"]), (2, ["a", "a", "B "]), (3, ["q"])), rows((10, ["a", "b", "c", "c"]), (11, ["a", "x"])))
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3)]


def test_tail_of_a_hundred_million(spark):
    """Against the normal law with its skewness term (Edgeworth)."""
    from math import erfc, exp, pi, sqrt

    n, cases = 10**8, [20_000_001, 20_004_000, 20_010_000, 20_020_000]
    got = {r.k: r.p for r in spark.createDataFrame([(k, n) for k in cases], "k long, n long").select("k", stats.binom_sf("k", "n").alias("p")).collect()}
    for k in cases:
        sd = sqrt(0.16 * n)
        z, skew = (k - 0.5 - 0.2 * n) / sd, 0.6 / sd
        want = 0.5 * erfc(z / sqrt(2)) + skew / 6 * (z * z - 1) * exp(-z * z / 2) / sqrt(2 * pi)
        assert got[k] == pytest.approx(want, rel=2e-6)
    mc = spark.createDataFrame([(49_990_000, 50_010_000), (0, 10**8)], "b long, c long").select(stats.mcnemar("b", "c").alias("p")).collect()
    assert mc[0].p == pytest.approx(0.0455, rel=1e-3) and mc[1].p == 0.0


def test_hosted_scorer(spark, monkeypatch):
    """A stub server in this process stands for the endpoint."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers["Authorization"], body))
            out = json.dumps({"choices": [{"message": {"content": "B" if body["messages"][1]["content"] == "q" else None}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "k1")
    ask = scoring.endpoint("big-model", "http://unused", f"http://127.0.0.1:{server.server_port}/v1", system="s", key_variable="SOME_KEY")()
    assert [ask("q"), ask("other")] == ["B", ""] and seen[0][0] == "Bearer k1"
    text = spark.createDataFrame([("q",)], "p string").select(scoring.request_body("big-model", "s", F.col("p"))).first()[0]
    assert json.loads(text) == seen[0][1]
    server.shutdown()


def test_breaker_stops_the_job(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "item_pos long, prompt string").coalesce(2)
    down = scoring.flaky(scoring.stub(), lambda prompt, attempt: True)
    with pytest.raises(scoring.Stopped):
        scoring.score_in_batches(df, down, str(tmp_path / "a"), 3, wait=lambda s: None)
    assert not (tmp_path / "a" / "batch1").exists()
    assert scoring.score_in_batches(df, scoring.stub(), str(tmp_path / "b"), 3).filter("error is null").count() == 200


def test_running_accuracy_over_stretches(spark):
    rows = [("m", "c", i, "A", "A" if i % 3 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "model string, condition string, item_pos long, gold string, pick string")
    want = [(n, sum(1 for i in range(n) if i % 3)) for n in range(20, 251, 20)]
    for width in (7, 1 << 16):
        assert sorted((r.seen, r.right) for r in R.running_accuracy(df, 20, width).collect()) == want


def test_swap_ring(spark):
    """Every item of a bank with two items or more has another item as donor, each once."""
    rows = [(i, "a" if i < 300 else f"b{i % 2}" if i < 304 else "alone", x, j, f"{i}{x}", x == "C") for i in range(305) for j, x in enumerate("ABCDE")]
    got = I.swap_donor(spark.createDataFrame(rows, "item_pos long, bank string, letter string, letter_idx int, text string, is_gold boolean"), 5).collect()
    bank = {r[0]: r[1] for r in rows}
    assert sorted(r.item_pos for r in got) == list(range(304)) == sorted(r.donor for r in got)
    assert all(r.item_pos != r.donor and bank[r.item_pos] == bank[r.donor] and r.donor_text == f"{r.donor}{r.donor_letter}" for r in got)


def test_overlapping_is_overlaps_from_three(spark):
    import random

    draw = random.Random(1)
    make = lambda n, at: spark.createDataFrame([(at + i, draw.choice("abcdefghij")) for i in range(n) for _ in range(5)], "item_pos long, text string")
    for least in (1, 2, 3, 5):
        train, evaluation = make(40, 0).cache(), make(15, 1000).cache()
        want = {(r.item_pos, r.shared) for r in matching.overlaps(train, evaluation).collect() if r.shared >= least}
        assert {(r.item_pos, r.shared) for r in matching.overlapping(train, evaluation, least).collect()} == want


def test_aligned_items(spark):
    sample = spark.createDataFrame([(i, "b", "A") for i in range(5)], "item_pos long, bank string, answer string")
    found = spark.createDataFrame([(i, 10 + i) for i in range(4)], "item_pos long, archive_pos long")
    mapping = spark.createDataFrame([("b", 10, 0), ("b", 11, 1), ("b", 12, 2)], "bank string, left_pos long, right_pos long")
    run = "题１ A. 一 B. 二 C. 三 D. 四 E. 五"
    blocks = spark.createDataFrame([("b", 0, run, "A"), ("b", 1, run, "B"), ("b", 2, run, "A")], "bank string, pos long, text string, answer string")
    got = matching.aligned_items(sample, found, mapping, blocks, (2,)).orderBy("sample_index").collect()
    assert [(r.sample_index, r.question, r.options["E"], r.excluded) for r in got] == [(0, "题1", "五", False), (2, "题1", "五", True)]
    key = spark.createDataFrame([("A", "１２ and ３.５")], "a string, t string").select(matching.alignment_key(F.col("a"), F.col("t"))).first()[0]
    assert key == "A|12,3.5"


def test_choice_of_c():
    from stemwise.operators import classifier

    assert classifier.best_of([(0.1, 0.4), (1.0, 0.5), (10.0, 0.5)]) == 1.0 and classifier.best_of([(0.1, 0.0)]) == 0.1


def test_json_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 4 else f"x\n{i}") for i in range(20)], "bank string, gold string").repartition(3)
    sinks.write_json(df, str(tmp_path / "t.json"))
    got = readers.json_table(spark, str(tmp_path / "t.json"), schemas.RESULT).select("bank", "gold")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect())) and {r.file for r in readers.json_table(spark, str(tmp_path / "t.json"), schemas.RESULT).collect()} == {"t.json"}
    sinks.write_json(df.coalesce(1), str(tmp_path / "one.json"))
    files = list((tmp_path / "one.json").glob("part-*"))
    assert len(files) == 1 and len(json.loads(files[0].read_text())) == 20


def test_windowed_accuracy(spark, tmp_path):
    """Late answers within the watermark count in their window."""
    from stemwise.streaming import upsert

    rows = [("2026-01-01 00:10:00", "m", "A", "A"), ("2026-01-01 01:10:00", "m", "A", "B"), ("2026-01-01 00:50:00", "m", "A", None), ("2026-01-01 09:00:00", "m", "A", "A")]
    df = spark.createDataFrame(rows, "t string, model string, gold string, pick string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = upsert.windowed_accuracy(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.window.start.hour, r.k, r.n) for r in spark.table("windowed").collect())
    assert got == [(0, 1, 2), (1, 0, 1), (9, 1, 1)]


def test_entry_survives_without_the_training_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "stemwise", tmp_path / "stemwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op1') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
