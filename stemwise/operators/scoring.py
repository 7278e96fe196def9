"""Model scoring: a pluggable scorer over partitions with retries, a second pass and a
circuit breaker. A failed call is never scored as a wrong answer."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

RETRIES = 3
MOST_FAILURES = 5
Ask = Callable[[str], str]


def is_local(model: str) -> bool:
    return ":" in model


def local_endpoint(model: str, url: str, system: str = "", timeout: float = 180) -> Callable[[], Ask]:
    """A factory of callables for a chat endpoint at temperature 0."""

    def make() -> Ask:
        def ask(prompt: str) -> str:
            body = {"model": model, "stream": False, "options": {"temperature": 0}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)["message"]["content"]

        return ask

    return make


def request_body(model: str, system: str, prompt: Column) -> Column:
    """The JSON that a hosted chat endpoint takes."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", prompt)).alias("messages"), F.lit(2000).alias("max_tokens"), F.lit(0).alias("temperature")))


def hosted_endpoint(model: str, url: str, system: str = "", key_variable: str = "CHAT_API_KEY", timeout: float = 180) -> Callable[[], Ask]:
    """A factory of callables for a hosted chat endpoint; its key comes from the
    environment of the machine that calls, and is never part of a plan."""

    def make() -> Ask:
        headers = {"Content-Type": "application/json"}
        if os.environ.get(key_variable):
            headers["Authorization"] = f"Bearer {os.environ[key_variable]}"

        def ask(prompt: str) -> str:
            body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "max_tokens": 2000, "temperature": 0}
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"] or ""

        return ask

    return make


def endpoint(model: str, local_url: str, hosted_url: str, **options) -> Callable[[], Ask]:
    """By name: a colon means a local model."""
    return local_endpoint(model, local_url, **options) if is_local(model) else hosted_endpoint(model, hosted_url, **options)


def routes(models: DataFrame) -> DataFrame:
    """(model, local) of each model, as ``endpoint`` sends them."""
    return models.select("model", F.contains("model", F.lit(":")).alias("local")).distinct()


def flaky(make: Callable[[], Ask], fails: Callable[[str, int], bool]) -> Callable[[], Ask]:
    """A scorer that fails where ``fails`` (prompt, attempt from 1) says so, for tests."""

    def wrapped() -> Ask:
        ask, calls = make(), {}

        def call(prompt: str) -> str:
            calls[prompt] = calls.get(prompt, 0) + 1
            if fails(prompt, calls[prompt]):
                raise ValueError("down")
            return ask(prompt)

        return call

    return wrapped


class Stopped(RuntimeError):
    """A circuit breaker opened: nothing more is asked, and no result is reported."""


def stub(seed: int = 0) -> Callable[[], Ask]:
    """Deterministic replies, for tests and dry runs."""

    def make() -> Ask:
        import hashlib

        return lambda prompt: T.LETTERS[hashlib.sha256(f"{seed}|{prompt}".encode()).digest()[0] % 5]

    return make


def with_retry(ask: Ask, prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """Three attempts, with waits of 2 and 4 seconds; the last error goes on."""
    for attempt in range(1, RETRIES + 1):
        try:
            return ask(prompt)
        except Exception:
            if attempt == RETRIES:
                raise
            sleep(2.0**attempt)
    raise AssertionError


def _asked(batches: Iterator[pa.RecordBatch], make: Callable[[], Ask], pause: float, wait: Callable[[float], None], most: int) -> Iterator[pa.RecordBatch]:
    """Replies and errors of a partition's prompts, by one client."""
    ask, failures = make(), 0
    for batch in batches:
        out = []
        for pos, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if failures >= most:
                out.append((pos, None, "stopped"))
                continue
            try:
                out.append((pos, with_retry(ask, prompt, wait), None))
                failures = 0
            except Exception as e:
                failures += 1
                out.append((pos, None, f"{type(e).__name__}: {e}"[:200]))
            if pause:
                wait(pause)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["item_pos", "reply", "error"])


def score(prompts: DataFrame, make: Callable[[], Ask], pause: float = 0.0, wait: Callable[[float], None] = time.sleep, most: int = MOST_FAILURES) -> DataFrame:
    """(item_pos, reply, error) of prompts (item_pos, prompt). One client per partition;
    after ``most`` failures in a row a partition's remaining rows fail without a call."""
    run = lambda batches: _asked(batches, make, pause, wait, most)
    return prompts.select(F.col("item_pos").cast("long"), "prompt").mapInArrow(run, "item_pos long, reply string, error string")


def score_in_batches(prompts: DataFrame, make: Callable[[], Ask], path: str, batches: int, **options) -> DataFrame:
    """``score`` in so many jobs. Once a partition has stopped after five failures in a row,
    the batches that follow are not asked at all: Stopped is raised."""
    spark, done = prompts.sparkSession, None
    for i in range(batches):
        part = prompts.filter(F.pmod(F.xxhash64("item_pos"), F.lit(batches)) == i)
        score(part, make, **options).write.mode("overwrite").parquet(f"{path}/batch{i}")
        got = spark.read.parquet(f"{path}/batch{i}")
        if not got.filter("error = 'stopped'").isEmpty():
            raise Stopped(f"batch {i} of {batches}: five calls in a row failed")
        done = got if done is None else done.union(got)
    return done


def score_as_one(prompts: DataFrame, make: Callable[[], Ask], path: str, pause: float = 0.0, wait: Callable[[float], None] = time.sleep, most: int = MOST_FAILURES) -> DataFrame:
    """(item_pos, reply, error) as one client gives that asks the partitions one after
    another, so that the breaker is the job's and not a partition's. ``path``: a folder.

    Partitions are asked side by side, each with its own breaker, and written down with
    their order; where failures in a row span partitions is settled by four numbers of each,
    and what lies behind the first open breaker is "stopped", its replies too. So a
    partition asks ``most`` prompts at most that one client would not have asked while down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in _asked(batches, make, pause, wait, most):
            n = batch.num_rows
            columns = [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])
            place += n

    prompts.select(F.col("item_pos").cast("long"), "prompt").mapInArrow(run, "item_pos long, reply string, error string, part int, place long").write.mode("overwrite").parquet(path)
    asked = prompts.sparkSession.read.parquet(path)
    answered = F.col("error").isNull()
    ends = asked.groupBy("part").agg(
        F.count("*").alias("n"), F.min(F.when(answered, F.col("place"))).alias("first"), F.max(F.when(answered, F.col("place"))).alias("last"), F.min(F.when(F.col("error") == "stopped", F.col("place"))).alias("stop")
    )
    row, opened = 0, None
    for r in ends.orderBy("part").toLocalIterator():
        ahead = r["n"] if r["first"] is None else r["first"]
        if row + ahead >= most:
            opened = r["part"], max(most - row, 0)
        elif r["stop"] is not None:
            opened = r["part"], r["stop"]
        if opened:
            break
        row = row + r["n"] if r["last"] is None else r["n"] - 1 - r["last"]
    if opened is None:
        return asked.select("item_pos", "reply", "error")
    behind = (F.col("part") > opened[0]) | (F.col("part") == opened[0]) & (F.col("place") >= opened[1])
    return asked.select("item_pos", F.when(~behind, F.col("reply")).alias("reply"), F.when(behind, "stopped").otherwise(F.col("error")).alias("error"))


def scored_only(scored: DataFrame) -> DataFrame:
    """(item_pos, pick) of calls that did not fail; a failed call is no wrong answer."""
    return scored.filter("error is null").select("item_pos", T.extract_letter(F.col("reply")).alias("pick"))


def score_twice(prompts: DataFrame, make: Callable[[], Ask], path: str, again: Callable[[], Ask] | None = None, **options) -> DataFrame | None:
    """Scores, then scores what failed once more (by ``again``, if given); None if rows still
    fail, so that an incomplete run is never reported. ``path``: a folder for the passes."""
    spark = prompts.sparkSession
    score(prompts, make, **options).write.mode("overwrite").parquet(f"{path}/first")
    first = spark.read.parquet(f"{path}/first")
    failed = prompts.join(first.filter("error is not null").select("item_pos"), "item_pos", "left_semi")
    score(failed, again or make, **options).write.mode("overwrite").parquet(f"{path}/second")
    both = first.filter("error is null").union(spark.read.parquet(f"{path}/second"))
    if not both.filter("error is not null").isEmpty():
        return None
    return both.select("item_pos", "reply", T.extract_letter(F.col("reply")).alias("pick"))
