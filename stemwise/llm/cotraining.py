"""Quality classifier by co-training of two views.

One logistic model sees the text's content (words, characters, lines), the other only the
page's metadata (language, source, length as recorded, and host and address where there is
a column ``url``). Each round, every document without a label that one view is sure of
becomes a training row, at half weight, of the other. Labelled rows of one fold, which
neither view trains on, calibrate both views, and a last logistic model combines their
calibrated log-odds; those of another fold (held_out) are used for nothing but measuring.

Models are fitted by Newton steps whose sums run over all rows; what reaches the driver
is one matrix of (features x features) sums a step, whatever the number of rows.

Cases: null text, language, source and url are empty; texts of any length are counted
whole, beside a list of their words; null n_chars counts as 0; labels of a repeated id are
averaged and rounded (half up); null labels are none; without labels all scores are 0.5;
an empty table gives no rows; scores of at least 0.5 are kept; other columns are left out,
and results get a trailing underscore where the id column has their name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh

ROUNDS = 2
STEPS = 6
RIDGE = 1.0
SURE = 0.95
PSEUDO_WEIGHT = 0.5
LANGUAGES, SOURCES, HOSTS, LENGTHS = 8, 32, 32, 24
MARKS = b"#$%&*|<>!?.,;:-_\"'()"

BYTE_GROUP = np.full(256, 4, np.int64)  # other
BYTE_GROUP[ord("a") : ord("z") + 1] = 0
BYTE_GROUP[ord("A") : ord("Z") + 1] = 1
BYTE_GROUP[ord("0") : ord("9") + 1] = 2
BYTE_GROUP[128:] = 3
BYTE_GROUP[[9, 10, 11, 12, 13, 32]] = 5
for _i, _c in enumerate(MARKS):
    BYTE_GROUP[_c] = 6 + _i
GROUPS = 6 + len(MARKS)
CONTENT, METADATA = 1 + GROUPS + 10, 1 + LANGUAGES + SOURCES + HOSTS + LENGTHS + 3


def content(text: bytes) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    share = np.bincount(BYTE_GROUP[np.frombuffer(text, np.uint8)], minlength=GROUPS) / max(1, len(text))
    counts = Counter(words)
    triples = max(1, len(words) - 2)
    distinct = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        1.0,
        *np.sqrt(share).tolist(),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        distinct / triples,
        sum(map(len, words)) / n,
        np.log1p(len(words)),
        float(len(words) < 50),
        np.log1p(len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
        len(zlib.compress(text, 1)) / (len(text) + 16),
        len(set(lines)) / max(1, len(lines)),
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None, url: str | None) -> list[float]:
    """Hashed language, source and host; length by thirds of powers of two; the address."""
    out = [0.0] * METADATA
    out[0] = 1.0
    host = (url or "").split("//")[-1].split("/")[0]
    size = max(0, n_chars or 0)
    length = min(LENGTHS - 1, max(0, int(2 * np.log2(size + 1)) - 8))
    at = 1
    for wide, k in ((LANGUAGES, zlib.crc32((lang or "").encode())), (SOURCES, zlib.crc32((source or "").encode())), (HOSTS, zlib.crc32(host.encode())), (LENGTHS, length)):
        out[at + k % wide] = 1.0
        at += wide
    out[at:] = [np.log1p(size), np.log1p(len(url or "")), float((url or "").count("/"))]
    return out


def views(df: DataFrame, id_column: str) -> DataFrame:
    """(id, content, metadata) of the rows (id, text, lang, source, n_chars, maybe url)."""
    kind = df.schema[id_column].dataType.simpleString()
    url = F.col("url").cast("string") if "url" in df.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [content(text.as_py() or b"") for text in b.column(1).cast(pa.binary())]
            m = [metadata(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            kind_ = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, kind_), pa.array(m, kind_)], names=["id", "content", "metadata"])

    return df.select(F.col(id_column).alias("id"), "text", "lang", "source", F.col("n_chars").cast("long"), url).mapInArrow(run, f"id {kind}, content array<float>, metadata array<float>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Batch:
    """Standardised views, labels (nan: none) and folds (0: train, 1: measure, 2: calibrate)."""

    def __init__(self, b: pa.RecordBatch, scale: list[tuple[np.ndarray, np.ndarray]]):
        self.x = []
        for i, width, (mean, deviation) in zip((1, 2), (CONTENT, METADATA), scale, strict=True):
            self.x.append((_matrix(b.column(i), width) - mean) / deviation)
        self.y = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        self.fold = b.column(4).to_numpy(zero_copy_only=False)


def sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of`` over all batches of rows, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "x"])

    out = np.zeros(size)
    for i, x in rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def newton(rows: DataFrame, samples: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray, np.ndarray]]], start: list[np.ndarray], ridge: float = RIDGE) -> list[np.ndarray]:
    """Logistic models fitted side by side. samples: (x, y, weight) of a batch for each."""
    beta = [b.copy() for b in start]
    sizes = [len(b) for b in beta]

    def of(b: pa.RecordBatch) -> np.ndarray:
        parts = []
        for w, (x, y, weight) in zip(beta, samples(b), strict=True):
            p = _sigmoid(x @ w)
            parts += [(x.T * (weight * p * (1 - p))) @ x, x.T @ (weight * (y - p))]
        return np.concatenate([p.ravel() for p in parts])

    for _ in range(STEPS):
        flat, at, most = sums(rows, of, sum(n * n + n for n in sizes)), 0, 0.0
        for k, n in enumerate(sizes):
            hessian, gradient = flat[at : at + n * n].reshape(n, n), flat[at + n * n : at + n * n + n]
            at += n * n + n
            step = np.linalg.solve(hessian + ridge * np.eye(n), gradient - ridge * beta[k])
            step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
            beta[k] = beta[k] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-4:
            break
    return beta


def classify(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(id, content_score, metadata_score, score, kept, labelled, held_out): the
    probability of quality by either calibrated view and by both."""
    truth = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.avg("quality").alias("y")).filter("y is not null")
    truth = truth.select("label_id", (F.col("y") >= 0.5).cast("double").alias("y"))
    seen = views(df, id_column)
    part = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5
    fold = F.when(part == 1, 1).when(part == 2, 2).otherwise(0)
    rows = cut(seen.join(truth, F.col("id") == F.col("label_id"), "left").select("id", "content", "metadata", "y", fold.alias("fold")))

    widths = (CONTENT, METADATA)
    size = 1 + 2 * sum(widths)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        parts = [np.array([float(b.num_rows)])]
        for i, w in zip((1, 2), widths, strict=True):
            x = _matrix(b.column(i), w)
            parts += [x.sum(axis=0), (x * x).sum(axis=0)]
        return np.concatenate(parts)

    flat = sums(rows, moments, size)
    n, at, scale = max(1.0, flat[0]), 1, []
    for w in widths:
        mean, square = flat[at : at + w] / n, flat[at + w : at + 2 * w] / n
        at += 2 * w
        deviation = np.sqrt(np.maximum(square - mean * mean, 0.0))
        deviation[deviation < 1e-6] = 1.0
        mean[0] = 0.0
        scale.append((mean, deviation))

    beta = [np.zeros(w) for w in widths]
    for r in range(rounds + 1):
        before = [b.copy() for b in beta]

        def samples(b: pa.RecordBatch, first: bool = r == 0, before: list[np.ndarray] = before) -> list[tuple]:
            batch = Batch(b, scale)
            known = ~np.isnan(batch.y)
            out = []
            for view in (0, 1):
                y, weight = np.where(known, batch.y, 0.0), (known & (batch.fold == 0)).astype(np.float64)
                if not first:
                    p = _sigmoid(batch.x[1 - view] @ before[1 - view])
                    sure = ~known & ((p >= SURE) | (p <= 1 - SURE))
                    y, weight = np.where(sure, p >= 0.5, y), np.where(sure, PSEUDO_WEIGHT, weight)
                out.append((batch.x[view], y, weight))
            return out

        beta = newton(rows, samples, beta)

    def odds(batch: Batch) -> list[np.ndarray]:
        return [np.stack([np.ones(len(batch.y)), np.clip(x @ b, -20, 20)], axis=1) for x, b in zip(batch.x, beta, strict=True)]

    def held(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
        use = ~np.isnan(batch.y) & (batch.fold == 2)
        return np.where(use, batch.y, 0.0), use.astype(np.float64)

    def calibration(b: pa.RecordBatch) -> list[tuple]:
        batch = Batch(b, scale)
        return [(x, *held(batch)) for x in odds(batch)]

    platt = newton(rows, calibration, [np.zeros(2), np.zeros(2)], ridge=0.1)

    def both(batch: Batch) -> np.ndarray:
        return np.stack([np.ones(len(batch.y)), *(np.clip(x @ p, -20, 20) for x, p in zip(odds(batch), platt, strict=True))], axis=1)

    def combination(b: pa.RecordBatch) -> list[tuple]:
        batch = Batch(b, scale)
        return [(both(batch), *held(batch))]

    mixed = newton(rows, combination, [np.zeros(3)], ridge=0.1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = Batch(b, scale)
            x = both(batch)
            final = _sigmoid(x @ mixed)
            columns = [b.column(0), *(pa.array(v) for v in (_sigmoid(x[:, 1]), _sigmoid(x[:, 2]), final, final >= 0.5, ~np.isnan(batch.y), batch.fold == 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "content_score", "metadata_score", "score", "kept", "labelled", "held_out"])

    kind = df.schema[id_column].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, content_score double, metadata_score double, score double, kept boolean, labelled boolean, held_out boolean")
    results = out.columns[1:]
    return out.select(F.col("id").alias(id_column), *(F.col(c).alias(n) for c, n in zip(results, fresh(df.select(id_column), *results), strict=True)))
