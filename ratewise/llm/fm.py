"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a document, each 0 or a weight:

* words: every distinct word, hashed into ``WORDS`` places, with weight 1 / sqrt(distinct);
* structure: ten statistics of the text (length, word length, capitals, digits, marks,
  symbols, repeated lines and words, distinct words, line breaks), one bin each;
* metadata: the stated number of characters, in binary steps, and whether it is missing.

The score is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` through a sigmoid; the
pairs cost linear time by ``((sum v x)^2 - sum (v x)^2) / 2`` in each of ``RANK`` factors.
The labels, lang, source and doc_id are never features.

It is fitted on at most ``SAMPLE`` labelled rows outside the held-out fold, those with the
smallest hash of their id; scoring runs over all documents.

Null text counts as empty and gets a score; without labels the score is 0.5 everywhere.
Rows may repeat, doc_id may be null, an empty table gives an empty result; only doc_id,
text and n_chars (if there) are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.llm.common import col, crc_column, one_per_id, only, utf8

WORDS = 1 << 14
RANK = 8
SAMPLE = 8000
EPOCHS = 6
BATCH = 64
RATE = 0.05
DECAY = 1e-4
PASS = 0.7
FOLDS, HELD = 4, 2
STEPS = 12  # bins of a statistic
N_STATS = 10
META = 24
SIZE = WORDS + STEPS * N_STATS + META
SEED = 11

MARKS = re.compile(rb"[!?.,;:|]")
SYMBOLS = re.compile(rb"[#*$%&|<>=_~^{}\[\]\\/@]")
CAPITALS = re.compile(rb"[A-Z]|\xc3[\x80-\x9e]")
DIGITS = re.compile(rb"[0-9]")


def _step(share: float) -> int:
    """Bin of a share in 0..1: finer towards 0."""
    if share <= 0:
        return 0
    return min(STEPS - 1, 1 + int(10.0 * min(1.0, share) ** 0.5))


def statistics(data: bytes, ws: list[bytes], distinct: int) -> list[int]:
    """The bins of the structure statistics."""
    n, size = max(1, len(ws)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    return [
        min(STEPS - 1, len(ws).bit_length()),
        min(STEPS - 1, sum(map(len, ws)) // n),
        _step(len(CAPITALS.findall(data)) / size),
        _step(len(DIGITS.findall(data)) / size),
        _step(len(MARKS.findall(data)) / size),
        _step(len(SYMBOLS.findall(data)) / size),
        _step((len(lines) - len(set(lines))) / max(1, len(lines))),
        _step(repeated / n),
        _step(distinct / n),
        _step(len(lines) / n),
    ]


def features(data: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of a document."""
    data = data or b""
    ws = data.lower().split()
    uniq = set(ws)
    at = np.fromiter(map(zlib.crc32, uniq), np.int64, len(uniq)) % WORDS
    at, times = np.unique(at, return_counts=True)
    weight = times / np.sqrt(max(1, len(uniq)))
    bins = [WORDS + STEPS * k + b for k, b in enumerate(statistics(data, ws, len(uniq)))]
    meta = 0 if n_chars is None else 1 + min(META - 2, max(0, int(n_chars)).bit_length())
    extra = np.array([*bins, WORDS + STEPS * N_STATS + meta], np.int64)
    return np.concatenate([at, extra]), np.concatenate([weight, np.ones(len(extra))])


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        return float(self.bias + self.w[at] @ x + 0.5 * ((vx.sum(0) ** 2) - (vx ** 2).sum(0)).sum())

    def score(self, data: bytes | None, n_chars: int | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(data, n_chars)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """Adaptive-gradient descent on the logistic loss; rows (places, weights, label)."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK))
    if not rows:
        return Machine(0.0, w, np.zeros_like(v))
    share = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[k:k + BATCH]]
            ends = np.cumsum([len(p[0]) for p in part])
            starts = np.concatenate([[0], ends[:-1]])
            at, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            doc = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            vx = v[at] * x[:, None]
            s = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * (s ** 2 - np.add.reduceat(vx ** 2, starts)).sum(1)
            err = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - np.array([p[2] for p in part])
            err /= len(part)
            used, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, err[doc] * x, len(used)) + DECAY * w[used]
            each = (err[doc] * x)[:, None] * (s[doc] - vx)
            dv = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            bias -= RATE * err.sum()
    return Machine(bias, w, v)


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars; a column n_chars that holds no numbers counts as null."""
    n_chars = F.lit(None).cast("long")
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.NumericType | T.StringType):
        n_chars = col("n_chars").try_cast("long")
    return docs.select(col("doc_id"), col("text"), n_chars.alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of the bounded sample (the driver gets at most ``sample`` rows)."""
    held = crc_column(F.col("doc_id")) % FOLDS == HELD
    chosen = (only(labels, "doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held)
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    kind = "doc_id long, quality int, at array<bigint>, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = [features(d, n) for d, n in zip(utf8(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("quality"), pa.array([g[0] for g in got], pa.list_(pa.int64())),
                     pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["doc_id", "quality", "at", "x"])

    # The sample has at most ``sample`` narrow rows, so it may be broadcast.
    joined = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text", "n_chars")
    joined = one_per_id(joined, "quality", "text", "n_chars")
    got = joined.mapInArrow(run, kind).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return []
    at, x = (got.column(n).combine_chunks() for n in ("at", "x"))
    ends = np.asarray(at.offsets)
    at, x = np.asarray(at.values), np.asarray(x.values)
    return [(at[lo:hi], x[lo:hi], y) for lo, hi, y in zip(ends[:-1], ends[1:], got.column("quality").to_pylist(), strict=True)]


def predict(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE x (RANK + 1) numbers
    kind = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = [shared.value.score(d, n) for d, n in zip(utf8(batch.column("text")), batch.column("n_chars").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    held = crc_column(F.col("doc_id")) % FOLDS == HELD
    return _inputs(docs).mapInArrow(run, kind).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= PASS, 1).otherwise(0).alias("predicted"))


def rate_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(training_rows(docs, labels)))
