"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``size`` tokens.  The plan is made on
counts alone: pieces of each length, longest first, go to the open sequences with
the least room that still fits, many sequences at a time, so planning costs the
same for a thousand pieces or a trillion.  The plan says, for runs of ranks within
a length, which sequences and offsets they take.  Pieces get their rank within the
length without any sort: a running number inside the task that cut them, plus the
counts of the tasks before it.

Null text counts as empty; an empty text is its end token alone, one piece.  The strings
of special tokens become those tokens, as in the tokenizer itself.  A very long text is
cut into pieces like any other; its ids are held by the task that reads it.  Rows
may repeat and doc_id may be null: every row is packed.  An empty table gives an
empty result.  Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import only, settle, utf8
from ratewise.llm.tokens import default_path, encoder

SIZE = 4096
END_ID = 1
RANK_BITS = 44  # ranks within a length; 2^44 pieces of one length

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
FLUSH = 50_000


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: place in its document, length, checksum of its ids, the
    task that cut it and its running number among that task's pieces of its length."""
    path = tokenizer or default_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                ids = enc.encode_text(data) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at:at + 4 * size]
                    n = len(cut) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(cut), part, seen[n]))
                    seen[n] += 1
                if len(rows) >= FLUSH:
                    yield _batch(rows, PIECES)
                    rows = []
        if rows:
            yield _batch(rows, PIECES)

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best fit, longest first, over a histogram {length: count}.

    Rows (length, first rank, first sequence, pieces per sequence, first offset):
    the piece of this length with rank ``r`` goes to sequence
    ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    Open sequences are kept as runs of neighbouring numbers with equal room."""
    room: list[int] = []  # rooms that some open sequence has, ascending
    open_runs: dict[int, list[tuple[int, int]]] = {}
    out, used = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in open_runs:
                open_runs[left] = []
                bisect.insort(room, left)
            open_runs[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                new = -(-todo // (size // length))
                put(size, used, new)
                used += new
                continue
            left = room[at]
            first, n = open_runs[left].pop()
            if not open_runs[left]:
                del open_runs[left], room[at]
            per = left // length
            full = min(n, todo // per)
            if full:
                out.append((length, rank, first, per, size - left))
                put(left - per * length, first, full)
                put(left, first + full, n - full)
                rank, todo = rank + full * per, todo - full * per
            else:
                out.append((length, rank, first, per, size - left))
                put(left - todo * length, first, 1)
                put(left, first + 1, n - 1)
                todo = 0
    return np.array(out, np.int64).reshape(-1, 5)


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (already written) with their sequence and offset.

    The plan depends on the histogram only, at most ``size`` lengths; it travels
    with the task code.  A piece finds its run of ranks by binary search."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(counts, size)
    keys = (runs[:, 0] << RANK_BITS) + runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    per_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("idx")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            row = runs[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            seq, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(offset)],
                names=[f.split()[0] for f in PLACED.split(", ")])

    return ranked.mapInArrow(run, PLACED)


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(settle(pieces(docs, size, tokenizer), "pieces"), size)
