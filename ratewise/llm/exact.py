"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 16 bytes hits a mask, so equal
content is cut alike wherever it stands.  A chunk's identifier is its 128-bit
digest, *verified*: one pass groups all chunks by (digest, bytes), and a digest
that stands for several contents gets an ordinal per content.  A text's recipe is
the ordered list of its identifiers; equal recipes are equal texts.  After the
verification, which moves every distinct chunk once, only recipes (16 bytes for
about 1 KB of text) are shuffled, so long documents are never moved whole.

Nulls count as empty text (the empty recipe).  Rows may repeat: of equal texts
exactly one row stays, that with the largest doc_id (a null id is the smallest;
among equal ids any one row).  An empty table gives an empty result.  Other
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.llm.common import UID, add_columns, col, only, settle, utf8, with_uid

WINDOW = 16
MEAN_BITS = 10  # a cut about every 1024 bytes
LEAST, MOST = 256, 8192
BLOCK = 1 << 20
DIGEST = 16

SHA, RECIPE = "__rw_sha", "__rw_recipe"


def _gear() -> np.ndarray:
    """256 well-mixed 32-bit values from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x >> np.uint64(16)).astype(np.uint32)


GEAR = _gear()


def _marks(data: bytes) -> np.ndarray:
    """Positions after which the content asks for a cut; blockwise, so memory is bounded."""
    out = []
    for start in range(0, len(data), BLOCK):
        head = max(0, start - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), start + BLOCK) - head, head)]
        step = 1
        while step < WINDOW:
            shifted = h[:-step] << np.uint32(step)
            h = h.copy()
            h[step:] += shifted
            step *= 2
        hit = np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + head + 1
        out.append(hit[hit > start])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data`` in order (none for empty data)."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    ends, last = [], 0
    for m in _marks(data).tolist():
        if m - last < LEAST:
            continue
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    out, last = [], 0
    for e in cuts(data):
        out.append(data[last:e])
        last = e
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def with_recipes(docs: DataFrame, digest: int = DIGEST) -> DataFrame:
    """``docs`` plus row id, sha256 of the text, and the list of chunk digests."""

    def make(batch: pa.RecordBatch) -> list:
        shas, recipes = [], []
        for data in utf8(batch.column("text")):
            data = data or b""
            shas.append(hashlib.sha256(data).hexdigest())
            recipes.append(b"".join(_digest(c, digest) for c in chunks(data)))
        return [shas, recipes]

    return with_uid(add_columns(docs, [T.StructField(SHA, T.StringType()), T.StructField(RECIPE, T.BinaryType())], make))


def chunk_rows(texts: DataFrame, digest: int = DIGEST) -> DataFrame:
    """(uid, seq, digest, chunk) of every chunk; ``texts`` has text and maybe a row id."""
    keyed = UID in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(UID).to_pylist() if keyed else [None] * batch.num_rows
            rows: list[tuple] = []
            held = 0
            for uid, data in zip(ids, utf8(batch.column("text")), strict=True):
                for k, c in enumerate(chunks(data or b"")):
                    rows.append((uid, k, _digest(c, digest), c))
                    held += len(c)
                    if held >= 16 * BLOCK:
                        yield _chunk_batch(rows)
                        rows, held = [], 0
            if rows:
                yield _chunk_batch(rows)

    return texts.mapInArrow(run, "uid long, seq int, digest binary, chunk binary")


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    uid, seq, digest, chunk = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(uid, pa.int64()), pa.array(seq, pa.int32()), pa.array(digest, pa.binary()), pa.array(chunk, pa.binary())],
        names=["uid", "seq", "digest", "chunk"])


def contents(texts: DataFrame, digest: int = DIGEST) -> DataFrame:
    """Distinct (digest, chunk): every distinct chunk moves once, copies are combined before."""
    return chunk_rows(only(texts, "text"), digest).groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("uses"))


def ambiguous(texts: DataFrame, digest: int = DIGEST) -> DataFrame:
    """Digests that stand for more than one content (with 128 bits: none in practice)."""
    return contents(texts, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def resolve(keyed: DataFrame, docs_text: DataFrame, digest: int = DIGEST) -> DataFrame:
    """``keyed`` with recipes whose identifiers are verified.

    Where a digest is ambiguous, every text that uses it gets the ordinals of its
    contents appended to its recipe.  The usual case is an empty table of such
    digests, which leaves the recipes as they are."""
    bad = settle(ambiguous(docs_text, digest), "ambiguous")
    if bad.isEmpty():
        return keyed
    if "text" not in keyed.columns:
        # Row ids hold for one written table only, so it is written anew with its texts.
        keyed = settle(with_recipes(docs_text, digest), "recipes-text")
    mine = chunk_rows(only(keyed, UID, "text"), digest).join(bad, "digest", "left_semi")
    ranked = mine.select("digest", "chunk").distinct().groupBy("digest").agg(
        F.sort_array(F.collect_list("chunk")).alias("all"))
    ordinals = (mine.join(ranked, "digest")
                .select("uid", F.struct("seq", F.array_position("all", F.col("chunk")).alias("k")).alias("x"))
                .groupBy("uid").agg(F.to_json(F.sort_array(F.collect_list("x"))).alias("tail")))
    return (keyed.join(ordinals, keyed[UID] == ordinals["uid"], "left")
            .withColumn(RECIPE, F.concat(RECIPE, F.coalesce(F.col("tail"), F.lit("")).cast("binary")))
            .drop("uid", "tail"))


def groups(keyed: DataFrame) -> DataFrame:
    """Recipe -> the row that stays and the number of rows, for recipes used more than once."""
    return (keyed.groupBy(RECIPE)
            .agg(F.max(F.struct(col("doc_id"), col(UID))).alias("keep"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select(F.col(RECIPE).alias("r"), F.col("keep.doc_id").alias("k_id"), F.col(f"keep.{UID}").alias("k_uid"), "n"))


def find_copies(docs: DataFrame, digest: int = DIGEST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = only(docs, "doc_id", "text")
    keyed = settle(with_recipes(slim, digest).drop("text"), "recipes")
    keyed = resolve(keyed, slim, digest)
    # Written first, both sides of the join below are plain scans: adaptive execution
    # can then split a recipe that a third of the rows share.
    dup = settle(groups(keyed), "copies")
    j = keyed.join(dup, F.col(RECIPE) == F.col("r"), "left")
    return j.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("k_uid") == F.col(UID), F.lit(True)).alias("kept"),
        F.col(SHA).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged."""
    keyed = settle(with_recipes(docs), "recipes-full")
    fixed = resolve(keyed, docs)
    slim = only(fixed, "doc_id", UID, RECIPE)
    dup = settle(groups(slim), "copies")
    gone = (slim.join(dup, F.col(RECIPE) == F.col("r")).where(F.col(UID) != F.col("k_uid"))
            .select(F.col(UID).alias("gone")))
    return only(keyed.join(gone, F.col(UID) == F.col("gone"), "left_anti"), *docs.columns)
