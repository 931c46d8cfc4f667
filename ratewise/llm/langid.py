"""Language identification by n-gram filters with a bit per language.

Learning counts, over all training documents, in how many documents of each language an
n-gram of letters occurs (words padded with a space, n from 1 to 4).  An n-gram belongs
to a language if it occurs in at least ``SUPPORT`` of its documents (in the share
``SUPPORT_SHARE``, where a language has so few that this is less) and its document rate
there is at least ``RATE`` of its highest rate in any language.  Memberships are
written into bit-sliced Bloom filters: one table with a word of 64 language bits per
slot, in as many slices as the languages need.  One lookup per hash function and
an ``and`` give all languages that contain an n-gram.

A text's n-grams are looked up at once; per language the hits are counted, corrected for
the share of hits that its filter gives by chance, and weighed by how few languages share
the n-gram.  The language with most corrected hits wins; the score is its share.

The counts pass through the driver only as the filters: each task writes the bits of its own
n-grams, merged by bitwise or.  A filter has ``SLOTS_PER_KEY`` slots or more for each n-gram of
the language that has most, in a power of two up to ``MOST_SLOTS``; beyond that filters fill,
and the correction for chance hits takes more.

A null text or one without a letter is ``und`` with score 0, and so is a text when nothing was
learned; ties go to the smallest language.  Null languages are not learned from.  Rows may
repeat, doc_id may be null (its checksum is that of empty text); an empty table gives an
empty result; only doc_id, text and lang are read, and lang only for learning.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import col, crc_column, only, settle

NGRAMS = (1, 2, 3, 4)
HASHES = 3
SLOTS_PER_KEY = 32
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 23
SUPPORT, SUPPORT_SHARE = 3, 0.1
RATE = 0.25
FOLDS, HELD = 5, 0
BLOCK = 1 << 18  # code points looked up at once
UNKNOWN = "und"
KEY_MASK = (1 << 62) - 1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _code_points(text: str) -> np.ndarray:
    """Lower-case code points with every run of non-letters as one space, padded."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.take(_letters(), cp)
    cp = np.where(keep, cp, np.uint32(32))
    drop = ~keep
    drop[1:] &= ~keep[:-1]
    drop[:1] = False
    cp = cp[~drop]
    return np.concatenate([np.array([32], np.uint32), cp, np.array([32], np.uint32)])


def ngram_keys(text: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, block by block (blocks overlap, so none is lost)."""
    cp = _code_points(text).astype(np.uint64)
    most = max(NGRAMS)
    for at in range(0, len(cp), BLOCK):
        part = cp[at:at + BLOCK + most - 1]
        own = min(BLOCK, len(cp) - at)
        out, h = [], np.zeros(len(part), np.uint64)
        for n in range(1, most + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            h = (h[:size] * np.uint64(0x100000001B3)) + part[n - 1:n - 1 + size] + np.uint64(n)
            if n in NGRAMS:
                x = h[:own].copy()
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
                out.append(x & np.uint64(KEY_MASK))
        yield np.concatenate(out)


def document_keys(text: str) -> np.ndarray:
    """Distinct n-gram hashes of a text."""
    return np.unique(np.concatenate([np.unique(k) for k in ngram_keys(text)]))


def _places(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """Slots of the keys, one array per hash function."""
    a = keys.view(np.int64)
    b = (a >> 31) | 1
    return [(a + k * b) & (slots - 1) for k in range(HASHES)]


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, key, n): documents of each language that hold an n-gram; counted in the
    tasks first, then over all."""
    kind = "lang string, key long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letter(text):
                    keys = document_keys(text)
                    held.setdefault(lang, []).append(keys)
                    size += len(keys)
                    if size > 8_000_000:
                        yield from flush()
                        size = 0
        yield from flush()

    return training.mapInArrow(run, kind).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def members(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, lang) of the n-grams that belong to a language."""
    needed = F.least(F.lit(SUPPORT), F.ceil(F.col("docs") * SUPPORT_SHARE))
    rated = counts.join(sizes, "lang").where(F.col("n") >= needed).withColumn("rate", F.col("n") / F.col("docs"))
    best = F.max("rate").over(Window.partitionBy("key"))  # one row per language and key
    return rated.withColumn("best", best).where(F.col("rate") >= RATE * F.col("best")).select("key", "bit")


def slots_for(belongs: DataFrame) -> int:
    """A power of two that leaves ``SLOTS_PER_KEY`` slots for each member of the largest language."""
    most = belongs.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return min(max(LEAST_SLOTS, 1 << (SLOTS_PER_KEY * most - 1).bit_length()), MOST_SLOTS)


def filters(belongs: DataFrame, n_langs: int) -> np.ndarray:
    """The bit-sliced filter table, (slices, slots) words of 64 language bits."""
    slots = slots_for(belongs)
    slices = max(1, -(-n_langs // 64))
    kind = "slot int, slice int, bits long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((slices, slots), np.uint64)
        for batch in batches:
            if batch.num_rows:
                keys = np.asarray(batch.column("key")).astype(np.uint64)
                bit = np.asarray(batch.column("bit"))
                word = np.uint64(1) << (bit % 64).astype(np.uint64)
                for at in _places(keys, slots):
                    np.bitwise_or.at(table, (bit // 64, at), word)
        which, slot = np.nonzero(table)
        if len(slot):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(table[which, slot].view(np.int64))], names=["slot", "slice", "bits"])

    table = np.zeros((slices, slots), np.uint64)
    rows = belongs.mapInArrow(run, kind).groupBy("slot", "slice").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # at most a row a slot for each slice of 64 languages
    if got.num_rows:
        at = (np.asarray(got.column("slice")), np.asarray(got.column("slot")))
        table[at] = np.asarray(got.column("bits")).view(np.uint64)
    return table


class Model:
    """The languages in order and their filter table."""

    def __init__(self, langs: list[str], table: np.ndarray) -> None:
        self.langs, self.table = langs, table
        filled = np.array([np.count_nonzero(table[b // 64] >> np.uint64(b % 64) & np.uint64(1)) for b in range(len(langs))])
        self.chance = (filled / table.shape[1]) ** HASHES  # hits that a filter gives for unknown n-grams
        # Few languages need few bits a slot, and a small table stays in the cache.
        self.small = table[0].astype(np.uint8 if len(langs) <= 8 else np.uint16) if len(langs) <= 16 else None

    def _sets(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sets, n): the sets of languages that hold an n-gram, as rows of words, and how many n-grams have each."""
        places = _places(keys, self.table.shape[1])
        slices = [self.small] if self.small is not None else list(self.table)
        words = [np.bitwise_and.reduce([np.take(s, at) for at in places]) for s in slices]
        if self.small is not None:
            n = np.bincount(words[0])
            own = np.flatnonzero(n)
            return own.astype(np.uint64)[:, None], n[own]
        return np.unique(np.stack(words, 1), axis=0, return_counts=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        hits, total = np.zeros(len(self.langs)), 0.0
        at = np.arange(len(self.langs))
        for keys in ngram_keys(text):
            sets, n = self._sets(keys)
            # One row per set: a bit per language, their number by popcount.
            shared = np.bitwise_count(sets).sum(1).astype(float)
            member = (sets[:, at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(float)
            # N-grams of fewer languages say more.
            weight = np.where(shared > 0, n / np.maximum(shared, 1) ** 2, 0.0)
            total += float(weight.sum())
            hits += weight @ member
        real = np.maximum(0.0, (hits - self.chance * total) / (1 - np.minimum(self.chance, 0.999)))
        if real.sum() == 0:
            return self.langs[0], 0.0
        best = int(np.argmax(real))
        return self.langs[best], float(real[best] / real.sum())


def learn(docs: DataFrame) -> Model:
    """The model from all training documents with text and language."""
    training = settle_training(docs)
    sizes = training.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).orderBy("lang").collect()  # one row per language
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], np.zeros((1, LEAST_SLOTS), np.uint64))
    known = docs.sparkSession.createDataFrame([(r["lang"], r["docs"], k) for k, r in enumerate(sizes)], "lang string, docs long, bit int")
    counts = settle(gram_counts(training), "gram-counts")
    return Model(langs, filters(settle(members(counts, known), "members"), len(langs)))


def settle_training(docs: DataFrame) -> DataFrame:
    held = crc_column(col("doc_id")) % FOLDS == HELD
    return only(docs.where(~held & col("text").isNotNull() & col("lang").isNotNull()), "lang", "text")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # up to MOST_SLOTS words of 8 bytes per 64 languages
    kind = "doc_id long, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang, score = zip(*[shared.value.predict(t) for t in batch.column("text").to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    held = crc_column(F.col("doc_id")) % FOLDS == HELD
    return only(docs, "doc_id", "text").mapInArrow(run, kind).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
