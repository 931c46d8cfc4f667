"""Phrases of two and three words that occur together too often, from counting quotient filters.

A word's id is a 64-bit hash of (lang, word).  All ids are verified: the vocabulary is
grouped by id, and where two words share one, everything starts again with another seed,
so an n-gram packed as its ids (128 or 192 bits) stands for one phrase.  The packed ids go
through an invertible permutation; the leading bits of the result choose a slice and, in
it, a quotient, and the rest is kept whole as the remainder, so nothing is lost.  A filter
stores its entries in order: run lengths of the quotients as unary bits, remainders, and
counters of one byte with an escape.  Each task counts its n-grams into filters, one for
each slice; the filters of a slice are decoded, merged in order and read back by the
inverse permutation.

An n-gram with ``LEAST`` occurrences has only words, and shorter parts, with as many.  Bit
maps of bounded size hold the hashes of those, so tasks leave most other n-grams out; a
wrong hit costs work and changes nothing, since the filters count exactly.

Defined results: null text counts as empty, null lang as ``und`` (together with documents
that say ``und``).  A very long text is cut between pieces; a piece, and a word, may be of
any length.  Repeated rows count again; ties rank by phrase; a lang without candidates has
no rows; an empty table gives none.  Other columns, whatever their names, are not read.
Products are decimals of 38 digits: exact up to 1e16 occurrences of a phrase.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import settle, utf8

LEAST = 10
TOP = 2000
INSIDE = 50  # percent of a phrase's occurrences inside one longer candidate that drop it
CHUNK = 2_000_000  # bytes of text counted at a time
HELD = 300_000  # entries that a task holds before it gives its filters away
LONG_WORD = 256  # bytes; longer words are hashed one by one
SLICE_WORDS = 1 << 18  # word occurrences for each slice
SLICES = (1 << 10, 1 << 20)  # least and most
MAP_BITS = (1 << 16, 1 << 27)  # least and most bits of a bit map (16 MB)
SALTS = 64
TRIES = 20

# Pieces end at [.,;:!?\x0A-\x0D] (read as \n); words at blanks and tabs; A-Z lower-cased.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_PART = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (fixed public constants of a common finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- words

class Words:
    """The words of a chunk: where they are, their ids, and which follow one another in a piece."""

    def __init__(self, parts: list[bytes], langs: list[int], seeds: np.ndarray, seed: int) -> None:
        self.data = b"\n".join([*parts, b"\n" * 8])
        buf = np.frombuffer(self.data, np.uint8)
        inside = (buf != 10) & (buf != 32)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, ends = edge[0::2], edge[1::2]
        self.sizes = ends - self.starts
        part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), self.starts, "right")
        self.lang = np.array(langs, np.int64)[part]
        piece = np.searchsorted(np.flatnonzero(buf == 10), self.starts)
        self.joined = piece[1:] == piece[:-1]
        self.eight = np.ndarray((len(buf) - 7,), "<u8", buffer=self.data, strides=(1,))
        h = mix(seeds[self.lang] + self.sizes.astype(np.uint64))
        short = np.flatnonzero(self.sizes <= LONG_WORD)
        at = 0
        while len(short):
            h[short] = mix(h[short] ^ self._bytes(short, at))
            at += 8
            short = short[self.sizes[short] > at]
        key = seed.to_bytes(8, "little")
        for i in np.flatnonzero(self.sizes > LONG_WORD).tolist():
            h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8, key=key).digest(), "little"))
        self.ids = h

    def _bytes(self, words: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at + 8`` of words that are longer than ``at``."""
        return self.eight[self.starts[words] + at] & _PART[np.minimum(self.sizes[words] - at, 8)]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.starts[i] + self.sizes[i]]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` (of equal ids) are different words or langs."""
        out = (self.sizes[a] != self.sizes[b]) | (self.lang[a] != self.lang[b])
        long = self.sizes[a] > LONG_WORD
        for i in np.flatnonzero(long & ~out).tolist():
            out[i] = self.word(a[i]) != self.word(b[i])
        left, at = np.flatnonzero(~out & ~long), 0
        while len(left):
            out[left] |= self._bytes(a[left], at) != self._bytes(b[left], at)
            at += 8
            left = left[self.sizes[a[left]] > at]
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one occurrence of each word, its count), by id.  Different words of one id stay apart."""
        order = np.argsort(self.ids, kind="stable")
        new = np.ones(len(order), bool)
        ids = self.ids[order]
        same = np.flatnonzero(ids[1:] == ids[:-1]) + 1
        new[same] = self.differ(order[same], order[same - 1])
        at = np.flatnonzero(new)
        return order[at], np.diff(np.append(at, len(order)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):  # few texts as Python objects at a time
            some = batch.slice(at, 200)
            yield from zip(some.column(0).to_pylist(), utf8(some.column(1)), strict=True)


def chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    """The texts of (lang, text) batches as chunks of words, with the names of their langs."""
    names: dict[str, int] = {}
    seeds: list[int] = []
    parts: list[bytes] = []
    langs: list[int] = []
    size = 0

    def out() -> Words:
        return Words(parts, langs, np.array(seeds, np.uint64), seed)

    for lang, data in _rows(batches):
        if lang not in names:
            names[lang] = len(names)
            digest = hashlib.blake2b(lang.encode(), digest_size=8, key=b"lang" + seed.to_bytes(8, "little")).digest()
            seeds.append(int.from_bytes(digest, "little"))
        plain, at = data.translate(_PLAIN), 0
        while at < len(plain):
            end = len(plain)
            if end - at > CHUNK:  # a very long text is cut between pieces
                end = plain.rfind(b"\n", at, at + CHUNK)
                end = plain.find(b"\n", at + CHUNK) if end < 0 else end
                end = len(plain) if end < 0 else end
            parts.append(plain[at:end])
            langs.append(names[lang])
            size += end - at
            at = end + 1
            if size >= CHUNK:
                yield out(), list(names)
                parts, langs, size = [], [], 0
    if parts:
        yield out(), list(names)


WORD = "id long, lang string, word string, n long"


def _count_words(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, lang, word, n) of a task's words; the empty word counts all words of a lang."""
    def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.concat_tables(held).combine_chunks()
            t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
            new = np.ones(len(t), bool)
            if len(t) > 1:
                changed = [pc.not_equal(t.column(c).combine_chunks()[1:], t.column(c).combine_chunks()[:-1]) for c in ("id", "word", "lang")]
                new[1:] = pc.or_(pc.or_(changed[0], changed[1]), changed[2]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            n = np.add.reduceat(t.column("n").to_numpy(), at)
            t = t.take(pa.array(at)).set_column(3, "n", pa.array(n))
            yield from t.combine_chunks().to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for words, langs in chunks(batches, seed):
            some, n = words.distinct()
            name = pa.array(langs, pa.string())
            every = np.bincount(words.lang, minlength=len(langs))
            there = np.flatnonzero(every)
            total = [int.from_bytes(hashlib.blake2b(langs[i].encode(), digest_size=8, key=b"total").digest(), "little", signed=True) for i in there]
            held.append(pa.table({"id": pa.array(total, pa.int64()), "lang": name.take(pa.array(there)), "word": pa.array([""] * len(there), pa.string()), "n": every[there]}))
            text = pa.array([words.word(i) for i in some.tolist()], pa.binary()).cast(pa.string())
            held.append(pa.table({"id": words.ids[some].view(np.int64), "lang": name.take(pa.array(words.lang[some])), "word": text, "n": n.astype(np.int64)}))
            size += len(some)
            if size > HELD:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return run


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of the words with ``LEAST`` occurrences, and of the empty word for
    each lang's total; and the seed under which every word has an id of its own."""
    for seed in range(TRIES):
        one = F.struct("lang", "word")
        found = docs.mapInArrow(_count_words(seed), WORD).groupBy("id").agg(F.sum("n").alias("n"), F.min(one).alias("one"), F.max(one).alias("last"))
        clash = F.col("one") != F.col("last")
        kept = settle(found.where((F.col("n") >= LEAST) | clash | (F.col("one.word") == "")).select("id", "one.lang", "one.word", "n", clash.alias("clash")), "phrase-words")
        if kept.where("clash").isEmpty():
            return kept.drop("clash"), seed
    raise RuntimeError(f"words share 64-bit ids under each of {TRIES} seeds")


# ---------------------------------------------------------------- counting quotient filters

def permute(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """An invertible permutation of numbers of 64 bits a lane, after which the first lane
    depends on all."""
    x = list(lanes)
    for step in range(2 * len(x)):
        j = step % len(x)
        x[j] = x[j] ^ mix(x[j - 1] + np.uint64(step + 1))
    return x


def restore(lanes: list[np.ndarray]) -> list[np.ndarray]:
    x = list(lanes)
    for step in reversed(range(2 * len(x))):
        j = step % len(x)
        x[j] = x[j] ^ mix(x[j - 1] + np.uint64(step + 1))
    return x


def combine(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in order, equal ones added up."""
    order = np.argsort(lanes[0], kind="stable")
    x = [a[order] for a in lanes]
    same, other = x[0][1:] == x[0][:-1], np.zeros(max(len(order) - 1, 0), bool)
    for a in x[1:]:
        other |= a[1:] != a[:-1]
    if (same & other).any():  # two entries with one first lane: order by all lanes
        order = np.lexsort(lanes[::-1])
        x = [a[order] for a in lanes]
        same, other = x[0][1:] == x[0][:-1], np.zeros(len(order) - 1, bool)
        for a in x[1:]:
            other |= a[1:] != a[:-1]
    at = np.flatnonzero(np.concatenate([[True], ~same | other])) if len(order) else np.zeros(0, np.int64)
    return [a[at] for a in x], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def encode_filter(lanes: list[np.ndarray], counts: np.ndarray, cut: int) -> bytes:
    """A filter of ordered entries whose first lanes share their leading ``cut`` bits."""
    n = len(counts)
    q = max(int(n).bit_length() - 1, 0)
    low = 64 - cut - q
    own = lanes[0] & np.uint64((1 << (64 - cut)) - 1)
    quotient = (own >> np.uint64(low)).astype(np.int64)
    bits = np.zeros(n + (1 << q), np.uint8)  # a 1 for each entry, a 0 after each quotient
    bits[quotient + np.arange(n)] = 1
    wide = (low + 7) // 8
    rest = (own & np.uint64((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :wide]
    small = np.minimum(counts, 255).astype(np.uint8)
    return b"".join([struct.pack("<BBBI", len(lanes), cut, q, n), np.packbits(bits).tobytes(), np.ascontiguousarray(rest).tobytes(),
                     *[a.astype("<u8").tobytes() for a in lanes[1:]], small.tobytes(), counts[counts >= 255].astype("<i8").tobytes()])


def decode_filter(data: bytes, which: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of the filter of slice ``which``."""
    width, cut, q, n = struct.unpack_from("<BBBI", data)
    at = struct.calcsize("<BBBI")
    size = n + (1 << q)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size)
    at += (size + 7) // 8
    low = 64 - cut - q
    wide = (low + 7) // 8
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
    at += n * wide
    quotient = (np.flatnonzero(bits) - np.arange(n)).astype(np.uint64)
    lanes = [np.uint64(which << (64 - cut)) | (quotient << np.uint64(low)) | rest.view("<u8")[:, 0]]
    for _ in range(width - 1):
        lanes.append(np.frombuffer(data, "<u8", n, at))
        at += 8 * n
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    at += n
    big = counts == 255
    counts[big] = np.frombuffer(data, "<i8", int(big.sum()), at)
    return lanes, counts


FILTER = "slice int, filter binary"


def _count_grams(size: int, seed: int, cut: int, words_map, pairs_map) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's n-grams of ``size`` words as filters, one for each slice that has some."""
    def flush(lanes: list[list[np.ndarray]], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not counts:
            return
        x, n = combine([np.concatenate(a) for a in lanes], np.concatenate(counts))
        which = (x[0] >> np.uint64(64 - cut)).astype(np.int64)
        at = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
        slices, filters, held = [], [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            slices.append(int(which[a]))
            filters.append(encode_filter([lane[a:b] for lane in x], n[a:b], cut))
            held += len(filters[-1])
            if held > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(filters, pa.binary())], names=["slice", "filter"])
                slices, filters, held = [], [], 0
        if slices:
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(filters, pa.binary())], names=["slice", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes: list[list[np.ndarray]] = [[] for _ in range(size)]
        counts: list[np.ndarray] = []
        held = 0
        for words, _ in chunks(batches, seed):
            ids = words.ids
            known = _in_map(words_map.value, ids)
            pair = np.flatnonzero(words.joined & known[1:] & known[:-1])
            x = permute([ids[pair], ids[pair + 1]])
            if size == 3:
                pair = pair[_in_map(pairs_map.value, x[0])]
                first = pair[:-1][pair[1:] == pair[:-1] + 1]
                x = permute([ids[first], ids[first + 1], ids[first + 2]])
            x, n = combine(x, np.ones(len(x[0]), np.int64))
            for a, b in zip(lanes, x, strict=True):
                a.append(b)
            counts.append(n)
            held += len(n)
            if held > HELD:
                yield from flush(lanes, counts)
                lanes, counts, held = [[] for _ in range(size)], [], 0
        yield from flush(lanes, counts)

    return run


def merge_filters(filters: DataFrame, size: int, least: int = 1) -> DataFrame:
    """(w1 .. w<size>, a): the filters of a slice merged in order, ids restored from quotient
    and remainder; only n-grams counted ``least`` times."""
    names = [f"w{i + 1}" for i in range(size)]

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [decode_filter(f.as_py(), key[0].as_py()) for f in table.column("filter")]
        x, n = combine([np.concatenate([p[0][i] for p in parts]) for i in range(size)], np.concatenate([p[1] for p in parts]))
        kept = n >= least
        lanes = restore([a[kept] for a in x])
        return pa.table([*[pa.array(a.view(np.int64)) for a in lanes], pa.array(n[kept])], names=[*names, "a"])

    return filters.groupBy("slice").applyInArrow(merge, ", ".join(f"{x} long" for x in [*names, "a"]))


# ---------------------------------------------------------------- bit maps

def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _pairs_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = permute([batch.column(i).to_numpy().view(np.uint64) for i in range(2)])
        yield pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64))], names=["key"])


def bit_map(keys: DataFrame, n: int):
    """A broadcast bit map of the column ``key``: 16 bits for each of the ``n`` keys, within
    ``MAP_BITS``.  Beyond that it says yes more often, which only costs work."""
    spark = keys.sparkSession
    bits = MAP_BITS[0]
    while bits < min(16 * n, MAP_BITS[1]):
        bits *= 2
    # One row for each byte that is not 0, then blocks of bytes: at most bits / 8 bytes in all.
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    one = keys.select(F.shiftright(at, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    bytes_ = one.groupBy("byte").agg(F.bit_or("bit").cast("int").alias("bits"))
    blocks = bytes_.groupBy(F.shiftright("byte", 12).alias("block")).agg(
        F.collect_list(F.struct(F.col("byte").bitwiseAND(F.lit(4095)).cast("int").alias("at"), "bits")).alias("own"))
    out = np.zeros(bits // 8, np.uint8)
    packed = blocks.select("block", F.transform("own", lambda x: x["at"]).alias("at"), F.transform("own", lambda x: x["bits"]).alias("bits")).toArrow()
    for block, places, values in zip(packed.column(0).to_pylist(), packed.column(1), packed.column(2), strict=True):
        out[(block << 12) + np.array(places.values)] = np.array(values.values).astype(np.uint8)
    return spark.sparkContext.broadcast(out)


# ---------------------------------------------------------------- phrases

def _slices(words: int) -> int:
    """Leading bits that number the slices."""
    n = SLICES[0]
    while n < min(words // SLICE_WORDS, SLICES[1]):
        n *= 2
    return n.bit_length() - 1


def _whole(x: str) -> Column:
    return F.col(x).cast("decimal(38,0)")


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    return F.call_function("div", _whole("a") * _whole("a") * F.lit(1000000).cast("decimal(7,0)"), _whole(left) * _whole(right))


def ngrams(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, lang totals, pairs, triples): all with ``LEAST`` occurrences, by exact counts."""
    every, seed = vocabulary(docs)
    totals = every.where("word = ''").select("lang", F.col("n").alias("total"))
    words = every.where("word <> ''").select("id", "lang", "word", "n")
    size = every.agg(F.count_if(F.col("word") != "").alias("words"), F.sum(F.when(F.col("word") == "", F.col("n"))).alias("all")).first()
    cut = _slices(size["all"] or 0)
    words_map = bit_map(words.select(F.col("id").alias("key")), size["words"])

    def grams(n: int, pairs_map) -> DataFrame:
        filters = docs.mapInArrow(_count_grams(n, seed, cut, words_map, pairs_map), FILTER)
        return settle(merge_filters(filters, n, LEAST), f"phrases-{n}")

    pairs = grams(2, None)
    pairs_map = bit_map(pairs.select("w1", "w2").mapInArrow(_pairs_key, "key long"), pairs.count())
    return words, totals, pairs, grams(3, pairs_map)


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that stay.  Plain joins on ids, which
    Spark may split where one word is in very many phrases."""
    def word(i: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}"), F.col("n").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))

    # A pair is dropped where a triple around it has INSIDE percent of its occurrences.
    around = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    around = around.groupBy("w1", "w2").agg(F.max("a").alias("most"))
    two = pairs.join(around, ["w1", "w2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < INSIDE * F.col("a")))
    two = two.join(word(1), "w1").join(word(2), "w2").select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))
    front = pairs.select("w1", "w2", F.col("a").alias("f12"))
    back = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    three = triples.join(front, ["w1", "w2"]).join(back, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    three = three.withColumns({"s1": _score("f1", "f23"), "s2": _score("f12", "f3")})
    early = F.col("s1") <= F.col("s2")  # ties go to the first cut
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                         F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def mine(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``TOP`` phrases of each lang."""
    plain = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words, totals, pairs, triples = ngrams(plain)
    found = scored(words, pairs, triples)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= TOP).drop("_at")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
