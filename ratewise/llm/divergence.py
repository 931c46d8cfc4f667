"""Divergence between the sources of a language, from in-mapper stripes.

A stripe is a term's document frequency and its count in every source.  A task folds whole
documents into stripes in flat arrays of numbered cells; beyond ``HELD`` cells they spill,
as sorted rows (lang, term, df, sources, counts).  The spills are dealt by (lang, term), sorted and
merged as a stream, one stripe at a time, and a merged stripe with enough documents gives
its cells (lang, term, source, count, total).

With V kept terms and N occurrences in a group, a count c has
``p = 1 + floor(10^9 (c+2) / (N+2V))`` and two values differ by
``f = floor((p-q)^2 / (p+q))``.  A pair of sources sums f over all kept terms.  Most terms
are in neither source, so the sum is taken apart, exactly: with z the value of count 0,

    sum f = sum over terms of s of f(p, z_t) + the same for t + (V - n_s - n_t) f(z_s, z_t)
          + sum over terms of both of f(p, p') - f(p, z_t) - f(z_s, p') + f(z_s, z_t)

The first part needs the number of terms for each value of p only; the last comes from the
stripes, added up inside the tasks.  So work follows the sources that a term has, not all
sources of its language.

Defined results: null text, lang or source count as ''.  A very long text is folded piece
by piece; a repeated row counts again, in df too.  Ties rank by item.  A group without
terms has rows of part ``pair`` (value 0 where its language has no kept term); an empty
table gives no rows.  Other columns, whatever their names, are not read.  Counts and sums
are exact for fewer than 9e15 occurrences in a group.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import settle, utf8

LEAST_DOCS = 10
TOP_TERMS = 10
HELD = 1_000_000  # cells that a task holds before it spills
PIECE = 4_000_000  # bytes of a text folded at a time
ROWS = 500  # texts taken from a batch at a time
SALTS = 64
CELLS = 1_000_000  # cells of a numpy block

# Terms: everything but [\x00-\x40\x5B-\x60\x7B-\x7F]; A-Z lower-cased.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
CELL = "lang string, term string, source string, n long, total long, first boolean"


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, a bounded piece at a time, cut between terms."""
    plain = data.translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.rfind(b" ", at, at + PIECE)
        if end < at:  # one term longer than a piece
            end = plain.find(b" ", at + PIECE)
            end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end + 1


class _Stripes:
    """Stripes of one language: terms and sources are numbered, cells are (term, source, n,
    documents) in flat arrays, so that a cell takes tens of bytes and not a Python object."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = defaultdict(count().__next__)
        self.sources: dict[str, int] = defaultdict(count().__next__)
        self.raw = [array("q"), array("q"), array("q"), array("q")]  # term, n; source and number of terms of each document
        self.cells = (np.zeros(0, np.int64),) * 3  # key, n, documents; by key

    def add(self, source: str, found: Counter) -> None:
        term, n, of, size = self.raw
        term.extend(map(self.terms.__getitem__, found))
        n.extend(found.values())
        of.append(self.sources[source])
        size.append(len(found))

    def fold(self) -> None:
        """The documents added since the last time go into the cells."""
        if not self.raw[0]:
            return
        term, n, of, size = (np.array(x, np.int64) for x in self.raw)
        self.raw = [array("q") for _ in self.raw]
        key = np.concatenate([self.cells[0], term << 32 | np.repeat(of, size)])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        key = key[order[first]]
        added = (np.add.reduceat(np.concatenate(x)[order], first) for x in ((self.cells[1], n), (self.cells[2], np.ones(len(n), np.int64))))
        self.cells = (key, *added)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """The stripes in order of their terms."""
        self.fold()
        terms, names = sorted(self.terms), pa.array(list(self.sources), pa.string())
        rank = np.empty(len(terms), np.int64)
        rank[np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        row = rank[self.cells[0] >> 32]
        order = np.argsort(row, kind="stable")
        row = row[order]
        for at in range(0, len(terms), 50_000):
            some = terms[at:at + 50_000]
            lo, hi = np.searchsorted(row, [at, at + len(some)])
            pick = order[lo:hi]
            ends = pa.array(np.searchsorted(row[lo:hi], np.arange(at, at + len(some) + 1)).astype(np.int32))
            df = np.add.reduceat(self.cells[2][pick], ends.to_numpy()[:-1])
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(df),
                pa.ListArray.from_arrays(ends, names.take(pa.array(self.cells[0][pick] & 0xFFFFFFFF))),
                pa.ListArray.from_arrays(ends, pa.array(self.cells[1][pick]))],
                names=["lang", "term", "df", "sources", "counts"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents into stripes; spills when the table is full."""
    table: dict[str, _Stripes] = defaultdict(_Stripes)
    waiting = 0  # a document's cells, before they are added up

    def spill() -> Iterator[pa.RecordBatch]:
        while table:
            lang, stripes = table.popitem()
            yield from stripes.rows(lang)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for lang, source, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                found: Counter = Counter()
                for terms in pieces(data):
                    found.update(terms)
                table[lang].add(source, found)
                waiting += len(found)
                if waiting > HELD // 4:
                    for stripes in table.values():
                        stripes.fold()
                    waiting = 0
                    if sum(len(stripes.cells[0]) for stripes in table.values()) > HELD:
                        yield from spill()
    yield from spill()


def _merged(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Stripes in key order, equal keys merged: (cells of each stripe, one row per cell)."""
    lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        differ = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        new[1:] = differ.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    df = np.add.reduceat(table.column("df").to_numpy(), starts)
    key = np.cumsum(new) - 1
    sources, counts = (table.column(c).combine_chunks() for c in ("sources", "counts"))
    sizes = pc.list_value_length(sources).to_numpy(zero_copy_only=False)
    names = pc.list_flatten(sources).dictionary_encode()
    width = max(len(names.dictionary), 1)
    cell, back = np.unique(np.repeat(key, sizes) * width + names.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, back, pc.list_flatten(counts).to_numpy(zero_copy_only=False))
    of = cell // width
    each = np.bincount(of, minlength=len(starts))
    total = np.add.reduceat(n, np.cumsum(each) - each)
    row = starts[of]
    first = np.ones(len(cell), bool)
    first[1:] = of[1:] != of[:-1]
    cells = pa.table({
        "lang": lang.take(pa.array(row)), "term": term.take(pa.array(row)), "source": names.dictionary.take(pa.array(cell % width)),
        "n": n, "total": total[of], "first": first, "df": df[of]})
    return each, cells


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of the kept stripes, from spilled stripes in key order.  The last stripe of a
    batch may go on in the next: it is held, merged, as one row."""
    held: pa.Table | None = None

    def out(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        kept = cells.filter(pc.greater_equal(cells.column("df"), LEAST_DOCS)).drop_columns(["df"])
        yield from kept.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table.cast(held.schema)])
        each, cells = _merged(table)
        done = len(cells) - int(each[-1])
        yield from out(cells.slice(0, done))
        last = cells.slice(done)
        held = pa.table({"lang": last.column("lang").slice(0, 1), "term": last.column("term").slice(0, 1), "df": last.column("df").slice(0, 1),
                         "sources": pa.array([last.column("source").to_pylist()], pa.list_(pa.string())),
                         "counts": pa.array([last.column("n").to_pylist()], pa.list_(pa.int64()))}).cast(table.schema)
    if held is not None:
        yield from out(_merged(held)[1])


def cells(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, total, first): the kept stripes, one row per source of a
    term; ``total`` is the term's count in the language, ``first`` marks one row per term."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    stripes = docs.select(*blank).mapInArrow(_fold, STRIPE)
    sorted_ = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sorted_.mapInArrow(_merge, CELL)


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, b)


def share(n: Column, of: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n+2) / (of+2 terms)) by long division, three digits a step, so that no
    product leaves 64 bits; null where there are no terms."""
    below = F.when(terms > 0, of + 2 * terms)
    rest = n + F.lit(2).cast("long")
    value = _div(rest, below)
    for _ in range(3):
        rest = (rest % below) * F.lit(1000).cast("long")
        value = value * 1000 + _div(rest, below)
    return value + 1


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per occurring (lang, source): n (its occurrences), held (terms that it has),
    v and lang_n (kept terms and occurrences of its language), z (p of count 0)."""
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_n"))
    filled = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "held", "v", "lang_n"])
    zero = F.lit(0).cast("long")
    return filled.withColumn("z", share(zero, F.col("n"), F.col("v")))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of sources that share a term, what the term adds beyond each alone; summed
    in the task.  A stripe with many sources is taken in blocks of its rows."""
    names: dict[tuple[str, str], int] = {}
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in sums])
        one, back = np.unique(key, return_inverse=True)
        value = np.zeros(len(one), np.int64)
        np.add.at(value, back, np.concatenate([v for _, v in sums]))
        return one, value

    def out() -> Iterator[pa.RecordBatch]:
        if not sums:
            return
        every = list(names)
        key, value = reduced()
        for at in range(0, len(key), 100_000):
            a, b = (key[at:at + 100_000] >> 32).tolist(), (key[at:at + 100_000] & 0xFFFFFFFF).tolist()
            v = pa.array(value[at:at + 100_000])
            x, y = [every[i] for i in a], [every[i][1] for i in b]
            lang, x = pa.array([k[0] for k in x], pa.string()), pa.array([k[1] for k in x], pa.string())
            y = pa.array(y, pa.string())
            for one, other in ((x, y), (y, x)):
                yield pa.RecordBatch.from_arrays([lang, one, other, v], names=["lang", "source", "item", "value"])

    for batch in batches:
        langs, lists = batch.column("lang").to_pylist(), batch.column("own")
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        source, p, z = (flat.field(i) for i in range(3))
        source, p, z = source.to_pylist(), p.to_numpy(zero_copy_only=False), z.to_numpy(zero_copy_only=False)
        for row, lang in enumerate(langs):
            a, b = int(ends[row]), int(ends[row + 1])
            ids = np.array([names.setdefault((lang, s), len(names)) for s in source[a:b]], np.int64)
            own, zero = p[a:b], z[a:b]
            step = max(1, CELLS // (b - a))
            for at in range(0, b - a, step):
                i, j = np.nonzero(np.arange(at, min(at + step, b - a))[:, None] < np.arange(b - a)[None, :])
                i += at
                value = _gap(own[i], own[j]) - _gap(own[i], zero[j]) - _gap(zero[i], own[j]) + _gap(zero[i], zero[j])
                sums.append((ids[i] << 32 | ids[j], value))
                held += len(i)
                if held > 2 * CELLS:
                    sums[:] = [reduced()]
                    held = len(sums[0][0])
                    if held > CELLS:
                        yield from out()
                        sums.clear()
                        names.clear()
                        ids = np.array([names.setdefault((lang, s), len(names)) for s in source[a:b]], np.int64)
                        held = 0
    yield from out()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a source and each other one of its language: the sum as if they shared no term."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            peers = row["peers"]
            z = np.array([x["z"] or 0 for x in peers], np.int64)
            part = np.zeros(len(peers), np.int64)
            rest = np.zeros(len(peers), np.int64)
            if row["v"]:
                p = np.array([x["p"] for x in row["own"]], np.int64)
                n = np.array([x["n"] for x in row["own"]], np.int64)
                step = max(1, CELLS // max(len(peers), 1))
                for at in range(0, len(p), step):
                    part += (_gap(p[at:at + step, None], z[None, :]) * n[at:at + step, None]).sum(0)
                held = np.array([x["held"] for x in peers], np.int64)
                rest = (row["v"] - row["held"] - held) * _gap(np.int64(row["z"]), z)
            names = [x["source"] for x in peers]
            other = np.array([s != row["source"] for s in names], bool)
            mine = [row["source"]] * int(other.sum())
            peer = [s for s, o in zip(names, other, strict=True) if o]
            lang = [row["lang"]] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(mine, pa.string()), pa.array(peer, pa.string()), pa.array((part + rest)[other])],
                                             names=["lang", "source", "item", "value"])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(peer, pa.string()), pa.array(mine, pa.string()), pa.array(part[other])],
                                             names=["lang", "source", "item", "value"])


def pair_sums(rated: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.  The
    result holds each pair, so a source's list of peers is as long as its own rows there."""
    kind = "lang string, source string, item string, value long"
    stripes = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("own"))
    both = stripes.select("lang", "own").mapInArrow(_both, kind)
    values = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    values = values.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("own"))
    peers = known.groupBy("lang").agg(F.collect_list(F.struct("source", "z", "held")).alias("peers"))
    alone = known.select("lang", "source", "v", "held", "z").join(values, ["lang", "source"], "left").join(peers, "lang")
    alone = alone.select("lang", "source", "v", "held", "z", F.coalesce("own", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("own"), "peers")
    return both.unionByName(alone.mapInArrow(_alone, kind)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(rated: DataFrame) -> DataFrame:
    """(lang, source, item, value) of a group's terms above their language's share, the
    ``TOP_TERMS`` best of each of ``SALTS`` parts (the best of all are among them)."""
    over = rated.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    worth = over.select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    part = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(F.desc("value"), "item")
    return worth.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= TOP_TERMS).drop("_at")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other
    sources of its language and from the language's terms."""
    kept = settle(cells(docs), "stripes")
    known = settle(groups(docs, kept), "stripe-groups")
    rated = settle(kept.join(known, ["lang", "source"]).select(
        "lang", "term", "source", kept["n"].alias("n"), "z", share(kept["n"], known["n"], F.col("v")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "stripe-shares")
    both = pair_sums(rated, known).withColumn("part", F.lit("pair")).unionByName(
        top_terms(rated).withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.select("lang", "source", "part", "item", "value", rank.cast("int").alias("rank"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
