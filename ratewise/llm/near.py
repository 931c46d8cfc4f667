"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct 5-word shingles; documents with Jaccard similarity
of at least ``percent`` are linked, and a component keeps its smallest doc_id.

1. Texts with equal sets form one class; everything below runs on classes.
2. Each class is posted under its ``K`` (coordinate, minimum) pairs.  Pairs that
   occur once can't collide and are skipped; a class with fewer than ``MATCHES``
   shared pairs has no partner and is skipped.
3. Prefix: two signatures that agree on ``MATCHES`` coordinates share a pair among
   the first (shared - MATCHES + 1) of each, in order of list length.  Only those
   postings are merged, so the longest lists (common passages) are skipped.
4. Star merge: in each list the members meet the list's centre only, the member that is
   in the longest lists.  Those pairs are counted (agreeing coordinates >= ``MATCHES``),
   confirmed on full sets, and linked components are found; the same again among the
   members outside each list's largest component.  Then, in each list that still holds
   several components, members outside the largest one meet all members of other
   components, and what is confirmed is linked too.  Two classes with a common prefix
   list thus either met, or already were in one component: no link between components
   is lost, and a group of m near copies costs about m pairs per list.

``MATCHES`` of ``K`` agreeing coordinates is well below what a similarity of 0.85 gives
(108.8 of 128 expected, standard deviation 4.0; fewer than 92 with probability 5e-5).
Between components, 401 of ``FINE`` = 512 are asked for as well (435 expected, 8.1).

Null and empty texts have the empty set and are linked with nothing; fewer than
five words make one shingle.  Rows may repeat (they are copies of each other);
a null doc_id counts after all numbers.  Other columns pass through ``drop_near``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratewise.llm.common import UID, Scratch, add_columns, col, only, settle, utf8, with_uid, words

WIDTH = 5
PERCENT = 85
K, MISS = 128, 5e-5
FINE, FINE_MISS = 512, 3e-5
BLOCK = 2048

N, SET, SIG, TXT = "__rw_n", "__rw_set", "__rw_sig", "__rw_txt"


def least_matches(k: int, percent: int, miss: float) -> int:
    """The largest threshold that two sets of similarity ``percent`` stay below with
    probability at most ``miss``, when each of ``k`` coordinates agrees on its own."""
    p, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * p ** m * (1 - p) ** (k - m)
        if below > miss:
            return max(m, 1)
    return k


MATCHES, FINE_MATCHES = least_matches(K, PERCENT, MISS), least_matches(FINE, PERCENT, FINE_MISS)


def _coordinates(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of the ``k`` hash functions, from a multiplicative rule."""
    x = np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(31))).astype(np.uint32)
    return x[:k, None] | np.uint32(1), x[k:, None]


FACTORS, MASKS = _coordinates(FINE)


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    ws = words(data)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    width = min(WIDTH, len(ws))
    n = len(ws) - width + 1
    s = np.full(n, width, np.uint64)
    for j in range(width):
        s = (s ^ (s >> np.uint64(32)) ^ h[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray, k: int = K) -> np.ndarray:
    """Minimum of each of ``k`` hash functions over the set; blocks bound the memory."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    best = None
    for at in range(0, len(x), BLOCK):
        low = ((x[None, at:at + BLOCK] ^ MASKS[:k]) * FACTORS[:k]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def with_signatures(docs: DataFrame) -> DataFrame:
    """``docs`` plus row id, hash of the text, set size, identifier of the set, and signature."""

    def make(batch: pa.RecordBatch) -> list:
        sizes, sets, flat = [], [], []
        for data in utf8(batch.column("text")):
            s = shingles(data)
            sizes.append(len(s))
            sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            if len(s):
                flat.append(signature(s).view(np.int32))
        ends = np.cumsum([0] + [K * (n > 0) for n in sizes]).astype(np.int32)
        sig = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
        return [sizes, sets, sig]

    return with_uid(add_columns(docs, [
        T.StructField(N, T.LongType()), T.StructField(SET, T.BinaryType()), T.StructField(SIG, T.ArrayType(T.IntegerType()))], make)
        .withColumn(TXT, F.xxhash64(col("text"))))


def classes(signed: DataFrame) -> DataFrame:
    """(set, cid, rep_id, rep_txt, first_id, n, sig): one row per distinct set; cid is its
    smallest row id, rep_id and rep_txt are that row's doc_id and hash of the text."""
    return (signed.where(F.col(N) > 0).groupBy(F.col(SET).alias("set"))
            .agg(F.min(F.struct(UID, "doc_id", TXT)).alias("rep"), F.min("doc_id").alias("first_id"),
                 F.first(N).alias("n"), F.first(SIG).alias("sig"))
            .select("set", F.col("rep")[UID].alias("cid"), F.col("rep.doc_id").alias("rep_id"), F.col("rep")[TXT].alias("rep_txt"),
                    "first_id", "n", "sig"))


def prefixes(cls: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(cid, token, weight, pre) of the postings that have to be merged: ``pre`` is the
    whole prefix of the class, ``weight`` the total length of the lists it is in."""
    posts = cls.select("cid", F.posexplode("sig").alias("at", "low")).select(
        "cid", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    # Written, so that the join below has two scans under it and can split a long list.
    lists = settle(posts.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "lists")
    mine = posts.join(lists, "token").groupBy("cid").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("all"), F.sum("f").alias("weight"))
    need = F.size("all") - F.lit(matches - 1)
    pre = mine.where(need > 0).select("cid", "weight", F.transform(F.slice("all", F.lit(1), need), lambda x: x["token"]).alias("pre"))
    return pre.select("cid", F.explode("pre").alias("token"), "weight", "pre")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, items, fine) for classes (cid, rep_id, rep_txt, set): the full shingle sets, and
    a longer signature of their 16 lowest bits.

    A class meets only rows with the id and the text of its representative, however often
    an id repeats or is null."""
    kind = "cid long, items array<bigint>, fine array<smallint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items, fine = [], [], []
            for cid, key, data in zip(batch.column("cid").to_pylist(), batch.column("set").to_pylist(), utf8(batch.column("text")), strict=True):
                s = shingles(data)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key:
                    ids.append(cid)
                    items.append(s.view(np.int64))
                    fine.append(signature(s, FINE).astype(np.uint16).view(np.int16))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int16()))], names=["cid", "items", "fine"])

    texts = only(docs, "doc_id", "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.xxhash64("text") == F.col("rep_txt")))
    found = texts.select("cid", "set", "text").mapInArrow(run, kind)
    return found.groupBy("cid").agg(F.first("items").alias("items"), F.first("fine").alias("fine"))


def _both(pairs: DataFrame, side: DataFrame, names: list[str]) -> DataFrame:
    """Pairs (a, b) with columns ``names`` of ``side`` for each end, as a_x and b_x."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("cid").alias(end), *[F.col(x).alias(f"{end}_{x}") for x in names]), end)
    return pairs


def _agree(one: str, other: str):
    """On how many coordinates two signatures agree."""
    return F.size(F.filter(F.zip_with(one, other, lambda x, y: x == y), lambda x: x))


def _sizes_fit(one: str, other: str, percent: int = PERCENT):
    return F.lit(100) * F.least(one, other) >= F.lit(percent) * F.greatest(one, other)


def confirm(pairs: DataFrame, cls: DataFrame, sets: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """The pairs (a, b) that are linked: enough agreeing coordinates, then full sets."""
    near = _both(pairs, cls, ["n", "sig"]).where(_sizes_fit("a_n", "b_n", percent) & (_agree("a_sig", "b_sig") >= matches))
    met = _both(settle(near.select("a", "b"), "near"), sets, ["items"])
    met = met.select("a", "b", (F.size("a_items") + F.size("b_items")).alias("total"), F.size(F.array_intersect("a_items", "b_items")).alias("common"))
    return met.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without links are absent.

    Alternating large-star and small-star: each round is two grouped minima with joins,
    written to the shared folder, until every node hangs directly below its root."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        changed = after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def star_pairs(posts: DataFrame) -> DataFrame:
    """(a, b): in each list, its centre (the member in the longest lists) with every other one."""
    top = posts.groupBy("token").agg(F.max(F.struct("weight", (-F.col("cid")).alias("m"))).alias("c"), F.count(F.lit(1)).alias("f"))
    centre = settle(top.where("f > 1").select("token", (-F.col("c.m")).alias("centre")), "centres")
    met = posts.join(centre, "token").where("centre <> cid")
    return met.select(F.least("centre", "cid").alias("a"), F.greatest("centre", "cid").alias("b")).distinct()


def open_lists(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """``posts`` with comp and top (the list's largest component), in lists that hold several components."""
    labelled = settle(posts.join(roots, F.col("cid") == F.col("node"), "left").select(
        "token", "cid", "weight", "pre", F.coalesce("root", "cid").alias("comp")), "labelled")
    sizes = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = settle(sizes.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "comp")).alias("top"))
                   .where("k > 1").select("token", F.col("top.comp").alias("top")), "mixed")
    return settle(labelled.join(mixed, "token"), "open-lists")


def open_pairs(lists: DataFrame, cls: DataFrame, sets: DataFrame, percent: int = PERCENT, matches: int = MATCHES,
               fine: int = FINE_MATCHES) -> DataFrame:
    """(a, b): members of one list in different components, but for pairs within the list's
    largest component (they are connected already).  A pair is made in the first list
    that both have in their prefixes, and only if enough coordinates agree, first of the
    signature, then of the longer one."""
    rows = lists.join(cls.select(F.col("cid").alias("s"), "sig", "n"), F.col("cid") == F.col("s")).drop("s")
    rows = settle(rows.join(sets.select(F.col("cid").alias("s"), "fine"), F.col("cid") == F.col("s")).drop("s"), "open-rows")
    few = rows.where("comp <> top").select("token", *[F.col(c).alias(f"x_{c}") for c in ("cid", "comp", "pre", "sig", "fine", "n")])
    met = few.join(rows, "token").where(
        F.expr("x_comp <> comp and (comp = top or x_cid < cid)") & _sizes_fit("x_n", "n", percent)
        & (F.array_min(F.array_intersect("x_pre", "pre")) == F.col("token"))
        & (_agree("x_sig", "sig") >= matches) & (_agree("x_fine", "fine") >= fine))
    return met.select(F.least("x_cid", "cid").alias("a"), F.greatest("x_cid", "cid").alias("b"))


def link(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, roots of the linked ones); ``signed`` is written already."""
    with Scratch() as scratch:
        cls, roots = _link(docs, signed, percent)
    scratch.clear(docs.sparkSession, cls, roots)
    return cls, roots


def _link(docs: DataFrame, signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    matches, fine = least_matches(K, percent, MISS), least_matches(FINE, percent, FINE_MISS)
    cls = settle(classes(only(signed, UID, "doc_id", TXT, N, SET, SIG)), "classes")
    posts = settle(prefixes(cls, matches), "prefixes")
    wanted = posts.select("cid").distinct().join(cls.select("cid", "rep_id", "rep_txt", "set"), "cid")
    sets = settle(full_sets(docs, wanted), "sets")

    def joined(old: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components of what is connected already (roots stand for it) and new links."""
        if old is not None:
            links = links.unionByName(old.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return settle(components(links), "roots")

    roots = joined(None, settle(confirm(settle(star_pairs(posts), "stars"), cls, sets, percent, matches), "links"))
    # Once more among the members outside each list's largest component.
    lists = open_lists(posts, roots)
    links = settle(confirm(settle(star_pairs(lists.where("comp <> top")), "stars"), cls, sets, percent, matches), "links")
    if not links.isEmpty():
        roots = joined(roots, links)
        lists = open_lists(posts, roots)
    links = settle(confirm(settle(open_pairs(lists, cls, sets, percent, matches, fine), "open"), cls, sets, percent, matches), "links")
    if not links.isEmpty():
        roots = joined(roots, links)
    return cls, roots


def result(signed: DataFrame, cls: DataFrame, roots: DataFrame) -> DataFrame:
    """(uid, doc_id, n, comp_id, comp): the component of every row."""
    named = settle(cls.join(roots, F.col("cid") == F.col("node"), "left").select(
        "set", "first_id", F.coalesce("root", "cid").alias("comp")), "named")
    smallest = settle(named.groupBy("comp").agg(F.min("first_id").alias("comp_id"), F.count(F.lit(1)).alias("k"))
                      .select(F.col("comp").alias("c"), "comp_id"), "smallest")
    of_set = settle(named.join(smallest, F.col("comp") == F.col("c")).select("set", "comp", "comp_id"), "of-set")
    return only(signed, UID, "doc_id", N, SET).join(of_set, F.col(SET) == F.col("set"), "left").select(
        UID, "doc_id", F.col(N).alias("n"), F.col("comp"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("comp_id")).alias("comp_id"))


def find_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = settle(with_signatures(only(docs, "doc_id", "text")).drop("text"), "signatures")
    cls, roots = link(docs, signed, percent)
    return result(signed, cls, roots).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("comp_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("comp_id"), F.lit(True)).alias("kept"))


def drop_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all without shingles."""
    full = settle(with_signatures(docs), "signatures-full")
    cls, roots = link(full, full, percent)
    rows = settle(result(full, cls, roots).where("comp is not null"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col(UID).alias("z"))
    stay = settle(rows.groupBy("comp").agg(F.min(order).alias("o")).select(F.col("comp").alias("c"), F.col("o.z").alias("stay")), "stay")
    gone = rows.join(stay, F.col("comp") == F.col("c")).where(F.col(UID) != F.col("stay")).select(F.col(UID).alias("gone"))
    return only(full.join(gone, F.col(UID) == F.col("gone"), "left_anti"), *docs.columns)
