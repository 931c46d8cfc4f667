"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, twice over.  A queue
entry's virtual finish time is its source's cumulative words up to its end, divided
by the source's target, so all sources reach time 1 together.  Entries are
range-sorted by finish time over all sources and taken until the total budget is
spent; an entry in service at time 1 is cut there, and the entry that crosses the
budget is cut too.

The shuffle order of a source is the order of a 64-bit hash of the seed, the row
(doc_id, source, text) and the row's number among rows equal to it.  Equal rows are
numbered task by task, so a row that repeats a billion times is never gathered, and
since equal rows can stand for each other, the mix is the same however the table is
split into files and tasks.  A hash is uniform, so its leading bits cut any source,
however hot, into even buckets: cumulative words come from bucket sums plus a running
sum inside each bucket, and no source is ever gathered in one task.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating; they share
``share`` of all words, none gets more than ``most`` times its own words, and the
excess is shared again by weight (water filling).  The source table has one row per
source; only it is ordered in one place.

Null text has size 0, null sources form one source, documents of size 0 are never
taken, repeated rows are documents of their own, an empty table gives an empty
result, and other columns pass through ``mix`` whatever their names (rows that differ in
those alone count as equal).  A very long text is one document like any other: only its
size travels.  Equal finish times are ordered by the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import UID, col, settle, with_uid

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 20_24
BUCKET_ROWS = 2048  # documents that one bucket of the shuffle order should hold


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The water level rises until the shares are spent: with sources in the order of
    their ceiling per weight, the first k are at their ceiling and the rest share
    what is left; k is the largest prefix whose ceilings lie below the level."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    t = sources.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("ceiling"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("ceiling") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", (F.sum("source_size").over(everything) * F.lit(float(share))).alias("budget"),
                 F.coalesce(F.sum("ceiling").over(up), F.lit(0.0)).alias("spent"),
                 (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(up), F.lit(0.0))).alias("left"))
    # The level if this source and all above it shared what is left.
    t = t.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    t = t.withColumn("free", F.col("ceiling") >= F.col("level") * F.col("w"))
    lowest = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    return t.select("source", "source_size",
                    F.when(F.col("source_size") == 0, F.lit(0.0))
                    .otherwise(F.least(F.col("ceiling"), F.coalesce(lowest * F.col("w"), F.col("ceiling")))).alias("target"))


def numbered_copies(sized: DataFrame) -> DataFrame:
    """``nth``: the row's number among rows of its mark, from 0; a running number within its
    task's rows plus the counts of the tasks before."""
    t = sized.withColumn("task", F.shiftright(UID, 33))
    counts = t.groupBy("mark", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mark").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("mark", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("mark", "task").orderBy(UID)) - 1
    return t.withColumn("local", local).join(base, ["mark", "task"]).withColumn("nth", F.col("base") + F.col("local")).drop("task", "base", "local")


def queue(sized: DataFrame, n_docs: int, share: float, most: int) -> DataFrame:
    """(uid, doc_id, size, source_size, target, u, start): words of the source before
    this document in the shuffled order; ``u`` is its place there."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, share, most)
    bits = max(0, (max(1, n_docs) // BUCKET_ROWS).bit_length())
    u = F.xxhash64(F.lit(SEED), "doc_id", "size", "mark", "nth")  # rows that repeat are spread as well
    q = numbered_copies(sized).withColumn("u", u).withColumn("bucket", F.shiftrightunsigned("u", 64 - bits) if bits else F.lit(0).cast("long"))
    key = [F.col("source"), F.col("bucket")]
    sums = q.groupBy(*key).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = base.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("b_source"), F.col("b.bucket").alias("b_bucket"), "base", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy(F.shiftleft("u", bits) if bits else F.col("u"), "doc_id", UID).rowsBetween(
        Window.unboundedPreceding, -1)
    local = q.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = local.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    return j.select(UID, "doc_id", "size", "source_size", "target", "u", (F.col("base") + F.col("local")).alias("start"))


def entries(queued: DataFrame, most: int = MOST) -> DataFrame:
    """Queue entries (uid, copy, words, finish): each document once per pass, cut in
    two where virtual time 1 falls inside it."""
    at = F.col("start") + F.col("copy") * F.col("source_size")
    goal = F.floor("target").cast("long")
    e = queued.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(k).cast("long") for k in range(most)])))
    e = e.select(UID, "doc_id", "u", "copy", "size", "target", at.alias("at"), F.greatest(F.lit(0), F.least(F.col("size"), goal - at)).alias("now"))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("now").alias("words"), ((F.col("at") + F.col("now")) / F.col("target")).alias("finish")),
        F.struct(F.lit(1).alias("part"), (F.col("size") - F.col("now")).alias("words"), ((F.col("at") + F.col("size")) / F.col("target")).alias("finish")))
    return e.select(UID, "doc_id", "u", "copy", F.inline(parts)).where("words > 0")


def schedule(sized: DataFrame, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(queue, taken entries): the entries in global order of finish time, up to the budget."""
    spark = sized.sparkSession
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    queued = settle(queue(sized, total["n"], share, most), "queue")
    budget = int(total["words"] * share)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "u", "doc_id", UID, "copy", "part"]
    # Written once with its range number, so sampling again after a loss can't move rows.
    ranged = settle(entries(queued, most).repartitionByRange(parts, *order)
                    .withColumn("range", F.spark_partition_id()), "entries")
    sums = ranged.groupBy("range").agg(F.sum("words").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("local", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(base, "range")
    at = F.col("base") + F.col("local")
    taken = placed.where(at < budget).select(UID, "copy", "part", "finish", at.alias("position"),
                                             F.least(F.col("words"), F.lit(budget) - at).alias("words"))
    return queued, taken


def sizes(docs: DataFrame) -> DataFrame:
    return with_uid(docs.select(col("doc_id"), col("source"), word_count(col("text")).alias("size"), mark_of_row()))


def mark_of_row() -> Column:
    return F.xxhash64(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]).alias("mark")


def mix_report(docs: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    queued, taken = schedule(settle(sizes(docs), "sizes"), share, most)
    got = taken.groupBy(F.col(UID).alias("t_uid")).agg(F.sum("words").alias("taken"))
    return queued.join(got, F.col(UID) == F.col("t_uid"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def first_words(text: Column, n: Column, size: Column) -> Column:
    """The text up to the end of its n-th word, whole if it has no more words."""
    marked = F.regexp_extract_all(text, F.lit("([\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++)"), F.lit(1))
    return F.when(n >= size, text).otherwise(F.array_join(F.slice(marked, F.lit(1), n.cast("int")), ""))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed documents, columns as given: a document taken twice comes twice; the
    few that are cut at the end of their source's share keep their first words."""
    full = settle(with_uid(docs.withColumn("__rw_size", word_count(col("text")))), "mix-full")
    sized = full.select(col("doc_id"), col("source"), F.col("__rw_size").alias("size"), UID, mark_of_row())
    _, taken = schedule(settle(sized, "sizes"), share, most)
    copies = taken.groupBy(F.col(UID).alias("t_uid"), "copy").agg(F.sum("words").alias("__rw_words")).drop("copy")
    j = full.join(copies, F.col(UID) == F.col("t_uid"))
    cut = F.when(F.col("__rw_words") >= F.col("__rw_size"), col("text")).otherwise(
        first_words(col("text"), F.col("__rw_words"), F.col("__rw_size")))
    return j.select(*[cut.alias(c) if c == "text" else col(c) for c in docs.columns])
