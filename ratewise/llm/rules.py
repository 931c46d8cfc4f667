"""Quality rules with adaptive thresholds, DataFrame functions only.

Every document gets its statistics from array functions inside its own row: nothing
is exploded, so no text and no window moves.  Each ratio is kept as whole parts per
ten thousand.  A quantile sketch per (lang, source) and ratio is a table of counts by
logarithmic bucket (32 buckets for each power of two, so a value is known within
3 percent).  Such sketches merge by adding counts, in any order, with the same
result: groups with few documents use the merged sketch of their language, or of
everything.  From the quantiles of a group come its fences, and the documents are
joined with the fences of their group and filtered.

A fence is the median plus ``SPREADS`` times the distance from the median up to the
rule's upper quantile (``UPPER``), or from the rule's floor where a group's values lie
closer than that.  Symbols and duplicate lines are 0 in most documents, so their upper
quantile is the 75th percentile and junk can't move a fence as long as it is less than a
quarter of a group; chance repetition of words spreads over many documents, and the 90th
percentile measures it.  Only documents that pass the base rule are sketched.

Nulls: a null text has no words and fails the base rule; null lang or source form
groups of their own.  Rows may repeat; an empty table gives an empty result; a very
long text is one row's work, a few numbers for each word, and never moves; in
``keep_good`` other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import SPACE_CLASS, col, only, settle

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
SUPPORT = 200  # documents a sketch needs to stand alone
SPREADS = 12
#: Rule -> percent of the upper quantile, and least spread in parts per ten thousand.
UPPER = {"symbols": 75, "dup_lines": 75, "repeats": 90}
FLOOR = {"symbols": 50, "dup_lines": 300, "repeats": 150}

ST = "__rw_st"


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus the struct ``__rw_st`` of statistics.

    Each step is a projection of its own whose results are used more than once
    above it, so that an array is made once per row and not once per element."""
    text = F.coalesce(col("text"), F.lit(""))
    kept = [col(c) for c in docs.columns]
    ws = F.array_remove(F.split(text, SPACE_CLASS + "++", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    a = docs.select(*kept, ws.alias("__rw_ws"), lines.alias("__rw_lines"), F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("__rw_sym"))
    w = F.col("__rw_ws")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    chars = F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    b = a.select(*kept, F.size(w).cast("long").alias("__rw_n"), chars.alias("__rw_chars"), F.col("__rw_sym").cast("long").alias("__rw_sym"),
                 F.size("__rw_lines").cast("long").alias("__rw_nl"),
                 (F.size("__rw_lines") - F.size(F.array_distinct("__rw_lines"))).cast("long").alias("__rw_dup"), grams.alias("__rw_g"))
    g = F.col("__rw_g")
    # Windows in order of their hash, only where some window repeats.
    ordered = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    c = b.select(*kept, "__rw_n", "__rw_chars", "__rw_sym", "__rw_nl", "__rw_dup", ordered.alias("__rw_o"))
    o = F.col("__rw_o")
    same = F.filter(o, lambda x, k: F.coalesce(F.get(o, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n, chars, nl = F.col("__rw_n"), F.col("__rw_chars"), F.col("__rw_nl")
    return c.select(*kept, F.struct(
        n.alias("n_words"), chars.alias("word_chars"), F.col("__rw_sym").alias("n_symbols"), F.col("__rw_dup").alias("n_dup_lines"),
        F.coalesce(F.size(F.when(o.isNotNull(), covered)), F.lit(0)).cast("long").alias("n_repeat_words"), nl.alias("n_lines")).alias(ST))


def base_failed(st: Column) -> Column:
    return (st["n_words"] < LEAST_WORDS) | (100 * st["n_repeat_words"] > MOST_REPEATED * st["n_words"])


def ratios(st: Column) -> dict[str, Column]:
    """Rule -> value in whole parts per ten thousand."""
    return {"symbols": _share(st["n_symbols"], st["word_chars"]), "dup_lines": _share(st["n_dup_lines"], st["n_lines"]),
            "repeats": _share(st["n_repeat_words"], st["n_words"])}


def _share(part: Column, whole: Column) -> Column:
    """Whole-number division, so that any engine gets the same value."""
    scaled, below = part * 10_000, F.greatest(whole, F.lit(1).cast("long"))
    return ((scaled - scaled % below) / below).cast("long")


def bucket(v: Column) -> Column:
    """Logarithmic bucket: the value itself below 64, else its six leading bits."""
    cut = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftright", v, cut) + cut * 64


def bucket_floor(b: Column) -> Column:
    """The smallest value of a bucket."""
    # Buckets with cut c hold leading bits 32..63, at 64 * c + bits.
    c = F.greatest(F.floor((b - 32) / 64), F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - c * 64).cast("long"), c)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of every group."""
    st = F.col(ST)
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket")) for k, v in ratios(st).items()])
    return stats.where(~base_failed(st)).select("lang", "source", F.inline(rules)).groupBy(
        "lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, p50, p75, p90) of sketches merged to ``keys``."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    up = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = merged.withColumn("up", F.sum("n").over(up)).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("up") * 100 >= F.col("total") * p, bucket_floor(F.col("bucket"))))
    return t.groupBy(*keys, "rule").agg(F.max("total").alias("n"), *[at(p).alias(f"p{p}") for p in (50, 75, 90)])


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, <rule> ...): the highest value each rule lets pass."""
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in FLOOR.items() for x in kv]), F.col("rule"))
    upper = F.coalesce(*[F.when(F.col("rule") == r, F.col(f"p{p}")) for r, p in UPPER.items()])
    own, lang, all_ = (quantiles(sketch, k).withColumn("upper", upper) for k in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), *[F.col(x).alias(f"l_{x}") for x in ("n", "p50", "upper")])
    all_ = all_.select(F.col("rule").alias("a_rule"), *[F.col(x).alias(f"a_{x}") for x in ("p50", "upper")])
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(
        all_, F.col("rule") == F.col("a_rule"))

    def best(x: str) -> Column:
        return F.when(F.col("n") >= SUPPORT, F.col(x)).when(F.col("l_n") >= SUPPORT, F.col(f"l_{x}")).otherwise(F.col(f"a_{x}"))

    top = best("p50") + F.lit(SPREADS) * F.greatest(best("upper") - best("p50"), floor)
    return j.select("lang", "source", "rule", top.alias("top")).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("top"))).alias(r) for r in FLOOR])


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` (written already) plus base_failed and kept as ``__rw_bad``, ``__rw_keep``."""
    st = F.col(ST)
    lim = limits.select(F.col("lang").alias("__rw_l"), F.col("source").alias("__rw_s"), *[F.col(r).alias(f"__rw_{r}") for r in FLOOR])
    j = stats.join(lim, col("lang").eqNullSafe(F.col("__rw_l")) & col("source").eqNullSafe(F.col("__rw_s")), "left")
    inside = F.lit(True)
    for r, v in ratios(st).items():
        # A group without a fence has no document that passes the base rule.
        inside = inside & F.coalesce(v <= F.col(f"__rw_{r}"), F.lit(True))
    bad = base_failed(st)
    return j.withColumn("__rw_bad", bad).withColumn("__rw_keep", ~bad & inside)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: the statistics, base_failed and kept."""
    stats = settle(statistics(only(docs, "doc_id", "text", "lang", "source")).drop("text"), "statistics")
    limits = settle(fences(settle(sketches(stats), "sketches")), "fences")
    st = F.col(ST)
    return judge(stats, limits).select(
        "doc_id", *[st[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("__rw_bad").alias("base_failed"), F.col("__rw_keep").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    stats = settle(statistics(docs), "statistics-full")
    limits = settle(fences(settle(sketches(only(stats, "lang", "source", ST)), "sketches")), "fences")
    return only(judge(stats, limits).where("__rw_keep"), *docs.columns)
