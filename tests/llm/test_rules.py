"""Quality rules: statistics against plain Python, sketches against sorted values, native plans."""

import re

from pyspark.sql import functions as F

from ratewise.llm import rules


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(ws) - 2):
        grams.setdefault(tuple(ws[i:i + 3]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check(df, rows):
    got = rules.report(df).collect()
    want = sorted(((d, *brute(t)) for d, t in rows), key=repr)
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)
    return got


EDGES = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a a a a"), (5, "l\nl\n\nl x\nl"), (6, "é ü word\x0b\x0cx " * 30), (7, "a b c " * 20_000),
         (None, "one # two"), (8, "x " * 49), (9, "w1 w2 w3 w4 w1 w2 w3"), (10, "\n".join(f"line {i}" for i in range(60)))]


def test_statistics(frame, sample):
    rows = EDGES + EDGES[:3] + [r[:2] for r in sample]
    check(frame(rows), rows)


def test_labelled_documents(spark):
    """Rejected documents are those labelled bad, or short."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.report(docs).join(labels, "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in bad) <= 0.05 * len(bad)


def planted(rule, usual, odd, n=400):
    """Texts of one group whose ``rule`` is at most ``usual`` percent, and one at ``odd`` percent."""
    def text(tag, percent):
        if rule == "dup_lines":
            lines = [f"w{tag}x{i} y{tag}z{i}" for i in range(100 - percent)]
            return "\n".join(lines + lines[:1] * percent)
        if rule == "repeats":
            ws = [f"w{tag}x{i}" for i in range(300 - percent * 3)]
            return " ".join(ws + [w for i in range(percent * 3 // 3) for w in ("a", "b", "c")])
        return " ".join(f"w{i:04d}" for i in range(100)) + " " + "#" * (500 * percent // (100 - percent))

    return [text(k, k % 11 * usual // 10) for k in range(n)] + [text("odd", odd)]


def test_each_rule_follows_its_group(frame):
    """In a group whose documents are all clean the odd one goes, in a group where such values
    are usual the same one stays; nothing else is rejected."""
    for rule, odd, usual in (("symbols", 9, 4), ("dup_lines", 40, 35), ("repeats", 30, 12)):
        clean, wide = planted(rule, 0, odd), planted(rule, usual, odd)
        rows = [(i, t, "en", "clean") for i, t in enumerate(clean)] + [(10_000 + i, t, "en", "wide") for i, t in enumerate(wide)]
        got = {r.doc_id: r for r in rules.report(frame(rows)).collect()}
        assert not any(r.base_failed for r in got.values()), rule
        assert {d for d, r in got.items() if not r.kept} == {len(clean) - 1}, rule


def test_buckets_are_close_and_ordered(spark):
    v = spark.range(0, 50_000).select("id", rules.bucket(F.col("id")).alias("b")).withColumn("f", rules.bucket_floor(F.col("b")))
    assert v.where("f > id or id - f > id / 32").count() == 0
    assert v.groupBy("b").agg(F.min("id").alias("lo"), F.max("f").alias("f")).where("lo <> f").count() == 0


def test_merged_sketches_give_the_quantiles_of_all(spark):
    rows = [("en", s, "r", v % 900) for s in ("a", "b", None) for v in range(0, 3000, 7)]
    sk = spark.createDataFrame(rows, "lang string, source string, rule string, v long").select(
        "lang", "source", "rule", rules.bucket(F.col("v")).alias("bucket")).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))
    got = rules.quantiles(sk, ["lang"]).first()
    values = sorted(r[3] for r in rows)
    assert got.n == len(values)
    for p, x in ((50, got.p50), (75, got.p75), (90, got.p90)):
        true = values[-(-len(values) * p // 100) - 1]
        assert x <= true <= x * 33 / 32 + 1


def test_keep_good_and_empty_table(frame, sample):
    rows = EDGES + [r[:2] for r in sample]
    df = frame(rows)
    kept = rules.keep_good(df)
    assert kept.schema == df.schema
    assert kept.count() == sum(r.kept for r in rules.report(df).collect())
    assert rules.report(df.limit(0)).count() == 0 and rules.keep_good(df.limit(0)).count() == 0


def test_no_python_in_the_plan(frame, sample):
    df = frame([r[:2] for r in sample])
    plan = rules.statistics(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
