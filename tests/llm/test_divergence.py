import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from ratewise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=10):
    """The audit by plain Python over all rows (doc_id, text, lang, source)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(parts):
            n = {t: sum(counts[lang, s][t] for s in parts) for t in kept}
            below = sum(n.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // below for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        own, whole = shares([source]), shares([s for x, s in groups if x == lang])
        pairs = []
        for x, other in groups:
            if x == lang and other != source:
                p = shares([other])
                pairs.append((other, sum(gap(own[t], p[t]) for t in kept)))
        terms = [(t, gap(own[t], whole[t])) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, top in (("pair", pairs, None), ("term", terms, 10)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, r) for r, (i, v) in enumerate(items[:top], 1)]
    return sorted(out)


def audit(df):
    return sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_equals_brute_force_on_documents(frame, sample):
    assert audit(frame(sample)) == brute(sample)


def test_hard_rows(frame):
    rows = [(i, "The THE the Ünit_unit É9é", "en", "a") for i in range(12)]
    rows += [(i, "the unit unit\x00mark [x] x", "en", "b") for i in range(11)]
    rows += [(1, "the mark", "en", None), (1, None, "en", ""), (None, "x x x", "en", "c"), (3, None, None, None), (3, "", "fr", "z"), (4, "rare", "fr", "y")]
    rows += [(5, "the " * 3000, "en", "b")] * 2
    got = audit(frame(rows))
    assert got == brute(rows)
    assert ("fr", "y", "pair", "z", 0, 1) in got  # a language without kept terms
    assert not [r for r in got if r[0] == "" and r[2] == "pair"]  # one group only: nothing to compare


@pytest.mark.parametrize("parts", [1, 7])
def test_spills_and_pieces_change_nothing(frame, sample, parts, monkeypatch):
    """Tiny hash tables, pieces and blocks, run in this process over the merge order."""
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 64)
    rows = [(lang or "", source or "", text or "") for _, text, lang, source in sample]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k::parts]], pa.string()) for i in range(3)], names=["lang", "source", "text"])
               for k in range(parts)]
    spilled = pa.Table.from_batches([b for x in batches for b in divergence._fold(iter([x]))]).sort_by([("lang", "ascending"), ("term", "ascending")])
    cells = pa.Table.from_batches(list(divergence._merge(iter(spilled.to_batches(max_chunksize=13))))).to_pylist()
    counts, df = Counter(), Counter()
    for lang, source, text in rows:
        terms = TERM.findall(text.translate(LOWER))
        counts.update((lang, t, source) for t in terms)
        df.update({(lang, t) for t in terms})
    want = {k: n for k, n in counts.items() if df[k[:2]] >= 10}
    assert {(c["lang"], c["term"], c["source"]): c["n"] for c in cells} == want
    assert len(cells) == len(want)
    assert sum(c["first"] for c in cells) == len({k[:2] for k in want})


def test_long_division(spark):
    from pyspark.sql import functions as F

    rows = [(n, of, v) for n in (0, 5, 10**13) for of, v in ((0, 1), (3 * 10**13, 7), (10**13 + 5, 10**9)) if n <= of]
    df = spark.createDataFrame(rows, "n long, below long, v long")
    for r in df.withColumn("p", divergence.share(F.col("n"), F.col("below"), F.col("v"))).collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // (r.below + 2 * r.v)


def test_many_sources_in_blocks(monkeypatch):
    """Sums leave the task in several parts; together they are whole."""
    monkeypatch.setattr(divergence, "CELLS", 7)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("z", pa.int64())]))
    own = [[(f"s{i}", 5 + i * k, 3 + i) for i in range(9)] for k in range(4)]
    lists = pa.array([[dict(zip(("source", "p", "z"), c)) for c in row] for row in own], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), lists], names=["lang", "own"])
    got = Counter()
    for b in divergence._both(iter([batch])):
        for r in b.to_pylist():
            got[r["source"], r["item"]] += r["value"]
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for row in own:
        for s, p, z in row:
            for t, q, y in row:
                if s != t:
                    want[s, t] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_empty_table(frame):
    assert divergence.audit(frame([(1, "x", "en", "a")]).limit(0)).count() == 0


def test_a_cell_takes_tens_of_bytes():
    """400,000 cells (5,000 terms in 80 sources): what the fold holds at its peak."""
    text = " ".join("t" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(5_000))
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (["en"] * 80, [f"s{i}" for i in range(80)], [text] * 80)], names=["lang", "source", "text"])
    tracemalloc.start()
    cells = sum(len(b.column("counts").flatten()) for b in divergence._fold(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells == 400_000
    assert peak < 85 * cells  # about 74 each; with a Python object for each it was 99
