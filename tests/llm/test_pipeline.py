"""The pipeline stage by stage against plain Python, its registration, and static guards."""

import pathlib
import re
from collections import Counter

import duckdb
import numpy as np
import zlib

import __spark_entry__ as E
import corpus_pipeline as P
from ratewise.llm import packing, sql
from test_mixing import fill, size
from test_near import brute as near_components
from test_packing import whole_ids

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(P.__file__).parent


def test_registered():
    names = set(E.queries())
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
    assert [s for s, _ in P.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    out = []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append([tuple(r) for r in docs.collect()])
        if len(out) < 5:
            assert docs.columns == given

    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql.ORACLE['op2_adaptive_rules']}) WHERE kept").fetchall()}
    want = [r for r in rows if r[0] in kept]
    assert Counter(out[0]) == Counter(want)

    last = {}
    for r in want:
        last[r[1]] = max(last.get(r[1], r), r)
    want = list(last.values())
    assert Counter(out[1]) == Counter(want)

    stay = {c for _, n, c in near_components([r[:2] for r in want]) if n}
    want = [r for r in want if r[0] in stay]
    assert Counter(out[2]) == Counter(want)

    sizes = Counter()
    for r in want:
        sizes[r[3]] += size(r[1])
    goal, taken, per_doc = fill(sizes), Counter(), Counter()
    text = {r[0]: r[1] for r in want}
    for r in out[3]:
        assert text[r[0]].startswith(r[1])
        taken[r[3]] += size(r[1])
        per_doc[r[0]] += size(r[1])
    assert all(abs(taken[s] - goal[s]) <= len(sizes) for s in sizes)
    assert all(per_doc[d] <= 2 * size(text[d]) for d in per_doc)

    pieces = Counter()
    for r, ids in zip(out[3], whole_ids([r[1] for r in out[3]]), strict=True):
        for k, at in enumerate(range(0, len(ids), packing.SIZE)):
            part = ids[at:at + packing.SIZE]
            pieces[r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(r[:5] for r in out[4]) == pieces
    ends = {}
    for r in sorted(out[4], key=lambda r: (r[5], r[6])):
        assert r[6] == ends.get(r[5], 0)
        ends[r[5]] = r[6] + r[3]
    assert max(ends.values()) <= packing.SIZE


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_guards():
    """No cross join, local checkpoint, machine-local folder or swallowed import in the subpackage."""
    files = [*(ROOT / "ratewise" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]
    for path in files:
        text = path.read_text()
        assert not re.search(r"crossJoin|localCheckpoint|tempfile|toPandas|ImportError|ModuleNotFoundError|/opt/tokenizers", text), path
    for path in (ROOT / "ratewise").rglob("*.py"):
        if path.parent.name != "llm":
            assert "ratewise.llm" not in path.read_text(), path
