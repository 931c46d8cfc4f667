"""Static guards for the scale rules: nothing unbounded goes to the driver,
no cross joins, no local checkpoints in library code."""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parent.parent / "ratewise"

# Every driver-bound call in the library, with the bound that makes it safe.
ALLOWED = {
    ("operators/matrix.py", ".collect()"): "b(b+1)/2 Gram entries",
    ("operators/matrix.py", ".first()"): "one row of matrix dimensions",
    ("operators/matrix.py", ".rdd"): "MLlib CoordinateMatrix interop view",
    ("operators/als.py", ".take("): "Arrow rows inside a task",
    ("operators/lloyd.py", ".collect()"): "centres and moments: k rows for each configuration",
    ("operators/sketch.py", ".collect()"): "one sketch of size x width numbers",
    ("operators/split.py", ".collect()"): "4096 counts of a histogram of hash digits",
    ("plans/catalog.py", ".first()"): "one number: the chosen component count",
    ("session.py", ".first()"): "one row of table metadata (location of a temporary table)",
}


def _library():
    """All modules but the optional corpus operators, which have guards of their own."""
    return [p for p in LIB.rglob("*.py") if p.relative_to(LIB).parts[0] != "llm"]


def _code_lines(path):
    for line in path.read_text().splitlines():
        stripped = line.strip()
        if stripped.startswith("#") or stripped.startswith('"""') or "unlike localCheckpoint" in line:
            continue
        yield line


def test_no_cross_join_local_checkpoint_or_pandas_collect():
    for path in _library():
        for line in _code_lines(path):
            assert "crossJoin" not in line, (path, line)
            assert "localCheckpoint" not in line, (path, line)
            assert "toPandas" not in line, (path, line)


def test_driver_bound_calls_are_audited():
    pattern = re.compile(r"\.collect\(\)|\.first\(\)|\.rdd\b|\.take\(")
    for path in _library():
        rel = str(path.relative_to(LIB))
        for line in _code_lines(path):
            for m in pattern.finditer(line):
                assert (rel, m.group(0)) in ALLOWED, f"unaudited driver-bound call in {rel}: {line.strip()}"
