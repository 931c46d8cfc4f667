"""Exact dedup against a dictionary of texts; recipes, cuts and forced digest collisions."""

import hashlib
import random

from ratewise.llm import exact


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh \né", k=60_000))
    rows = [(i, rng.choice(["a", "b", "", None, "hot text " * 200, long, long[:-1] + "z", "x" + long])) for i in range(300)]
    rows += [(1000 + i, f"unique {i} " * rng.randint(1, 400)) for i in range(60)]
    return rows + [(None, "null id"), (None, "null id"), (5000, "null id"), (7, "twin"), (7, "twin"), (None, None)]


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_groups_equal_brute_force(frame):
    rows = corpus()
    got = exact.find_copies(frame(rows))
    assert rows_of(got) == brute(rows)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_one_byte_digests_collide_and_are_resolved(frame):
    rows = corpus()[:200] + [(9000 + i, f"{i}") for i in range(600)]
    assert rows_of(exact.find_copies(frame(rows), digest=1)) == brute(rows)


def test_drop_keeps_one_row_of_each_text(frame):
    rows = corpus()
    df = frame(rows)
    kept = exact.drop_copies(df)
    assert kept.schema == df.schema
    want = {}
    for d, t in rows:
        old = want.get(t or "", None)
        want[t or ""] = d if old is None else max(d, old) if d is not None else old
    assert sorted(((r.text or "", r.doc_id) for r in kept.collect()), key=repr) == sorted(want.items(), key=repr)


def test_empty_table(frame):
    df = frame([(1, "x")]).limit(0)
    assert exact.find_copies(df).count() == 0
    assert exact.drop_copies(df).count() == 0


def test_cuts_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3 * exact.BLOCK // 2))
    whole = exact.chunks(data)
    assert b"".join(whole) == data
    assert all(exact.LEAST <= len(c) <= exact.MOST for c in whole[:-1])
    assert 500 < len(data) / len(whole) < 2500
    moved = exact.chunks(b"some bytes in front" + data)
    assert len(set(whole) & set(moved)) > 0.99 * len(whole)  # a shift changes the first chunks only
    assert exact.chunks(b"") == [] and exact.chunks(b"a") == [b"a"]
    assert b"".join(exact.chunks(b"a" * 100_000)) == b"a" * 100_000
