"""Mixing: targets against plain water filling, taken words near them, reruns, edges."""

from ratewise.llm import mixing


def fill(sizes, share=1.5, most=2):
    """Targets by resharing the excess until none is above its ceiling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * w[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def size(text):
    return len((text or "").encode().split())


def check(df, rows):
    got = mixing.mix_report(df).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = fill(sizes)
    source_of = {}
    for d, text, _, source in rows:
        source_of.setdefault((d, size(text)), []).append(source)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        options = source_of[r.doc_id, r.size]
        s = next(x for x in options if sizes[x] == r.source_size and abs(want[x] - r.target) < 1e-6 * max(1, r.target))
        taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= len(sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    return sorted(map(tuple, got), key=repr)


def corpus(sample):
    rows = [(d, t, lang, None if d % 11 == 0 else source) for d, t, lang, source in sample]
    return rows + [(None, "three words here", None, "z"), (1, None, None, "empty"), (2, "", None, None), (5, "twin " * 50, None, "a"), (5, "twin " * 50, None, "a")]


def test_targets_and_taken(frame, sample):
    rows = corpus(sample)
    first = check(frame(rows), rows)
    for parts in (1, 3, 7):
        again = sorted(map(tuple, mixing.mix_report(frame(rows, parts=parts)).collect()), key=repr)
        assert again == first


def test_mixed_documents_do_not_follow_the_layout(frame, sample):
    rows = corpus(sample) + [(5, "twin " * 50, None, "a")] * 30 + [(6, "tie one two", None, "b"), (7, "tie one two", None, "b")]
    seen = [sorted((map(repr, mixing.mix(frame(rows, parts=parts)).collect()))) for parts in (1, 4, 9)]
    assert seen[0] == seen[1] == seen[2]
    report = [sorted(map(repr, mixing.mix_report(frame(rows[::-1], parts=parts)).collect())) for parts in (1, 5)]
    assert report[0] == report[1]


def test_equal_rows_are_numbered_once(frame):
    rows = [(1, "same words", None, "s")] * 40 + [(2, "other", None, "s")]
    sized = mixing.settle(mixing.sizes(frame(rows, parts=6)), "test-sizes")
    got = sorted((r.doc_id, r.nth) for r in mixing.numbered_copies(sized).collect())
    assert got == [(1, i) for i in range(40)] + [(2, 0)]


def test_one_huge_source(frame):
    rows = [(i, "w " * (i % 50 + 1), None, "big") for i in range(500)] + [(1000 + i, "x y z", None, f"s{i % 4}") for i in range(40)]
    check(frame(rows), rows)


def test_mix_returns_documents(frame, sample):
    rows = corpus(sample)
    df = frame(rows)
    mixed = mixing.mix(df)
    assert mixed.schema == df.schema
    got = mixed.collect()
    text_of = {(r[0], r[3]): r[1] for r in rows}
    for r in got:
        assert text_of[r.doc_id, r.source].startswith(r.text)
    report = mixing.mix_report(df).collect()
    assert sum(size(r.text) for r in got) == sum(r.taken for r in report)
    whole = sum(r.text == text_of[r.doc_id, r.source] for r in got)
    assert len(got) - whole <= 2 * len({r[3] for r in rows})


def test_empty_tables(frame):
    df = frame([(1, "x", None, "s")]).limit(0)
    assert mixing.mix_report(df).count() == 0 and mixing.mix(df).count() == 0
    only_empty = frame([(1, None, None, "s"), (2, " ", None, None)])
    assert [r.taken for r in mixing.mix_report(only_empty).collect()] == [0, 0]
    assert mixing.mix(only_empty).count() == 0
