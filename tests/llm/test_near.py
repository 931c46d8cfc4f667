"""Near duplicates against all pairs and union-find on small inputs."""

import random

from ratewise.llm import near


def brute(rows, percent=85, width=5):
    sets = []
    for _, text in rows:
        ws = (text or "").encode().lower().split()
        w = min(width, len(ws))
        sets.append({tuple(ws[i:i + w]) for i in range(len(ws) - w + 1)} if ws else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted(((d, len(sets[i]), smallest.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, ws, n, vocab):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(vocab)
    return ws


def small_corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    rows, doc = [], 0

    def add(ws):
        nonlocal doc
        rows.append((doc * 7 % 1009, " ".join(ws)))
        doc += 1

    for _ in range(6):
        base = rng.choices(vocab, k=rng.randint(80, 300))
        for _ in range(12):
            add(edited(rng, base, rng.randint(0, 3), vocab))
    base = rng.choices(vocab, k=120)
    for k in range(14):  # a chain: neighbours are linked, ends are not
        base = edited(rng, base, 1, vocab)
        add(base)
    for _ in range(40):  # a passage that many documents share
        add(rng.choices(vocab, k=50) + passage + rng.choices(vocab, k=50))
    rows += [(900, ""), (901, None), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"),
             (906, "a b c d e"), (907, "a b c d e a b c d e a b c d e"), (None, "null id words here now ok"), (None, "x")]
    return rows


def test_components_equal_all_pairs(frame):
    rows = small_corpus()
    got = near.find_near(frame(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_real_documents(frame, sample):
    rows = [r[:2] for r in sample]
    got = near.find_near(frame(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_drop_keeps_one_row_of_each_component(frame):
    rows = small_corpus() + [(3, "same row twice " * 9)] * 5
    df = frame(rows)
    kept = near.drop_near(df)
    assert kept.schema == df.schema
    by_text = {(r.doc_id, r.text) for r in kept.collect()}
    want = brute(rows)
    comps = {c for _, n, c in want if n and c is not None}
    loose = sum(1 for _, n, c in want if n == 0 or c is None)
    assert kept.count() == len(comps) + loose
    assert len(by_text) == kept.count()
    assert near.drop_near(kept).count() == kept.count()


def test_empty_table(frame):
    df = frame([(1, "x")]).limit(0)
    assert near.find_near(df).count() == 0
    assert near.drop_near(df).schema == df.schema


def test_a_large_group_of_near_copies_costs_no_square(frame, spark):
    """Posting lists of a thousand near copies: star pairs stay linear, nothing is left open."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocab, k=200)
    rows = [(i, " ".join(edited(rng, base, 1, vocab))) for i in range(1000)]
    df = frame(rows)
    signed = near.with_signatures(df.select("doc_id", "text")).cache()
    cls = near.classes(signed).cache()
    posts = near.prefixes(cls).cache()
    assert near.star_pairs(posts).count() < 12 * 1000
    assert {r.component_id for r in near.find_near(df).collect()} == {0}


def test_shingle_rules():
    assert len(near.shingles(None)) == len(near.shingles(b" \t")) == 0
    assert len(near.shingles(b"a b")) == len(near.shingles(b"A b c d e")) == 1
    assert len(near.shingles(b"a " * 100_000)) == 1
    assert near.signature(near.shingles(" ".join(map(str, range(50_000))).encode())).shape == (near.K,)


def test_other_percentages(frame):
    """The thresholds follow the percentage."""
    assert (near.MATCHES, near.FINE_MATCHES) == (92, 401)
    rows = small_corpus()
    for percent in (70, 80, 95):
        got = near.find_near(frame(rows), percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, percent)


def test_null_and_repeated_ids_meet_their_own_text_only(frame):
    """Different texts under one id, or without any, join with as many rows as there are."""
    rows = [(None if i % 2 else 7, " ".join(f"w{i}x{j}" for j in range(30)) + " shared tail of five words") for i in range(120)]
    df = frame(rows)
    signed = near.settle(near.with_signatures(near.only(df, "doc_id", "text")).drop("text"), "signatures")
    cls = near.classes(signed)
    sets = near.full_sets(df, cls.select("cid", "rep_id", "rep_txt", "set"))
    plan = sets._jdf.queryExecution().analyzed().toString()
    assert "xxhash64" in plan and sets.count() == 120
    texts = near.only(df, "doc_id", "text").join(cls, near.F.col("doc_id").eqNullSafe(near.F.col("rep_id")) & (near.F.xxhash64("text") == near.F.col("rep_txt")))
    assert texts.count() == 120
    assert len(near.find_near(df).collect()) == 120
