import re
from collections import Counter

import numpy as np
import pyarrow as pa

from ratewise.llm import phrases

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, top=2000):
    f = Counter()
    n = Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = {}
    inside = Counter()
    for (lang, ws), a in f.items():
        if len(ws) == 3 and a >= 10:
            for part in (ws[:2], ws[1:]):
                inside[lang, part] = max(inside[lang, part], a)
    for (lang, ws), a in f.items():
        if len(ws) > 1 and a >= 10 and not (inside[lang, ws] and 100 * inside[lang, ws] >= 50 * a):
            cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s)
                  for lang, own in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def mine(df):
    return sorted(map(tuple, phrases.mine(df).collect()))


HARD = [(i, "New York City, big Ünion\tjack. New  York? it is so!it is", "en") for i in range(12)]
HARD += [(i, "alpha beta gamma\x0balpha beta\x0cbeta alpha. " * 3, None) for i in range(4)]
HARD += [(1, "alpha beta delta" * 9, "und"), (None, None, "en"), (2, "", None), (3, "...,,,", "fr"), (3, "x" * 700 + " " + "y" * 700, "de")]
HARD += [(4, ("x" * 700 + " " + "y" * 700 + " z\n") * 11, "de")] * 2 + [(5, "a\x00b c\x1fd a\x00b c\x1fd. " * 20, "en")]


def test_equals_brute_force_on_documents(frame, sample):
    got = mine(frame(sample))
    assert len(got) > 50
    assert got == brute(sample)


def test_hard_rows(frame):
    got = mine(frame(HARD))
    assert got == brute(HARD)
    assert {r[0] for r in got} == {"en", "und", "de"}


def test_top_of_each_lang(frame, sample, monkeypatch):
    monkeypatch.setattr(phrases, "TOP", 7)
    assert mine(frame(sample)) == brute(sample, 7)


def test_empty_table(frame):
    assert phrases.mine(frame(HARD).limit(0)).count() == 0


def test_permutation_is_invertible():
    rng = np.random.default_rng(1)
    for width in (2, 3):
        x = [rng.integers(0, 2**64, 1000, np.uint64) for _ in range(width)]
        x[0][:10] = 0
        y = phrases.permute(x)
        assert not any((a == b).all() for a, b in zip(x, y, strict=True))
        assert all((a == b).all() for a, b in zip(x, phrases.restore(y), strict=True))


def test_filters_are_lossless():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 100, 5000):
        for cut, which in ((10, 5), (10, 1023), (20, 7)):
            first = rng.integers(0, 2**(64 - cut), n, np.uint64) | np.uint64(which << (64 - cut))
            x = [first, rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)]
            counts = rng.choice([1, 2, 254, 255, 256, 10**12], n)
            x, counts = phrases.combine(x, counts)
            data = phrases.encode_filter(x, counts, cut)
            back, again = phrases.decode_filter(data, which)
            assert all((a == b).all() for a, b in zip(x, back, strict=True)) and (counts == again).all()
            assert len(data) < 24 * n + 8 * (counts >= 255).sum() + 30


def test_entries_with_one_first_lane_stay_apart():
    x = [np.array([7, 7, 7, 7, 3], np.uint64), np.array([2, 1, 2, 1, 9], np.uint64)]
    lanes, counts = phrases.combine(x, np.array([1, 10, 100, 1000, 5]))
    assert list(zip(lanes[0].tolist(), lanes[1].tolist(), counts.tolist(), strict=True)) == [(3, 9, 5), (7, 1, 1010), (7, 2, 101)]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows], pa.string()), pa.array([r[1] or "" for r in rows], pa.string())], names=["lang", "text"])


def test_chunks_of_long_texts_change_nothing(monkeypatch):
    """Cut between pieces; a piece longer than a chunk stays whole."""
    rows = [(0, "one two three. four five, " * 40 + "a very long piece " * 30 + ".end here", "en"), (1, "short", "fr")]

    def words():
        return [(w.word(i), int(w.ids[i])) for w, _ in phrases.chunks(iter([_batch(rows)]), 0) for i in range(len(w.ids))]

    def joined():
        return sum(int(w.joined.sum()) for w, _ in phrases.chunks(iter([_batch(rows)]), 0))

    whole, pairs = words(), joined()
    monkeypatch.setattr(phrases, "CHUNK", 50)
    assert words() == whole and joined() == pairs
    assert len(list(phrases.chunks(iter([_batch(rows)]), 0))) > 10


def test_words_of_one_id_are_noticed(monkeypatch):
    """With ids of three bits words clash within a task; each still has a row of its own."""
    old = phrases.mix
    monkeypatch.setattr(phrases, "mix", lambda x: old(x) & np.uint64(7))
    text = " ".join(f"w{i % 40}" for i in range(400))
    got = Counter()
    for b in phrases._count_words(0)(iter([_batch([(0, text, "en")])])):
        for r in b.to_pylist():
            got[r["word"]] += r["n"]
    assert got == Counter(text.split()) + Counter({"": 400})


def test_another_seed_where_words_clash(frame, monkeypatch):
    """The first seed gives all words of a length one id: the vocabulary starts again."""
    plain = phrases._count_words

    def clashing(seed):
        def run(batches):
            for b in plain(seed)(batches):
                if seed == 0:
                    b = b.set_column(0, "id", pa.array([len(w) for w in b.column("word").to_pylist()], pa.int64()))
                yield b

        return run

    monkeypatch.setattr(phrases, "_count_words", clashing)
    assert mine(frame(HARD)) == brute(HARD)


def test_full_bit_maps_change_nothing(frame, sample, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", (64, 64))
    monkeypatch.setattr(phrases, "HELD", 100)
    assert mine(frame(sample)) == brute(sample)
