"""Best-fit packing: whole-text tokenizing as the yardstick, gapless sequences, plan against single best fit."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ratewise.llm import packing
from ratewise.llm.common import words
from ratewise.llm.tokens import default_path, encoder


def whole_ids(texts):
    t = Tokenizer.from_file(default_path())
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df, rows, size):
    got = packing.pack(df, size).collect()
    want = []
    for (d, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert not room or max(room.values()) <= size
    return len(room), sum(room.values())


def test_documents(frame, sample):
    rows = [r[:2] for r in sample]
    n, total = check(frame(rows), rows, packing.SIZE)
    assert n <= -(-total // packing.SIZE) + 1


def test_edges(frame):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "same"), (3, "same"), (4, "w " * 30_000), (5, "a" * 50_000), (6, "Σίσυφος 中文 ﬁ ½")]
    check(frame(rows), rows, 4096)
    check(frame(rows), rows, 7)
    assert packing.pack(frame(rows).limit(0)).count() == 0


def single_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return len(rooms), sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_equals_best_fit_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.plan(counts, 20).tolist()
    rooms = {}
    for n, total in counts.items():
        own = sorted(r for r in rows if r[0] == n)
        for rank in range(total):
            _, first_rank, first, per, at = max(r for r in own if r[1] <= rank)
            seq, offset = first + (rank - first_rank) // per, at + (rank - first_rank) % per * n
            rooms.setdefault(seq, set()).update(range(offset, offset + n))
    assert sum(map(len, rooms.values())) == sum(lengths)
    assert (len(rooms), sorted(20 - len(r) for r in rooms.values())) == single_best_fit(lengths, 20)
    assert all(r == set(range(len(r))) for r in rooms.values())


def test_plan_cost_does_not_follow_the_counts():
    counts = {n: 1000 + n % 37 for n in range(1, 4097)}
    small, large = len(packing.plan(counts)), len(packing.plan({n: 10**9 * c for n, c in counts.items()}))
    assert large < 3 * small


def test_words_give_the_ids_of_the_text():
    rng, enc = random.Random(2), encoder(default_path())
    letters = list("abzABZ's't'll09 \t\n.,!#é É ßÀÿ÷×Σσİı中文́ \x1c ½²<|>ﬁǆ")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "", "  ", "a" * 1000, "don't we'll I'd"]:
        assert np.frombuffer(enc.encode(words(t.encode())), np.uint32).tolist() == enc.whole.encode(t, add_special_tokens=False).ids


def test_special_strings_as_the_untouched_tokenizer_reads_them():
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(default_path()), encoder(default_path())
    texts = ["a <|endoftext|> b", "<|startoftext|><|endoftext|>", "x<|endoftext|>y's", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext", "|> <| <|endoftext|", "<|endoftext|>" * 3,
             "<<|endoftext|>>", "É <|startoftext|> é", "<|end oftext|>", "no mark", "", " ", "1<|startoftext|>2 ½<|endoftext|>\u0301"]
    for t in texts:
        assert np.frombuffer(enc.encode_text(t.encode()), np.uint32).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    rng = random.Random(3)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", " ", "word", "Ünï", "don't", "\n", "7"]
    for _ in range(500):
        t = "".join(rng.choices(marks, k=rng.randint(1, 8)))
        assert np.frombuffer(enc.encode_text(t.encode()), np.uint32).tolist() == plain.encode(t, add_special_tokens=False).ids, t
