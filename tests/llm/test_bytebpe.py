import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import bytebpe


@pytest.fixture(scope="module")
def brute():
    """The tiktoken library over the same ranks."""
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bytebpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(bytebpe.codec().encode(text), "<u4").tolist()


HARD = ["", " ", "  two  gaps ", "it's we'll I'D", "a\x00b\x1c\x1f\x7f", "x" * 5000, "ab" * 3000 + "!" * 700, "▁▁ ▁a",
        "<|endoftext|> <unk> <s> </s> ?", "Ünïcödé ß 漢字かな ไทย \U0001f600\U0001f468‍\U0001f469", "1234567890 ½ ² ٣", "\r\n\t\n  　 a b",
        "Ā ā ǿ Āǿ", " \n\n  def f(x):\n\treturn x\n", "﻿bom", "é ́"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts_equal_tiktoken(brute, text):
    assert ids_of(text) == brute.encode_ordinary(text)
    assert bytebpe.codec().decode(bytebpe.codec().encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs", "Cn"]), st.sampled_from(" \n\t'sdlrevm019azAZéß!<|>")), max_size=60))
def test_any_text_equals_tiktoken(brute, text):
    got = ids_of(text)
    assert got == brute.encode_ordinary(text)
    assert bytebpe.codec().decode(np.array(got, "<u4").tobytes()) == text.encode()


def test_every_token_alone(brute):
    own = bytebpe.codec()
    for rank, data in enumerate(own.bytes_of):
        assert brute.decode_single_token_bytes(rank) == data


def test_blocks_of_long_texts(brute, monkeypatch):
    text = " ".join(f"word{i}  x\n" for i in range(500))
    monkeypatch.setattr(bytebpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bytebpe, "BLOCK", 7)
    assert len(list(bytebpe.codec().blocks(text))) > 100
    assert ids_of(text) == brute.encode_ordinary(text)


def test_memo_generations_change_nothing(brute, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT", 50)
    own = bytebpe.Codec(bytebpe.default_path())
    for i in range(60):
        text = f"number {i} and {i * 7919} or word{i % 9}"
        assert np.frombuffer(own.encode(text), "<u4").tolist() == brute.encode_ordinary(text)
    assert len(own.young) <= 60


def test_whole_tokens_that_merging_misses(tmp_path):
    """A vocabulary whose longest token no chain of merges reaches: the match as a whole counts."""
    words = [bytes([b]) for b in range(256)] + [b"bc", b"abcd"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    own = bytebpe.Codec(str(path))
    assert own.whole == {b"abcd": 257}
    assert np.frombuffer(own.encode("abcd abcde"), "<u4").tolist() == [257, 32, 97, 256, 100, 101]


def test_incomplete_vocabularies_are_refused(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        bytebpe.Codec(str(path))


def test_documents(spark, frame, sample, brute):
    rows = [(d, t) for d, t, *_ in sample] + [(-1, None), (None, ""), (7, "same"), (7, "same"), (9, "y" * 300_000)]
    got = bytebpe.round_trip(frame(rows))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d, t in rows:
        ids = brute.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_columns_and_empty_table(spark, frame):
    df = frame([(1, "Some text"), (2, None)])
    both = bytebpe.decode(bytebpe.encode(df)).collect()
    assert {(r.doc_id, len(r.ids) > 0, bytes(r.decoded)) for r in both} == {(1, True, b"Some text"), (2, False, b"")}
    assert bytebpe.round_trip(df.limit(0)).count() == 0
