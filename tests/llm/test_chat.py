"""Chat formatting: read-back digests against the source rows, and parser properties."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "]", " ", "a", "\n", "<\\s>", "[\\", "é", "/", "s>", "INST]"]), max_size=12).map("".join)


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, chat.render(role, text)[0], role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode()))
        loss = "".join(t[4] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), sum(len(t[2]) for t in turns))
    return out


def check(spark, rows):
    df = spark.createDataFrame([r + ("x",) for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3)
    got = chat.format_report(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    assert len(got) == len(expected(rows))


def test_rows_read_back(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "assistant", ""),
            (2, 0, "user", None), (2, 1, None, "no role"), (2, 2, "assistant", chat.PROBE), (2, 2, "assistant", chat.PROBE),
            (None, None, "tool", "[ROLE]x[NAME] y [/ROLE]"), (None, 1, "user", "\\<\\s>"), (3, 5, "assistant", " </s> " * 3),
            (4, 0, "we[NAME] ird", "x"), (5, 0, "user", "w " * 200_000)]
    check(spark, rows)


def test_given_conversations_and_probe(spark):
    df = chat.with_probe(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    rows = [tuple(r) for r in df.collect()]
    got = chat.format_report(df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    probe = next(r for r in got if r.conv_id == -1)
    assert probe.loss_chars == len(chat.PROBE)
    assert probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()


def test_empty_table(spark):
    assert chat.format_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_plain_texts_are_left_alone():
    assert chat.render("user", "a [b] <c> \\n")[0] == "<s>[INST] a [b] <c> \\n [/INST]"
    assert "</s>" not in chat.render("assistant", "</s>")[0][:-5]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=4))
def test_any_turns_come_back_from_the_joined_text(turns):
    whole = "".join(chat.render(r, t)[0] for r, t in turns)
    assert (chat.read_back(whole) or []) == turns
    parser = chat.Parser()  # also in small pieces
    assert [x for c in whole for x in parser.feed(c)] == turns
