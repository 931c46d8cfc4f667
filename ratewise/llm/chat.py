"""Chat formatting checked by a grammar round trip.

A turn becomes a self-delimiting segment; a conversation is its segments in order:

    user        <s>[INST] text [/INST]
    assistant    text </s>                     (one space before; the text is the loss span)
    other role  <s>[ROLE]role[NAME] text [/ROLE]

Each segment is parsed again by a deterministic parser.  If role and text don't come
back identical, the conflicting content is escaped and the segment rendered anew: first
only control strings, then every opening bracket.  Escaping puts a backslash behind
``<`` or ``[``; reading back removes one backslash there, always, so a text that has
one already is itself a conflict and gets another.  The last level can't fail: no
opening bracket is left that could start a control string.

Rendering and checking run turn by turn wherever the rows are.  For the order, segments
are dealt by conversation and sorted; a task then streams through them with a parser and
running digests, so even a conversation with a third of all rows needs memory for one
turn only (a digest over ordered text can't be cut into parallel parts).

Null text or role counts as empty; null conv_id is one conversation; turns are ordered
by turn (null first), ties by segment, and repeated rows are turns of their own.  An
empty table gives an empty result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import only

# The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NAME]")
SOME = re.compile(r"([<\[])(?=" + "|".join([re.escape(c[1:]) for c in CONTROLS] + [r"\\"]) + ")")
ANY = re.compile("|".join(map(re.escape, CONTROLS)))
EVERY = re.compile(r"([<\[])")
BACK = re.compile(r"([<\[])\\")

SEGMENT = "conv_id long, turn long, segment string, loss_start int, loss_end int"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: str, level: int) -> str:
    return text if level == 0 else (SOME if level == 1 else EVERY).sub(r"\1\\", text)


def unescape(text: str) -> str:
    return BACK.sub(r"\1", text)


def lay_out(role: str, text: str) -> tuple[str, int, int]:
    """Segment of an escaped turn, and where its loss span starts and ends (equal: none)."""
    if role == "user":
        return f"<s>[INST] {text} [/INST]", 0, 0
    if role == "assistant":
        return f" {text} </s>", 1, 1 + len(text)
    return f"<s>[ROLE]{role}[NAME] {text} [/ROLE]", 0, 0


class Parser:
    """Reads turns from formatted text, given in pieces; stops at text that is no turn."""

    def __init__(self) -> None:
        self.text = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.text += piece
        while (got := self._turn()) is not None:
            yield got

    def _turn(self) -> tuple[str, str] | None:
        t = self.text
        for head, tail in (("<s>[INST] ", " [/INST]"), ("<s>[ROLE]", " [/ROLE]"), (" ", " </s>")):
            if t.startswith(head):
                end = t.find(tail, len(head))
                if end < 0:
                    return None
                body, self.text = t[len(head):end], t[end + len(tail):]
                role, mark, text = body.partition("[NAME] ") if head == "<s>[ROLE]" else ("", "", body)
                if ANY.search(role) or ANY.search(text):  # no text may hold a bare control string
                    self.text = t
                    return None
                if head == " ":
                    return "assistant", unescape(body)
                if head == "<s>[INST] ":
                    return "user", unescape(body)
                return unescape(role), unescape(text)
        return None

    def rest(self) -> str:
        return self.text


def read_back(segment: str) -> list[tuple[str, str]] | None:
    """The turns of a segment, or None if something is left over."""
    parser = Parser()
    turns = list(parser.feed(segment))
    return None if parser.rest() else turns


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The segment of a turn at the lowest escape level that reads back identical."""
    role, text = role or "", text or ""
    for level in (0, 1, 2):
        got = lay_out(role if role in ("user", "assistant") else escape(role, level), escape(text, level))
        if read_back(got[0]) == [(role, text)]:
            return got
    raise AssertionError(f"a turn can't be read back: {role!r}")


def segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) of every turn, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            seg, start, end = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(seg, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                names=[f.split()[0] for f in SEGMENT.split(", ")])

    typed = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return typed.mapInArrow(run, SEGMENT)


def in_order(segs: DataFrame) -> DataFrame:
    """Segments dealt by conversation, in order inside each task."""
    return segs.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.parser = conv_id, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int, end: int) -> None:
        self.chars += len(segment)
        for role, text in self.parser.feed(segment):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if end > start or segment.startswith(" "):
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.parser.rest():
            raise AssertionError(f"conversation {self.conv_id} can't be read back")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_conversations(ordered: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text gives when it is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        rows: list[tuple] = []
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end")]
            for conv_id, segment, start, end in zip(*cols, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(conv_id)
                now.add(segment, start, end)
            if rows:
                yield _result(rows)
                rows = []
        if now is not None:
            yield _result([now.row()])

    return ordered.mapInArrow(run, RESULT)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus number -1, whose texts look like the template itself."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return only(conversations, "conv_id", "turn", "role", "text").unionByName(probe)


def format_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return read_conversations(in_order(segments(conversations)))
