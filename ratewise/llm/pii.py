"""Personal data by weak supervision.

1. Candidates.  Exact rules give the base spans (email, ip, card, phone); looser
   rules give further candidates: base matches that failed their check, phone numbers
   without a plus, spelled-out addresses, national ids, credentials.
2. Votes.  Five labelers vote yes, no or nothing on every candidate: strict shape
   (regex with its check), loose shape (regex), gazetteer (known prefixes, domains and
   key names), context (words next to it), and randomness of its characters.
3. Reliabilities.  Expectation-maximisation over the counts of (kind, votes) estimates
   how often each labeler is right when the truth is yes and when it is no.  There are
   at most 3^5 vote patterns for each kind, so the driver sees a table of bounded size
   made from all candidates.
4. Final classifier.  A logistic regression on votes, kind, and binned length and digit
   share is fitted to the posteriors, again on counts, and scores every candidate.
   Spans it accepts are added unless they overlap a base span; base spans always stay.

Null text counts as empty.  Very long texts are scanned in one pass per rule, without
rules that could backtrack over a long run.  Rows may repeat, doc_id may be null, an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.llm.common import only, settle

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = KINDS[:4]
LABELERS = ("strict", "loose", "gazetteer", "context", "random")
ACCEPT = 0.5
SWEEPS = 50

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[0-9A-Za-z_]{12,}")
LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SPELLED = re.compile(r"[\[(](?:at|AT)[\])]")
SPELLED_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
SPELLED_RIGHT = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63})+")

# Gazetteers of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info example".split())
KEY_NAMES = ("password", "passwd", "token", "secret", "apikey", "api_key", "akia", "bearer", "private")
CUES = {
    "email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"), "phone": ("call", "phone", "tel", "fax", "mobile"),
    "id": ("ssn", "social", "passport", "tax", "id "), "secret": ("password", "passwd", "token", "key", "secret", "=", ":"),
}
REACH = 24

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each at sign outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append(("email", start, tail.end()))
            done = tail.end()
        # A run that led to no match is never walked again: the next one stops behind this sign.
        at = text.find("@", max(done, at + 1))
    return out


def ips(text: str) -> tuple[list[Span], list[Span]]:
    """Four dotted numbers: those with parts up to 255, and the others."""
    good, bad = [], []
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            n = sum(map(len, four)) + 3
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four)
            (good if ok else bad).append(("ip", at, at + n))
            at += n + 1
    return good, bad


def cards(text: str) -> tuple[list[Span], list[Span]]:
    good, bad = [], []
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19:
            (good if luhn(d) else bad).append(("card", m.start(), m.end()))
    return good, bad


def phones(text: str) -> tuple[list[Span], list[Span]]:
    good, bad = [], []
    for m in PHONE.finditer(text):
        n = sum(c.isdigit() for c in m.group())
        (good if 9 <= n <= 15 else bad).append(("phone", m.start(), m.end()))
    return good, bad


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind as listed."""
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        found += ips(text)[0] + cards(text)[0] + (phones(text)[0] if "+" in text else [])
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def loose_spans(text: str) -> list[tuple[Span, bool]]:
    """Further candidates, each with whether its strict shape holds."""
    out: list[tuple[Span, bool]] = []
    for m in SPELLED.finditer(text):
        left = SPELLED_LEFT.search(text[max(0, m.start() - 66):m.start()])
        right = SPELLED_RIGHT.match(text, m.end())
        if left and right:
            out.append((("email", m.start() - len(left.group()), right.end()), True))
    if not DIGIT.search(text):
        return out
    out += [(s, False) for s in ips(text)[1] + cards(text)[1] + (phones(text)[1] if "+" in text else [])]
    out += [(("phone", m.start(), m.end()), True) for m in LOOSE_PHONE.finditer(text)]
    out += [(("id", m.start(), m.end()), True) for m in NATIONAL.finditer(text)]
    for m in TOKEN.finditer(text):
        word = m.group()
        digits = len(DIGIT.findall(word))
        if digits and digits < len(word):
            strict = len(word) >= 16 and (re.fullmatch(r"[0-9a-f]+|AKIA[0-9A-Z]{16}", word) is not None)
            out.append((("secret", m.start(), m.end()), strict))
    return out


def votes(text: str, span: Span, strict: bool) -> str:
    """One letter per labeler: y, n or - (no vote)."""
    kind, start, end = span
    body = text[start:end]
    before = text[max(0, start - REACH):start].lower()
    digits = "".join(c for c in body if c.isdigit())
    if kind == "email":
        known = body.rstrip(")]").rsplit(".", 1)[-1].lower() in TOP_DOMAINS or "dot" in body.lower()
        rnd = "-"
    elif kind == "ip":
        known, rnd = not body.startswith(("0.", "127.", "255.")), "y" if len(set(body)) > 3 else "n"
    elif kind == "card":
        known, rnd = body[0] in "3456", "y" if len(set(digits)) > 4 else "n"
    elif kind == "phone":
        known, rnd = len(digits) in (10, 11, 12), "y" if len(set(digits)) > 3 else "n"
    elif kind == "id":
        known, rnd = not body.startswith(("000", "666", "9")), "y" if len(set(digits)) > 3 else "n"
    else:
        known = body.startswith("AKIA") or any(k in before for k in KEY_NAMES)
        counts = Counter(body)
        bits = -sum(n / len(body) * math.log2(n / len(body)) for n in counts.values())
        rnd = "y" if bits >= 3 else "n"
    cue = any(c in before for c in CUES[kind])
    return ("y" if strict else "n") + "y" + ("y" if known else "n") + ("y" if cue else "-") + rnd


def bins(text: str, span: Span) -> int:
    """Length and digit share of a candidate, in 4 x 4 bins."""
    body = text[span[1]:span[2]]
    share = len(DIGIT.findall(body)) / len(body)
    return 4 * min(3, len(body) // 12) + min(3, int(4 * share))


CANDIDATE = "struct<kind:string,s:int,e:int,votes:string,bin:int,base:boolean>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, cand): the candidates of every document with votes and bins."""
    kind = f"doc_id long, cand array<{CANDIDATE}>"
    shape = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("votes", pa.string()), ("bin", pa.int32()), ("base", pa.bool_())]))

    def one(text: str) -> list[dict]:
        base = base_spans(text)
        rows = [(s, True, True) for s in base] + [(s, strict, False) for s, strict in loose_spans(text)]
        return [{"kind": s[0], "s": s[1], "e": s[2], "votes": votes(text, s, strict), "bin": bins(text, s), "base": b} for s, strict, b in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([one(t or "") for t in batch.column("text").to_pylist()], shape)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "cand"])

    return only(docs, "doc_id", "text").mapInArrow(run, kind)


def reliabilities(counts: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], float], dict]:
    """EM over (kind, votes) counts: posterior of yes for each, and the parameters.

    Labelers are independent given the truth; each kind has its own prior.  Counts are
    smoothed towards labelers that are right more often than not, which also fixes
    which of the two classes means yes."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    vote = np.array([["n-y".index(c) for c in v] for _, v in keys]).reshape(len(keys), len(LABELERS))
    kind = np.array([KINDS.index(k) for k, _ in keys], int)
    right = np.where((vote == 2).sum(1) > (vote == 0).sum(1), 0.9, 0.2)
    prior_yes, prior_no = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0])
    for _ in range(SWEEPS):
        share = np.array([(1 + (n * right)[kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        table = np.empty((2, len(LABELERS), 3))
        for j in range(len(LABELERS)):
            for v in range(3):
                hit = vote[:, j] == v
                table[0, j, v] = prior_no[v] + (n * (1 - right))[hit].sum()
                table[1, j, v] = prior_yes[v] + (n * right)[hit].sum()
        table /= table.sum(2, keepdims=True)
        like = np.log(table)[:, np.arange(len(LABELERS))[None], vote].sum(2) if len(keys) else np.zeros((2, 0))
        odds = np.log(share / (1 - share))[kind] + like[1] - like[0]
        right = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, right.tolist(), strict=True)), {"share": share, "table": table}


def features(kind: str, vote: str, bin_: int) -> list[int]:
    """Active features of a candidate: kind, votes, votes by kind, bins."""
    k = KINDS.index(kind)
    own = ["n-y".index(c) for c in vote]
    at = [k] + [len(KINDS) + 3 * j + v for j, v in enumerate(own)]
    at += [len(KINDS) + 15 + 15 * k + 3 * j + v for j, v in enumerate(own)]
    return at + [len(KINDS) + 15 + 15 * len(KINDS) + bin_]


WIDTH = len(KINDS) + 15 + 15 * len(KINDS) + 16


def fit(rows: list[tuple[str, str, int, int]], posterior: dict[tuple[str, str], float]) -> np.ndarray:
    """Logistic regression on soft labels; rows (kind, votes, bin, count)."""
    w = np.zeros(WIDTH)
    if not rows:
        return w
    x = np.zeros((len(rows), WIDTH))
    for i, (k, v, b, _) in enumerate(rows):
        x[i, features(k, v, b)] = 1
    y = np.array([posterior[k, v] for k, v, _, _ in rows])
    weight = np.array([float(c) for *_, c in rows])
    weight /= weight.sum()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (weight * (p - y)) + 1e-5 * w)
    return w


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the counts of all candidates."""
    c = found.select(F.explode("cand").alias("c")).select("c.kind", "c.votes", "c.bin")
    rows = [(r["kind"], r["votes"], r["bin"], r["n"]) for r in c.groupBy("kind", "votes", "bin").agg(F.count(F.lit(1)).alias("n")).collect()]
    rows.sort()
    counts: Counter = Counter()
    for k, v, _, n in rows:
        counts[k, v] += n
    return fit(rows, reliabilities(dict(counts))[0])


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _disjoint(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that ``spans`` cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def choose(found: DataFrame, w: np.ndarray) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [f.split()[0] for f in kind.split(", ")]

    def one(cand: list[dict]) -> tuple:
        base = [(c["kind"], c["s"], c["e"]) for c in cand if c["base"]]
        rest = [(float(w[features(c["kind"], c["votes"], c["bin"])].sum()), (c["kind"], c["s"], c["e"])) for c in cand if not c["base"]]
        spans, (starts, ends) = list(base), _disjoint(base)
        for score, span in sorted(rest, key=lambda x: (-x[0], x[1][1], x[1][0])):
            if 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))) >= ACCEPT:
                at = bisect_left(starts, span[2])  # the intervals before it start before the span ends
                if not at or ends[at - 1] <= span[1]:
                    spans.append(span)
                    starts.insert(at, span[1])
                    ends.insert(at, span[2])
        n = Counter(k for k, _, _ in base)
        return (*[n[k] for k in BASE], hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = list(zip(*[one(c) for c in batch.column("cand").to_pylist()], strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return found.mapInArrow(run, kind)


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = settle(candidates(docs), "candidates")
    return choose(found, train(found))
