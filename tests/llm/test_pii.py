"""Base spans against the plain patterns, and the method on planted credentials."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["@", ".", "a", "b.c", "+", "1", "23", "256", " ", "-", "(", ")", "é", "4111 1111-1111 1111", "10.0.0.1", "x@y.zz", "\n", "%"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def report(frame, rows):
    return {r.doc_id: r for r in pii.find_private(frame(rows)).collect()}


def test_documents(frame, sample):
    rows = [r[:2] for r in sample]
    got = report(frame, rows)
    assert len(got) == len(rows)
    for doc, text in rows:
        base = plain(text)
        r = got[doc]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in PATTERNS)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans)
        if not re.search("[0-9@]", text):
            assert r.spans == ""
        for m in re.finditer(r'(?:token = "|password=)([0-9a-f]{16,})', text):
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans


def test_edges(frame):
    rows = [(1, None), (2, ""), (3, "9" * 200_000), (4, "a" * 200_000 + "@" + "b" * 1000), (None, "mail me@x.org"), (5, "+1 " + " " * 100_000)]
    got = report(frame, rows + [(6, "me@x.org"), (7, "no data at all")])
    assert got[1].spans == got[2].spans == got[3].spans == got[4].spans == got[7].spans == ""
    assert got[None].spans == "email:5:13" and got[6].n_email == 1
    assert pii.find_private(frame(rows).limit(0)).count() == 0


def test_em_finds_the_reliable_labelers():
    """Three labelers that are usually right and two that guess: reliabilities tell them apart."""
    import random

    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        vote = "".join("y" if (truth if rng.random() < p else not truth) else "n" for p in (0.95, 0.9, 0.9, 0.5, 0.5))
        counts["secret", vote] = counts.get(("secret", vote), 0) + 1
    posterior, found = pii.reliabilities(counts)
    assert found["table"][1, 0, 2] > 0.9 and abs(found["table"][1, 4, 2] - 0.5) < 0.1
    assert posterior["secret", "yyynn"] > 0.9 > 0.1 > posterior["secret", "nnnyy"]


def test_intervals_equal_a_scan_over_all_spans(spark):
    """Spans accepted by interval search are those that overlap no span before them."""
    import random

    import numpy as np

    rng = random.Random(4)
    cand = []
    for i in range(3000):
        s = rng.randrange(20_000)
        cand.append({"kind": rng.choice(pii.KINDS), "s": s, "e": s + rng.randint(1, 25), "votes": "".join(rng.choice("yn") for _ in range(5)), "bin": rng.randrange(16), "base": i % 9 == 0})
    w = np.random.default_rng(1).normal(1, 2, 4096)
    found = spark.createDataFrame([(1, cand)], f"doc_id long, cand array<{pii.CANDIDATE}>")
    spans = [(c["kind"], c["s"], c["e"]) for c in cand if c["base"]]
    rest = [(float(w[pii.features(c["kind"], c["votes"], c["bin"])].sum()), (c["kind"], c["s"], c["e"])) for c in cand if not c["base"]]
    for score, span in sorted(rest, key=lambda x: (-x[0], x[1][1], x[1][0])):
        if score >= 0 and all(span[2] <= s or e <= span[1] for _, s, e in spans):
            spans.append(span)
    assert pii.choose(found, w).first().spans == pii.join_spans(spans)
