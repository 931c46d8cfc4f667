"""Language filters: held-out accuracy, membership against exact counts, edges."""

import math
from collections import Counter

import numpy as np

from ratewise.llm import langid
from ratewise.llm.common import crc_of_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_filters_hold_every_member(frame, spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and dog", "en"), ("der hund und die katze", "de"), ("el gato", None)] * 20)]
    model = langid.learn(frame(rows))
    assert model.langs == ["de", "en"]
    keys = langid.document_keys("the cat and dog")
    got = np.bitwise_and.reduce([model.table[0][at] for at in langid._places(keys, model.table.shape[1])])
    assert np.all(got >> np.uint64(1) & np.uint64(1))
    assert model.predict("the dog")[0] == "en" and model.predict("die katze")[0] == "de"


def test_more_languages_than_bits_in_a_word(frame):
    letters = [chr(0x4E00 + i) for i in range(70)]
    rows = [(k * 100 + i, c * 30, f"l{k:02d}", "s") for k, c in enumerate(letters) for i in range(8)]
    model = langid.learn(frame(rows))
    assert len(model.langs) == 70 and model.table.shape[0] == 2
    assert all(model.predict(c * 9)[0] == f"l{k:02d}" for k, c in enumerate(letters))


def test_edges(frame):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(30)] + [(100, None, "en", None), (101, "", None, None), (102, "12 - 34 ²", "en", "s"), (None, "the cat", "en", "s"), (103, "the " * 100_000, None, None), (103, "Ж", None, None)]
    got = langid.identify(frame(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id != 103}
    assert [by_id[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by_id[None].lang_pred == "en"
    assert langid.identify(frame(rows).limit(0)).count() == 0
    unlabelled = frame([(1, "some text", None, None)])
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_blocks_lose_no_ngram(monkeypatch):
    text = "Überall gibt es Wörter, 12 und mehr. " * 40
    whole = np.sort(np.concatenate(list(langid.ngram_keys(text))))
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(langid.ngram_keys(text)))), whole)


def test_predictions_equal_exact_sets(spark):
    """Whole predictions against exact sets of n-grams in place of filters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = [r for r in rows if crc_of_id(r.doc_id) % 5 and r.text and r.lang and langid.has_letter(r.text)]
    langs = sorted({r.lang for r in learned})
    sizes = {g: sum(r.lang == g for r in rows if crc_of_id(r.doc_id) % 5 and r.text is not None) for g in langs}
    rates = {g: Counter() for g in langs}
    for r in learned:
        rates[r.lang].update(langid.document_keys(r.text).tolist())
    best = Counter()
    for g in langs:
        best |= Counter({k: n / sizes[g] for k, n in rates[g].items() if n >= min(3, math.ceil(sizes[g] * 0.1))})
    sets = [np.array(sorted(k for k, n in rates[g].items() if n >= min(3, math.ceil(sizes[g] * 0.1)) and n / sizes[g] >= 0.25 * best[k]), np.uint64) for g in langs]
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in rows:
        if not r.text or not langid.has_letter(r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        keys = np.concatenate(list(langid.ngram_keys(r.text)))
        member = np.stack([np.isin(keys, own) for own in sets], 1)
        hits = (member / np.maximum(member.sum(1), 1)[:, None] ** 2).sum(0)
        share = hits / max(hits.sum(), 1e-9)
        first, second = np.sort(share)[::-1][:2]
        assert abs(got[r.doc_id].score - first) < 0.03
        assert got[r.doc_id].lang_pred == langs[int(share.argmax())] or first - second < 0.03


def test_a_language_with_one_document(frame):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(1, 40)] + [(k, "hund katze maus", "de", "s") for k in (1000, 1001, 1002)]
    model = langid.learn(frame([r for r in rows if crc_of_id(r[0]) % 5][:36] + [next(r for r in rows if r[2] == "de" and crc_of_id(r[0]) % 5)]))
    assert model.predict("katze und hund")[0] == "de" and model.predict("a dog")[0] == "en"


def test_slots_follow_the_members(spark):
    def table(n):
        return spark.range(n).selectExpr("id AS key", "0 AS bit")

    assert langid.slots_for(table(0)) == langid.slots_for(table(100)) == langid.LEAST_SLOTS
    assert langid.slots_for(table(20_000)) == 1 << 20
