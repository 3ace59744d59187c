"""Language identification: held-out accuracy, gradient of the network, and odd inputs."""

import numpy as np
import pytest

from tracewright.llm import langid
from tracewright.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return langid.fit(table(spark, SF, "documents"))


def test_held_out_accuracy(spark, net):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 150 and right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.keep_identified(docs, net).count() >= 0.99 * docs.count()


def test_whole_text_counts(frame, net):
    """A text whose first window is of another language than the rest is of the rest's language."""
    english, german = "the and that with from this are was for have ", "der und nicht ist das mit ein sich auf den die schön für "
    rows = langid.identify(frame([(1, english * 4 + german * 60), (2, german * 4 + english * 60)]), net).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "de", 2: "en"}


def test_unknown_and_repeated_rows(frame, net, long_text):
    texts = [None, "", " \n", "123 !!", "!" * 5000, "é", long_text, "the cat", "the cat"]
    docs = frame(list(enumerate(texts)))
    rows = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert len(rows) == len(texts)
    assert [rows[i].lang_pred == "und" and rows[i].score == 0 for i in range(9)] == [True] * 5 + [False] * 4
    assert rows[7].score == rows[8].score and rows[7].lang_pred in net.languages
    kept = langid.keep_identified(docs, net, least=0.0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8]


def test_nothing_to_learn_from(frame, spark):
    docs = frame([(1, "some text", None), (None, "text", "en")], lang="string")
    none = langid.fit(docs)  # no label, or an id whose fold is unknown
    assert none.languages == []
    assert {(r.lang_pred, r.held_out) for r in langid.identify(docs, none).collect()} >= {("und", True)}
    assert langid.identify(docs.limit(0), none).count() == 0
    assert langid.fit(docs.limit(0)).languages == []


def test_training_lowers_the_loss():
    texts = [bytes([65 + k % 2] * 20 + [97 + k % 7] * 20) for k in range(200)]
    net = langid.train(texts, [k % 2 for k in range(200)], ["a", "b"], epochs=6)
    x = np.stack([np.frombuffer(t.ljust(langid.WINDOW, b"\0"), np.uint8) for t in texts])
    assert (net.probabilities(x).argmax(1) == np.arange(200) % 2).all()


def test_every_language_is_learned_and_repeated_rows_count_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, places, languages: seen.append((texts, places, languages)))
    rows = [(i, f"some text number {i} of language {i % 250}", f"l{i % 250}") for i in range(2000)]
    rows += [(7, "the same row again and again", "often")] * 3000 + [(9, None, "l1"), (11, "123 456", "l2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs)
    texts, places, languages = seen[0]
    held = {i for i in range(2000) if __import__("zlib").crc32(str(i).encode()) % 5 == 0}
    want = {r[2] for r in rows if r[1] and r[0] not in held and r[1] != "123 456"}
    assert set(languages) == want and {languages[p] for p in places} == want
    if 7 not in held:
        assert sum(languages[p] == "often" for p in places) == 1
    monkeypatch.setattr(langid, "SAMPLE_ALL", 300)
    langid.fit(docs)
    assert set(seen[1][2]) == want and len(seen[1][0]) == len(want)
