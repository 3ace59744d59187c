"""Piece lattice against the library with the model set to its lattice type, and against all segmentations."""

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tracewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "Hello  world", "héllo ▁ x", "漢字 \n\n  x  y", "😀 a😀 a", "x" * 200, "ab " * 50, "tab\tnul\0end", "퟿￿"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def read(data, at):
    x = shift = 0
    while True:
        byte = data[at]
        x, shift, at = x | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return x, at


def as_lattice_model(data):
    """The model file with field 3 of the trainer's part (field 2), its type, set to 1."""
    out, at = b"", 0
    while at < len(data):
        tag, at = read(data, at)
        size, at = read(data, at)
        body, at = data[at : at + size], at + size
        if tag >> 3 == 2:
            body += b"\x18\x01"  # the last value of a field counts
        out += number(tag) + number(len(body)) + body
    return out


def test_nbest_scores_equal_the_library(model):
    with open(PATH, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_lattice_model(f.read()))
    lattice, rng, seen = pieces.Lattice(model), random.Random(4), 0
    for _ in range(400):
        word = "".join(rng.choice("etaoinshrdlucmé") for _ in range(rng.randint(1, 14)))
        mine = [s for s, _ in lattice.nbest(pieces.MARK + word, 4)]
        if min(mine) > -(10**8):  # beyond that the library's sums are rounded
            other = library.nbest_encode(word, nbest_size=4, out_type=int)
            assert mine == [sum(round(library.get_score(i)) for i in x) for x in other]
            seen += 1
    assert seen > 200


def all_paths(model, word):
    if not word:
        return [(0, [])]
    out = []
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in model.scores or n == 1:
            score, ids = (model.scores[head][0], [model.scores[head][1]]) if head in model.scores else (model.unknown, [model.byte_ids[b] for b in head.encode()])
            out += [(score + s, ids + rest) for s, rest in all_paths(model, word[n:])]
    return out


def test_nbest_are_the_best_of_all(model):
    lattice, rng = pieces.Lattice(model), random.Random(9)
    for _ in range(60):
        word = pieces.MARK + "".join(rng.choice("theran ß漢") for _ in range(rng.randint(1, 8))).replace(" ", "")
        every = sorted(all_paths(model, word), key=lambda x: -x[0])
        got = lattice.nbest(word, 6)
        assert [s for s, _ in got] == [s for s, _ in every[:6]]
        assert all(x in every for x in got) and len({tuple(i) for _, i in got}) == len(got)


def test_texts_as_a_chain_equal_one_lattice(model):
    """The N best of a text from its weakest words equal a search over the text's whole lattice."""
    for text in [*TEXTS[:8], "the quick brown fox jumps over the lazy dog"]:
        whole = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
        want = pieces.Lattice(model).nbest(whole, 5) if whole else [(0, [])]
        got = pieces.Lattice(model).encode([text], 5)[0]
        assert got["ids"].tolist() == want[0][1] and [x["score"] for x in got["nbest"]] == [s for s, _ in want]
        for best, (_, ids) in zip(got["nbest"], want):
            mine = got["ids"].tolist()
            for edit in reversed(best["edits"]):
                mine[edit["first"] : edit["first"] + edit["count"]] = edit["ids"]
            assert pieces.Lattice(model).decode(mine) == pieces.Lattice(model).decode(ids)


def test_side_by_side_equals_one_by_one(model, monkeypatch):
    rng = random.Random(2)
    words = [pieces.MARK * rng.randint(0, 2) + "".join(rng.choice("aeinrstß漢😀") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    words = [w for w in dict.fromkeys(words)]
    lattice = pieces.Lattice(model)
    monkeypatch.setattr(pieces, "_SIDE", 64)
    score, loss, first, count, ids = lattice.solve(words)
    for k, word in enumerate(words):
        two = lattice.nbest(word, 2)
        assert (score[k], ids[first[k] : first[k] + count[k]].tolist()) == (two[0][0], two[0][1])
        assert loss[k] == two[0][0] - two[1][0] if len(two) > 1 else loss[k] > 1 << 50


def test_operator_round_trip(frame, model, monkeypatch, long_text):
    monkeypatch.setattr(pieces, "_CHARS", 1000)
    monkeypatch.setattr(pieces, "_WORDS_KNOWN", 500)
    texts = [*TEXTS, None, long_text, TEXTS[3]]
    out = pieces.encode(frame(list(enumerate(texts))), model, n=2).withColumn("back", pieces.decoding(F.col("ids"), model)).collect()
    assert len(out) == len(texts)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in out:
        text = texts[r.doc_id]
        if text is None:
            assert r.ids is None and r.back is None and r.nbest is None
        else:
            assert r.back == text.replace(pieces.MARK, " ") == library.decode(r.ids)
            assert r.nbest[0].score == r.score and r.nbest[0].edits == []
    assert pieces.encode(frame([]), model).count() == 0


def test_ties_and_long_lines(model):
    """Words of many equal paths: the scores are those of all segmentations, and a long line takes no longer than its length."""
    lattice = pieces.Lattice(model)

    def every(word, end):
        return [s + t for a, s, _ in lattice.arcs(word, end) for t in every(word, a)] if end else [0]

    for word in ("-" * 9, "=" * 8, "ababab", "....__", "0" * 9):
        for n in (1, 2, 3, 7):
            assert [s for s, _ in lattice.nbest(word, n)] == sorted(every(word, len(word)), reverse=True)[:n]
    start = time.time()
    for word in ("-" * 10_000, "=-" * 5_000):
        best = lattice.nbest(word, 3)
        assert best[0][0] == lattice.forward(word)[-1] and len(best) == 3
    assert time.time() - start < 20
