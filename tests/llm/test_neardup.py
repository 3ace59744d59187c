"""Near copies against a direct version: every pair of shingle sets compared."""

import random

from tracewright.llm import neardup, simhash

import corpus_pipeline


def marks(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def direct(rows):
    """Ids that stay, by components over all pairs at 0.8 or more."""
    sets, parent = [marks(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return sorted(min(rows[i][0] for i in range(len(rows)) if top(i) == r) for r in {top(i) for i in range(len(rows))})


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    phrase, rows = [word() for _ in range(9)], [None, "", "one two", "One two", "one two three four five"]
    for _ in range(25):  # chains of edits, some of them with one passage that many share
        words = [word() for _ in range(rng.randint(6, 120))]
        if rng.random() < 0.5:
            words[3:3] = phrase
        for _ in range(6):
            rows.append(" ".join(words))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_what_stays_equals_all_pairs(spark, frame, monkeypatch):
    rows = corpus()
    want = direct(rows)
    assert sorted(r.doc_id for r in neardup.drop_similar(frame(rows)).collect()) == want
    monkeypatch.setattr(neardup, "WIDE", 1)
    assert sorted(r.doc_id for r in neardup.drop_similar(frame(rows)).collect()) == want
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    assert sorted(r.doc_id for r in neardup.drop_similar(frame(rows), block=4).collect()) == want


def test_stage_drops_copies_beyond_the_radius(spark, frame):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    edited = [*words]
    for at in (20, 70, 120):
        edited[at] = "other"
    a, b = " ".join(words), " ".join(edited)
    assert 5 * len(marks(a) & marks(b)) >= 4 * len(marks(a) | marks(b))
    assert ((simhash.fingerprint(a) ^ simhash.fingerprint(b)) % (1 << 64)).bit_count() > simhash.RADIUS
    docs = frame([(1, a), (2, b), (3, "quite another text")])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_rows_that_repeat_and_null_ids(frame):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(5, base), (3, base), (3, base), (9, base + " end"), (None, base), (7, "quite another text"), (None, None), (8, "")]
    assert sorted(r.doc_id for r in neardup.drop_similar(frame(rows)).collect()) == [3, 7, 8]


def test_empty_table(frame):
    assert neardup.drop_similar(frame([])).count() == 0


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) * rng.integers(0, 10) // 9], rng.integers(0, 1 << 63, rng.integers(0, 900)).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        found = neardup.differing(neardup.parities(a), neardup.parities(b))
        assert found <= apart and (apart - found) % 2 == 0
        assert neardup.differing(neardup.parities(a), neardup.parities(a)) == 0


def test_parities_of_a_bucket_are_those_of_pairs():
    import numpy as np

    rng = np.random.default_rng(5)
    bits = [neardup.parities(np.unique(rng.integers(0, 1 << 63, rng.integers(0, 3000)).astype(np.uint64))) for _ in range(40)]
    known = neardup.Parities(bits)
    for i in range(40):
        others = np.array([j for j in range(40) if j != i])
        assert known.apart(i, others).tolist() == [neardup.differing(bits[i], bits[j]) for j in others]
