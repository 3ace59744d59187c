"""SimHash against a direct version: fingerprints by definition, links by comparing all pairs."""

import random
import re

import numpy as np
import xxhash

from tracewright.llm import simhash


def direct(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    marks = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(m.encode(), 42) for m in marks]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


TEXTS = [None, "", " \n", "One", "one two", "A B c d", "a b C D", "x " * 9, "É é A a b c d e", "a b c d e f\x1cg", "tie one two three four", "THE quick brown fox jumps"]


def test_fingerprints_follow_the_definition(frame, long_text):
    texts = [*TEXTS, long_text]
    rows = simhash.near_duplicates(frame(list(enumerate(texts)))).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{direct(t):016x}" for i, t in enumerate(texts)}


def test_pieces_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdefg") * 3 for _ in range(300))
    want = direct(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "_PIECE", size)
        assert simhash.fingerprint(text) % (1 << 64) == want


def test_links_equal_all_pairs_in_any_block_size(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):  # chains, and one dense ball
        x = rng.getrandbits(64)
        for _ in range(5):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    ball = rng.getrandbits(64)
    prints |= {ball ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(10)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = groups(prints)
    for block in (8, 4096):
        links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), block=block).collect()
        place = {s: i for i, s in enumerate(signed)}
        assert all((prints[place[r.src]] ^ prints[place[r.dst]]).bit_count() <= 4 for r in links)
        parent = list(range(len(prints)))

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for r in links:
            a, b = top(place[r.src]), top(place[r.dst])
            parent[max(a, b)] = min(a, b)
        assert [top(i) for i in range(len(prints))] == want
        assert len(links) < 20 * len(prints)


def test_links_of_a_dense_bucket_grow_with_its_prints_only(spark):
    each = []
    for n in (200, 400, 4000):  # one segment is the same for all, the others lie within two bits of each other
        ball = {(1 << a) ^ (1 << b) ^ (1 << c) for a in range(43) for b in range(a) for c in range(b)}
        prints = sorted(ball)[:n]
        each.append(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), block=16).count() / n)
    assert max(each) < 64 and each[2] < 3 * each[0], each


def test_segments_leave_one_bit():
    for radius in range(0, 9):
        cut = simhash.segments(radius)
        assert sum(w for _, w in cut) == 64 and radius // len(cut) <= 1 and (len(cut) == 1 or radius // (len(cut) - 1) > 1)


def test_components_and_what_stays(frame):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(5, base), (3, base), (3, base), (9, base + " end"), (None, base), (7, "quite another text"), (None, None), (8, "")]
    docs = frame(rows)
    got = simhash.near_duplicates(docs)
    assert got.count() == len(rows)
    near = (direct(base) ^ direct(base + " end")).bit_count() <= 4
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert by[5, f"{direct(base):016x}"] == by[3, f"{direct(base):016x}"] == by[None, f"{direct(base):016x}"] == 3
    assert by[8, "0" * 16] == by[None, "0" * 16] == 8
    assert by[9, f"{direct(base + ' end'):016x}"] == (3 if near else 9)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({3, 7, 8} | (set() if near else {9}))


def test_empty_table(frame):
    docs = frame([])
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_carried_groups_over_batches():
    import pyarrow as pa

    g, fp = np.repeat(np.array([1, 2, 3]), [1, 40, 2]), np.arange(43, dtype=np.int64)
    table = pa.RecordBatch.from_arrays([pa.array(g), pa.array(fp)], ["bucket", "fp"])
    whole = [x for b in simhash._links(iter([table]), 64) for x in b.to_pylist()]
    parts = [x for b in simhash._links(iter([table.slice(i, 7) for i in range(0, 43, 7)]), 64) for x in b.to_pylist()]
    key = lambda x: (x["src"], x["dst"])
    assert sorted(whole, key=key) == sorted(parts, key=key) and len(whole) == 40
