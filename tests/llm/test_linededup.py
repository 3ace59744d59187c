"""Three-line windows against a direct version that goes through all documents in order."""

from tracewright.llm import linededup


def direct(rows):
    """(doc_id, text) with different ids, in order of id -> text without repeated windows."""
    seen, out = set(), {}
    for name, text in sorted(rows):
        if text is None:
            out[name] = None
            continue
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for a in range(len(filled) - 2):
            at = filled[a : a + 3]
            key = tuple(lines[i].strip(" \t\n\r\x0b\x0c") for i in at)
            if key in seen:
                gone |= set(range(at[0], at[2] + 1))
            seen.add(key)
        out[name] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


PASSAGE = "first line\nsecond line\n\n third line \nfourth line"
ROWS = [(1, f"a\n{PASSAGE}\nb"), (2, f"x\n{PASSAGE}\ny"), (3, PASSAGE), (4, "first line\nsecond line"), (5, None), (6, ""), (7, "\n\n\n\n"),
        (8, "r\nr\nr\nr\nr"), (9, "second line\nthird line\nfourth line\nnew"), (10, "ä\r\nö\r\nü\r\n"), (11, "ä\nö\nü")]


def test_equals_direct_version(frame, long_text):
    rows = [*ROWS, (12, long_text), (13, long_text + "\nnew end")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(rows)).select("row.doc_id", "text").collect()}
    assert got == direct(rows)


def test_counts_nulls_and_repeated_rows(frame):
    rows = [*ROWS, (1, ROWS[0][1]), (None, f"n\n{PASSAGE}")]
    out = linededup.dedup_lines(frame(rows)).selectExpr("row.doc_id", "text", "n_lines", "n_removed").collect()
    assert len(out) == len(rows)
    # the null id comes first, so its passage stays and both copies of document 1 lose theirs
    assert [r.text for r in out if r.doc_id is None] == [f"n\n{PASSAGE}"]
    assert [(r.text, r.n_lines, r.n_removed) for r in out if r.doc_id == 1] == [("a\nb", 7, 5)] * 2
    assert [(r.text, r.n_lines, r.n_removed) for r in out if r.doc_id == 5] == [(None, 0, 0)]


def test_clean_documents_drops_what_is_left_empty(frame):
    docs = frame([(*r, 99) for r in ROWS], n_chars="int")
    out = linededup.clean_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {r[0] for r in ROWS} - {3, 11}
    assert got[2].n_chars == len(got[2].text) == 3 and got[1].n_chars == 99


def test_empty_table(frame):
    assert linededup.dedup_lines(frame([])).count() == 0
    assert linededup.clean_documents(frame([])).count() == 0
