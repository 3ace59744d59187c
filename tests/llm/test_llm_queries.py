"""Registered queries: SQL where there is one, and the pipeline on a small table against its rules."""

import os

import duckdb
import pytest

import corpus_pipeline
from tracewright.llm import catalog
from tracewright.llm.common import table

SF = "/root/testdata/sf0.001"


def view(con, name):
    path = f"{SF}/{name}.parquet"
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    view(con, "documents")
    view(con, "pages")
    view(con, "embeddings")
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_names():
    import __spark_entry__ as entry

    known = entry.queries()
    assert "pipeline" in known and all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]


@pytest.mark.parametrize("name", ["op4_warc", "op5_secret_scan", "op9_decontamination", "op10_html_text"])
def test_ids_are_numbers(spark, name):
    kinds = dict(catalog.QUERIES[name](spark, SF).dtypes)
    assert kinds.get("doc_id", kinds.get("page_id")) == "bigint"


def test_pipeline_on_small_tables(spark, tmp_path):
    """Clean documents stay, whatever a stage is for goes, and every stage sees what the one before kept."""
    docs = table(spark, SF, "documents").limit(60).collect()
    item = "this benchmark item has more than enough words to make several shingles of five words each"
    passage = "\n".join(f"passage line number {i} of the shared text" for i in range(4))
    own = lambda k: " ".join(f"the {k}th and {k * i + i} of that" for i in range(40))
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars) for d in docs]
    start = 10_000
    more = [own(1), own(2) + "\n" + passage, own(3) + "\n" + passage, own(1), own(4) + f" {item} ", "1234 5678", None, ""]
    rows += [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(more)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {k for k in out if k >= start} == {start, start + 1, start + 2}
    assert out[start + 1].text == more[1] and out[start + 2].text == own(3) and out[start + 2].n_chars == len(own(3))
    assert all(r.round_trip and r.n_ids == len(r.ids) > 0 for r in out.values())
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
