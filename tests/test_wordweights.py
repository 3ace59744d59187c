"""Weights of packed keys equal those of a row for each term of a document, and no shuffle carries such rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import documents as D
from tracewright.operators.wordweights import WordWeights


def corpus(spark):
    rng = random.Random(3)
    words = ["ab", "ß", "日本", "x,y", "[t]", "a" * 40] + [f"w{i}" for i in range(60)]
    rows = [(i, "\t".join(rng.choices(words, k=rng.randrange(0, 30))) + "\x0b \n") for i in range(200)]
    # one id in several rows, a null text, blanks only, rows without an id
    rows += [(7, "ab ab w1 w2"), (7, "w2 ab"), (300, None), (301, " \f "), (None, "w1 w2 w3"), (None, "w1 only here")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def plain(docs, least):
    terms = docs.select("doc_id", F.explode(D.word_grams(F.col("text"))).alias("term"))
    return D.tfidf(terms, "doc_id", F.lit(docs.count()), min_df=least)


def table(df):
    return {(r.doc_id, r.term): r.weight for r in df.collect()}


@pytest.mark.parametrize("least", [1, 5])
def test_weights_equal_plain_ones(spark, least):
    docs = corpus(spark)
    want = table(plain(docs, least))
    got = table(WordWeights(docs, "doc_id", min_df=least, block_bytes=500, part_bytes=700).rows())
    assert got.keys() == want.keys() and len(got) > 1000
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_vectors_have_one_place_for_each_term(spark):
    docs = corpus(spark)
    w = WordWeights(docs, "doc_id", block_bytes=500, part_bytes=700)
    first, size = w.vocabulary()
    rows = table(w.rows())
    assert size == len({t for _, t in rows})
    parts = [r for k in range(3) for r in w.vectors(first, 3, k).collect()]
    assert sorted(r.doc_id for r in parts) == sorted({d for d, _ in rows})
    for r in parts:
        assert list(r["indices"]) == sorted(set(r["indices"])) and 0 <= r["indices"][0] and r["indices"][-1] < size
        assert sorted(r["values"]) == pytest.approx(sorted(x for (d, _), x in rows.items() if d == r.doc_id))


def test_no_terms_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert D.word_tfidf(none, "doc_id").count() == 0
    assert D.word_tfidf(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string"), "doc_id").count() == 0


def test_no_shuffle_of_terms(spark):
    plan = D.word_tfidf(corpus(spark), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "term" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "Generate" not in plan


def test_vectors_are_never_there_all_at_once(spark, monkeypatch):
    from tracewright.operators import heads

    docs = corpus(spark).filter("doc_id < 200").dropDuplicates(["doc_id"]).repartition(5)  # a block for each
    labels = docs.select("doc_id", F.col("text").contains("w1").cast("double").alias("y")).filter("doc_id % 2 = 0")
    made = []
    keep = heads.written
    monkeypatch.setattr(heads, "written", lambda df, name, *a, **kw: made.append((name, df.count())) or keep(df, name, *a, **kw))
    w = WordWeights(docs, "doc_id", block_bytes=500, part_bytes=700)
    answers = heads.text_classifier(w, labels, rounds=5, passes=3).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    known = {d for d, _ in table(w.rows())}
    assert {r.doc_id for r in answers} == known and all(r.n == 2 and r.p == pytest.approx(1) for r in answers)
    vectors = [n for name, n in made if name == "text_vectors"]
    assert len(vectors) == 3 and sum(vectors) == len(known) and max(vectors) < len(known)


def told(docs, classes):
    """Labels that words tell, not always."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w.isin("w1", "w2", "w3")))
    return docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.least(n, F.lit(classes - 1))).cast("double").alias("y")).filter("doc_id % 5 > 0")


@pytest.mark.parametrize("classes", [2, 3])
def test_classifier_equals_spark_ml(spark, classes):
    """Near its optimum after 15 steps; the coefficients lie in several parts and the documents in many blocks."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector, VectorUDT

    from tracewright.operators.heads import text_classifier

    docs = corpus(spark).filter("doc_id < 200 and doc_id <> 7").repartition(5)
    w = WordWeights(docs, "doc_id", block_bytes=3000, part_bytes=7000)
    first, size = w.vocabulary()
    vector = F.udf(lambda i, v: SparseVector(size, i, v), VectorUDT())
    x = w.vectors(first).select("doc_id", vector("indices", "values").alias("features"))
    model = LogisticRegression(family="multinomial", labelCol="y", maxIter=300, regParam=0.01, tol=1e-12).fit(x.join(told(docs, classes), "doc_id"))
    want = {r.doc_id: r.p for r in model.transform(x).select("doc_id", vector_to_array("probability").alias("p")).collect()}
    got = {(r.doc_id, r.c): r.p for r in text_classifier(w, told(docs, classes), rounds=15, passes=2).collect()}
    assert len(got) == classes * len(want) > 300
    assert max(abs(got[d, c] - p) for d, v in want.items() for c, p in enumerate(v)) < (0.02 if classes == 2 else 0.05)


def test_classifier_has_two_classes_and_skips_rows_without_a_label(spark):
    from tracewright.operators.heads import text_classifier

    docs = corpus(spark)
    labels = spark.createDataFrame([(d, None if d % 2 else 0.0) for d in range(50)] + [(999, 1.0)], "doc_id long, y double")
    w = WordWeights(docs, "doc_id", block_bytes=500, part_bytes=700)
    got = text_classifier(w, labels, rounds=3, passes=2).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in table(w.rows())} and all(r.n == 2 and r.p == pytest.approx(1) for r in got)
