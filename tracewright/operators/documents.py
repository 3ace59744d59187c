"""Run documents, TF-IDF weights and pooled embeddings as plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import count_where
from tracewright.functions.text import normalise
from tracewright.operators.runfeatures import condition_streaks, state_changes
from tracewright.operators.turns import with_roles
from tracewright.operators.wordweights import WordWeights
from tracewright.plans.gather import gather
from tracewright.plans.scan import chunk_of, framed
from tracewright.sources.traces import Traces


def _under(c: Column) -> Column:
    return F.replace(normalise(c), F.lit(" "), F.lit("_"))


def structure_words(tr: Traces) -> DataFrame:
    """Presence words of a run: unanswered tasks, restarts, ties, duplicates, flips, conflicts, drift and loops."""
    m = tr.messages
    it = m.filter("trim(intent) <> ''").groupBy("run_id", "intent").agg(
        F.max(F.size("refs") > 0).alias("r"), F.max(F.col("type") == "handoff").alias("h"),
        F.count_distinct(F.nullif("sender", F.lit(""))).alias("who"), F.count_distinct("sender").alias("owners"))
    a = it.groupBy("run_id").agg(count_where(~F.col("r") & F.col("h")).alias("never"), F.max(F.col("who") > 1).alias("restart"),
                                 F.max(F.col("owners") > 1).alias("tie"))
    hs = tr.artifacts.filter("hash <> ''").groupBy("run_id", "hash").agg(
        count_where(F.col("subtask") != "").alias("named"), F.count(F.lit(1)).alias("k"), F.count_distinct("subtask").alias("d"))
    dup = hs.groupBy("run_id").agg(F.max((F.col("named") > 1) | ((F.col("k") > 1) & (F.col("d") == 1))).alias("dup"))
    st = tr.once("state_changes", state_changes).groupBy("run_id").agg(F.max("flip").alias("flip"), F.max(F.col("alt_flip") | (F.lower("op") == "override")).alias("clash"))
    rep = framed(m.select("run_id", "t", "norm"), ["run_id"], 1, 0, lambda w: {"p": F.lag("norm").over(w)}).groupBy("run_id").agg(
        count_where((F.col("norm") != "") & (F.col("norm") == F.col("p"))).alias("rep"))
    zero = condition_streaks(m.select("run_id", "t", "goal_ov"), {"z": F.col("goal_ov") == 0}).groupBy("run_id").agg(F.max("z").alias("zero"))
    j = gather(tr.runs.select("run_id", (F.size("goal_words") > 0).alias("has_goal")), a, dup, st, rep, zero)
    on = lambda c: F.coalesce(c, F.lit(False))
    words = {"CONFLICT": on(F.col("clash")), "DEAD": on(F.col("flip")), "DRIFT": on(F.col("has_goal") & (F.col("zero") >= 2)), "DUP": on(F.col("dup")),
             "LOOP": on(F.col("rep") >= 2), "NOKEYWORD": on(F.col("never") > 0), "REASSIGN": on(F.col("restart")), "TIE": on(F.col("tie")),
             "UNANSWERED_MANY": on(F.col("never") >= 2)}
    return j.select("run_id", F.filter(F.array(*[F.when(c, f"[{w}]") for w, c in words.items()]), lambda x: x.isNotNull()).alias("words"))


def document_lines(tr: Traces) -> DataFrame:
    """Tagged lines of every run document: (run_id, section, pos, line), in reading order by section and pos."""
    m = with_roles(tr, tr.messages)
    tx, tl = normalise(F.col("text")), F.trim("tool")
    line = F.concat_ws(
        " ", F.concat(F.lit("["), F.upper(F.when(F.col("type") == "", "other").otherwise(F.col("type"))), F.lit("]")),
        F.when(F.trim("intent") != "", F.concat(F.lit("[SUB] "), _under(F.trim("intent")))).otherwise("[NOINTENT]"),
        F.concat(F.lit("[ROLE] "), F.coalesce(F.nullif(F.lower("sender_role"), F.lit("")), F.lit("unknown"))),
        F.when(tx != "", tx).otherwise("[NOTEXT]"), F.when(tl != "", F.concat(F.lit("[TOOL] "), _under(tl))),
        F.when((F.size("refs") > 0) & (F.col("type") == "handoff"), "[DELIVERED]"))
    parts = [
        tr.goals.select("run_id", F.lit(0).alias("section"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("[GOAL] "), normalise(F.col("goal"))).alias("line")),
        m.select("run_id", F.lit(1).alias("section"), F.col("t").cast("long").alias("pos"), line.alias("line")),
        tr.artifacts.select("run_id", F.lit(2).alias("section"), F.col("t").cast("long").alias("pos"), F.concat_ws(
            " ", F.when(_under(F.col("type")) != "", F.concat(F.lit("[ART] "), _under(F.col("type")))), F.when(
                F.col("status") != "", F.concat(F.lit("[ARTSTATUS] "), F.lower("status")))).alias("line")),
        tr.state.select("run_id", F.lit(3).alias("section"), F.col("t").cast("long").alias("pos"), F.concat_ws(
            " ", F.when(_under(F.col("key")) != "", F.concat(F.lit("[STATEKEY] "), _under(F.col("key")))), F.when(
                F.col("op") != "", F.concat(F.lit("[STATEOP] "), F.lower("op")))).alias("line")),
        structure_words(tr).select("run_id", F.lit(4).alias("section"), F.lit(0).cast("long").alias("pos"), F.array_join("words", " ").alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("line <> ''")


def document_parts(tr: Traces) -> DataFrame:
    """Document text in parts of at most one chunk of turns; joining the parts in order gives the document."""
    d = document_lines(tr)
    return d.groupBy("run_id", "section", chunk_of(d, "pos").alias("part")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))


# ---- TF-IDF --------------------------------------------------------------------
def word_grams(text: Column) -> Column:
    """Single words and neighbouring pairs of a text, split at blanks."""
    w = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    left, right = F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, 2**30)
    return F.concat(w, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))


def char_grams(word: Column) -> Column:
    """Character 3- to 5-grams of one word padded by a blank on both sides; a short word counts once."""
    w = F.concat(F.lit(" "), word, F.lit(" "))
    n = F.length(w)

    def of(k: int) -> Column:
        many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(w, i, F.lit(k)))
        # a word no longer than k gives itself, and no longer grams follow
        return F.when(n > k, many).when((n == k) | (F.lit(k) == 3), F.array(F.substring(w, F.lit(1), F.lit(k)))).when(
            n == k - 1, F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))

    return F.concat(of(3), of(4), of(5))


def tfidf(terms: DataFrame, key: str, n_docs: Column, min_df: int = 5, max_terms: int | None = None) -> DataFrame:
    """(key, term, weight) from one row per term occurrence: 1 + ln tf, smoothed idf, unit length per document.

    Occurrences are counted before the shuffle. All terms of ``min_df`` or more
    documents are kept unless ``max_terms`` asks for the most frequent only; the
    vocabulary grows with the data, so the join on it is a shuffle unless it
    turns out small.
    """
    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_terms is not None:
        vocab = vocab.orderBy(F.col("total").desc(), "term").limit(max_terms)
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1
    w = tf.join(vocab.select("term", idf.alias("idf")), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("len")).alias("weight"))


def word_tfidf(docs: DataFrame, key: str, text: str = "text", min_df: int = 5, max_terms: int | None = None) -> DataFrame:
    """Weights of words and neighbouring pairs; terms are counted by packed keys unless only the most frequent are wanted."""
    if max_terms is None:
        return WordWeights(docs, key, text, min_df).rows()
    n = docs.select(F.count(F.lit(1))).scalar()
    return tfidf(docs.select(key, F.explode(word_grams(F.col(text))).alias("term")), key, n, min_df, max_terms)


def char_tfidf(docs: DataFrame, key: str, text: str = "text", **kw) -> DataFrame:
    n = docs.select(F.count(F.lit(1))).scalar()
    words = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))).alias("word"))
    return tfidf(words.select(key, F.explode(char_grams(F.col("word"))).alias("term")), key, n, **kw)


def pooled_embeddings(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per group, scaled to unit length."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x"))
    mean = long.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    j = mean.join(size, key).select(key, "dim", (F.col("x") / F.greatest("len", F.lit(1e-12))).alias("x"))
    return j.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("vector"))
