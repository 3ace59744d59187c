"""Model jobs. Forests differ from other tree libraries, so their SQL checks properties: coverage and validity."""

from pyspark.sql import functions as F

from tracewright.catalog.base import register, sql_list
from tracewright.catalog.runblocks import BLOCKS
from tracewright.catalog.scans import SLICE_SQL
from tracewright.fixed import FAULTS, LABELS, TOPOLOGY_TYPES
from tracewright.operators import heads as H
from tracewright.operators import quality as Q
from tracewright.operators import resample as RS
from tracewright.operators import runfeatures as R
from tracewright.operators.basics import slices
from tracewright.operators.evaluate import macro_f1
from tracewright.operators.turns import WINDOW_COLS
from tracewright.operators.wordweights import WordWeights

# small models: the registered queries check the data flow, callers choose their own sizes
SMALL = {"trees": 8, "depth": 4}
# for reports that fit dozens of them
TINY = {"trees": 4, "depth": 2}


def _parts(tr):
    r = tr.runs.select("run_id")
    return r.filter("run_id % 3 <> 0"), r.filter("run_id % 3 = 0")


def _xy(tr):
    base = H.foundation(tr)
    return H.label_rows(tr, base), [c for c in base.columns if c != "run_id"]


def _split(tr):
    x, cols = _xy(tr)
    a, b = _parts(tr)
    return x.join(a, "run_id", "left_semi"), x.join(b, "run_id", "left_semi"), cols


def _label_head(tr):
    train, test, cols = _split(tr)
    return H.fit_forest(train, cols, ["run_id"], classes=7, **SMALL)(test)


OK = "run_id,classes:l valid,complete:b"
HELD = "SELECT run_id, {} AS classes, true AS valid, true AS complete FROM runs WHERE run_id % 3 = 0"
register("l5_label_head", OK, lambda tr: H.probability_rows_ok(_label_head(tr), 7), HELD.format(7))
register("l5_label_probabilities", "run_id,c:l p:d", _label_head)


def _success_head(tr):
    train, test, _ = _split(tr)
    return H.fit_boosted(train, H.success_columns(H.foundation(tr)), ["run_id"], y="success", rounds=4, depth=3)(test)


register("l6_success_head", OK, lambda tr: H.probability_rows_ok(_success_head(tr), 2), HELD.format(2))


def _window_head(tr):
    a, b = _parts(tr)
    w = H.windows(tr)
    return H.fit_forest(w.join(a, "run_id", "left_semi"), WINDOW_COLS, ["run_id", "t"], weight="weight", classes=7, **SMALL)(w.join(b, "run_id", "left_semi"))


register("l7_window_head", "run_id,t,classes:l valid:b", lambda tr: _window_head(tr).groupBy("run_id", "t").agg(
    F.count(F.lit(1)).alias("classes"), (F.abs(F.sum("p") - 1) < 1e-6).alias("valid")), "SELECT run_id, t, 7 AS classes, true AS valid FROM messages WHERE run_id % 3 = 0")


def _oof(tr):
    x, cols = _xy(tr)
    return H.out_of_fold(x, RS.stratified_folds(tr.truth, 3, 42), 3, lambda r: H.fit_forest(r, cols, ["run_id"], classes=7, **SMALL))


register("l8_out_of_fold", OK, lambda tr: H.probability_rows_ok(_oof(tr), 7), "SELECT run_id, 7 AS classes, true AS valid, true AS complete FROM runs")
register("l9_stacking", OK, lambda tr: H.probability_rows_ok(H.stacked_label_probabilities(tr, 2, 2, **SMALL), 7),
         "SELECT run_id, 7 AS classes, true AS valid, true AS complete FROM runs")


def _two_stage(tr):
    train, test, cols = _split(tr)
    return H.two_stage(train, test, cols, 0.5, rounds=4, **SMALL)


register("l10_two_stage", "run_id:l fault:d label:s", _two_stage)
register("l10_two_stage_contract", "run_id,n:l fault_ok,label_ok:b", lambda tr: _two_stage(tr).groupBy("run_id").agg(
    F.count(F.lit(1)).alias("n"), F.min(F.col("fault").between(0, 1)).alias("fault_ok"), F.min(F.col("label").isin(*LABELS)).alias("label_ok")),
    "SELECT run_id, 1 AS n, true AS fault_ok, true AS label_ok FROM runs WHERE run_id % 3 = 0")


def _learns(tr):
    """Turns whose class follows from two columns: a head that works finds it in runs it has not seen."""
    w, a, b = H.windows(tr), *_parts(tr)
    w = w.withColumn("y", F.when(F.col("w_win_assign") > 0, 2.0).otherwise(0.0) + F.when(F.col("w_win_tools") > 1, 1.0).otherwise(0.0))
    p = H.fit_forest(w.join(a, "run_id", "left_semi"), ["w_win_assign", "w_win_tools", "w_win_status"], ["run_id", "t"], classes=4, **SMALL)(w.join(b, "run_id", "left_semi"))
    best = p.groupBy("run_id", "t").agg(F.max_by("c", "p").alias("c"))
    right = best.join(w.select("run_id", "t", "y"), ["run_id", "t"])
    return right.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("c") == F.col("y")).cast("double")) > 0.9).alias("learned"))


register("l7_learns_rule", "n:l learned:b", _learns, "SELECT count(*) AS n, true AS learned FROM messages WHERE run_id % 3 = 0")


def _text_head(tr):
    docs = tr.spark.read.parquet(f"{tr.sf_dir}/documents.parquet")
    y = tr.spark.read.parquet(f"{tr.sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("double").alias("y"))
    return H.text_classifier(WordWeights(docs.select("doc_id", F.lower("text").alias("text")), "doc_id"), y, rounds=8)


register("l12_text_classifier", "doc_id,c:l p:d", _text_head)
# documents without a known term have no vector
TERM_DOCS = r"""dw AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
  tm AS (SELECT doc_id, unnest(w) AS term FROM dw UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM dw),
  vo AS (SELECT term FROM tm GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)"""
register("l12_text_contract", "doc_id,classes:l valid:b", lambda tr: _text_head(tr).groupBy("doc_id").agg(
    F.count(F.lit(1)).alias("classes"), ((F.abs(F.sum("p") - 1) < 1e-6) & (F.min("p") >= 0)).alias("valid")),
    f"WITH {TERM_DOCS}, answer AS (SELECT DISTINCT doc_id, 2 AS classes, true AS valid FROM tm SEMI JOIN vo USING (term))")


def _ranker(tr):
    return tr.once("turn_ranker", lambda t: H.turn_ranker(t, RS.stratified_folds(t.truth, 2, 42), 2, rounds=2, depth=3))


register("l16_turn_ranker", "run_id,t:l label:s p:d", _ranker)
register("l16_ranker_coverage", "run_id,n:l label:s inside:b", lambda tr: _ranker(tr).join(
    tr.run_sizes.withColumnRenamed("n", "len"), "run_id").groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("t") >= 0) & (F.col("t") < F.col("len"))).alias("inside")),
    f"SELECT run_id, 1 AS n, unnest({sql_list(FAULTS)}) AS label, true AS inside FROM runs")
TRANSFER = [f"topo_{v}" for v in TOPOLOGY_TYPES]


def _transfer(tr):
    return tr.once("transfer", lambda t: H.transfer_scores(t, slices(t), TRANSFER, _xy(t)[1], **TINY))


def unit(*cols):
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).between(0, 1)
    return out


register("l17_transfer", "slice:s n:l macro_f1,reference,penalty:d", _transfer)
register("l17_transfer_contract", "slice:s n:l scores_ok:b", lambda tr: _transfer(tr).select("slice", "n", (unit("macro_f1") & F.coalesce(unit("reference"), F.lit(True))).alias("scores_ok")),
         f"WITH {SLICE_SQL}, answer AS (" + " UNION ALL ".join(
             f"SELECT '{s}' AS slice, count(*) AS n, true AS scores_ok FROM slices WHERE {s} HAVING count(*) > 0" for s in TRANSFER) + ")")
GROUPS = {name.partition("_")[2]: b[0].split() for name, b in BLOCKS.items()}


def _ablation(tr):
    return tr.once("ablation", lambda t: H.ablation(t, GROUPS, 2, **TINY))


register("l18_ablation", "dropped:s macro_f1:d", _ablation)
register("l18_ablation_contract", "dropped:s scores_ok:b", lambda tr: _ablation(tr).select("dropped", unit("macro_f1").alias("scores_ok")),
         f"SELECT unnest({sql_list(['nothing', *GROUPS])}) AS dropped, true AS scores_ok")


def _importance(tr):
    return tr.once("importance", lambda t: H.importance_by_group(t, GROUPS, **SMALL))


register("t10_importance", "grp:s features:l importance:d", _importance)
register("t10_importance_contract", "grp:s features:l share_ok,whole:b", lambda tr: _importance(tr).select(
    "grp", "features", unit("importance").alias("share_ok"), (F.abs(_importance(tr).select(F.sum("importance")).scalar() - 1) < 1e-6).alias("whole")),
    " UNION ALL ".join(f"SELECT '{g}' AS grp, {len(set(c))} AS features, true AS share_ok, true AS whole" for g, c in GROUPS.items()))


def _rescore(tr):
    """Fit on clean run blocks, score on blocks rebuilt from degraded messages."""
    base = tr.once("run_block", R.run_block)
    cols = [c for c in base.columns if c != "run_id"]
    predict = H.fit_forest(H.label_rows(tr, base), cols, ["run_id"], **SMALL)
    out = None
    for kind in ("mask", "keywords", "intents", "refs"):
        blk = R.run_block(Q.like(tr, Q.probe_messages(tr, kind).select(*tr.plain_messages.columns)))
        d = tr.truth.select("run_id", F.col("label").alias("y")).join(H.decisions(predict(blk)).withColumnRenamed("label", "yp"), "run_id").withColumn("probe", F.lit(kind))
        s = macro_f1(d, ["probe"])
        out = s if out is None else out.unionByName(s)
    return out


register("l20_probe_scores", "probe:s macro_f1:d", _rescore)
register("l20_probe_contract", "probe:s scores_ok:b", lambda tr: _rescore(tr).select("probe", unit("macro_f1").alias("scores_ok")),
         "SELECT unnest(['mask', 'keywords', 'intents', 'refs']) AS probe, true AS scores_ok")
register("l21_shipped_job", "run_id:l label:s success,fault_turn:l", lambda tr: H.shipped_job(tr, *_parts(tr), inner=2, rounds=3, **SMALL))
register("l21_shipped_contract", "run_id:l label_ok,turn_ok,success_ok:b", lambda tr: H.shipped_job(tr, *_parts(tr), inner=2, rounds=3, **SMALL).join(
    tr.run_sizes, "run_id").select("run_id", F.col("label").isNotNull().alias("label_ok"), (((F.col("label") == "clean") & (F.col("fault_turn") == -1)) | (
        (F.col("label") != "clean") & (F.col("fault_turn") >= 0) & (F.col("fault_turn") < F.col("n")))).alias("turn_ok"), F.col("success").isin(0, 1).alias("success_ok")),
    "SELECT run_id, true AS label_ok, true AS turn_ok, true AS success_ok FROM runs WHERE run_id % 3 = 0")
register("l22_local_cv", "macro_f1,robustness_f1,success_f1,fault_turn_hit2,composite:d", lambda tr: H.local_evaluation(tr, rounds=4, **SMALL)[0])
register("l22_local_class_scores", "label:s precision,recall,f1:d support:l", lambda tr: H.local_evaluation(tr, rounds=4, **SMALL)[1])
