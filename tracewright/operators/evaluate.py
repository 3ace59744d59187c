"""Scores and reports over truth and prediction tables. All of them are groupings with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import LABELS, WEIGHTS
from tracewright.functions.numbers import count_where, flag, ratio
from tracewright.operators.basics import slices
from tracewright.operators.localize import argmax, label_name, predicted_peak
from tracewright.plans.scan import percentiles
from tracewright.sources.traces import Traces


def _one() -> Column:
    return F.count(F.lit(1))


def joined(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth and prediction side by side by run_id; rows of either side that lack the other stay."""
    t = truth.select("run_id", F.col("label").alias("y"), F.col("success").alias("s"), F.col("fault_turn").alias("ft"), F.lit(1).alias("has_y"))
    p = pred.select("run_id", F.col("label").alias("yp"), F.col("success").alias("sp"), F.col("fault_turn").alias("tp"), F.lit(1).alias("has_p"))
    return t.join(p, "run_id", "full")


def pairs(tr: Traces) -> DataFrame:
    return joined(tr.truth, tr.pred).filter("has_y = 1 and has_p = 1").drop("has_y", "has_p")


def model_labels(tr: Traces) -> DataFrame:
    """Truth with the labels of models A and B (largest probability)."""
    d = tr.label_probs.groupBy("run_id").agg(label_name(argmax("pa", "c")).alias("a"), label_name(argmax("pb", "c")).alias("b"))
    return tr.truth.select("run_id", "n", F.col("label").alias("y"), "success", F.col("fault_turn").alias("ft")).join(d, "run_id")


def coverage(tr: Traces, pred: DataFrame) -> DataFrame:
    j = joined(tr.truth, pred)
    return j.agg(_one().alias("rows"), count_where(F.col("has_p").isNull()).alias("missing_pred"),
                 count_where(F.col("has_y").isNull()).alias("unknown_pred"))


# ---- class scores --------------------------------------------------------------
def class_scores(df: DataFrame, keys: list[str] = (), y: str = "y", yp: str = "yp", weight: Column | None = None,
                 labels: list[str] = LABELS) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and support of every label inside ``keys`` (one pass, no window)."""
    w = weight if weight is not None else F.lit(1)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, w).otherwise(0)), F.lit(0))
    t, p = F.col(y), F.col(yp)
    cells = []
    for i, c in enumerate(labels):
        cells += [part((t == c) & (p == c)).alias(f"tp{i}"), part((t != c) & (p == c)).alias(f"fp{i}"), part((t == c) & (p != c)).alias(f"fn{i}")]
    g = df.groupBy(*keys).agg(*cells)
    rows = g.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                                                        F.col(f"fn{i}").alias("fn")) for i, c in enumerate(labels)])).alias("x"))
    rows = rows.select(*keys, "x.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                       ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def macro_f1(df: DataFrame, keys: list[str] = (), **kw) -> DataFrame:
    """Mean F1 over labels present in the truth (over all labels when none is)."""
    s = class_scores(df, keys, **kw)
    return s.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.avg("f1")).alias("macro_f1"))


def hit(k: int, y: str = "y", yp: str = "yp", ft: str = "ft", tp: str = "tp") -> Column:
    return (F.col(y) == F.col(yp)) & (F.col(tp) >= 0) & (F.abs(F.col(tp) - F.col(ft)) <= k)


def hit_at(df: DataFrame, ks: list[int], keys: list[str] = ()) -> DataFrame:
    faulty = F.col("y") != "clean"
    return df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(faulty, flag(hit(k)))), F.lit(0.0)).alias(f"hit_{k}") for k in ks])


def binary_f1(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    s, p = F.col("s") == 1, F.col("sp") == 1
    return df.groupBy(*keys).agg(ratio(2 * count_where(s & p), 2 * count_where(s & p) + count_where(~s & p) + count_where(s & ~p)).alias("success_f1"))


def composite(tr: Traces, df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Four scores and their weighted sum."""
    rob = slices(tr).filter("robust").select("run_id")
    ks = list(keys) or ["_"]
    one = df if keys else df.withColumn("_", F.lit(0))
    parts = [macro_f1(one, ks), macro_f1(one.join(rob, "run_id", "left_semi"), ks).withColumnRenamed("macro_f1", "robustness_f1"),
             binary_f1(one, ks), hit_at(one, [2], ks).withColumnRenamed("hit_2", "fault_turn_hit2")]
    j = parts[0]
    for p in parts[1:]:
        j = j.join(p, ks, "left")
    total = sum((w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    return j.select(*keys, *[F.coalesce(F.col(k), F.lit(0.0)).alias(k) for k in WEIGHTS], total.alias("composite"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y").pivot("yp", LABELS).count().na.fill(0)


def top_confusions(df: DataFrame, k: int) -> DataFrame:
    c = df.groupBy("y", "yp").agg(_one().alias("n"))
    s = df.groupBy("y").agg(_one().alias("total"))
    return c.filter("y <> yp").join(s, "y").select("y", "yp", "n", ratio("n", "total").alias("share")).orderBy(
        F.col("n").desc(), "y", "yp").limit(k)


# ---- localisation reports ---------------------------------------------------------
def localisation_report(tr: Traces, df: DataFrame) -> DataFrame:
    """Per true class: errors of the turn when the class is given (df: run_id, y, ft, tp, n)."""
    f = df.filter("y <> 'clean'").withColumn("ae", F.abs(F.col("tp") - F.col("ft")))
    med = percentiles(tr.runs, [], "n", {"m": 0.5}).select("m").scalar()
    f = f.withColumn("short", F.col("n") <= med)
    ae = F.col("ae")
    r = f.groupBy("y").agg(
        _one().alias("n"), *[F.avg(flag(ae <= k)).alias(f"hit_{k}") for k in (2, 5, 10)], F.avg(flag(ae == 0)).alias("exact"),
        count_where(F.col("tp") < 0).alias("returned_none"), count_where(F.col("tp") < F.col("ft")).alias("too_early"),
        count_where(F.col("tp") > F.col("ft")).alias("too_late"), F.coalesce(F.avg(F.when(F.col("short"), flag(ae <= 2))), F.lit(0.0)).alias("hit_2_short"),
        F.coalesce(F.avg(F.when(~F.col("short"), flag(ae <= 2))), F.lit(0.0)).alias("hit_2_long"))
    return r.join(percentiles(f, ["y"], "ae", {"median_abs_err": 0.5}), "y")


def hit_decomposition(tr: Traces) -> DataFrame:
    """A = label right, B = label right and within 2 turns, C = B / A, plus the hit rate with the true class given."""
    d = pairs(tr).select("run_id", "y", "yp", "ft")
    at = predicted_peak(tr, tr.pred).select("run_id", F.col("fault_turn").alias("tp"))
    orc = predicted_peak(tr, tr.truth).select("run_id", F.col("fault_turn").alias("to"))
    d = d.join(at, "run_id").join(orc, "run_id").filter("y <> 'clean'")
    d = d.select("*", F.explode(F.array(F.lit("ALL"), F.col("y"))).alias("grp"))
    return d.groupBy("grp").agg(
        _one().alias("n"), F.avg(flag(F.col("y") == F.col("yp"))).alias("a"), F.avg(flag(hit(2))).alias("b"),
        F.avg(flag((F.col("to") >= 0) & (F.abs(F.col("to") - F.col("ft")) <= 2))).alias("oracle_class")).withColumn("c", ratio("b", "a"))


def offset_report(tr: Traces) -> DataFrame:
    d = _offsets(tr)
    x = F.col("off")
    g = d.agg(F.avg("off").alias("mean"), F.avg(flag(x == 0)).alias("exact"), F.avg(flag(F.abs(x) <= 2)).alias("within_2"),
              F.avg(flag(F.abs(x) <= 5)).alias("within_5"), F.avg(flag(x > 2)).alias("after_fault"))
    m = percentiles(d, [], "off", {"median": 0.5})
    return g.withColumn("median", m.scalar())


def _offsets(tr: Traces) -> DataFrame:
    p = predicted_peak(tr, tr.pred).filter("label <> 'clean'").select("run_id", "fault_turn")
    return p.join(tr.truth.select("run_id", F.col("fault_turn").alias("ft")), "run_id").select(
        "run_id", (F.col("fault_turn") - F.col("ft")).alias("off"))


def offset_histogram(tr: Traces) -> DataFrame:
    return _offsets(tr).groupBy(F.greatest(F.lit(-20), F.least(F.lit(20), F.col("off"))).alias("off")).agg(_one().alias("n"))


def turn_truth(tr: Traces) -> DataFrame:
    """Per turn: true window class (0 = background) and the class with the largest probability."""
    t = tr.truth.select("run_id", "label", "fault_turn")
    inside = (F.col("label") != "clean") & (F.abs(F.col("t") - F.col("fault_turn")) <= 2)
    y = F.when(inside, F.col("label")).otherwise("clean")
    best = tr.probs.groupBy("run_id", "t").agg(label_name(argmax("p", "c")).alias("yp"))
    return best.join(t, "run_id").select("run_id", "t", y.alias("y"), "yp")


def candidate_bounds(tr: Traces) -> DataFrame:
    """First candidate turn against the one nearest to the truth, over unresolved assignments of faulty runs."""
    from tracewright.operators.lifecycles import assignment_records

    c = assignment_records(tr).filter("unresolved_at_end").select("run_id", F.col("handoff_turn").alias("t"))
    f = tr.truth.filter("label <> 'clean'").select("run_id", "label", "fault_turn")
    j = c.join(f, "run_id").groupBy("run_id", "label").agg(
        F.abs(F.min("t") - F.max("fault_turn")).alias("first"), F.min(F.abs(F.col("t") - F.col("fault_turn"))).alias("best"))
    n = f.groupBy("label").agg(_one().alias("faulty"))
    r = j.groupBy("label").agg(_one().alias("covered"), *[
        F.avg(flag(F.col(w) <= k)).alias(f"{w}_hit_{k}") for w in ("first", "best") for k in (0, 1, 2)])
    return n.join(r, "label", "left").na.fill(0)


# ---- slices, shares, changes ----------------------------------------------------------
def sliced(tr: Traces, df: DataFrame, names: list[str]) -> DataFrame:
    """One row per (run, slice it belongs to)."""
    s = slices(tr)
    return df.join(s, "run_id").select(*df.columns, F.explode(F.filter(F.array(*[
        F.when(F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())).alias("slice"))


def slice_scores(tr: Traces, df: DataFrame, names: list[str], smallest: int) -> DataFrame:
    x = sliced(tr, df, names)
    n = x.groupBy("slice").agg(_one().alias("n"))
    return n.join(macro_f1(x, ["slice"]), "slice").select("slice", "n", F.when(F.col("n") >= smallest, F.col("macro_f1")).alias("macro_f1"))


def label_shares(tr: Traces) -> DataFrame:
    """Label shares of truth and prediction with the total variation distance."""
    def share(df, name):
        return df.groupBy("label").agg(_one().alias("c")).withColumn(name, F.col("c") / df.select(_one()).scalar()).drop("c")
    j = share(tr.truth, "true_share").join(share(tr.pred, "pred_share"), "label", "full").na.fill(0)
    tv = j.agg(0.5 * F.sum(F.abs(F.col("true_share") - F.col("pred_share")))).scalar()
    return j.withColumn("distance", tv)


def change_table(df: DataFrame) -> DataFrame:
    """How labels move from model A to model B: fixed, broken, changed but still wrong."""
    return df.filter("a <> b").groupBy("a", "b").agg(
        _one().alias("n"), count_where((F.col("b") == F.col("y")) & (F.col("a") != F.col("y"))).alias("fixed"),
        count_where((F.col("a") == F.col("y")) & (F.col("b") != F.col("y"))).alias("broke"),
        count_where((F.col("a") != F.col("y")) & (F.col("b") != F.col("y"))).alias("still_wrong"))


def by_group_delta(df: DataFrame, key: str) -> DataFrame:
    """Macro F1 of A and B and their difference per value of ``key``."""
    a = macro_f1(df, [key], yp="a").withColumnRenamed("macro_f1", "f1_a")
    b = macro_f1(df, [key], yp="b").withColumnRenamed("macro_f1", "f1_b")
    return a.join(b, key).withColumn("delta", F.col("f1_b") - F.col("f1_a"))


def complementarity(df: DataFrame) -> DataFrame:
    y, a, b = F.col("y"), F.col("a"), F.col("b")
    o = macro_f1(df.withColumn("o", F.when(a == y, a).otherwise(b)), yp="o").scalar()
    return df.agg(count_where(a != y).alias("a_misses"), count_where((a != y) & (b == y)).alias("b_hits_on_misses"),
                  F.avg(flag(a == b)).alias("agreement")).withColumn("oracle_macro", o)


def error_group(y: Column, yp: Column) -> Column:
    return F.when(y == yp, F.concat(y, F.lit(" correct"))).otherwise(F.concat(y, F.lit(" -> "), yp))


def group_profile(profile: DataFrame, groups: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, median, p90 and share above zero of every metric inside every group."""
    long = profile.join(groups, "run_id").unpivot(["run_id", "grp"], metrics, "metric", "value")
    g = long.groupBy("grp", "metric").agg(_one().alias("n"), F.avg("value").alias("mean"), F.avg(flag(F.col("value") > 0)).alias("share_positive"))
    return g.join(percentiles(long, ["grp", "metric"], "value", {"median": 0.5, "p90": 0.9}), ["grp", "metric"])


def format_check(answer: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per violation: duplicate, unknown or missing ids, unknown labels, bad success or turn."""
    kinds = [
        (answer.groupBy("run_id").agg(_one().alias("c")).filter("c > 1").select("run_id"), "duplicate_id"),
        (answer.select("run_id").join(expected.select("run_id"), "run_id", "left_anti").distinct(), "unknown_id"),
        (expected.select("run_id").join(answer.select("run_id"), "run_id", "left_anti"), "missing_id"),
        (answer.filter(~F.coalesce(F.col("label").isin(LABELS), F.lit(False))).select("run_id"), "unknown_label"),
        (answer.filter(~F.coalesce(F.col("success").isin(0, 1), F.lit(False))).select("run_id"), "bad_success"),
        (answer.filter(F.col("fault_turn").cast("string").try_cast("bigint").isNull()).select("run_id"), "bad_turn")]
    out = None
    for df, kind in kinds:
        rows = df.withColumn("violation", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def consistency(tr: Traces, pred: DataFrame) -> DataFrame:
    j = pred.join(tr.runs.select("run_id", "n"), "run_id")
    clean, t = F.col("label") == "clean", F.col("fault_turn")
    return j.agg(_one().alias("rows"), count_where(clean & (t != -1)).alias("clean_with_turn"), count_where(~clean & (t < 0)).alias("fault_without_turn"),
                 count_where(t >= F.col("n")).alias("turn_outside_run"))


EPISODE_CLASSES = ["no episode", "with new result", "no progress, short", "no progress, long"]


def episode_classes(tr: Traces) -> DataFrame:
    """Class of the longest episode of each run, by true label."""
    from tracewright.operators.waits import all_episodes

    e = all_episodes(tr)
    top = F.struct(F.col("length"), -F.col("start_turn"))
    l = e.groupBy("run_id").agg(F.max("length").alias("length"), F.max_by(
        (F.col("n_artifacts_during") > 0) | (F.col("n_new_intent_during") > 0), top).alias("made"))
    j = tr.truth.select("run_id", "label").join(l, "run_id", "left")
    cls = (F.when(F.col("length").isNull(), EPISODE_CLASSES[0]).when(F.col("made"), EPISODE_CLASSES[1])
           .when(F.col("length") >= 7, EPISODE_CLASSES[3]).otherwise(EPISODE_CLASSES[2]))
    return j.groupBy(cls.alias("episode_class")).pivot("label", LABELS).count().na.fill(0)


# Signature families as family -> (column, comparison, threshold).
FAMILIES = {
    "dropped": [("lc_n_unresolved", ">=", 1.0), ("unanswered_assign", ">=", 1.0), ("undelivered_assign", ">=", 3.0)],
    "loop": [("norm_dup_max", ">=", 4.0), ("max_sender_repeat_streak", ">=", 3.0), ("intent_max_share", ">=", 0.40)],
    "wait": [("wg_has_recip_pair", ">=", 1.0), ("wg_has_same_subtask_recip_pair", ">=", 1.0), ("share_status", ">=", 0.30)],
    "conflict": [("state_alternating_flips", ">=", 1.0), ("state_override_ratio", ">=", 0.30)],
    "drift": [("goal_ov_delta", "<=", -0.10), ("goal_ov_zero_ratio", ">=", 0.90), ("new_intents_in_tail", ">=", 3.0)],
}


def signature_families(block: DataFrame, groups: DataFrame) -> DataFrame:
    """Activation rate of each family and share of rows with two or three active families, by group."""
    def on(tests):
        cond = F.lit(False)
        for c, op, x in tests:
            v = F.round(F.col(c).cast("double"), 9)
            cond = cond | ((v >= x) if op == ">=" else (v <= x))
        return cond

    j = block.join(groups, "run_id").select("run_id", "grp", *[flag(on(t)).alias(f) for f, t in FAMILIES.items()])
    k = sum((F.col(f) for f in FAMILIES), F.lit(0.0))
    j = j.withColumn("k", k).select("*", F.explode(F.array(F.col("grp"), F.lit("ALL"))).alias("grp2"))
    return j.groupBy(F.col("grp2").alias("grp")).agg(_one().alias("n"), *[F.avg(f).alias(f"rate_{f}") for f in FAMILIES],
                                                   F.avg(flag(F.col("k") >= 2)).alias("two_plus"), F.avg(flag(F.col("k") >= 3)).alias("three_plus"))


def success_breakdown(tr: Traces, recovered: DataFrame) -> DataFrame:
    """Base rate and errors of the success answer by true label and by observed recovery (run_id, recovered)."""
    j = pairs(tr).join(recovered, "run_id", "left")
    j = j.select("s", "sp", F.explode(F.array(
        F.concat(F.lit("label="), F.col("y")),
        F.when(F.coalesce(F.col("recovered"), F.lit(False)), "recovery observed").otherwise("no recovery"))).alias("grp"))
    return j.groupBy("grp").agg(_one().alias("n"), F.avg(flag(F.col("s") == 1)).alias("base_rate"), F.avg(flag(F.col("sp") == 1)).alias("predicted_rate"),
                                count_where(F.col("s") != F.col("sp")).alias("errors"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Promotion gate: each delta against its threshold (metrics: metric, delta; thresholds: metric, least)."""
    return thresholds.join(metrics, "metric", "left").select("metric", "least", "delta", F.coalesce(
        F.round(F.col("delta"), 9) >= F.col("least"), F.lit(False)).alias("passed"))


