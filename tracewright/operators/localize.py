"""Where does the fault begin? Peaks of window probabilities and rules per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.fixed import FAULTS, HIGH, LABELS
from tracewright.functions.numbers import count_where, flag
from tracewright.operators.matching import first_replies, undelivered
from tracewright.operators.runfeatures import longest_runs
from tracewright.operators.turns import decaying_streak
from tracewright.plans.gather import gather
from tracewright.plans.scan import framed, running
from tracewright.session import chunk_turns
from tracewright.sources.traces import Traces


def undelivered_near_fault(tr: Traces) -> DataFrame:
    """Runs with a never-delivered assignment: first such turn, how many, and whether it is within 2 turns of the fault."""
    u = tr.once("undelivered", undelivered).groupBy("run_id").agg(F.min("t").alias("first_undelivered"), F.count(F.lit(1)).alias("n_undelivered"))
    j = u.join(tr.truth.select("run_id", "label", "fault_turn"), "run_id")
    near = (F.col("label") != "clean") & (F.abs(F.col("first_undelivered") - F.col("fault_turn")) <= 2)
    return j.select("run_id", "label", "fault_turn", "first_undelivered", "n_undelivered", near.alias("near_fault"))


def label_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LABELS]), (index + 1).cast("int"))


def label_index(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in LABELS]), name) - 1


def argmax(value: str, index: str) -> Column:
    """Index of the largest value; the lowest index wins ties. Combines before the shuffle."""
    return F.max_by(index, F.struct(F.col(value), -F.col(index)))


def peaks(tr: Traces) -> DataFrame:
    """Best turn and its probability per (run, class); clean (class 0) has turn -1."""
    return tr.once("peaks", lambda t: t.probs.groupBy("run_id", "c").agg(
        argmax("p", "t").alias("t"), F.max("p").alias("p")).withColumn("t", F.when(F.col("c") == 0, -1).otherwise(F.col("t"))))


def predicted_peak(tr: Traces, pred: DataFrame) -> DataFrame:
    """Peak turn of the predicted class of each run, -1 for clean."""
    want = pred.select("run_id", "label", label_index(F.col("label")).alias("c"))
    return want.join(peaks(tr), ["run_id", "c"], "left").select(
        "run_id", "label", F.when(F.col("c") == 0, -1).otherwise(F.coalesce("t", F.lit(-1))).cast("long").alias("fault_turn"), "p")


def top_windows(tr: Traces) -> DataFrame:
    """Mean of the three largest probabilities and the gap of the first two, per (run, class).

    The rank filter is applied before the shuffle as well (group limit), so a
    long run sends three rows per task and not its turns.
    """
    w = Window.partitionBy("run_id", "c").orderBy(F.col("p").desc(), F.col("t"))
    top = tr.probs.withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return top.groupBy("run_id", "c").agg(
        F.avg("p").alias("top3"), F.max(F.when(F.col("k") == 1, F.col("p"))).alias("first"),
        F.max(F.when(F.col("k") == 2, F.col("p"))).alias("second")).select(
            "run_id", "c", "top3", F.coalesce(F.col("first") - F.col("second"), F.lit(0.0)).alias("gap12"))


PER_CLASS = ["amax", "atop3", "pos_max", "pos_first_hi", "n_hi", "area", "gap12"]
GLOBALS = ["strongest_prob", "strongest_gap", "n_strong_classes", "earliest_strong_pos", "probs_entropy", "bg_max", "bg_mean",
           "bg_peak_pos", "argmax_prob_spread"]
AGGREGATE_COLS = [f"p_{c}_{s}" for c in FAULTS for s in PER_CLASS] + [f"g_{s}" for s in GLOBALS]


def probability_block(tr: Traces) -> DataFrame:
    """51 run-level columns from the per-turn class probabilities."""
    return window_aggregates(tr.probs, tr.runs.select("run_id", "n"))


def window_aggregates(probs: DataFrame, sizes: DataFrame) -> DataFrame:
    # one pass, as probabilities may cost a model each; the three largest are taken inside chunks of turns, then of those
    hi = F.col("p") >= HIGH
    first = lambda values: F.slice(F.sort_array(values, asc=False), 1, 3)
    chunk = F.floor(F.col("t") / chunk_turns(probs.sparkSession)).alias("chunk")
    s = probs.groupBy("run_id", "c", chunk).agg(
        F.max("p").alias("amax"), argmax("p", "t").alias("at"), F.min(F.when(hi, F.col("t"))).alias("first_hi"),
        count_where(hi).alias("n_hi"), F.sum("p").alias("mass"), F.count("p").alias("turns"), first(F.collect_list("p")).alias("top"))
    s = s.groupBy("run_id", "c").agg(
        F.max("amax").alias("amax"), argmax("amax", "at").alias("at"), F.min("first_hi").alias("first_hi"), F.sum("n_hi").alias("n_hi"),
        (F.sum("mass") / F.sum("turns")).alias("area"), first(F.flatten(F.collect_list("top"))).alias("top"))
    total = F.aggregate("top", F.lit(0.0), lambda a, p: a + p)
    x = s.withColumns({"atop3": total / F.size("top"), "second": F.get("top", F.lit(1))}).join(sizes, "run_id")
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    x = x.select(
        "run_id", "c", "amax", "atop3", (F.col("at") / n).alias("pos_max"), F.coalesce(F.col("first_hi") / n, F.lit(1.0)).alias("pos_first_hi"),
        (F.col("n_hi") / n).alias("n_hi"), "area", F.coalesce(F.col("amax") - F.col("second"), F.lit(0.0)).alias("gap12"))
    fault = F.col("c") > 0
    best = F.sort_array(F.collect_list(F.when(fault, F.col("amax"))), asc=False)  # six classes at most
    picks = [F.max(F.when(F.col("c") == i + 1, F.col(st))).alias(f"p_{c}_{st}") for i, c in enumerate(FAULTS) for st in PER_CLASS]
    g = x.groupBy("run_id").agg(
        *picks, best.alias("best"), F.sum("area").alias("mass"), F.collect_list("area").alias("areas"),
        count_where(fault & (F.col("amax") >= HIGH)).alias("g_n_strong_classes"),
        F.coalesce(F.min(F.when(fault & (F.col("amax") >= HIGH), F.col("pos_first_hi"))), F.lit(1.0)).alias("g_earliest_strong_pos"),
        *[F.max(F.when(F.col("c") == 0, F.col(a))).alias(b) for a, b in (("amax", "g_bg_max"), ("area", "g_bg_mean"), ("pos_max", "g_bg_peak_pos"))])
    q = lambda a: a / F.greatest(F.col("mass"), F.lit(1e-12))
    ent = F.aggregate("areas", F.lit(0.0), lambda acc, a: acc - q(a) * F.log(q(a) + 1e-12))
    g = g.withColumns({
        "g_strongest_prob": F.get("best", F.lit(0)), "g_strongest_gap": F.get("best", F.lit(0)) - F.get("best", F.lit(1)),
        "g_probs_entropy": ent, "g_argmax_prob_spread": F.get("best", F.lit(0)) - F.element_at("best", -1)})
    return g.select("run_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in AGGREGATE_COLS])


# ---- rules -------------------------------------------------------------------
def most_common_intent(tr: Traces) -> DataFrame:
    c = tr.messages.groupBy("run_id", "intent").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("t"))
    top = F.struct(F.col("c"), -F.col("t"))
    return c.groupBy("run_id").agg(F.max_by("intent", top).alias("intent"), F.max_by("t", top).alias("first_t"))


def hottest_key(tr: Traces) -> DataFrame:
    """Most written state key (first seen on ties) with at least two writes, and its first override."""
    k = tr.state.groupBy("run_id", "key").agg(F.count(F.lit(1)).alias("c"), F.min("t").alias("t0"),
                                              F.min(F.when(F.col("op") == "override", F.col("t"))).alias("o"))
    top = F.struct(F.col("c"), -F.col("t0"))
    h = k.groupBy("run_id").agg(F.max_by("key", top).alias("key"), F.max("c").alias("writes"), F.max_by("o", top).alias("first_override"))
    return h.withColumn("first_override", F.when(F.col("writes") >= 2, F.col("first_override")))


def off_goal_start(tr: Traces, floor: float = 0.0) -> DataFrame:
    """First of three off-goal turns (overlap at most ``floor``) within six turns, and the first off-goal turn."""
    m = framed(tr.messages.select("run_id", "t", flag(F.col("goal_ov") <= floor).alias("off")), ["run_id"], 0, 6, lambda w: {
        "ahead": F.sum("off").over(w.rowsBetween(0, 6))})
    off = F.col("off") > 0
    return m.groupBy("run_id").agg(F.min(F.when(off & (F.col("ahead") >= 3), F.col("t"))).alias("dense"),
                                   F.min(F.when(off, F.col("t"))).alias("any"))


def rule_turns(tr: Traces) -> DataFrame:
    """One column per fault class: the turn its rule points at, -1 when it finds none."""
    m = tr.messages
    und = tr.once("undelivered", undelivered).groupBy("run_id").agg(F.min("t").alias("und"))
    una = tr.once("first_replies", first_replies).groupBy("run_id").agg(F.min(F.when(F.col("reply_t").isNull(), F.col("t"))).alias("una"), F.min("t").alias("a0"))
    second = running(m.filter("is_assign").select("run_id", "intent", "t"), ["run_id", "intent"], ["t"], {
        "before": ("max", "t", False)}, pos="t").groupBy("run_id").agg(F.min(F.when(F.col("before").isNotNull(), F.col("t"))).alias("second"))
    dup = tr.artifacts.groupBy("run_id", "hash").agg(F.count(F.lit(1)).alias("c"), F.max("t").alias("t")).filter("c > 1").groupBy(
        "run_id").agg(F.max("t").alias("dup"))
    agree = m.filter((F.col("type") == "state_update") & F.lower("text").contains("gree")).groupBy("run_id").agg(F.min("t").alias("agree"))
    loop = decaying_streak(tr).filter("level > 0").groupBy("run_id").agg(
        F.max_by("onset", F.struct(F.col("level"), -F.col("t"))).alias("loop"))
    j = gather(tr.runs.select("run_id", "n"), und, una, second, dup, agree, loop, longest_runs(tr).select("run_id", "status_start"), hottest_key(tr).select("run_id", "first_override"), off_goal_start(tr), most_common_intent(tr).select("run_id", F.col("first_t").alias("top_t")))
    none = F.lit(-1)
    return j.select(
        "run_id", F.coalesce("und", "una", "a0", none).alias("dropped_handoff"),
        F.coalesce("second", "dup", F.floor(F.col("n") / 2)).alias("duplicated_work"), F.coalesce("status_start", none).alias("deadlock"),
        F.coalesce("first_override", "agree", none).alias("conflict"), F.coalesce("dense", "any", none).alias("goal_drift"),
        F.coalesce("loop", "top_t", none).alias("runaway_loop"))


def rule_localiser(tr: Traces, labels: DataFrame) -> DataFrame:
    """Turn by the rule of the given label; -1 for clean."""
    r = tr.once("rule_turns", rule_turns)
    pick = F.lit(-1)
    for c in FAULTS:
        pick = F.when(F.col("label") == c, F.col(c)).otherwise(pick)
    return labels.select("run_id", "label").join(r, "run_id").select("run_id", "label", pick.cast("long").alias("fault_turn"))


def confident_peak(tr: Traces, labels: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Peak turn when its probability reaches the threshold, else the rule turn."""
    p = predicted_peak(tr, labels).select("run_id", "label", F.col("fault_turn").alias("peak"), "p")
    r = rule_localiser(tr, labels).select("run_id", F.col("fault_turn").alias("rule"))
    sure = (F.col("label") != "clean") & (F.col("p") >= threshold)
    return p.join(r, "run_id").select("run_id", "label", F.when(sure, F.col("peak")).otherwise(F.col("rule")).alias("fault_turn"))


def hybrid_by_class(tr: Traces, labels: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Turn by the rule for the classes whose source is "rule", by the peak for the others."""
    p = predicted_peak(tr, labels).select("run_id", "label", F.col("fault_turn").alias("peak"))
    r = rule_localiser(tr, labels).select("run_id", F.col("fault_turn").alias("rule"))
    by_rule = F.col("label").isin([c for c, s in sources.items() if s == "rule"])
    return p.join(r, "run_id").select("run_id", "label", F.when(by_rule, F.col("rule")).otherwise(F.col("peak")).alias("fault_turn"))



def named_sources(tr: Traces, labels: DataFrame) -> dict[str, DataFrame]:
    return {"peak": predicted_peak(tr, labels).select("run_id", "label", "fault_turn"), "rule": rule_localiser(tr, labels)}


def _stacked(sources: dict[str, DataFrame], folds: DataFrame) -> DataFrame:
    long = [d.select("run_id", "label", "fault_turn", F.lit(k).alias("place"), F.lit(name).alias("source")) for k, (name, d) in enumerate(sources.items())]
    out = long[0]
    for d in long[1:]:
        out = out.unionByName(d)
    return out.join(folds.select("run_id", "fold"), "run_id")


def source_map(tr: Traces, sources: dict[str, DataFrame], folds: DataFrame, k: int) -> DataFrame:
    """``(fold, label, source, hits, runs)``: for each fold and predicted class the source with most hits on the other folds.

    Hits are truly faulty runs whose class is right and whose turn is within 2. What the other folds have is all folds' total
    less the fold's own, so one aggregation of the runs serves every fold. Equal hits go to the source named first.
    """
    x = _stacked(sources, folds).filter("label <> 'clean'").join(tr.truth.select("run_id", F.col("label").alias("y"), F.col("fault_turn").alias("ft")).filter("y <> 'clean'"), "run_id")
    hit = (F.col("y") == F.col("label")) & (F.abs(F.col("fault_turn") - F.col("ft")) <= 2)
    per = x.groupBy("fold", "label", "place", "source").agg(F.sum(flag(hit)).alias("hits"), F.count(F.lit(1)).alias("runs"))
    total = per.groupBy("label", "place", "source").agg(F.sum("hits").alias("all_hits"), F.sum("runs").alias("all_runs"))
    total = total.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("fold"))
    rest = total.join(per, ["fold", "label", "place", "source"], "left").na.fill(0, ["hits", "runs"]).select(
        "fold", "label", "place", "source", (F.col("all_hits") - F.col("hits")).alias("hits"), (F.col("all_runs") - F.col("runs")).alias("runs")).filter("runs > 0")
    best = F.struct(F.col("hits"), -F.col("place"))
    return rest.groupBy("fold", "label").agg(F.max_by("source", best).alias("source"), F.max("hits").alias("hits"), F.max_by("runs", best).alias("runs"))


def hybrid_by_fold(tr: Traces, sources: dict[str, DataFrame], folds: DataFrame, k: int) -> DataFrame:
    """``(run_id, label, fold, source, fault_turn)``: each run's turn by the source that the other folds chose for its class.

    Clean runs get -1; a class that no other fold predicts for a faulty run takes the first source.
    """
    chosen = source_map(tr, sources, folds, k).select("fold", "label", F.col("source").alias("pick"))
    first = next(iter(sources))
    x = _stacked(sources, folds).join(chosen, ["fold", "label"], "left").filter(F.col("source") == F.coalesce("pick", F.lit(first)))
    clean = F.col("label") == "clean"
    return x.select("run_id", "label", "fold", F.when(clean, "none").otherwise(F.col("source")).alias("source"), F.when(clean, -1).otherwise(F.col("fault_turn")).cast("long").alias("fault_turn"))
