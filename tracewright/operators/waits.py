"""Wait graph, repeat episodes and the task graph of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import EPISODE_MAX_GAP, EPISODE_MIN_LENGTH
from tracewright.functions.numbers import count_where, flag, ratio
from tracewright.functions.text import key_form, normalise
from tracewright.operators.basics import wait_events
from tracewright.operators.lifecycles import open_counter  # noqa: F401  (re-exported for the catalog)
from tracewright.operators.matching import pair_edges, reciprocal_pairs
from tracewright.operators.runfeatures import state_changes
from tracewright.plans.gather import gather
from tracewright.plans.scan import lookup, percentiles, running
from tracewright.sources.runs import event_log
from tracewright.sources.traces import Traces


def _one() -> Column:
    return F.count(F.lit(1))


# Names of output columns.
WAIT_COLS = ["wg_n_wait_edges", "wg_n_unique_wait_edges", "wg_n_recip_pairs", "wg_has_recip_pair", "wg_recip_wait_share",
             "wg_n_same_subtask_recip_pairs", "wg_has_same_subtask_recip_pair", "wg_earliest_recip_pos_rel",
             "wg_max_pair_wait_events", "wg_max_pair_repeat_after_onset", "wg_max_pair_span_rel", "wg_n_agents_in_recip_pairs"]


def wait_block(tr: Traces) -> DataFrame:
    w = wait_events(tr)
    edges = pair_edges(w, "waiter", "awaited")
    per = edges.groupBy("run_id").agg(F.sum("cnt").alias("e"), _one().alias("ue"))
    pairs = reciprocal_pairs(edges).withColumn("onset", F.greatest("first_ab", "first_ba"))
    a, b = F.least("waiter", "awaited").alias("a"), F.greatest("waiter", "awaited").alias("b")
    same = w.filter("task is not null and waiter <> awaited").groupBy("run_id", a, b, "task").agg(
        F.max(F.col("waiter") < F.col("awaited")).alias("up"), F.max(F.col("waiter") > F.col("awaited")).alias("down")).filter(
            "up and down").select("run_id", "a", "b").distinct().groupBy("run_id").agg(_one().alias("same"))
    again = w.select("run_id", a, b, "t").join(pairs.select("run_id", "a", "b", "onset"), ["run_id", "a", "b"]).groupBy(
        "run_id", "a", "b").agg(count_where(F.col("t") > F.col("onset")).alias("again"))
    pp = pairs.join(again, ["run_id", "a", "b"])
    top = F.struct("cnt", "a", "b")
    pr = pp.groupBy("run_id").agg(
        _one().alias("rp"), F.min("onset").alias("onset"), F.max("cnt").alias("mx"), F.max_by("again", top).alias("again"),
        F.max_by(F.col("last_t") - F.col("first_t"), top).alias("span"))
    ag = pairs.select("run_id", F.explode(F.array("a", "b")).alias("x")).distinct().groupBy("run_id").agg(_one().alias("ag"))
    j = gather(tr.runs.select("run_id", "n"), per, pr, same, ag)
    end = F.greatest(F.col("n") - 1, F.lit(1))
    vals = [F.col("e"), F.col("ue"), F.col("rp"), flag(F.col("rp") > 0), ratio("e", "n"), F.col("same"), flag(F.col("same") > 0),
            ratio("onset", end), F.col("mx"), F.col("again"), ratio("span", end), F.col("ag")]
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(WAIT_COLS, vals)])


# ---- repeat episodes ---------------------------------------------------------
def _repeats(tr: Traces, norm: Callable[[Column], Column]) -> DataFrame:
    """Messages of repeated texts: the start of their burst, and how often the agent changed up to them."""
    m = tr.messages.select("run_id", "t", "n", "sender", "receiver", "type", "intent", norm(F.col("text")).alias("sig"))
    k = m.filter("sig <> ''")
    k = running(k, ["run_id", "sig"], ["t"], {"prev": ("last", F.struct("t", "sender"), False)}, pos="t")
    gap = F.col("t") - F.col("prev.t")
    starts = gap.isNull() | (gap > EPISODE_MAX_GAP)
    k = k.withColumn("gap", F.when(~starts, gap)).withColumn(
        "turns_over", F.when(starts | (F.col("prev.sender") != F.col("sender")), 1).otherwise(0)).withColumn("starts", starts)
    return running(k, ["run_id", "sig"], ["t"], {"start_turn": ("max", F.when(F.col("starts"), F.col("t"))),
                                                 "over": ("sum", "turns_over")}, pos="t")


def episode_segments(tr: Traces, norm: Callable[[Column], Column] = normalise) -> DataFrame:
    """(run_id, sig, start_turn, segment, agent): every stretch of one agent in an episode, in order from 1."""
    k = _repeats(tr, norm)
    e = k.groupBy("run_id", "sig", "start_turn").agg(_one().alias("length"), F.min("over").alias("first_over")).filter(
        F.col("length") >= EPISODE_MIN_LENGTH)
    seg = k.filter("turns_over = 1").join(e, ["run_id", "sig", "start_turn"])
    return seg.select("run_id", "sig", "start_turn", (F.col("over") - F.col("first_over") + 1).alias("segment"), F.col("sender").alias("agent"))


def episodes(tr: Traces, norm: Callable[[Column], Column] = normalise) -> DataFrame:
    """Bursts of one normalised text: neighbours at most six turns apart, at least three messages.

    Who spoke in which order is a table of its own, ``episode_segments``.
    """
    m = tr.messages
    k = _repeats(tr, norm)
    e = k.groupBy("run_id", "sig", "start_turn").agg(
        F.max("n").alias("n"), F.max("t").alias("end_turn"), _one().alias("length"), F.max("gap").alias("max_gap"),
        F.avg("gap").alias("mean_gap"),
        F.count_distinct("sender").alias("n_distinct_agents"), F.sum("turns_over").alias("n_trajectory_segments"),
        count_where(F.col("type").isin("handoff", "inform")).alias("n_deliver_msgs"),
        F.min_by("receiver", "t").alias("to_agent")).filter(F.col("length") >= EPISODE_MIN_LENGTH)
    firsts = m.filter("trim(intent) <> ''").groupBy("run_id", "intent").agg(F.min("t").alias("t"))
    marks = (tr.artifacts.select("run_id", "t", F.lit(1).alias("a"), F.lit(0).alias("s"), F.lit(0).alias("i"))
             .unionByName(tr.state.select("run_id", "t", F.lit(0).alias("a"), F.lit(1).alias("s"), F.lit(0).alias("i")))
             .unionByName(firsts.select("run_id", "t", F.lit(0).alias("a"), F.lit(0).alias("s"), F.lit(1).alias("i"))))
    ends = e.select("run_id", "sig", "start_turn", F.explode(F.array(
        F.struct((F.col("start_turn") - 1).alias("t"), F.lit(-1).alias("w")),
        F.struct(F.col("end_turn").alias("t"), F.lit(1).alias("w")))).alias("x")).select("run_id", "sig", "start_turn", "x.*")
    c = lookup(ends, marks, ["run_id"], {x: ("sum", x) for x in "asi"}, direction="prev", inclusive=True)
    c = c.groupBy("run_id", "sig", "start_turn").agg(*[
        F.sum(F.col("w") * F.col(x)).alias(n) for x, n in zip("asi", ("n_artifacts_during", "n_state_during",
                                                                      "n_new_intent_during"))])
    e = e.join(c, ["run_id", "sig", "start_turn"])
    d, span = F.col("n_distinct_agents"), F.col("end_turn") - F.col("start_turn")
    idle = (F.col("n_artifacts_during") == 0) & (F.col("n_state_during") == 0)
    tight = F.col("max_gap") == 1
    return e.select(
        "run_id", "sig", "n", "start_turn", "end_turn", "length",
        span.alias("span"), tight.alias("consecutive"), (~tight).alias("interleaved"), "max_gap", "mean_gap", "n_distinct_agents",
        "n_trajectory_segments", (d >= 2).alias("is_cycle"), (d == 2).alias("is_2cycle"), (d == 3).alias("is_3cycle"),
        (d == 1).alias("same_agent"), "n_artifacts_during", "n_state_during", "n_new_intent_during",
        "n_deliver_msgs", idle.alias("no_progress"), F.when(idle, span).otherwise(0).alias("no_progress_span"), "to_agent")


# Names of output columns.
EPISODE_COLS = ["ep_n_episodes", "ep_has_episode", "ep_longest_len", "ep_longest_span_rel", "ep_repeat_event_share",
                "ep_max_distinct_agents", "ep_has_multi_agent_cycle", "ep_n_cycle_episodes", "ep_n_interleaved_episodes",
                "ep_interleaved_share", "ep_n_no_progress_episodes", "ep_no_progress_share", "ep_longest_no_progress_span_rel",
                "ep_episodes_with_progress_share", "ep_earliest_start_rel", "ep_latest_end_rel"]
# Names of output columns.
EPISODE_PROFILE = ["n_episodes", "longest_len", "longest_span", "repeat_density", "max_gap", "same_agent_ep", "cycle2_ep",
                   "cycle3_ep", "any_cycle_ep", "ep_with_artifact", "ep_with_state", "ep_with_new_intent", "ep_no_progress",
                   "longest_no_progress_span", "longest_start_rel", "ep_repeated_same_intent", "interleaved_ep",
                   "episodes_with_new_result"]


def all_episodes(tr: Traces) -> DataFrame:
    return tr.once("episodes", episodes)


def _episode_sums(tr: Traces) -> DataFrame:
    e = all_episodes(tr)
    longest = F.struct(F.col("length"), -F.col("start_turn"))
    some = lambda c: F.max(flag(c))
    made = F.col("n_artifacts_during") > 0
    per = e.groupBy("run_id").agg(
        _one().alias("k"), F.max("length").alias("len"), F.max_by("span", longest).alias("span"), F.sum("length").alias("tot"),
        F.max_by("start_turn", longest).alias("start"), F.max("n_distinct_agents").alias("mda"), count_where(F.col("is_cycle")).alias("cyc"),
        count_where(F.col("interleaved")).alias("il"), count_where(F.col("no_progress")).alias("np"),
        F.max("no_progress_span").alias("nps"), F.min("start_turn").alias("first"), F.max("end_turn").alias("last"),
        count_where(made | (F.col("n_state_during") > 0) | (F.col("n_deliver_msgs") > 0)).alias("prog"), F.max("max_gap").alias("gap"),
        some(F.col("same_agent")).alias("same"), some(F.col("is_2cycle")).alias("c2"), some(F.col("is_3cycle")).alias("c3"),
        some(made).alias("art"), some(F.col("n_state_during") > 0).alias("st"), some(F.col("n_new_intent_during") > 0).alias("ni"),
        some(F.col("n_new_intent_during") == 0).alias("noni"), some(made | (F.col("n_deliver_msgs") > 0)).alias("res"))
    return tr.runs.select("run_id", "n").join(per, "run_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))


def episode_block(tr: Traces) -> DataFrame:
    j, k = _episode_sums(tr), F.col("k")
    end = F.greatest(F.col("n") - 1, F.lit(1))
    none = lambda v: F.when(k > 0, v).otherwise(-1.0)
    vals = [k, flag(k > 0), F.col("len"), ratio("span", end), ratio("tot", "n"), F.col("mda"), flag(F.col("cyc") > 0), F.col("cyc"),
            F.col("il"), ratio("il", k), F.col("np"), ratio("np", k), ratio("nps", end), ratio("prog", k),
            none(ratio("first", end)), none(ratio("last", end))]
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(EPISODE_COLS, vals)])


def episode_profile(tr: Traces) -> DataFrame:
    j, k = _episode_sums(tr), F.col("k")
    end = F.greatest(F.col("n") - 1, F.lit(1))
    vals = [k, F.col("len"), F.col("span"), ratio("tot", "n"), F.col("gap"), F.col("same"), F.col("c2"), F.col("c3"),
            flag(F.col("cyc") > 0), F.col("art"), F.col("st"), F.col("ni"), flag(F.col("np") > 0), F.col("nps"),
            F.when(k > 0, ratio("start", end)).otherwise(-1.0), F.col("noni"), flag(F.col("il") > 0), F.col("res")]
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(EPISODE_PROFILE, vals)])


# ---- task graph ----------------------------------------------------------------
def ordered_log(tr: Traces) -> DataFrame:
    return tr.once("event_log", event_log)


def artifact_tasks(tr: Traces) -> DataFrame:
    """Artifacts with their task: the stated subtask, else the one task whose handoff names this unique id."""
    a = tr.artifacts.select("run_id", "t", "id", "by", key_form(F.col("subtask")).alias("own_task"))
    unique = a.groupBy("run_id", "id").agg(_one().alias("copies"))
    refs = tr.messages.filter("type = 'handoff'").select(
        "run_id", key_form(F.col("intent")).alias("task"), F.explode("refs").alias("id")).filter("task is not null")
    named = refs.groupBy("run_id", "id").agg(F.min("task").alias("t1"), F.max("task").alias("t2")).filter("t1 = t2")
    j = a.join(unique, ["run_id", "id"]).join(named.select("run_id", "id", "t1"), ["run_id", "id"], "left")
    return j.select("run_id", "t", "id", "by", "copies", F.coalesce("own_task", F.when(F.col("copies") == 1, F.col("t1"))).alias("task"))


def task_deliveries(tr: Traces) -> DataFrame:
    """Result evidence: (run_id, task, seq, t, actor), one row per (task, t, actor)."""
    arts = artifact_tasks(tr)
    log = ordered_log(tr)
    mseq = log.filter("kind = 'message'").select("run_id", "t", "seq")
    aseq = log.filter("kind = 'artifact'").select("run_id", F.col("src").alias("id"), "t", "seq")
    m = tr.messages.filter("is_delivery").select("run_id", "t", "sender", key_form(F.col("intent")).alias("task"),
                                                 F.explode("refs").alias("id"))
    one = arts.filter("copies = 1").select("run_id", "id", F.col("task").alias("art_task"), F.col("by").alias("maker"), F.lit(1).alias("hit"))
    g = m.join(one, ["run_id", "id"], "left").groupBy("run_id", "t").agg(
        F.first("sender").alias("sender"), F.first("task").alias("task"), _one().alias("k"), F.count("hit").alias("hits"),
        F.count("maker").alias("makers"), F.min("art_task").alias("a1"), F.max("art_task").alias("a2"),
        F.min("maker").alias("m1"), F.max("maker").alias("m2"))
    full = F.col("hits") == F.col("k")
    a1, a2 = F.when(full, F.col("a1")), F.when(full, F.col("a2"))
    task = F.coalesce("task", F.when(full & (a1 == a2), a1))
    agree = a1.isNull() | ((a1 == a2) & (a1 == task))
    actor = F.when(full & (F.col("makers") == F.col("k")) & (F.col("m1") == F.col("m2")), F.col("m1")).otherwise(
        F.nullif(F.col("sender"), F.lit("")))
    msg = g.filter(task.isNotNull() & agree).select("run_id", "t", task.alias("task"), actor.alias("actor")).join(mseq, ["run_id", "t"])
    art = arts.filter("task is not null").join(aseq, ["run_id", "id", "t"]).select(
        "run_id", "t", "task", F.col("by").alias("actor"), "seq")
    return msg.unionByName(art).groupBy("run_id", "task", "t", "actor").agg(F.min("seq").alias("seq"))


def task_assignments(tr: Traces) -> DataFrame:
    return tr.once("task_assignments", _task_assignments)


def _task_assignments(tr: Traces) -> DataFrame:
    """Assignments closed by the next delivery of their task (a delivery closes all pending ones)."""
    return tr.once("task_assignments", _task_assignments)


def _task_assignments(tr: Traces) -> DataFrame:
    log = ordered_log(tr)
    mseq = log.filter("kind = 'message'").select("run_id", "t", "seq")
    a = tr.messages.filter("is_assign").select("run_id", "t", "sender", F.col("receiver").alias("assignee"),
                                               key_form(F.col("intent")).alias("task")).filter(
        "task is not null and sender <> '' and assignee <> ''").join(mseq, ["run_id", "t"])
    d = tr.once("task_deliveries", task_deliveries)
    res = ("last", F.struct(F.col("seq").alias("seq"), F.col("t").alias("t"), F.col("actor").alias("actor")))
    a = lookup(a, d, ["run_id", "task"], {"result": res}, direction="next", pos="seq")
    a = running(a, ["run_id", "task"], ["seq"], {"before": ("last", F.struct("seq", "result"), False)}, pos="seq")
    pending = F.col("before").isNotNull() & (F.col("before.result").isNull() | (F.col("before.result.seq") > F.col("seq")))
    return a.select("run_id", "t", "seq", "task", "assignee", F.col("result.seq").alias("result_seq"),
                    F.col("result.t").alias("result_t"), F.col("result.actor").alias("result_actor"), pending.alias("again_before_result"))


def _assignee_activity(tr: Traces) -> DataFrame:
    """Flags per assignment: the assignee spoke on the task / on another task before the result."""
    a = task_assignments(tr)
    mseq = ordered_log(tr).filter("kind = 'message'").select("run_id", "t", "seq")
    m = tr.messages.filter("type <> 'system'").select("run_id", "t", "sender", "type", key_form(F.col("intent")).alias("task")).filter(
        "task is not null").join(mseq, ["run_id", "t"])
    key = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    ev = m.select("run_id", "seq", F.explode(F.filter(F.array(
        F.when(F.col("type") != "handoff", key("r", "sender", "task")), key("a", "sender"), key("s", "sender", "task")),
        lambda x: x.isNotNull())).alias("k"))
    pts = a.select("run_id", F.col("seq").alias("at"), "result_seq", F.explode(F.array(
        F.struct(key("r", "assignee", "task").alias("k"), F.lit("resp").alias("side"), F.lit(1).alias("w")),
        F.struct(key("a", "assignee").alias("k"), F.lit("other").alias("side"), F.lit(1).alias("w")),
        F.struct(key("s", "assignee", "task").alias("k"), F.lit("other").alias("side"), F.lit(-1).alias("w")))).alias("x"))
    pts = pts.select("run_id", "at", "x.*", F.explode(F.array(
        F.struct((F.col("at") + 1).alias("seq"), F.lit(-1).alias("e")),
        F.struct(F.col("result_seq").alias("seq"), F.lit(1).alias("e")))).alias("y")).select(
            "run_id", "at", "k", "side", F.col("y.seq").alias("seq"), (F.col("w") * F.col("y.e")).alias("w"))
    c = lookup(pts.filter("seq is not null"), ev, ["run_id", "k"], {"c": ("sum", F.lit(1))}, pos="seq")
    # without a result all that follows counts: the key's total, so no position gathers the open tasks of a run
    total = ev.groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("c"))
    c = c.unionByName(pts.filter("seq is null").join(total, ["run_id", "k"]).select(c.columns))
    return c.groupBy("run_id", F.col("at").alias("seq")).agg(
        (F.sum(F.when(F.col("side") == "resp", F.col("w") * F.col("c")).otherwise(0)) > 0).alias("response"),
        (F.sum(F.when(F.col("side") == "other", F.col("w") * F.col("c")).otherwise(0)) > 0).alias("other_activity"))


def resolved_waits(tr: Traces) -> DataFrame:
    """Waits naming agent and task with the first later delivery by that agent on that task."""
    mseq = ordered_log(tr).filter("kind = 'message'").select("run_id", "t", "seq")
    w = wait_events(tr).filter("task is not null and awaited <> ''").select(
        "run_id", "t", F.col("awaited").alias("actor"), key_form(F.col("task")).alias("task")).join(mseq, ["run_id", "t"])
    d = tr.once("task_deliveries", task_deliveries)
    return lookup(w, d, ["run_id", "task", "actor"], {"d": ("last", F.struct(F.col("t").alias("t"), F.col("seq").alias("seq")))},
                  direction="next", pos="seq").select("run_id", "t", "actor", "task", F.col("d.t").alias("delivery_t"))


# Names of output columns.
TASK_COLS = [
    "g_known_assignments", "g_assignments_without_later_result", "g_unresolved_assignment_rate",
    "g_executor_response_without_result", "g_response_without_result_rate", "g_other_task_activity_before_result",
    "g_other_task_activity_rate", "g_delivery_delay_mean_turns", "g_delivery_delay_p90_turns", "g_delivery_delay_max_rel",
    "g_peak_open_assignments", "g_open_assignment_area_rel", "g_max_open_age_rel", "g_repeat_assignment_before_result",
    "g_repeat_before_result_rate", "g_other_executor_deliveries", "g_other_executor_delivery_rate", "g_wait_task_links",
    "g_wait_resolved_by_named_agent_rate", "g_wait_to_delivery_delay_mean_rel", "g_state_multiwriter_keys",
    "g_state_cross_writer_events", "g_state_cross_writer_overrides", "g_state_cross_writer_value_changes"]


def open_tasks(tr: Traces) -> DataFrame:
    """Open assignments after every change in event order, with the turn of the next change."""
    a = task_assignments(tr)
    ev = a.select("run_id", "seq", "t", F.lit(1).alias("d")).unionByName(a.filter("result_seq is not null").select(
        "run_id", F.col("result_seq").alias("seq"), F.col("result_t").alias("t"), F.lit(-1).alias("d")))
    ev = ev.groupBy("run_id", "seq", "t").agg(F.sum("d").alias("d"))
    o = running(ev, ["run_id"], ["seq"], {"open": ("sum", "d")})
    return running(o, ["run_id"], ["seq"], {"next_t": ("last", "t", False)}, reverse=True)


def task_block(tr: Traces) -> DataFrame:
    a = task_assignments(tr).join(_assignee_activity(tr), ["run_id", "seq"], "left")
    ends = ordered_log(tr).filter("t is not null").groupBy("run_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    a = a.join(ends, "run_id")
    done = F.col("result_seq").isNotNull()
    delay = F.col("result_t") - F.col("t")
    per = a.groupBy("run_id").agg(
        _one().alias("k"), count_where(~done).alias("u"), count_where(~done & F.col("response")).alias("ur"),
        count_where(F.col("response")).alias("r"), count_where(~done & F.col("other_activity")).alias("uo"), F.avg(delay).alias("dm"),
        F.max(delay).alias("dx"), F.max(F.greatest(F.coalesce("result_t", "t1") - F.col("t"), F.lit(0))).alias("age"),
        count_where(F.col("again_before_result")).alias("rep"),
        count_where(F.coalesce(F.col("result_actor") != F.col("assignee"), F.lit(False)) & (F.col("result_actor") != "")).alias("oth"),
        count_where(done).alias("d"))
    p90 = percentiles(a.withColumn("delay", delay), ["run_id"], "delay", {"p90": 0.9}, how="disc")
    area = open_tasks(tr).join(ends, "run_id").groupBy("run_id").agg(
        F.max("open").alias("peak"), F.sum(F.col("open") * (F.coalesce("next_t", "t1") - F.col("t"))).alias("area"))
    w = resolved_waits(tr).withColumn("x", F.col("delivery_t") - F.col("t")).groupBy("run_id").agg(
        _one().alias("w"), F.count("x").alias("wd"), F.avg("x").alias("wm"))
    ch = tr.once("state_changes", state_changes)
    multi = ch.filter("key <> '' and agent <> ''").groupBy("run_id", F.lower("key").alias("key")).agg(
        (F.min("agent") != F.max("agent")).alias("m")).groupBy("run_id").agg(count_where(F.col("m")).alias("mk"))
    cw = ch.filter("cross_writer").groupBy("run_id").agg(
        _one().alias("cw"), count_where(F.col("op") == "override").alias("co"), count_where(F.col("flip")).alias("cv"))
    j = gather(tr.runs.select("run_id"), ends, per, p90, area, w, multi, cw)
    span = F.greatest(F.col("t1") - F.col("t0"), F.lit(1))
    k = F.col("k")
    vals = [k, F.col("u"), ratio("u", k), F.col("ur"), ratio("ur", "r"), F.col("uo"), ratio("uo", k), F.col("dm"), F.col("p90"), ratio("dx", span),
            F.col("peak"), ratio("area", k * span), ratio("age", span), F.col("rep"), ratio("rep", k), F.col("oth"), ratio("oth", "d"), F.col("w"),
            ratio("wd", "w"), ratio("wm", span), F.col("mk"), F.col("cw"), F.col("co"), F.col("cv")]
    return j.select("run_id", *[F.coalesce(v, F.lit(0)).cast("double").alias(c) for c, v in zip(TASK_COLS, vals)])
