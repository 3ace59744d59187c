"""Turn tables: one row per (run, turn), causal columns and centred-window columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.fixed import CONTEXT, KEYWORDS, MESSAGE_TYPES, RADIUS
from tracewright.functions.numbers import flag, ratio
from tracewright.functions.text import keyword_count
from tracewright.operators.matching import delivered_assignments, pair_edges, reciprocal_pairs
from tracewright.operators.runfeatures import condition_streaks, state_changes, streaks
from tracewright.plans.gather import gather
from tracewright.plans.scan import chunk_of, framed, lookup, running
from tracewright.session import chunk_turns
from tracewright.sources.traces import Traces


def _one() -> Column:
    return F.count(F.lit(1))


def _key(kind: str, *parts: str) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), *parts)


# ---- counts known at a turn ------------------------------------------------------
def turn_counters(tr: Traces) -> DataFrame:
    return tr.once("turn_counters", _turn_counters)


# names of the counters: what is counted, by the columns whose value a turn shares with it
COUNTERS = {
    ("norm",): {"norm_count": "is_message"},
    ("intent",): {"intent_count": "is_message", "assigns": "is_assigned", "deliveries": "is_delivered", "authors": "is_author", "arts_for_intent": "is_artfor"},
    ("sender",): {"sent": "is_message", "out_degree": "is_edge", "arts_by_sender": "is_artifact"},
    ("receiver",): {"received": "is_message", "in_degree": "is_edge"},
    ("lo", "hi"): {"forth": "is_forth", "back": "is_back", "waits_forth": "is_wait_forth", "waits_back": "is_wait_back"},
    (): {"edges": "is_edge", "nodes": "is_node", "arts": "is_artifact"}}


def _turn_counters(tr: Traces) -> DataFrame:
    """Everything counted up to and including each turn, for the turn's own text, intent, agents and pair.

    Messages and what else is counted are dealt once by (run, chunk of turns); every counter is a window inside that chunk, so
    none is shuffled by itself. What earlier chunks of a long run hold comes as rows at the chunk's first turn.
    """
    m = tr.messages
    size = chunk_turns(m.sparkSession)
    one = F.lit(1).cast("long")
    when = lambda cond: F.when(cond, one)
    # both directions of a pair meet at (lo, hi); agents that are not known are one agent
    ahead = F.coalesce(F.col("sender") <= F.col("receiver"), F.lit(True))
    status = F.col("type") == "status"
    said = m.select(
        "run_id", "t", "norm", "intent", "sender", "receiver", F.least("sender", "receiver").alias("lo"), F.greatest("sender", "receiver").alias("hi"),
        one.alias("is_message"), when(F.col("is_assign")).alias("is_assigned"), when(F.col("is_delivery")).alias("is_delivered"),
        when(ahead).alias("is_forth"), when(~ahead).alias("is_back"), when(ahead & status).alias("is_wait_forth"), when(~ahead & status).alias("is_wait_back"))
    edges = pair_edges(m).select("run_id", F.col("first_t").alias("t"), F.col("src").alias("sender"), F.col("dst").alias("receiver"), one.alias("is_edge"))
    agents = m.select("run_id", "t", F.explode(F.array("sender", "receiver")).alias("x")).groupBy("run_id", "x").agg(F.min("t").alias("t"))
    authors = m.filter("intent <> ''").groupBy("run_id", "intent", "sender").agg(F.min("t").alias("t"))
    arts = tr.artifacts.select("run_id", F.greatest("t", F.lit(0)).cast("long").alias("t"), F.col("by").alias("sender"), F.col("subtask").alias("intent"),
                               one.alias("is_artifact"), when(F.col("subtask") != "").alias("is_artfor"))
    line = said
    for e in (edges, agents.select("run_id", "t", one.alias("is_node")), authors.select("run_id", "t", "intent", one.alias("is_author")), arts):
        line = line.unionByName(e, allowMissingColumns=True)
    line = line.withColumn("c", chunk_of(line, "t"))
    # a run of several chunks has more turns than a chunk: these are few, whatever the number of runs
    long = m.filter(F.col("n") > size).select("run_id").distinct()
    parts = line.join(F.broadcast(long), "run_id", "left_semi")
    for by, counts in COUNTERS.items():
        sums = sorted(set(counts.values()))
        upto = Window.partitionBy("run_id", *by).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.groupBy("run_id", *by, "c").agg(*[F.sum(x).alias(x) for x in sums]).select(
            "run_id", *by, "c", (F.col("c") * size).alias("t"), *[F.sum(x).over(upto).alias(f"{x}_before") for x in sums])
        line = line.unionByName(before.select("run_id", *by, "c", "t", *[F.col(f"{x}_before").alias(f"{x}_{'_'.join(by)}") for x in sums]), allowMissingColumns=True)
    own = lambda by, x: F.coalesce(F.col(x), F.col(f"{x}_{'_'.join(by)}"))
    line = line.repartition("run_id", "c").select("run_id", "t", "sender", "receiver", "is_message", *[
        F.coalesce(F.sum(own(by, x)).over(Window.partitionBy("run_id", "c", *by).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(name)
        for by, counts in COUNTERS.items() for name, x in counts.items()])
    same = F.col("sender").eqNullSafe(F.col("receiver"))
    pick = lambda kind: (F.when(ahead, F.col(f"{kind}forth")).otherwise(F.col(f"{kind}back")), F.when(~ahead | same, F.col(f"{kind}forth")).otherwise(F.col(f"{kind}back")))
    (pair, reverse), (waits, reverse_waits) = pick(""), pick("waits_")
    return line.filter("is_message = 1").select(
        "run_id", "t", "norm_count", "intent_count", "assigns", "deliveries", "sent", "received", pair.alias("pair_count"), reverse.alias("reverse_count"),
        waits.alias("pair_waits"), reverse_waits.alias("reverse_waits"), "out_degree", "in_degree", "edges", "nodes",
        "authors", "arts", "arts_by_sender", "arts_for_intent")


def pair_history(tr: Traces) -> DataFrame:
    """Earlier messages of the pair, reverse messages seen at the pair's previous message, earlier waits."""
    m = tr.messages.select("run_id", "t", "sender", "receiver", "type")
    c = turn_counters(tr).select("run_id", "t", "pair_count", "reverse_count", "pair_waits", "reverse_waits")
    x = running(m.join(c, ["run_id", "t"]), ["run_id", "sender", "receiver"], ["t"], {
        "before": ("last", "reverse_count", False)}, pos="t")
    st = F.col("type") == "status"
    return x.select("run_id", "t", (F.col("pair_count") - 1).alias("pair_before"), F.coalesce("before", F.lit(0)).alias("reverse_before"),
                    (F.col("pair_waits") - F.when(st, 1).otherwise(0)).alias("waits_before"),
                    flag(st & (F.col("reverse_waits") > 0)).alias("wait_answered"))


def state_so_far(tr: Traces) -> DataFrame:
    """For every turn the latest state write at or before it, with running totals."""
    ch = tr.once("state_changes", state_changes)
    news = ch.groupBy("run_id", "key", "value").agg(F.min(F.struct("t", "idx")).alias("first"))
    x = ch.join(news, ["run_id", "key", "value"]).withColumn("fresh", F.when(F.struct("t", "idx") == F.col("first"), 1).otherwise(0))
    x = x.select("run_id", "t", "idx", "key", "op", "flip", "alt_flip", "fresh")
    one, over = F.lit(1).cast("long"), F.when(F.col("op") == "override", 1).otherwise(0)
    b = lambda c: F.when(F.col(c), 1).otherwise(0)
    key = running(x, ["run_id", "key"], ["t", "idx"], {"key_writes": ("sum", one), "key_values": ("sum", "fresh")}, pos="t")
    j = running(key, ["run_id"], ["t", "idx"], {"writes": ("sum", one), "values": ("sum", "fresh"), "overrides": ("sum", over),
                                         "flips": ("sum", b("flip")), "alts": ("sum", b("alt_flip"))})
    names = ["writes", "values", "overrides", "flips", "alts", "key_writes", "key_values"]
    last = F.struct(*names, over.alias("is_override"), b("flip").alias("changed"), b("alt_flip").alias("alt"),
                    F.when(F.col("key") == "run_status", 1).otherwise(0).alias("is_run_status"))
    out = lookup(tr.messages.select("run_id", "t"), j, ["run_id"], {"s": ("last", last)}, inclusive=True, tie="idx")
    return out.select("run_id", "t", *[F.coalesce(f"s.{n}", F.lit(0)).cast("double").alias(n) for n in [
        *names, "is_override", "changed", "alt", "is_run_status"]])


# Names of output columns.
CAUSAL_COLS = (
    ["abs_pos", "rel_pos", "turns_to_end", "run_len", "run_n_agents", "run_n_artifacts", "run_n_state", "run_n_intents",
     "run_n_types", "run_max_streak", "run_frac_handoff", "run_frac_status"]
    + [f"type_{v}" for v in MESSAGE_TYPES] + ["is_assign", "is_delivery"]
    + ["has_intent", "intent_len", "refs_count", "text_len", "text_trunc_12_30", "tool_present", "self_loop"]
    + [f"kw_{g}" for g in KEYWORDS]
    + ["goal_ov", "goal_ov_zero", "goal_ov_delta_prev", "goal_ov_minus_runmean", "goal_ov_runmean", "goal_ov_drop_3",
       "goal_ov_drop_5"]
    + ["sender_role_orch", "sender_role_analyst", "recv_role_orch", "recv_self", "sender_out_deg", "recv_out_deg",
       "sender_share_so_far", "sender_distinct_recv_so_far", "recv_share_so_far", "sender_so_far_frac", "recv_so_far_frac"]
    + ["norm_rep_count_so_far", "norm_rep_run_so_far", "same_norm_as_prev", "same_sender_as_prev", "streak_len", "streak_frac",
       "intent_msg_count_so_far", "intent_distinct_agents_so_far", "intent_agents_frac", "intent_first_seen",
       "n_assigns_intent_so_far", "n_deliveries_intent_so_far", "intent_delivered_so_far", "is_second_assign_intent",
       "assign_unanswered_so_far", "unanswered_frac_so_far"]
    + ["status_streak", "status_streak_frac", "status_reciprocal_before", "pair_msg_count_so_far", "pair_recip_count_so_far",
       "status_between_pair_so_far"]
    + ["state_writes_so_far", "state_distinct_keys_so_far", "state_overrides_so_far", "state_flips_so_far",
       "state_altflips_so_far", "state_key_writes_so_far", "state_key_distinct_vals", "state_is_override",
       "state_value_changed", "state_alt_flip", "state_key_is_run_status", "state_key_writes_frac"]
    + ["arts_so_far", "arts_by_sender_so_far", "arts_for_intent_so_far", "intent_covered_by_arts", "edges_so_far",
       "graph_density_so_far", "edge_recip_before", "n_distinct_agents_so_far"]
    + [f"w{r}_{x}" for r in (RADIUS, CONTEXT) for x in (
        "handoff", "status", "state", "final", "intents", "goal_ov_mean", "goal_ov_max", "max_norm_rep", "forward", "backward")])


def goal_history(tr: Traces) -> DataFrame:
    """Running mean of the goal overlap and its change against the previous 1, 3 and 5 turns."""
    g = F.col("goal_ov")
    m = framed(tr.messages.select("run_id", "t", "goal_ov"), ["run_id"], 5, 0, lambda w: {
        "prev": F.lag("goal_ov").over(w), "back3": F.avg("goal_ov").over(w.rowsBetween(-3, -1)),
        "back5": F.avg("goal_ov").over(w.rowsBetween(-5, -1))})
    m = running(m, ["run_id"], ["t"], {"total": ("sum", "goal_ov")})
    mean = F.col("total") / (F.col("t") + 1)
    return m.select("run_id", "t", (g - F.coalesce("prev", g)).alias("goal_ov_delta_prev"), (g - mean).alias("goal_ov_minus_runmean"),
                    mean.alias("goal_ov_runmean"), (g - F.coalesce("back3", g)).alias("goal_ov_drop_3"),
                    (g - F.coalesce("back5", g)).alias("goal_ov_drop_5"))


def with_roles(tr: Traces, df: DataFrame) -> DataFrame:
    """Roles of sender and receiver (null for an unknown agent)."""
    role = tr.agents.select("run_id", "agent", "role")
    df = df.join(role.select("run_id", F.col("agent").alias("sender"), F.col("role").alias("sender_role")), ["run_id", "sender"], "left")
    return df.join(role.select("run_id", F.col("agent").alias("receiver"), F.col("role").alias("receiver_role")),
                   ["run_id", "receiver"], "left")


def run_context(tr: Traces) -> DataFrame:
    """Run-level constants of the turn tables."""
    m = tr.messages
    per = m.groupBy("run_id").agg(F.avg(flag(F.col("type") == "handoff")).alias("frac_handoff"),
                                  F.avg(flag(F.col("type") == "status")).alias("frac_status"),
                                  F.sum(flag(F.col("is_assign"))).alias("n_assign"))
    it = m.filter("intent <> ''").select("run_id", "intent").distinct().groupBy("run_id").agg(_one().alias("n_intents"))
    ty = m.select("run_id", "type").distinct().groupBy("run_id").agg(_one().alias("n_types"))
    who = m.select("run_id", F.explode(F.array("sender", "receiver")).alias("x")).distinct().groupBy("run_id").agg(_one().alias("n_people"))
    ag = tr.agents.groupBy("run_id").agg(_one().alias("n_agents"))
    ar = tr.artifacts.groupBy("run_id").agg(_one().alias("n_arts"))
    hs = tr.artifacts.filter("hash <> ''").groupBy("run_id", "hash").agg(_one().alias("c")).groupBy("run_id").agg(
        F.sum(F.col("c") - 1).alias("dup_hashes"))
    st = tr.state.groupBy("run_id").agg(_one().alias("n_state"), F.sum(flag(F.col("op") == "override")).alias("n_override"))
    mx = tr.once("streaks", streaks).groupBy("run_id").agg(F.max("streak").alias("max_streak"))
    j = gather(tr.runs.select("run_id"), per, it, ty, who, ag, ar, hs, st, mx)
    return j.na.fill(0)


def causal_turns(tr: Traces) -> DataFrame:
    """Turn table whose per-turn columns look only at turns up to the current one, plus centred shares."""
    m, n, t = tr.messages, F.col("n"), F.col("t")
    low = m.withColumn("low", F.lower("text"))
    base = with_roles(tr, low.select(*m.columns, *[keyword_count(F.col("low"), g).alias(f"kw_{g}") for g in KEYWORDS]))
    c = turn_counters(tr)
    x = base.join(c, ["run_id", "t"])
    cols = ["run_id", "t", "type", "intent", "goal_ov", "norm_count", "norm", "sender"]

    def frames(w):
        out = {"p_norm": F.lag("norm").over(w), "p_sender": F.lag("sender").over(w)}
        for r in (RADIUS, CONTEXT):
            f = w.rowsBetween(-r, r)
            for name, v in (("handoff", "handoff"), ("status", "status"), ("state", "state_update"), ("final", "final")):
                out[f"w{r}_{name}"] = F.avg(flag(F.col("type") == v)).over(f)
            out[f"w{r}_intents"] = F.size(F.collect_set(F.when(F.col("intent") != "", F.col("intent"))).over(f))
            out[f"w{r}_goal_ov_mean"] = F.avg("goal_ov").over(f)
            out[f"w{r}_goal_ov_max"] = F.max("goal_ov").over(f)
            out[f"w{r}_max_norm_rep"] = F.max("norm_count").over(f)
        return out

    win = framed(x.select(*cols), ["run_id"], CONTEXT, CONTEXT, frames).drop("type", "intent", "goal_ov", "norm_count", "norm", "sender")
    sp = condition_streaks(m.select("run_id", "t", "type"), {"status_streak": F.col("type") == "status"}).drop("type")
    e = pair_edges(m)
    recip = reciprocal_pairs(e).select("run_id", F.greatest("first_ab", "first_ba").alias("r")).unionByName(
        e.filter("src = dst").select("run_id", F.col("first_t").alias("r"))).groupBy("run_id").agg(F.min("r").alias("recip_t"))
    x = x.join(win, ["run_id", "t"]).join(sp, ["run_id", "t"]).join(goal_history(tr), ["run_id", "t"])
    x = x.join(tr.once("streaks", streaks).select("run_id", "t", "streak"), ["run_id", "t"]).join(pair_history(tr), ["run_id", "t"])
    x = x.join(state_so_far(tr), ["run_id", "t"]).join(run_context(tr), "run_id").join(recip, "run_id", "left")
    na, nas, nd = F.greatest("n_agents", F.lit(1)), F.col("assigns"), F.col("deliveries")
    keyed = F.col("intent") != ""
    authors = F.when(keyed, F.col("authors")).otherwise(0)
    artfor = F.when(keyed, F.col("arts_for_intent")).otherwise(0)
    place = {"forward": lambda r: F.least(t, F.lit(r)) / r, "backward": lambda r: F.least(n - 1 - t, F.lit(r)) / r}
    v = {
        "abs_pos": t, "rel_pos": ratio(t, F.greatest(n - 1, F.lit(1))), "turns_to_end": n - t - 1, "run_len": n, "run_n_agents": na,
        "run_n_artifacts": "n_arts", "run_n_state": "n_state", "run_n_intents": "n_intents", "run_n_types": "n_types",
        "run_max_streak": "max_streak", "run_frac_handoff": "frac_handoff", "run_frac_status": "frac_status",
        **{f"type_{k}": flag(F.col("type") == k) for k in MESSAGE_TYPES}, "is_assign": flag(F.col("is_assign")),
        "is_delivery": flag(F.col("is_delivery")), "has_intent": flag(keyed), "intent_len": F.length("intent"),
        "refs_count": F.size("refs"), "text_len": F.length("text"), "text_trunc_12_30": flag(F.length("text").between(12, 30)),
        "tool_present": flag(F.col("tool") != ""), "self_loop": flag(F.col("sender") == F.col("receiver")),
        "goal_ov_zero": flag(F.col("goal_ov") == 0), "sender_role_orch": flag(F.col("sender_role") == "orchestrator"),
        "sender_role_analyst": flag(F.col("sender_role") == "analyst"), "recv_role_orch": flag(F.col("receiver_role") == "orchestrator"),
        "recv_self": flag(F.col("sender") == F.col("receiver")), "sender_out_deg": "out_degree", "recv_out_deg": "in_degree",
        "sender_share_so_far": F.col("sent") / (t + 1), "sender_distinct_recv_so_far": "out_degree",
        "recv_share_so_far": F.col("received") / (t + 1), "sender_so_far_frac": F.col("sent") / n, "recv_so_far_frac": F.col("received") / n,
        "norm_rep_count_so_far": "norm_count", "norm_rep_run_so_far": F.col("norm_count") - 1,
        "same_norm_as_prev": flag(F.col("norm") == F.col("p_norm")), "same_sender_as_prev": flag(F.col("sender") == F.col("p_sender")),
        "streak_len": "streak", "streak_frac": F.col("streak") / n, "intent_msg_count_so_far": "intent_count",
        "intent_distinct_agents_so_far": authors, "intent_agents_frac": authors / na, "intent_first_seen": flag(F.col("intent_count") == 1),
        "n_assigns_intent_so_far": nas, "n_deliveries_intent_so_far": nd, "intent_delivered_so_far": flag(nd > 0),
        "is_second_assign_intent": flag(F.col("is_assign") & (nas >= 2)),
        "assign_unanswered_so_far": flag(F.col("is_assign") & (nas - nd > 0)),
        "unanswered_frac_so_far": (nas - nd) / F.greatest(nas, F.lit(1)), "status_streak_frac": F.col("status_streak") / n,
        "status_reciprocal_before": "wait_answered", "pair_msg_count_so_far": "pair_before", "pair_recip_count_so_far": "reverse_before",
        "status_between_pair_so_far": "waits_before", "state_writes_so_far": "writes", "state_distinct_keys_so_far": "values",
        "state_overrides_so_far": "overrides", "state_flips_so_far": "flips", "state_altflips_so_far": "alts",
        "state_key_writes_so_far": "key_writes", "state_key_distinct_vals": "key_values", "state_is_override": "is_override",
        "state_value_changed": "changed", "state_alt_flip": "alt", "state_key_is_run_status": "is_run_status",
        "state_key_writes_frac": F.col("key_writes") / n, "arts_so_far": "arts", "arts_by_sender_so_far": "arts_by_sender",
        "arts_for_intent_so_far": artfor, "intent_covered_by_arts": flag(artfor > 0), "edges_so_far": "edges",
        "graph_density_so_far": F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1)),
        "edge_recip_before": flag(t >= F.col("recip_t")), "n_distinct_agents_so_far": "nodes",
        **{f"w{r}_{k}": fn(r) for r in (RADIUS, CONTEXT) for k, fn in place.items()}}
    return x.select("run_id", "t", *[(F.col(v[k]) if isinstance(v.get(k), str) else v.get(k, F.col(k))).cast("double").alias(k)
                                     for k in CAUSAL_COLS])


# ---- centred windows ---------------------------------------------------------------
# Names of output columns.
WINDOW_COLS = [
    "w_n_msgs", "w_n_agents", "w_n_intents", "w_n_artifacts", "w_n_assign", "w_unresolved_ratio", "w_pos", "w_rel_turn",
    "w_is_first", "w_is_last", "w_dist_start", "w_dist_end", "w_dist_start_rel", "w_dist_end_rel", "w_win_n", "w_win_n_rel",
    "w_win_handoff", "w_win_inform", "w_win_status", "w_win_state_update", "w_win_final", "w_win_system", "w_win_assign",
    "w_win_result", "w_win_refs", "w_win_tools", "w_win_tools_rel", "w_win_distinct_tools", "w_win_distinct_senders",
    "w_win_distinct_receivers", "w_win_distinct_intents", "w_win_new_intents", "w_win_repeat_intents", "w_win_state_set",
    "w_win_state_override", "w_win_state_keys", "w_win_artifacts", "w_win_artifacts_final", "w_win_status_rel",
    "w_status_streak", "w_status_streak_rel", "w_win_assign_no_reply", "w_win_dup_intent", "w_run_dup_intent_rate",
    "w_win_dup_tool", "w_run_dup_artifact_hash", "w_win_override", "w_run_override_rel", "w_win_same_key_set",
    "w_state_contention", "w_win_goal_rel", "w_no_goal_streak", "w_no_goal_streak_rel", "w_win_dup_text",
    "w_win_dup_text_rel", "w_run_dup_text_rate", "w_loop_streak", "w_open_before", "w_open_after", "w_open_after_rel",
    "w_backlog_frac", "w_recv_active_after_rel", "w_recv_silence_oldest_rel", "w_recv_own_msgs_after_mean_rel",
    "w_delta_assign_prev", "w_delta_assign_next", "w_delta_status_prev", "w_delta_status_next", "w_delta_handoff_prev",
    "w_delta_handoff_next", "w_delta_tools_prev", "w_delta_tools_next", "w_delta_worst", "w_ctx_assign", "w_ctx_status",
    "w_ctx_inform", "w_ctx_state_update", "w_ctx_tools", "w_ctx_override", "w_since_assign", "w_since_assign_rel",
    "w_to_next_assign", "w_assign_pos_rel"]

SUMMED = ["handoff", "inform", "status", "state_update", "final", "system", "assign", "result", "refs", "tools", "st_set",
          "st_over", "art", "art_final", "no_reply", "dup_intent", "dup_tool", "dup_text", "no_goal", "contention"]


def turn_base(tr: Traces) -> DataFrame:
    return tr.once("turn_base", _turn_base)


def _turn_base(tr: Traces) -> DataFrame:
    """Per-turn indicators: types, repeats inside the run, state and artifact counts, open assignments."""
    m = tr.messages
    per_turn_state = tr.once("state_changes", state_changes).groupBy("run_id", "t").agg(
        F.sum(flag(F.col("op") == "override")).alias("st_over"), F.sum(flag(F.col("op") != "override")).alias("st_set"),
        F.sum(flag(F.col("cross_writer"))).alias("contention"))
    per_turn_art = tr.artifacts.groupBy("run_id", "t").agg(F.count(F.lit(1)).cast("double").alias("art"),
                                                          F.sum(flag(F.col("status") == "final")).alias("art_final"))
    intents = m.filter("intent <> ''").groupBy("run_id", "intent").agg(
        F.sum(flag(F.col("is_assign"))).alias("a_count"), F.min("t").alias("intent_first"))
    tools = m.filter("tool <> ''").groupBy("run_id", "tool").agg(_one().alias("tool_count"))
    norms = m.filter("norm <> ''").groupBy("run_id", "norm").agg(_one().alias("norm_total"))
    replied = m.filter("is_delivery").select("run_id", F.col("sender").alias("receiver"), "intent", F.lit(True).alias("replied")).distinct()
    resolved = delivered_assignments(tr).select("run_id", "t", F.lit(1.0).alias("resolved"))
    x = (m.join(per_turn_state, ["run_id", "t"], "left").join(per_turn_art, ["run_id", "t"], "left")
         .join(resolved, ["run_id", "t"], "left").join(intents, ["run_id", "intent"], "left").join(tools, ["run_id", "tool"], "left")
         .join(norms, ["run_id", "norm"], "left").join(replied, ["run_id", "receiver", "intent"], "left"))
    keyed_assign = F.col("is_assign") & (F.col("intent") != "")
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return x.select(
        "run_id", "t", "n", "sender", "receiver", "intent", "tool", "intent_first", keyed_assign.alias("keyed_assign"),
        *[flag(F.col("type") == v).alias(v) for v in MESSAGE_TYPES], flag(F.col("is_assign")).alias("assign"),
        flag(F.col("is_delivery")).alias("result"), flag(F.size("refs") > 0).alias("refs"), flag(F.col("tool") != "").alias("tools"),
        z("st_set"), z("st_over"), z("contention"), z("art"), z("art_final"), z("resolved"),
        flag(keyed_assign & F.col("replied").isNull()).alias("no_reply"), flag(keyed_assign & (F.col("a_count") > 1)).alias("dup_intent"),
        flag((F.col("tool") != "") & (F.col("tool_count") > 1)).alias("dup_tool"),
        flag((F.col("norm") != "") & (F.col("norm_total") >= 3)).alias("dup_text"), flag(F.col("goal_ov") == 0).alias("no_goal"))


def receiver_activity(tr: Traces) -> DataFrame:
    """What receivers of the window's assignments do after the window: activity, silence, share on the task."""
    b = turn_base(tr).filter("keyed_assign").select("run_id", "n", F.col("t").alias("j"), "receiver", "intent")
    c = b.select("*", F.explode(F.sequence(F.greatest(F.col("j") - RADIUS, F.lit(0)), F.least(F.col("j") + RADIUS, F.col("n") - 1))).alias("i"))
    said = tr.messages.select("run_id", "t", F.explode(F.array(_key("s", "sender"), _key("p", "sender", "intent"))).alias("k"))
    pts = c.select("run_id", "n", "i", "j", (F.col("i") + RADIUS).alias("t"), F.explode(F.array(
        F.struct(F.lit("s").alias("side"), _key("s", "receiver").alias("k")),
        F.struct(F.lit("p").alias("side"), _key("p", "receiver", "intent").alias("k")))).alias("x")).select("run_id", "n", "i", "j", "t", "x.*")
    r = lookup(pts, said, ["run_id", "k"], {"c": ("sum", F.lit(1)), "last": ("max", "t")}, direction="next")
    r = r.groupBy("run_id", "n", "i", "j").agg(
        F.max(F.when(F.col("side") == "s", F.col("c"))).alias("after"), F.max(F.when(F.col("side") == "p", F.col("c"))).alias("own"),
        F.max(F.when(F.col("side") == "s", F.col("last"))).alias("last"))
    n = F.col("n")
    return r.groupBy("run_id", F.col("i").alias("t")).agg(
        F.avg(F.col("after") / F.greatest(n - F.col("i") - RADIUS - 1, F.lit(1))).alias("w_recv_active_after_rel"),
        F.max(F.when(F.col("after") > 0, (n - 1 - F.col("last")) / n).otherwise(1.0)).alias("w_recv_silence_oldest_rel"),
        F.avg(F.col("own") / F.greatest(F.col("after"), F.lit(1))).alias("w_recv_own_msgs_after_mean_rel"))


def turn_windows(tr: Traces) -> DataFrame:
    """Centred-window table: sums over two and five turns either side, changes, streaks and backlog."""
    b = turn_base(tr)
    t, n = F.col("t"), F.col("n")
    d = running(b, ["run_id"], ["t"], {
        "a_before": ("sum", "assign", False), "r_before": ("sum", "resolved", False),
        "last_a": ("max", F.when(F.col("assign") > 0, t), False), **{
            f"x_{s}": ("max", F.when(F.col(s) == 0, t)) for s in ("status", "no_goal", "dup_text")}})
    nx = running(b.select("run_id", "t", "assign"), ["run_id"], ["t"], {"next_a": ("min", F.when(F.col("assign") > 0, t))}, reverse=True)
    d = d.join(nx.drop("assign"), ["run_id", "t"])
    # an assignment counts as closed from the second turn after it, so the previous turn's is still open
    d = framed(d, ["run_id"], 1, 0, lambda w: {"p_res": F.coalesce(F.lag("resolved").over(w), F.lit(0.0))})
    d = d.withColumn("open_before", F.greatest(F.col("a_before") - (F.col("r_before") - F.col("p_res")), F.lit(0.0)))
    d = written_once(tr, "turn_scanned", d)

    def frames(w):
        near, ctx = w.rowsBetween(-RADIUS, RADIUS), w.rowsBetween(-CONTEXT, CONTEXT)
        prev, nxt = w.rowsBetween(-2 * RADIUS - 1, -RADIUS - 1), w.rowsBetween(RADIUS + 1, 2 * RADIUS)
        out = {f"s_{k}": F.sum(k).over(near) for k in SUMMED}
        out |= {f"c_{k}": F.sum(k).over(ctx) for k in ("assign", "status", "inform", "state_update", "tools", "st_over")}
        for k in ("assign", "status", "handoff", "tools"):
            out[f"p_{k}"] = F.coalesce(F.sum(k).over(prev), F.lit(0.0))
            out[f"f_{k}"] = F.coalesce(F.sum(k).over(nxt), F.lit(0.0))
        out["win_n"] = F.count(F.lit(1)).over(near)
        for k in ("tool", "sender", "receiver", "intent"):
            out[f"d_{k}"] = F.size(F.collect_set(F.when(F.col(k) != "", F.col(k))).over(near))
        out["seen"] = F.collect_list("intent_first").over(near)
        out["open_later"] = F.last("open_before").over(w.rowsBetween(0, RADIUS))
        return out

    x = framed(d, ["run_id"], CONTEXT, CONTEXT, frames)
    tot = b.groupBy("run_id").agg(F.sum("dup_intent").alias("all_dup_intent"), F.sum("dup_text").alias("all_dup_text"))
    x = x.join(run_context(tr), "run_id").join(tot, "run_id").join(receiver_activity(tr), ["run_id", "t"], "left")
    lo = F.greatest(t - RADIUS, F.lit(0))
    one = F.lit(1)
    w = F.col("win_n")
    streak = lambda s: t - F.coalesce(f"x_{s}", F.lit(-1))
    last_a = F.coalesce(F.col("last_a") + 1, F.lit(0))
    deltas = {}
    for k in ("assign", "status", "handoff", "tools"):
        deltas[f"w_delta_{k}_prev"] = F.col(f"s_{k}") - F.col(f"p_{k}")
        deltas[f"w_delta_{k}_next"] = F.col(f"f_{k}") - F.col(f"s_{k}")
    gap = F.col("open_later") - F.col("open_before")
    v = {
        "w_n_msgs": n, "w_n_agents": F.col("n_people"), "w_n_intents": F.col("n_intents"), "w_n_artifacts": F.col("n_arts"),
        "w_n_assign": F.col("n_assign"), "w_unresolved_ratio": F.col("open_before") / F.greatest("n_assign", F.lit(1.0)),
        "w_pos": t / F.greatest(n - 1, one), "w_rel_turn": t / n, "w_is_first": flag(t == 0), "w_is_last": flag(t == n - 1),
        "w_dist_start": t, "w_dist_end": n - 1 - t, "w_dist_start_rel": t / n, "w_dist_end_rel": (n - 1 - t) / n, "w_win_n": w,
        "w_win_n_rel": w / n, **{f"w_win_{k}": F.col(f"s_{k}") for k in (*MESSAGE_TYPES, "assign", "result", "refs", "tools", "dup_intent",
                                                                        "dup_tool", "dup_text")},
        "w_win_tools_rel": F.col("s_tools") / w, "w_win_distinct_tools": F.col("d_tool"), "w_win_distinct_senders": F.col("d_sender"),
        "w_win_distinct_receivers": F.col("d_receiver"), "w_win_distinct_intents": F.col("d_intent"),
        "w_win_new_intents": F.size(F.filter("seen", lambda s: s >= lo)), "w_win_repeat_intents": F.size(F.filter("seen", lambda s: s < lo)),
        "w_win_state_set": F.col("s_st_set"), "w_win_state_override": F.col("s_st_over"), "w_win_state_keys": F.col("s_st_set") + F.col("s_st_over"),
        "w_win_artifacts": F.col("s_art"), "w_win_artifacts_final": F.col("s_art_final"), "w_win_status_rel": F.col("s_status") / w,
        "w_status_streak": streak("status"), "w_status_streak_rel": streak("status") / n, "w_win_assign_no_reply": F.col("s_no_reply"),
        "w_run_dup_intent_rate": F.col("all_dup_intent") / F.greatest("n_assign", F.lit(1.0)),
        "w_run_dup_artifact_hash": F.col("dup_hashes") / F.greatest(F.col("n_arts"), one), "w_win_override": F.col("s_st_over"),
        "w_run_override_rel": F.col("n_override") / F.greatest(F.col("n_state"), one), "w_win_same_key_set": F.col("s_st_set"),
        "w_state_contention": F.col("s_contention"), "w_win_goal_rel": 1.0 - F.col("s_no_goal") / w, "w_no_goal_streak": streak("no_goal"),
        "w_no_goal_streak_rel": streak("no_goal") / n, "w_win_dup_text_rel": F.col("s_dup_text") / w,
        "w_run_dup_text_rate": F.col("all_dup_text") / n, "w_loop_streak": streak("dup_text"), "w_open_before": F.col("open_before"),
        "w_open_after": gap, "w_open_after_rel": gap / w, "w_backlog_frac": F.col("open_before") / n,
        "w_recv_active_after_rel": F.coalesce("w_recv_active_after_rel", F.lit(0.0)),
        "w_recv_silence_oldest_rel": F.coalesce("w_recv_silence_oldest_rel", F.lit(1.0)),
        "w_recv_own_msgs_after_mean_rel": F.coalesce("w_recv_own_msgs_after_mean_rel", F.lit(0.0)), **deltas,
        "w_delta_worst": F.greatest(*[F.abs(d) for d in deltas.values()]),
        **{f"w_ctx_{k}": F.col(f"c_{k}") for k in ("assign", "status", "inform", "state_update", "tools")}, "w_ctx_override": F.col("c_st_over"),
        "w_since_assign": t - last_a, "w_since_assign_rel": (t - last_a) / n, "w_to_next_assign": F.coalesce("next_a", "n") - t,
        "w_assign_pos_rel": last_a / n}
    return x.select("run_id", "t", *[v[k].cast("double").alias(k) for k in WINDOW_COLS])


def written_once(tr: Traces, name: str, df: DataFrame) -> DataFrame:
    return tr.once(name, lambda _tr: df)


def decaying_streak(tr: Traces) -> DataFrame:
    """Level that grows by one on a text seen three times in the run and shrinks by one otherwise, never below 0.

    The reflected walk is the running sum minus its running minimum; the onset is
    the first hot turn after the level was last zero.
    """
    b = turn_base(tr).select("run_id", "t", F.when(F.col("dup_text") > 0, 1).otherwise(-1).alias("step"))
    s = running(b, ["run_id"], ["t"], {"walk": ("sum", "step")})
    s = running(s, ["run_id"], ["t"], {"low": ("min", "walk")})
    s = s.withColumn("level", F.col("walk") - F.least(F.lit(0), F.col("low")))
    s = running(s, ["run_id"], ["t"], {"zero": ("max", F.when(F.col("level") == 0, F.col("t")))})
    return s.select("run_id", "t", "level", F.when(F.col("level") > 0, F.coalesce("zero", F.lit(-1)) + 1).alias("onset"))
