"""Run-level feature blocks. Each block is one row per run; runs without events get zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import KEYWORDS, MESSAGE_TYPES, TOPOLOGY_TYPES
from tracewright.functions.numbers import count_where, entropy_term, flag, ratio
from tracewright.functions.text import keyword_count, occurrences
from tracewright.operators.graph import graph_block
from tracewright.operators.matching import first_replies, undelivered
from tracewright.plans.gather import gather
from tracewright.plans.scan import framed, running
from tracewright.sources.traces import Traces


def _one() -> Column:
    return F.count(F.lit(1))


def entropy_of(df: DataFrame, key: str) -> DataFrame:
    """Entropy of a column's value counts inside each run."""
    c = df.groupBy("run_id", key).agg(_one().alias("c"))
    z = c.groupBy("run_id").agg(F.sum("c").alias("z"))
    return c.join(z, "run_id").groupBy("run_id").agg(F.sum(entropy_term(F.col("c"), F.col("z"))).alias("entropy"))


def join_blocks(base: DataFrame, *blocks: DataFrame) -> DataFrame:
    """``gather`` with missing numbers as 0."""
    return gather(base, *blocks).na.fill(0)


def volume(tr: Traces) -> DataFrame:
    tools = F.sum(F.size("tools")) if "tools" in tr.agents.columns else F.lit(0)
    ag = tr.agents.groupBy("run_id").agg(_one().alias("n_agents"), tools.alias("n_tools_declared"))
    ar = tr.artifacts.groupBy("run_id").agg(_one().alias("n_artifacts"))
    st = tr.state.groupBy("run_id").agg(_one().alias("n_state_writes"))
    j = join_blocks(tr.runs.select("run_id", F.col("n").alias("n_messages")), ag, ar, st)
    return j.select("*", ratio("n_messages", "n_agents").alias("msgs_per_agent"),
                    ratio("n_artifacts", "n_messages").alias("arts_per_msg"),
                    ratio("n_state_writes", "n_messages").alias("state_per_msg"))


def protocol(tr: Traces) -> DataFrame:
    m = tr.messages
    per = m.groupBy("run_id").agg(_one().alias("n"), *[
        count_where(F.col("type") == v).alias(f"type_{v}") for v in MESSAGE_TYPES])
    return per.select(
        "run_id", *[F.col(f"type_{v}") for v in MESSAGE_TYPES],
        *[ratio(f"type_{v}", "n").alias(f"share_{v}") for v in MESSAGE_TYPES],
        flag(F.col("type_final") > 0).alias("has_final_msg"), flag(F.col("type_system") > 0).alias("has_system_msg"))


def senders(tr: Traces) -> DataFrame:
    c = tr.messages.groupBy("run_id", "sender").agg(_one().alias("c"))
    z = tr.runs.select("run_id", "n")
    per = c.join(z, "run_id").groupBy("run_id").agg(
        _one().alias("n_senders"), F.sum(entropy_term(F.col("c"), F.col("n"))).alias("sender_entropy"),
        ratio(F.max("c"), F.max("n")).alias("sender_max_share"))
    active = tr.messages.select("run_id", F.explode(F.array("sender", "receiver")).alias("agent")).distinct()
    team = tr.agents.join(active.withColumn("seen", F.lit(1)), ["run_id", "agent"], "left").groupBy("run_id").agg(
        ratio(count_where(F.col("seen").isNull()), _one()).alias("silent_agent_ratio"))
    return join_blocks(per, team)


def streaks(tr: Traces) -> DataFrame:
    """Length of the repeat streak ending at every turn: same text, and same sender with same text."""
    m = framed(tr.messages.select("run_id", "t", "norm", "sender"), ["run_id"], 1, 0, lambda w: {
        "p_norm": F.lag("norm").over(w), "p_sender": F.lag("sender").over(w)})
    new_text = F.col("p_norm").isNull() | (F.col("p_norm") != F.col("norm"))
    new_pair = new_text | (F.col("p_sender") != F.col("sender"))
    s = running(m, ["run_id"], ["t"], {"s1": ("max", F.when(new_text, F.col("t"))),
                                       "s2": ("max", F.when(new_pair, F.col("t")))})
    return s.select("run_id", "t", (F.col("t") - F.col("s1") + 1).alias("streak"), F.col("s1").alias("start"),
                    (F.col("t") - F.col("s2") + 1).alias("sender_streak"))


def repetition(tr: Traces) -> DataFrame:
    def dup(col, p):
        c = tr.messages.groupBy("run_id", col).agg(_one().alias("c"))
        return c.groupBy("run_id").agg(F.max("c").alias(f"{p}_max"), _one().alias(f"{p}_k"), F.sum("c").alias(f"{p}_n"))

    ex, nm = dup("text", "ex"), dup("norm", "nm")
    st = tr.once("streaks", streaks).groupBy("run_id").agg(F.max("streak").alias("max_consecutive_repeat"),
                                           F.max("sender_streak").alias("max_sender_repeat_streak"))
    j = join_blocks(ex, nm, st)
    n = F.col("ex_n")
    return j.select("run_id", F.col("ex_max").alias("dup_text_max"), ratio(n - F.col("ex_k"), n).alias("dup_text_ratio"),
                    F.col("nm_max").alias("norm_dup_max"), ratio(n - F.col("nm_k"), n).alias("norm_dup_ratio"),
                    ratio("nm_k", n).alias("norm_unique_ratio"), "max_consecutive_repeat", "max_sender_repeat_streak")


def intents(tr: Traces) -> DataFrame:
    c = tr.messages.groupBy("run_id", "intent").agg(_one().alias("c"))
    return c.join(tr.runs.select("run_id", "n"), "run_id").groupBy("run_id").agg(
        _one().alias("n_intents"), F.sum(entropy_term(F.col("c"), F.col("n"))).alias("intent_entropy"),
        F.max("c").alias("intent_max_count"), ratio(F.max("c"), F.max("n")).alias("intent_max_share"))


def keywords(tr: Traces) -> DataFrame:
    """Keyword counts over the run's joined text.

    The text is never joined: words are counted per message, and phrases with a
    blank are also looked for across the border to the next two messages.
    """
    m = framed(tr.messages.select("run_id", "t", "n", F.lower("text").alias("low")), ["run_id"], 0, 2, lambda w: {
        "next1": F.lead("low", 1).over(w), "next2": F.lead("low", 2).over(w)})
    nxt = F.concat_ws(" ", "next1", "next2")

    def border(word: str) -> Column:
        k = len(word) - 1
        joined = F.concat(F.right("low", F.lit(k)), F.lit(" "), F.left(nxt, F.lit(k)))
        return F.when(F.col("next1").isNotNull(), occurrences(joined, word)).otherwise(0)

    def count(group: str) -> Column:
        c = keyword_count(F.col("low"), group)
        for word in KEYWORDS[group]:
            if " " in word:
                c = c + border(word)
        return F.sum(c)

    per = m.groupBy("run_id").agg(F.max("n").alias("n"), *[count(g).alias(f"kw_{g}") for g in KEYWORDS])
    return per.select("run_id", *[F.col(f"kw_{g}") for g in KEYWORDS],
                      *[ratio(f"kw_{g}", "n").alias(f"kw_{g}_rate") for g in KEYWORDS])


def third() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("n") / 3))


def goal_alignment(tr: Traces) -> DataFrame:
    g, t, n = F.col("goal_ov"), F.col("t"), F.col("n")
    head, tail = t < third(), t >= n - third()
    per = tr.messages.groupBy("run_id").agg(
        F.avg(g).alias("goal_ov_mean"), F.avg(F.when(head, g)).alias("goal_ov_head"),
        F.avg(F.when(tail, g)).alias("goal_ov_tail"), F.avg(flag(g == 0)).alias("goal_ov_zero_ratio"),
        F.max(g).alias("goal_ov_max"))
    return per.withColumn("goal_ov_delta", F.col("goal_ov_tail") - F.col("goal_ov_head"))


def intent_shift(tr: Traces) -> DataFrame:
    t, n = F.col("t"), F.col("n")
    per = tr.messages.groupBy("run_id", "intent").agg(
        F.max(t < third()).alias("h"), F.max(t >= n - third()).alias("l")).filter("h or l")
    return per.groupBy("run_id").agg(
        ratio(count_where(F.col("h") & F.col("l")), _one()).alias("intent_head_tail_jaccard"),
        count_where(F.col("l") & ~F.col("h")).alias("new_intents_in_tail"))


def handoffs(tr: Traces) -> DataFrame:
    m = tr.messages
    base = m.groupBy("run_id").agg(count_where(F.col("is_assign")).alias("n_assign"),
                                   count_where(F.col("is_delivery")).alias("n_result"))
    rep = tr.once("first_replies", first_replies).withColumn("d", F.col("reply_t") - F.col("t")).groupBy("run_id").agg(
        count_where(F.col("reply_t").isNull()).alias("unanswered_assign"), F.avg("d").alias("reply_delay_mean"),
        F.max("d").alias("reply_delay_max"))
    und = tr.once("undelivered", undelivered).groupBy("run_id").agg(_one().alias("undelivered_assign"))
    owners = m.filter("is_assign").groupBy("run_id", "intent", "receiver").agg(_one().alias("c"))
    per_intent = owners.groupBy("run_id", "intent").agg(F.sum("c").alias("c"), _one().alias("o"))
    re = per_intent.groupBy("run_id").agg(
        count_where(F.col("c") > 1).alias("reassigned_intents"), _one().alias("k"),
        F.max("c").alias("max_assign_per_intent"), count_where(F.col("o") > 1).alias("intents_with_multiple_owners"))
    j = join_blocks(base, rep, und, re)
    return j.select(
        "run_id", "n_assign", "n_result", (F.col("n_assign") - F.col("n_result")).alias("assign_result_gap"),
        "unanswered_assign", ratio("unanswered_assign", "n_assign").alias("unanswered_ratio"), "undelivered_assign",
        ratio("undelivered_assign", "n_assign").alias("undelivered_ratio"), "reply_delay_mean", "reply_delay_max",
        "reassigned_intents", ratio("reassigned_intents", "k").alias("reassigned_ratio"), "max_assign_per_intent",
        "intents_with_multiple_owners")


def artifact_block(tr: Traces) -> DataFrame:
    a = tr.artifacts
    h = a.groupBy("run_id", "hash").agg(_one().alias("c")).groupBy("run_id").agg(
        _one().alias("n_unique_hashes"), F.sum(F.col("c") - 1).alias("dup_hash_pairs"), F.max("c").alias("dup_hash_max"),
        F.sum("c").alias("k"))
    asg = tr.messages.filter("is_assign").select("run_id", F.col("intent").alias("subtask")).distinct()
    per_sub = a.groupBy("run_id", "subtask").agg(_one().alias("c"))
    s = per_sub.groupBy("run_id").agg(F.max("c").alias("max_arts_per_subtask"),
                                      count_where(F.col("c") > 1).alias("subtasks_with_2plus_arts"))
    both = asg.join(per_sub, ["run_id", "subtask"], "left").groupBy("run_id").agg(
        ratio(F.count("c"), _one()).alias("coverage"))
    st = a.groupBy("run_id").agg(
        count_where(F.col("status") == "partial").alias("art_partial"), count_where(F.col("status") == "copy").alias("art_copy"),
        F.max(flag(F.col("subtask") == "final_delivery")).alias("has_final_artifact"))
    ty = a.groupBy("run_id", "type").agg(_one()).groupBy("run_id").agg(_one().alias("art_types"))
    j = join_blocks(tr.runs.select("run_id"), h, s, both, st, ty)
    return j.withColumn("dup_hash_ratio", ratio("dup_hash_pairs", "k")).drop("k")


def state_changes(tr: Traces) -> DataFrame:
    """State writes, in order of turn and place in it, with the key's previous two values and writer."""
    w = tr.state
    one = running(w, ["run_id", "key"], ["t", "idx"], {"prev": ("last", F.struct("value", "agent"), False)})
    two = running(one, ["run_id", "key"], ["t", "idx"], {"prev2": ("last", F.col("prev.value"), False)})
    v, p, p2 = F.col("value"), F.col("prev.value"), F.col("prev2")
    return two.select(
        "run_id", "t", "idx", "agent", "key", "op", "value", p.alias("prev_value"), F.col("prev.agent").alias("prev_agent"),
        (p.isNotNull() & (v != p)).alias("flip"),
        F.coalesce(p2.isNotNull() & (v == p2) & (v != p), F.lit(False)).alias("alt_flip"),
        (F.col("prev").isNotNull() & (F.col("prev.agent") != F.col("agent"))).alias("cross_writer"))


def state_block(tr: Traces) -> DataFrame:
    vals = tr.state.groupBy("run_id", "key", "value").agg(
        _one().alias("c"), count_where(F.col("op") == "override").alias("o"))
    keys = vals.groupBy("run_id", "key").agg(F.sum("c").alias("c"), F.sum("o").alias("o"), _one().alias("d"),
                                             F.max(F.when(F.col("key") == "run_status", F.col("value") == "completed")).alias("done"),
                                             F.max(F.when(F.col("key") == "run_status", F.col("value").isin(
                                                 "timeout", "aborted", "incomplete"))).alias("failed"))
    per = keys.groupBy("run_id").agg(
        _one().alias("state_keys"), F.sum("o").alias("state_overrides"), F.sum("c").alias("k"),
        F.max("c").alias("state_max_writes_per_key"), F.max("d").alias("state_max_distinct_per_key"),
        count_where(F.col("c") >= 3).alias("state_keys_3plus"), F.max(flag(F.col("done"))).alias("status_completed"),
        F.max(flag(F.col("failed"))).alias("status_failed"), F.min(flag(F.col("key") != "run_status")).alias("status_missing"))
    fl = tr.once("state_changes", state_changes).groupBy("run_id").agg(count_where(F.col("flip")).alias("state_flips"),
                                                 count_where(F.col("alt_flip")).alias("state_alternating_flips"))
    j = gather(tr.runs.select("run_id"), per, fl).na.fill(1.0, ["status_missing"]).na.fill(0)
    return j.withColumn("state_override_ratio", ratio("state_overrides", "k")).drop("k")


def topology_block(tr: Traces) -> DataFrame:
    e = tr.topology_edges.groupBy("run_id").agg(_one().alias("topo_edges"))
    a = tr.agents.groupBy("run_id").agg(_one().alias("k"))
    j = join_blocks(tr.topology, e, a)
    return j.select("run_id", *[flag(F.col("topo_type") == v).alias(f"topo_{v}") for v in TOPOLOGY_TYPES],
                    "topo_edges", ratio("topo_edges", "k").alias("topo_edge_per_agent"))


def tail_block(tr: Traces) -> DataFrame:
    tail = tr.messages.filter(F.col("t") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return tail.groupBy("run_id").agg(
        *[F.avg(flag(F.col("type") == v)).alias(f"tail_{v}_share") for v in ("status", "inform", "handoff")],
        F.max(flag(F.col("type") == "final")).alias("tail_has_final"))


def run_block(tr: Traces) -> DataFrame:
    """All run-level blocks side by side (122 columns besides run_id).

    Each block is written by itself: planned together they are one statement of a megabyte, which the driver plans anew
    whenever a stage ends.
    """
    blocks = (volume, protocol, senders, repetition, intents, keywords, goal_alignment, intent_shift, handoffs, artifact_block,
              state_block, topology_block, tail_block, graph_block)
    return join_blocks(*[tr.once(f"block_{b.__name__}", b) for b in blocks])


# Normalised columns as (name, numerator, denominator, smallest denominator or None).
NORMALISED = [
    ("nz_norm_dup_max_per_msg", "norm_dup_max", "n_messages", None),
    ("nz_dup_text_max_per_msg", "dup_text_max", "n_messages", None),
    ("nz_max_consecutive_repeat_per_msg", "max_consecutive_repeat", "n_messages", None),
    ("nz_max_sender_streak_per_msg", "max_sender_repeat_streak", "n_messages", None),
    ("nz_max_sender_streak_per_sender", "max_sender_repeat_streak", "n_senders", 1),
    ("nz_intents_per_agent", "n_intents", "n_agents", 1),
    ("nz_dup_hash_pairs_per_msg", "dup_hash_pairs", "n_messages", None),
    ("nz_assign_per_msg", "n_assign", "n_messages", None),
    ("nz_result_per_msg", "n_result", "n_messages", None),
    ("nz_result_per_assign", "n_result", "n_assign", None),
    ("nz_assign_gap_per_assign", "assign_result_gap", "n_assign", None),
    ("nz_reply_delay_mean_per_msg", "reply_delay_mean", "n_messages", None),
    ("nz_reply_delay_max_per_msg", "reply_delay_max", "n_messages", None),
    ("nz_unanswered_per_msg", "unanswered_assign", "n_messages", None),
    ("nz_undelivered_per_msg", "undelivered_assign", "n_messages", None),
    ("nz_reassign_per_msg", "reassigned_intents", "n_messages", None),
    ("nz_max_assign_per_intent_per_intent", "max_assign_per_intent", "n_intents", 1),
    ("nz_multi_owner_per_intent", "intents_with_multiple_owners", "n_intents", 1),
    ("nz_intent_max_count_per_msg", "intent_max_count", "n_messages", None),
    ("nz_intent_entropy_per_intent", "intent_entropy", "n_intents", 1),
    ("nz_new_intents_tail_per_intent", "new_intents_in_tail", "n_intents", 1),
    ("nz_unique_hashes_per_art", "n_unique_hashes", "n_artifacts", None),
    ("nz_max_arts_per_subtask_per_art", "max_arts_per_subtask", "n_artifacts", None),
    ("nz_art_partial_per_art", "art_partial", "n_artifacts", None),
    ("nz_art_copy_per_art", "art_copy", "n_artifacts", None),
    ("nz_art_types_per_art", "art_types", "n_artifacts", None),
    ("nz_subtasks_2plus_per_art", "subtasks_with_2plus_arts", "n_artifacts", None),
    ("nz_artifacts_per_assign", "n_artifacts", "n_assign", None),
    ("nz_state_flips_per_write", "state_flips", "n_state_writes", None),
    ("nz_state_altflips_per_write", "state_alternating_flips", "n_state_writes", None),
    ("nz_state_max_writes_per_key_per_write", "state_max_writes_per_key", "n_state_writes", None),
    ("nz_state_max_distinct_per_key_per_write", "state_max_distinct_per_key", "n_state_writes", None),
    ("nz_state_keys_per_agent", "state_keys", "n_agents", 1),
    ("nz_state_keys_3plus_per_write", "state_keys_3plus", "n_state_writes", None),
    ("nz_state_flips_per_msg", "state_flips", "n_messages", None),
    ("nz_state_altflips_per_msg", "state_alternating_flips", "n_messages", None),
    ("nz_state_overrides_per_key", "state_overrides", "state_keys", 1),
    ("nz_state_flips_per_key", "state_flips", "state_keys", 1),
    ("nz_g_two_cycles_per_msg", "g_two_cycles", "n_messages", None),
    ("nz_g_pingpong_per_msg", "g_pingpong", "n_messages", None),
    ("nz_g_self_loops_per_msg", "g_self_loops", "n_messages", None),
    ("nz_g_edges_per_node", "g_edges", "g_nodes", 1),
    ("nz_g_max_pair_per_msg", "g_max_pair", "n_messages", None),
    ("nz_g_max_out_deg_per_node", "g_max_out_deg", "g_nodes", 1),
    ("nz_g_max_in_deg_per_node", "g_max_in_deg", "g_nodes", 1),
    ("nz_g_triangles_per_node", "g_triangles", "g_nodes", 1),
    ("nz_g_pingpong_per_pair", "g_pingpong", "g_n_pairs", 1),
    ("nz_g_largest_scc_per_node", "g_largest_scc", "g_nodes", 1),
    ("nz_tools_per_agent", "n_tools_declared", "n_agents", 1),
    ("nz_senders_per_agent", "n_senders", "n_agents", 1),
    ("nz_n_pairs_per_node", "g_n_pairs", "g_nodes", 1),
    ("nz_msgs_per_sender", "n_messages", "n_senders", 1),
]


def normalised(block: DataFrame) -> DataFrame:
    return block.select("run_id", *[
        ratio(a, F.greatest(F.col(b).cast("double"), F.lit(float(lo))) if lo else b).alias(name)
        for name, a, b, lo in NORMALISED])


POSITIONS = ["pos_first_assign", "pos_first_delivery", "pos_last_assign", "pos_last_delivery", "pos_streak_start",
             "pos_first_override", "pos_first_state_write", "pos_goal_zero_run", "pos_first_status_run",
             "pos_first_conflict_flip", "pos_first_ack"]


def condition_streaks(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """For each condition, how many turns in a row (ending here) it has held. ``t`` must be dense."""
    out = running(df, ["run_id"], ["t"], {f"__x_{n}": ("max", F.when(~c, F.col("t"))) for n, c in conds.items()})
    return out.select(*df.columns, *[(F.col("t") - F.coalesce(f"__x_{n}", F.lit(-1))).alias(n) for n in conds])


def positions(tr: Traces) -> DataFrame:
    """Relative positions (0..1) of the first and last events of several kinds."""
    t = F.col("t")
    m = framed(tr.messages.select("run_id", "t", "n", "type", "intent", "is_assign", "is_delivery", "goal_ov", "refs"),
               ["run_id"], 1, 0, lambda w: {"p_intent": F.lag("intent").over(w)})
    ack = (F.col("type") == "inform") & (F.col("intent") == F.col("p_intent")) & (F.size("refs") == 0)
    m = condition_streaks(m, {"status_run": F.col("type") == "status", "zero_run": F.col("goal_ov") == 0})
    status_start = t - 1
    per = m.groupBy("run_id").agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("is_assign"), t)).alias("pos_first_assign"),
        F.min(F.when(F.col("is_delivery"), t)).alias("pos_first_delivery"),
        F.max(F.when(F.col("is_assign"), t)).alias("pos_last_assign"),
        F.max(F.when(F.col("is_delivery"), t)).alias("pos_last_delivery"),
        F.min(F.when(F.col("zero_run") == 2, t - 1)).alias("pos_goal_zero_run"),
        F.min(F.when((F.col("status_run") == 2) & (status_start > 0), status_start)).alias("pos_first_status_run"),
        F.min(F.when(ack, t)).alias("pos_first_ack"))
    long = tr.once("streaks", streaks).filter("streak >= 2").groupBy("run_id").agg(
        F.min_by("start", F.struct(-F.col("streak"), F.col("start"))).alias("pos_streak_start"))
    st = tr.once("state_changes", state_changes).groupBy("run_id").agg(
        F.min("t").alias("pos_first_state_write"), F.min(F.when(F.col("op") == "override", t)).alias("pos_first_override"),
        F.min(F.when(F.col("flip"), t)).alias("pos_first_conflict_flip"))
    gw = tr.runs.select("run_id", (F.size("goal_words") > 0).alias("has_goal"))
    j = gather(per, long, st, gw)
    j = j.withColumn("pos_goal_zero_run", F.when(F.col("has_goal"), F.col("pos_goal_zero_run")))
    last = F.greatest(F.col("n") - 1, F.lit(1))
    return j.select("run_id", *[ratio(p, last).alias(p) for p in POSITIONS])


def longest_runs(tr: Traces) -> DataFrame:
    """Starts of the longest repeat streak and the longest status run (earliest on ties)."""
    m = condition_streaks(tr.messages.select("run_id", "t", "type"), {"k": F.col("type") == "status"})
    st = m.filter("k > 0").groupBy("run_id").agg(
        F.min(F.struct(-F.col("k"), F.col("t") - F.col("k") + 1)).alias("s")).select(
            "run_id", (-F.col("s.col1")).alias("status_len"), F.col("s.col2").alias("status_start"))
    rp = tr.once("streaks", streaks).groupBy("run_id").agg(F.min(F.struct(-F.col("streak"), F.col("start"))).alias("s")).select(
        "run_id", (-F.col("s.col1")).alias("repeat_len"), F.col("s.start").alias("repeat_start"))
    return gather(tr.runs.select("run_id"), st, rp)
