"""Turn-level queries: running counters, causal turn table and centred-window table."""

from pyspark.sql import functions as F

from tracewright.catalog.base import KEYWORDS, register, sql_keyword
from tracewright.catalog.runblocks import CHANGES_SQL, REPLY_SQL, STREAK_SQL
from tracewright.fixed import MESSAGE_TYPES
from tracewright.operators import turns as T

B = "CASE WHEN {} THEN 1.0 ELSE 0.0 END"


def b(cond):
    return B.format(cond)


COUNT_SQL = """fp AS (SELECT run_id, sender, receiver, min(t) AS ft FROM messages GROUP BY 1, 2, 3),
fa AS (SELECT run_id, x, min(t) AS ft FROM (SELECT run_id, t, sender AS x FROM messages UNION ALL SELECT run_id, t, receiver FROM messages) GROUP BY 1, 2),
fi AS (SELECT run_id, intent, sender, min(t) AS ft FROM messages WHERE intent <> '' GROUP BY 1, 2, 3),
cn AS (SELECT m.*, count(*) OVER (PARTITION BY run_id, norm ORDER BY t) AS norm_count, count(*) OVER (PARTITION BY run_id, intent ORDER BY t) AS intent_count,
  sum(CASE WHEN is_assign THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, intent ORDER BY t) AS assigns,
  sum(CASE WHEN is_delivery THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, intent ORDER BY t) AS deliveries,
  count(*) OVER (PARTITION BY run_id, sender ORDER BY t) AS sent, count(*) OVER (PARTITION BY run_id, receiver ORDER BY t) AS received,
  count(*) OVER (PARTITION BY run_id, sender, receiver ORDER BY t) AS pair_count,
  sum(CASE WHEN type = 'status' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, sender, receiver ORDER BY t) AS pair_waits FROM messages m),
tcn AS (SELECT c.*, (SELECT count(*) FROM messages x WHERE x.run_id = c.run_id AND x.sender = c.receiver AND x.receiver = c.sender AND x.t <= c.t) AS reverse_count,
  (SELECT count(*) FROM messages x WHERE x.run_id = c.run_id AND x.sender = c.receiver AND x.receiver = c.sender AND x.type = 'status' AND x.t <= c.t) AS reverse_waits,
  (SELECT count(*) FROM fp WHERE fp.run_id = c.run_id AND fp.sender = c.sender AND ft <= c.t) AS out_degree,
  (SELECT count(*) FROM fp WHERE fp.run_id = c.run_id AND fp.receiver = c.receiver AND ft <= c.t) AS in_degree,
  (SELECT count(*) FROM fp WHERE fp.run_id = c.run_id AND ft <= c.t) AS edges, (SELECT count(*) FROM fa WHERE fa.run_id = c.run_id AND ft <= c.t) AS nodes,
  (SELECT count(*) FROM fi WHERE fi.run_id = c.run_id AND fi.intent = c.intent AND ft <= c.t) AS authors,
  (SELECT count(*) FROM artifacts a WHERE a.run_id = c.run_id AND a.t <= c.t) AS arts,
  (SELECT count(*) FROM artifacts a WHERE a.run_id = c.run_id AND a.t <= c.t AND a.maker = c.sender) AS arts_by_sender,
  (SELECT count(*) FROM artifacts a WHERE a.run_id = c.run_id AND a.t <= c.t AND a.subtask = c.intent AND c.intent <> '') AS arts_for_intent FROM cn c),
ph AS (SELECT run_id, t, pair_count - 1 AS pair_before, coalesce(lag(reverse_count) OVER w, 0) AS reverse_before, pair_waits - CASE WHEN type = 'status' THEN 1 ELSE 0 END AS waits_before,
  CASE WHEN type = 'status' AND reverse_waits > 0 THEN 1 ELSE 0 END AS wait_answered FROM tcn WINDOW w AS (PARTITION BY run_id, sender, receiver ORDER BY t))"""
CNAMES = ["norm_count", "intent_count", "assigns", "deliveries", "sent", "received", "pair_count", "reverse_count", "pair_waits",
          "reverse_waits", "out_degree", "in_degree", "edges", "nodes", "authors", "arts", "arts_by_sender", "arts_for_intent"]
Q_COUNT = f"WITH {COUNT_SQL}, answer AS (SELECT * FROM tcn)"
register("w4_seen_before", "run_id,t,norm_count,intent_count:l norm_seen,intent_seen:b", lambda tr: T.turn_counters(tr).select(
    "*", (F.col("norm_count") > 1).alias("norm_seen"), (F.col("intent_count") > 1).alias("intent_seen")),
    f"WITH {COUNT_SQL}, answer AS (SELECT *, norm_count > 1 AS norm_seen, intent_count > 1 AS intent_seen FROM tcn)")
register("w5_running_shares", "run_id,t:l sender_share,receiver_share:d out_degree,in_degree:l", lambda tr: T.turn_counters(tr).select(
    "*", (F.col("sent") / (F.col("t") + 1)).alias("sender_share"), (F.col("received") / (F.col("t") + 1)).alias("receiver_share")),
    f"WITH {COUNT_SQL}, answer AS (SELECT *, sent / (t + 1) AS sender_share, received / (t + 1) AS receiver_share FROM tcn)")
register("w6_pair_history", "run_id,t,pair_before,reverse_before,waits_before,wait_answered:l", T.pair_history,
         f"WITH {COUNT_SQL}, answer AS (SELECT * FROM ph)")
register("j8_prefix_counts", "run_id,t:l " + ",".join(CNAMES) + ":l", T.turn_counters, Q_COUNT)
STATE_SQL = f"""{CHANGES_SQL},
sc0 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY run_id, key, value ORDER BY t) = 1 THEN 1 ELSE 0 END AS fresh FROM changes),
sc1 AS (SELECT run_id, t, count(*) OVER r AS writes, sum(fresh) OVER r AS values, sum(CASE WHEN op = 'override' THEN 1 ELSE 0 END) OVER r AS overrides,
  sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER r AS flips, sum(CASE WHEN alt_flip THEN 1 ELSE 0 END) OVER r AS alts, count(*) OVER k AS key_writes, sum(fresh) OVER k AS key_values,
  CASE WHEN op = 'override' THEN 1 ELSE 0 END AS is_override, CASE WHEN flip THEN 1 ELSE 0 END AS changed, CASE WHEN alt_flip THEN 1 ELSE 0 END AS alt,
  CASE WHEN key = 'run_status' THEN 1 ELSE 0 END AS is_run_status FROM sc0
  WINDOW r AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY run_id, key ORDER BY t ROWS UNBOUNDED PRECEDING)),
ssf AS (SELECT m.run_id, m.t, s.* EXCLUDE (run_id, t) FROM messages m ASOF LEFT JOIN sc1 s ON m.run_id = s.run_id AND m.t >= s.t)"""
SNAMES = ["writes", "values", "overrides", "flips", "alts", "key_writes", "key_values", "is_override", "changed", "alt", "is_run_status"]
register("j8_state_so_far", "run_id,t:l " + ",".join(SNAMES) + ":d", T.state_so_far, f"WITH {STATE_SQL}, answer AS (SELECT run_id, t, "
         + ", ".join(f'coalesce("{s}", 0) AS "{s}"' for s in SNAMES) + " FROM ssf)")
GOAL_SQL = """gh AS (SELECT run_id, t, goal_ov - coalesce(lag(goal_ov) OVER w, goal_ov) AS goal_ov_delta_prev,
  goal_ov - avg(goal_ov) OVER (w ROWS UNBOUNDED PRECEDING) AS goal_ov_minus_runmean, avg(goal_ov) OVER (w ROWS UNBOUNDED PRECEDING) AS goal_ov_runmean,
  goal_ov - coalesce(avg(goal_ov) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), goal_ov) AS goal_ov_drop_3,
  goal_ov - coalesce(avg(goal_ov) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), goal_ov) AS goal_ov_drop_5 FROM messages WINDOW w AS (PARTITION BY run_id ORDER BY t))"""
register("w18_goal_history", "run_id,t:l goal_ov_delta_prev,goal_ov_minus_runmean,goal_ov_runmean,goal_ov_drop_3,goal_ov_drop_5:d", T.goal_history,
         f"WITH {GOAL_SQL}, answer AS (SELECT * FROM gh)")
register("j11_roles", "run_id,t:l sender_role,receiver_role:s", lambda tr: T.with_roles(tr, tr.plain_messages),
         "SELECT m.run_id, m.t, a.role AS sender_role, b.role AS receiver_role FROM messages m LEFT JOIN agents a ON a.run_id = m.run_id AND a.agent = sender "
         "LEFT JOIN agents b ON b.run_id = m.run_id AND b.agent = receiver")

CTX_SQL = f"""{STREAK_SQL},
cx AS (SELECT run_id, any_value(n) AS n, avg({b("type = 'handoff'")}) AS frac_handoff, avg({b("type = 'status'")}) AS frac_status, count(*) FILTER (WHERE is_assign) AS n_assign,
  count(DISTINCT intent) FILTER (WHERE intent <> '') AS n_intents, count(DISTINCT type) AS n_types FROM messages GROUP BY 1),
cx2 AS (SELECT run_id, count(*) AS n_agents FROM agents GROUP BY 1), cx3 AS (SELECT run_id, count(*) AS n_arts, count(*) - count(DISTINCT hash) AS dup_hashes FROM artifacts GROUP BY 1),
cx4 AS (SELECT run_id, count(*) AS n_state, count(*) FILTER (WHERE op = 'override') AS n_override FROM state GROUP BY 1), cx5 AS (SELECT run_id, max(streak) AS max_streak FROM st GROUP BY 1),
ctx AS (SELECT cx.*, n_agents, coalesce(n_arts, 0) AS n_arts, coalesce(dup_hashes, 0) AS dup_hashes, coalesce(n_state, 0) AS n_state, coalesce(n_override, 0) AS n_override, max_streak
  FROM cx LEFT JOIN cx2 USING (run_id) LEFT JOIN cx3 USING (run_id) LEFT JOIN cx4 USING (run_id) LEFT JOIN cx5 USING (run_id))"""


def causal_sql():
    own = {
        "abs_pos": "m.t", "rel_pos": "m.t / greatest(m.n - 1, 1)", "turns_to_end": "m.n - m.t - 1", "run_len": "m.n", "run_n_agents": "n_agents", "run_n_artifacts": "n_arts",
        "run_n_state": "n_state", "run_n_intents": "n_intents", "run_n_types": "n_types", "run_max_streak": "max_streak", "run_frac_handoff": "frac_handoff",
        "run_frac_status": "frac_status", **{f"type_{v}": b(f"m.type = '{v}'") for v in MESSAGE_TYPES}, "is_assign": b("m.is_assign"), "is_delivery": b("m.is_delivery"),
        "has_intent": b("m.intent <> ''"), "intent_len": "len(m.intent)", "refs_count": "len(refs)", "text_len": "len(text)",
        "text_trunc_12_30": b("len(text) BETWEEN 12 AND 30"), "tool_present": b("tool <> ''"), "self_loop": b("m.sender = receiver"),
        **{f"kw_{g}": sql_keyword("lower(text)", g) for g in KEYWORDS}, "goal_ov": "m.goal_ov", "goal_ov_zero": b("m.goal_ov = 0"),
        "sender_role_orch": b("a.role = 'orchestrator'"), "sender_role_analyst": b("a.role = 'analyst'"), "recv_role_orch": b("c.role = 'orchestrator'"),
        "recv_self": b("m.sender = receiver"), "sender_out_deg": "out_degree", "recv_out_deg": "in_degree", "sender_share_so_far": "sent / (m.t + 1)",
        "sender_distinct_recv_so_far": "out_degree", "recv_share_so_far": "received / (m.t + 1)", "sender_so_far_frac": "sent / m.n", "recv_so_far_frac": "received / m.n",
        "norm_rep_count_so_far": "norm_count", "norm_rep_run_so_far": "norm_count - 1", "same_norm_as_prev": b("m.norm = st.pn"), "same_sender_as_prev": b("m.sender = st.ps"),
        "streak_len": "streak", "streak_frac": "streak / m.n", "intent_msg_count_so_far": "intent_count",
        "intent_distinct_agents_so_far": "authors", "intent_agents_frac": "authors / n_agents", "intent_first_seen": b("intent_count = 1"),
        "n_assigns_intent_so_far": "assigns", "n_deliveries_intent_so_far": "deliveries", "intent_delivered_so_far": b("deliveries > 0"),
        "is_second_assign_intent": b("m.is_assign AND assigns >= 2"), "assign_unanswered_so_far": b("m.is_assign AND assigns > deliveries"),
        "unanswered_frac_so_far": "(assigns - deliveries) / greatest(assigns, 1)", "status_streak": "status_run", "status_streak_frac": "status_run / m.n",
        "status_reciprocal_before": "wait_answered", "pair_msg_count_so_far": "pair_before", "pair_recip_count_so_far": "reverse_before",
        "status_between_pair_so_far": "waits_before", "state_writes_so_far": "writes", "state_distinct_keys_so_far": '"values"', "state_overrides_so_far": "overrides",
        "state_flips_so_far": "flips", "state_altflips_so_far": "alts", "state_key_writes_so_far": "key_writes", "state_key_distinct_vals": "key_values",
        "state_is_override": "is_override", "state_value_changed": "changed", "state_alt_flip": "alt", "state_key_is_run_status": "is_run_status",
        "state_key_writes_frac": "key_writes / m.n", "arts_so_far": "arts", "arts_by_sender_so_far": "arts_by_sender", "arts_for_intent_so_far": "arts_for_intent",
        "intent_covered_by_arts": b("arts_for_intent > 0"), "edges_so_far": "edges", "graph_density_so_far": "edges / greatest(nodes * (nodes - 1), 1)",
        "edge_recip_before": b("m.t >= recip_t"), "n_distinct_agents_so_far": "nodes"}
    frames = []
    for r in (2, 5):
        for k, v in (("handoff", "handoff"), ("status", "status"), ("state", "state_update"), ("final", "final")):
            frames.append(f"avg({b(f'''type = '{v}' ''')}) OVER w{r} AS w{r}_{k}")
        frames += [f"len(list_distinct(list(nullif(intent, '')) OVER w{r})) AS w{r}_intents", f"avg(goal_ov) OVER w{r} AS w{r}_goal_ov_mean",
                   f"max(goal_ov) OVER w{r} AS w{r}_goal_ov_max", f"max(norm_count) OVER w{r} AS w{r}_max_norm_rep", f"least(t, {r}) / {r} AS w{r}_forward",
                   f"least(n - 1 - t, {r}) / {r} AS w{r}_backward"]
    wins = ", ".join(f"w{r} AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)" for r in (2, 5))
    outs = ", ".join(f"coalesce({own.get(c, c)}, 0) AS {c}" for c in T.CAUSAL_COLS)
    return f"""{COUNT_SQL}, {STATE_SQL}, {GOAL_SQL}, {CTX_SQL},
fr AS (SELECT run_id, t, {', '.join(frames)} FROM tcn WINDOW {wins}),
rc AS (SELECT x.run_id, min(greatest(x.ft, y.ft)) AS recip_t FROM fp x JOIN fp y ON x.run_id = y.run_id AND x.sender = y.receiver AND x.receiver = y.sender GROUP BY 1),
causal AS (SELECT m.run_id, m.t, {outs} FROM tcn m JOIN ph USING (run_id, t) JOIN ssf USING (run_id, t) JOIN gh USING (run_id, t) JOIN fr USING (run_id, t) JOIN st USING (run_id, t)
  JOIN ctx USING (run_id) LEFT JOIN rc USING (run_id) LEFT JOIN agents a ON a.run_id = m.run_id AND a.agent = m.sender LEFT JOIN agents c ON c.run_id = m.run_id AND c.agent = m.receiver)"""


CAUSAL_SQL = causal_sql()
register("w22_causal_turns", "run_id,t:l " + ",".join(T.CAUSAL_COLS) + ":d", T.causal_turns, f"WITH {CAUSAL_SQL}, answer AS (SELECT * FROM causal)")

# ---- centred windows ----
BASE_TURN_SQL = f"""{REPLY_SQL}, {CHANGES_SQL}, {CTX_SQL},
ps AS (SELECT run_id, t, count(*) FILTER (WHERE op = 'override') AS st_over, count(*) FILTER (WHERE op <> 'override') AS st_set, count(*) FILTER (WHERE cross_writer) AS contention FROM changes GROUP BY 1, 2),
pa AS (SELECT run_id, t, count(*) AS art, count(*) FILTER (WHERE status = 'final') AS art_final FROM artifacts GROUP BY 1, 2),
ic AS (SELECT run_id, intent, count(*) FILTER (WHERE is_assign) AS a_count, min(t) AS intent_first FROM messages WHERE intent <> '' GROUP BY 1, 2),
tk AS (SELECT run_id, tool, count(*) AS tool_count FROM messages WHERE tool <> '' GROUP BY 1, 2), nk AS (SELECT run_id, norm, count(*) AS norm_total FROM messages WHERE norm <> '' GROUP BY 1, 2),
rs AS (SELECT run_id, t FROM asg a WHERE EXISTS (SELECT 1 FROM messages m WHERE m.run_id = a.run_id AND m.sender = a.receiver AND m.intent = a.intent AND m.t > a.t)
  OR EXISTS (SELECT 1 FROM dkeys d WHERE d.run_id = a.run_id AND d.agent = a.receiver AND d.intent = a.intent)),
tb AS (SELECT m.run_id, m.t, m.n, m.sender, m.receiver, m.intent, m.tool, ic.intent_first, is_assign AND m.intent <> '' AS ka, {', '.join(f"{b(f'''m.type = '{v}' ''')} AS {v}" for v in MESSAGE_TYPES)},
  {b('is_assign')} AS assign, {b('is_delivery')} AS result, {b('len(refs) > 0')} AS refs, {b("m.tool <> ''")} AS tools, coalesce(st_set, 0) AS st_set, coalesce(st_over, 0) AS st_over,
  coalesce(contention, 0) AS contention, coalesce(art, 0) AS art, coalesce(art_final, 0) AS art_final, {b('rs.t IS NOT NULL')} AS resolved,
  {b("is_assign AND m.intent <> '' AND NOT EXISTS (SELECT 1 FROM dlv WHERE dlv.run_id = m.run_id AND dlv.sender = m.receiver AND dlv.intent = m.intent)")} AS no_reply,
  {b("is_assign AND m.intent <> '' AND a_count > 1")} AS dup_intent, {b('tool_count > 1')} AS dup_tool, {b('norm_total >= 3')} AS dup_text, {b('goal_ov = 0')} AS no_goal
  FROM messages m LEFT JOIN ps USING (run_id, t) LEFT JOIN pa USING (run_id, t) LEFT JOIN rs ON rs.run_id = m.run_id AND rs.t = m.t LEFT JOIN ic ON ic.run_id = m.run_id AND ic.intent = m.intent
  LEFT JOIN tk ON tk.run_id = m.run_id AND tk.tool = m.tool LEFT JOIN nk ON nk.run_id = m.run_id AND nk.norm = m.norm)"""
FLAGS = ["assign", "result", "refs", "tools", "st_set", "st_over", "contention", "art", "art_final", "resolved", "no_reply", "dup_intent", "dup_tool", "dup_text", "no_goal"]
register("w7_condition_streaks", "run_id,t,status_streak,no_goal_streak,loop_streak:l", lambda tr: T.condition_streaks(
    T.turn_base(tr).select("run_id", "t", "status", "no_goal", "dup_text"), {
        "status_streak": F.col("status") > 0, "no_goal_streak": F.col("no_goal") > 0, "loop_streak": F.col("dup_text") > 0}),
    f"""WITH {BASE_TURN_SQL}, g AS (SELECT *, max(CASE WHEN status = 0 THEN t END) OVER w AS a, max(CASE WHEN no_goal = 0 THEN t END) OVER w AS c, max(CASE WHEN dup_text = 0 THEN t END) OVER w AS d FROM tb
  WINDOW w AS (PARTITION BY run_id ORDER BY t)), answer AS (SELECT run_id, t, t - coalesce(a, -1) AS status_streak, t - coalesce(c, -1) AS no_goal_streak, t - coalesce(d, -1) AS loop_streak FROM g)""")
register("w8_turn_indicators", "run_id,t:l " + ",".join(FLAGS) + ":d", T.turn_base, f"WITH {BASE_TURN_SQL}, answer AS (SELECT * FROM tb)")


def window_sql():
    near = "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    p = "OVER (PARTITION BY run_id ORDER BY t "
    sel = [f"sum({k}) {p}{near}) AS s_{k}" for k in T.SUMMED]
    sel += [f"sum({k}) {p}ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c_{k}" for k in ("assign", "status", "inform", "state_update", "tools", "st_over")]
    for k in ("assign", "status", "handoff", "tools"):
        sel.append(f"coalesce(sum({k}) {p}ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0) AS p_{k}")
        sel.append(f"coalesce(sum({k}) {p}ROWS BETWEEN 3 FOLLOWING AND 4 FOLLOWING), 0) AS f_{k}")
    sel += [f"len(list_distinct(list(nullif({k}, '')) {p}{near}))) AS d_{k}" for k in ("tool", "sender", "receiver", "intent")]
    sel += [f"count(*) {p}{near}) AS win_n", f"list(intent_first) {p}{near}) AS seen"]
    deltas = {}
    for k in ("assign", "status", "handoff", "tools"):
        deltas[f"w_delta_{k}_prev"] = f"s_{k} - p_{k}"
        deltas[f"w_delta_{k}_next"] = f"f_{k} - s_{k}"
    lo = "greatest(t - 2, 0)"
    v = {
        "w_n_msgs": "n", "w_n_agents": "n_agents", "w_n_intents": "n_intents", "w_n_artifacts": "n_arts", "w_n_assign": "n_assign",
        "w_unresolved_ratio": "open_before / greatest(n_assign, 1)", "w_pos": "t / greatest(n - 1, 1)", "w_rel_turn": "t / n", "w_is_first": b("t = 0"), "w_is_last": b("t = n - 1"),
        "w_dist_start": "t", "w_dist_end": "n - 1 - t", "w_dist_start_rel": "t / n", "w_dist_end_rel": "(n - 1 - t) / n", "w_win_n": "win_n", "w_win_n_rel": "win_n / n",
        **{f"w_win_{k}": f"s_{k}" for k in (*MESSAGE_TYPES, "assign", "result", "refs", "tools", "dup_intent", "dup_tool", "dup_text")}, "w_win_tools_rel": "s_tools / win_n",
        "w_win_distinct_tools": "d_tool", "w_win_distinct_senders": "d_sender", "w_win_distinct_receivers": "d_receiver", "w_win_distinct_intents": "d_intent",
        "w_win_new_intents": f"len([s FOR s IN seen IF s >= {lo}])", "w_win_repeat_intents": f"len([s FOR s IN seen IF s < {lo}])", "w_win_state_set": "s_st_set",
        "w_win_state_override": "s_st_over", "w_win_state_keys": "s_st_set + s_st_over", "w_win_artifacts": "s_art", "w_win_artifacts_final": "s_art_final",
        "w_win_status_rel": "s_status / win_n", "w_status_streak": "status_run", "w_status_streak_rel": "status_run / n", "w_win_assign_no_reply": "s_no_reply",
        "w_run_dup_intent_rate": "adi / greatest(n_assign, 1)", "w_run_dup_artifact_hash": "dup_hashes / greatest(n_arts, 1)", "w_win_override": "s_st_over",
        "w_run_override_rel": "n_override / greatest(n_state, 1)", "w_win_same_key_set": "s_st_set", "w_state_contention": "s_contention", "w_win_goal_rel": "1 - s_no_goal / win_n",
        "w_no_goal_streak": "zero_run", "w_no_goal_streak_rel": "zero_run / n", "w_win_dup_text_rel": "s_dup_text / win_n", "w_run_dup_text_rate": "adt / n",
        "w_loop_streak": "t - coalesce(cold, -1)", "w_open_before": "open_before", "w_open_after": "open_later - open_before", "w_open_after_rel": "(open_later - open_before) / win_n",
        "w_backlog_frac": "open_before / n", "w_recv_active_after_rel": "coalesce(act, 0)", "w_recv_silence_oldest_rel": "coalesce(sil, 1)", "w_recv_own_msgs_after_mean_rel": "coalesce(own, 0)",
        **deltas, "w_delta_worst": "greatest(" + ", ".join(f"abs({d})" for d in deltas.values()) + ")",
        **{f"w_ctx_{k}": f"c_{k}" for k in ("assign", "status", "inform", "state_update", "tools")}, "w_ctx_override": "c_st_over", "w_since_assign": "t - la",
        "w_since_assign_rel": "(t - la) / n", "w_to_next_assign": "coalesce(na, n) - t", "w_assign_pos_rel": "la / n"}
    return f"""{BASE_TURN_SQL},
ob0 AS (SELECT *, coalesce(sum(assign) {p}ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - coalesce(sum(resolved) {p}ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS ob,
  coalesce(max(CASE WHEN assign > 0 THEN t END) {p}ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS la,
  min(CASE WHEN assign > 0 THEN t END) {p}ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS na,
  max(CASE WHEN dup_text = 0 THEN t END) {p}ROWS UNBOUNDED PRECEDING) AS cold FROM tb),
ob1 AS (SELECT *, greatest(ob, 0) AS open_before FROM ob0),
wf AS (SELECT *, last_value(open_before) {p}ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS open_later, sum(dup_intent) OVER (PARTITION BY run_id) AS adi, sum(dup_text) OVER (PARTITION BY run_id) AS adt,
  {', '.join(sel)} FROM ob1),
ra0 AS (SELECT i.run_id, i.t, i.n, j.t AS j, j.receiver, j.intent AS ji FROM tb i JOIN tb j ON i.run_id = j.run_id AND j.ka AND j.t BETWEEN i.t - 2 AND i.t + 2),
ra1 AS (SELECT r.run_id, r.t, r.n, r.j, count(m.t) AS after, count(m.t) FILTER (WHERE m.intent = r.ji) AS ow, max(m.t) AS lt FROM ra0 r LEFT JOIN messages m ON m.run_id = r.run_id AND m.sender = r.receiver AND m.t > r.t + 2 GROUP BY ALL),
ra AS (SELECT run_id, t, avg(after / greatest(n - t - 3, 1)) AS act, max(CASE WHEN after > 0 THEN (n - 1 - lt) / n ELSE 1.0 END) AS sil, avg(ow / greatest(after, 1)) AS own FROM ra1 GROUP BY 1, 2),
wj AS (SELECT wf.*, ctx.* EXCLUDE (run_id, n), act, sil, own, status_run, zero_run FROM wf JOIN ctx USING (run_id) LEFT JOIN ra USING (run_id, t) JOIN st USING (run_id, t)),
win AS (SELECT run_id, t, {', '.join(f'{v[c]} AS {c}' for c in T.WINDOW_COLS)} FROM wj)"""


WINDOW_SQL = window_sql()
QW = f"WITH {WINDOW_SQL}, answer AS (SELECT * FROM win)"
register("w23_turn_windows", "run_id,t:l " + ",".join(T.WINDOW_COLS) + ":d", T.turn_windows, QW)
PARTS = {
    "w8_centred_sums": ["w_win_handoff", "w_win_assign", "w_win_result", "w_win_tools", "w_win_artifacts", "w_win_dup_text", "w_ctx_assign", "w_ctx_override"],
    "w9_centred_distinct": ["w_win_distinct_tools", "w_win_distinct_senders", "w_win_distinct_receivers", "w_win_distinct_intents"],
    "w10_new_intents": ["w_win_new_intents", "w_win_repeat_intents"],
    "w11_window_deltas": [c for c in T.WINDOW_COLS if "delta" in c],
    "w12_open_before": ["w_open_before", "w_open_after", "w_open_after_rel", "w_backlog_frac"],
    "w13_assignment_distance": ["w_since_assign", "w_since_assign_rel", "w_to_next_assign", "w_assign_pos_rel"]}
for name, cols in PARTS.items():
    register(name, "run_id,t:l " + ",".join(cols) + ":d", T.turn_windows, QW)
register("w20_receiver_activity", "run_id,t:l w_recv_active_after_rel,w_recv_silence_oldest_rel,w_recv_own_msgs_after_mean_rel:d", T.receiver_activity,
         f"WITH {WINDOW_SQL}, answer AS (SELECT run_id, t, act AS w_recv_active_after_rel, sil AS w_recv_silence_oldest_rel, own AS w_recv_own_msgs_after_mean_rel FROM ra)")
DECAY_SQL = f"""{BASE_TURN_SQL},
dw AS (SELECT run_id, t, sum(CASE WHEN dup_text > 0 THEN 1 ELSE -1 END) OVER (PARTITION BY run_id ORDER BY t) AS walk FROM tb),
dv AS (SELECT *, walk - least(0, min(walk) OVER (PARTITION BY run_id ORDER BY t)) AS level FROM dw),
decay AS (SELECT run_id, t, level, CASE WHEN level > 0 THEN coalesce(max(CASE WHEN level = 0 THEN t END) OVER (PARTITION BY run_id ORDER BY t), -1) + 1 END AS onset FROM dv)"""
register("w21_decaying_streak", "run_id,t,level,onset:l", T.decaying_streak, f"WITH {DECAY_SQL}, answer AS (SELECT * FROM decay)")


def _turn_distinct(tr):
    """Distinct roles and texts in the two turns either side, on real conversations."""
    from tracewright.plans.scan import framed
    c = tr.spark.read.parquet(f"{tr.sf_dir}/conversations.parquet")
    return framed(c, ["conv_id"], 2, 2, lambda w: {
        "roles": F.size(F.collect_set("role").over(w.rowsBetween(-2, 2))),
        "chars": F.sum(F.length("text")).over(w.rowsBetween(-2, 2))}, pos="turn")


register("w9_conversation_windows", "conv_id,turn,roles,chars:l", _turn_distinct,
         "SELECT conv_id, turn, len(list_distinct(list(role) OVER w)) AS roles, sum(len(text)) OVER w AS chars FROM conversations "
         "WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
