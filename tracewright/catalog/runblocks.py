"""Run-level blocks, graph block and the joins behind them."""

from pyspark.sql import functions as F

from tracewright.catalog.base import KEYWORDS, TOPOLOGY_TYPES, register, sql_keyword, sql_ratio
from tracewright.fixed import MESSAGE_TYPES
from tracewright.operators import graph as G
from tracewright.operators import matching as M
from tracewright.operators import runfeatures as R

S = sql_ratio


def cnt(cond):
    return f"count(*) FILTER (WHERE {cond})"


BLOCKS = {}
BLOCKS["a1_volume"] = ("n_messages n_agents n_artifacts n_state_writes n_tools_declared msgs_per_agent arts_per_msg state_per_msg", R.volume, f"""
q AS (SELECT run_id, count(*) AS n FROM messages GROUP BY 1), qa AS (SELECT run_id, count(*) AS a FROM agents GROUP BY 1),
qr AS (SELECT run_id, count(*) AS r FROM artifacts GROUP BY 1), qs AS (SELECT run_id, count(*) AS s FROM state GROUP BY 1),
b1 AS (SELECT q.run_id, n AS n_messages, coalesce(a, 0) AS n_agents, coalesce(r, 0) AS n_artifacts, coalesce(s, 0) AS n_state_writes,
  0 AS n_tools_declared, {S('n', 'a')} AS msgs_per_agent, {S('coalesce(r, 0)', 'n')} AS arts_per_msg,
  {S('coalesce(s, 0)', 'n')} AS state_per_msg
  FROM q LEFT JOIN qa USING (run_id) LEFT JOIN qr USING (run_id) LEFT JOIN qs USING (run_id))""", "b1")
BLOCKS["a2_protocol"] = (" ".join([f"type_{v}" for v in MESSAGE_TYPES] + [f"share_{v}" for v in MESSAGE_TYPES]) + " has_final_msg has_system_msg", R.protocol, f"""
b2 AS (SELECT run_id, {', '.join(f"{cnt(f'''type = '{v}' ''')} AS type_{v}, avg(CASE WHEN type = '{v}' THEN 1.0 ELSE 0 END) AS share_{v}" for v in MESSAGE_TYPES)},
  max(CASE WHEN type = 'final' THEN 1 ELSE 0 END) AS has_final_msg, max(CASE WHEN type = 'system' THEN 1 ELSE 0 END) AS has_system_msg
  FROM messages GROUP BY run_id)""", "b2")
BLOCKS["a3_senders"] = ("n_senders sender_entropy sender_max_share silent_agent_ratio", R.senders, """
q3 AS (SELECT run_id, sender, count(*) AS c, max(n) AS n FROM messages GROUP BY 1, 2),
q3s AS (SELECT a.run_id, avg(CASE WHEN EXISTS (SELECT 1 FROM messages m WHERE m.run_id = a.run_id AND (m.sender = a.agent OR m.receiver = a.agent))
  THEN 0.0 ELSE 1.0 END) AS silent_agent_ratio FROM agents a GROUP BY 1),
b3 AS (SELECT * FROM (SELECT run_id, count(*) AS n_senders, -sum((c / n) * ln(c / n + 1e-12)) AS sender_entropy,
  max(c) / max(n) AS sender_max_share FROM q3 GROUP BY 1) JOIN q3s USING (run_id))""", "b3")
STREAK_SQL = """st0 AS (SELECT run_id, t, n, norm, sender, type, goal_ov, lag(norm) OVER w AS pn, lag(sender) OVER w AS ps FROM messages
  WINDOW w AS (PARTITION BY run_id ORDER BY t)),
st1 AS (SELECT *, sum(CASE WHEN pn = norm THEN 0 ELSE 1 END) OVER w AS g1,
  sum(CASE WHEN pn = norm AND ps = sender THEN 0 ELSE 1 END) OVER w AS g2,
  sum(CASE WHEN type = 'status' THEN 0 ELSE 1 END) OVER w AS g3, sum(CASE WHEN goal_ov = 0 THEN 0 ELSE 1 END) OVER w AS g4 FROM st0
  WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, row_number() OVER (PARTITION BY run_id, g1 ORDER BY t) AS streak, row_number() OVER (PARTITION BY run_id, g2 ORDER BY t) AS sender_streak,
  CASE WHEN type = 'status' THEN sum(CASE WHEN type = 'status' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g3 ORDER BY t) ELSE 0 END AS status_run,
  CASE WHEN goal_ov = 0 THEN sum(CASE WHEN goal_ov = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g4 ORDER BY t) ELSE 0 END AS zero_run FROM st1)"""
BLOCKS["a4_duplicates"] = ("dup_text_max dup_text_ratio norm_dup_max norm_dup_ratio norm_unique_ratio max_consecutive_repeat max_sender_repeat_streak", R.repetition, f"""
{STREAK_SQL},
q4a AS (SELECT run_id, max(c) AS mx, count(*) AS k, sum(c) AS n FROM (SELECT run_id, text, count(*) AS c FROM messages GROUP BY 1, 2) GROUP BY 1),
q4b AS (SELECT run_id, max(c) AS mx, count(*) AS k, sum(c) AS n FROM (SELECT run_id, norm, count(*) AS c FROM messages GROUP BY 1, 2) GROUP BY 1),
q4c AS (SELECT run_id, max(streak) AS max_consecutive_repeat, max(sender_streak) AS max_sender_repeat_streak FROM st GROUP BY 1),
b4 AS (SELECT a.run_id, a.mx AS dup_text_max, (a.n - a.k) / a.n AS dup_text_ratio, b.mx AS norm_dup_max, (b.n - b.k) / b.n AS norm_dup_ratio,
  b.k / b.n AS norm_unique_ratio, max_consecutive_repeat, max_sender_repeat_streak FROM q4a a JOIN q4b b USING (run_id) JOIN q4c USING (run_id))""", "b4")
BLOCKS["a5_intents"] = ("n_intents intent_entropy intent_max_count intent_max_share", R.intents, """
q5 AS (SELECT run_id, intent, count(*) AS c, max(n) AS n FROM messages GROUP BY 1, 2),
b5 AS (SELECT run_id, count(*) AS n_intents, -sum((c / n) * ln(c / n + 1e-12)) AS intent_entropy, max(c) AS intent_max_count,
  max(c) / max(n) AS intent_max_share FROM q5 GROUP BY 1)""", "b5")
BLOCKS["a6_keywords"] = (" ".join([f"kw_{g}" for g in KEYWORDS] + [f"kw_{g}_rate" for g in KEYWORDS]), R.keywords, f"""
q6 AS (SELECT run_id, lower(string_agg(text, ' ' ORDER BY t)) AS low, count(*) AS n FROM messages GROUP BY 1),
b6 AS (SELECT run_id, {', '.join(f"{sql_keyword('low', g)} AS kw_{g}, {S(sql_keyword('low', g), 'n')} AS kw_{g}_rate" for g in KEYWORDS)} FROM q6)""", "b6")
BLOCKS["a7_goal_alignment"] = ("goal_ov_mean goal_ov_head goal_ov_tail goal_ov_delta goal_ov_zero_ratio goal_ov_max", R.goal_alignment, """
q7 AS (SELECT run_id, avg(goal_ov) AS goal_ov_mean, avg(goal_ov) FILTER (WHERE t < greatest(1, n // 3)) AS goal_ov_head,
  avg(goal_ov) FILTER (WHERE t >= n - greatest(1, n // 3)) AS goal_ov_tail, avg(CASE WHEN goal_ov = 0 THEN 1.0 ELSE 0 END) AS goal_ov_zero_ratio,
  max(goal_ov) AS goal_ov_max FROM messages GROUP BY 1),
b7 AS (SELECT *, goal_ov_tail - goal_ov_head AS goal_ov_delta FROM q7)""", "b7")
BLOCKS["a8_intent_shift"] = ("intent_head_tail_jaccard new_intents_in_tail", R.intent_shift, """
q8 AS (SELECT run_id, list_distinct(list(intent) FILTER (WHERE t < greatest(1, n // 3))) AS h,
  list_distinct(list(intent) FILTER (WHERE t >= n - greatest(1, n // 3))) AS l FROM messages GROUP BY 1),
b8 AS (SELECT run_id, len(list_intersect(h, l)) / len(list_distinct(list_concat(h, l))) AS intent_head_tail_jaccard,
  len(l) - len(list_intersect(h, l)) AS new_intents_in_tail FROM q8)""", "b8")
REPLY_SQL = """asg AS (SELECT * FROM messages WHERE is_assign),
dlv AS (SELECT * FROM messages WHERE is_delivery),
dkeys AS (SELECT run_id, sender AS agent, intent FROM dlv UNION SELECT run_id, maker, subtask FROM artifacts),
reply AS (SELECT a.run_id, a.t, a.sender, a.receiver, a.intent, min(m.t) AS reply_t FROM asg a LEFT JOIN messages m
  ON m.run_id = a.run_id AND m.sender = a.receiver AND m.t > a.t GROUP BY ALL),
undel AS (SELECT * FROM asg a WHERE NOT EXISTS (SELECT 1 FROM dkeys d WHERE d.run_id = a.run_id AND d.agent = a.receiver AND d.intent = a.intent))"""
BLOCKS["a9_handoffs"] = ("n_assign n_result assign_result_gap unanswered_assign unanswered_ratio undelivered_assign undelivered_ratio reply_delay_mean reply_delay_max reassigned_intents reassigned_ratio max_assign_per_intent intents_with_multiple_owners", R.handoffs, f"""
{REPLY_SQL},
q9a AS (SELECT run_id, {cnt('is_assign')} AS n_assign, {cnt('is_delivery')} AS n_result FROM messages GROUP BY 1),
q9b AS (SELECT run_id, {cnt('reply_t IS NULL')} AS unanswered, avg(reply_t - t) AS dm, max(reply_t - t) AS dx FROM reply GROUP BY 1),
q9c AS (SELECT run_id, count(*) AS und FROM undel GROUP BY 1),
q9d AS (SELECT run_id, {cnt('c > 1')} AS re, count(*) AS k, max(c) AS mx, {cnt('o > 1')} AS mo FROM
  (SELECT run_id, intent, count(*) AS c, count(DISTINCT receiver) AS o FROM asg GROUP BY 1, 2) GROUP BY 1),
b9 AS (SELECT q9a.run_id, n_assign, n_result, n_assign - n_result AS assign_result_gap, coalesce(unanswered, 0) AS unanswered_assign,
  {S('unanswered', 'n_assign')} AS unanswered_ratio, coalesce(und, 0) AS undelivered_assign, {S('und', 'n_assign')} AS undelivered_ratio,
  coalesce(dm, 0) AS reply_delay_mean, coalesce(dx, 0) AS reply_delay_max, coalesce(re, 0) AS reassigned_intents, {S('re', 'k')} AS reassigned_ratio,
  coalesce(mx, 0) AS max_assign_per_intent, coalesce(mo, 0) AS intents_with_multiple_owners
  FROM q9a LEFT JOIN q9b USING (run_id) LEFT JOIN q9c USING (run_id) LEFT JOIN q9d USING (run_id))""", "b9")
BLOCKS["a11_artifacts"] = ("n_unique_hashes dup_hash_pairs dup_hash_max dup_hash_ratio max_arts_per_subtask subtasks_with_2plus_arts art_partial art_copy has_final_artifact coverage art_types", R.artifact_block, f"""
q11a AS (SELECT run_id, count(*) AS u, sum(c - 1) AS p, max(c) AS mx FROM (SELECT run_id, hash, count(*) AS c FROM artifacts GROUP BY 1, 2) GROUP BY 1),
q11b AS (SELECT run_id, max(c) AS mx, {cnt('c > 1')} AS k FROM (SELECT run_id, subtask, count(*) AS c FROM artifacts GROUP BY 1, 2) GROUP BY 1),
q11c AS (SELECT run_id, {cnt("status = 'partial'")} AS pa, {cnt("status = 'copy'")} AS co, count(DISTINCT type) AS ty, count(*) AS n,
  max(CASE WHEN subtask = 'final_delivery' THEN 1 ELSE 0 END) AS fi FROM artifacts GROUP BY 1),
q11d AS (SELECT run_id, avg(CASE WHEN EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = d.run_id AND a.subtask = d.intent) THEN 1.0 ELSE 0 END) AS cov
  FROM (SELECT DISTINCT run_id, intent FROM messages WHERE is_assign) d GROUP BY 1),
b11 AS (SELECT r.run_id, coalesce(u, 0) AS n_unique_hashes, coalesce(p, 0) AS dup_hash_pairs, coalesce(q11a.mx, 0) AS dup_hash_max, {S('p', 'q11c.n')} AS dup_hash_ratio,
  coalesce(q11b.mx, 0) AS max_arts_per_subtask, coalesce(k, 0) AS subtasks_with_2plus_arts, coalesce(pa, 0) AS art_partial, coalesce(co, 0) AS art_copy,
  coalesce(fi, 0) AS has_final_artifact, coalesce(cov, 0) AS coverage, coalesce(ty, 0) AS art_types FROM runs r LEFT JOIN q11a USING (run_id)
  LEFT JOIN q11b USING (run_id) LEFT JOIN q11c USING (run_id) LEFT JOIN q11d USING (run_id))""", "b11")
CHANGES_SQL = """chg AS (SELECT *, lag(value) OVER w AS pv, lag(value, 2) OVER w AS pv2, lag(agent) OVER w AS pa FROM state
  WINDOW w AS (PARTITION BY run_id, key ORDER BY t)),
changes AS (SELECT run_id, t, agent, key, op, value, pv AS prev_value, pa AS prev_agent, pv IS NOT NULL AND value <> pv AS flip,
  coalesce(value = pv2 AND value <> pv, false) AS alt_flip, pa IS NOT NULL AND pa <> agent AS cross_writer FROM chg)"""
BLOCKS["a12_state"] = ("state_keys state_overrides state_override_ratio state_max_writes_per_key state_max_distinct_per_key state_flips state_alternating_flips state_keys_3plus status_completed status_failed status_missing", R.state_block, f"""
{CHANGES_SQL},
q12 AS (SELECT run_id, key, count(*) AS c, count(DISTINCT value) AS d FROM state GROUP BY 1, 2),
q12b AS (SELECT run_id, count(*) AS k, max(c) AS mc, max(d) AS md, {cnt('c >= 3')} AS k3 FROM q12 GROUP BY 1),
q12c AS (SELECT run_id, {cnt("op = 'override'")} AS ov, count(*) AS w, {cnt('flip')} AS fl, {cnt('alt_flip')} AS al,
  max(CASE WHEN key = 'run_status' AND value = 'completed' THEN 1 ELSE 0 END) AS done,
  max(CASE WHEN key = 'run_status' AND value IN ('timeout', 'aborted', 'incomplete') THEN 1 ELSE 0 END) AS failed,
  min(CASE WHEN key = 'run_status' THEN 0 ELSE 1 END) AS missing FROM changes GROUP BY 1),
b12 AS (SELECT r.run_id, coalesce(k, 0) AS state_keys, coalesce(ov, 0) AS state_overrides, {S('ov', 'w')} AS state_override_ratio, coalesce(mc, 0) AS state_max_writes_per_key,
  coalesce(md, 0) AS state_max_distinct_per_key, coalesce(fl, 0) AS state_flips, coalesce(al, 0) AS state_alternating_flips, coalesce(k3, 0) AS state_keys_3plus,
  coalesce(done, 0) AS status_completed, coalesce(failed, 0) AS status_failed, coalesce(missing, 1) AS status_missing
  FROM runs r LEFT JOIN q12b USING (run_id) LEFT JOIN q12c USING (run_id))""", "b12")
BLOCKS["a13_topology"] = (" ".join(f"topo_{v}" for v in TOPOLOGY_TYPES) + " topo_edges topo_edge_per_agent", R.topology_block, f"""
q13 AS (SELECT run_id, count(*) AS e FROM topology_edges GROUP BY 1), q13a AS (SELECT run_id, count(*) AS a FROM agents GROUP BY 1),
b13 AS (SELECT t.run_id, {', '.join(f"CASE WHEN topo_type = '{v}' THEN 1 ELSE 0 END AS topo_{v}" for v in TOPOLOGY_TYPES)},
  coalesce(e, 0) AS topo_edges, {S('coalesce(e, 0)', 'a')} AS topo_edge_per_agent FROM topology t LEFT JOIN q13 USING (run_id) LEFT JOIN q13a USING (run_id))""", "b13")
BLOCKS["a14_tail_shares"] = ("tail_status_share tail_inform_share tail_handoff_share tail_has_final", R.tail_block, f"""
b14 AS (SELECT run_id, {', '.join(f"avg(CASE WHEN type = '{v}' THEN 1.0 ELSE 0 END) AS tail_{v}_share" for v in ('status', 'inform', 'handoff'))},
  max(CASE WHEN type = 'final' THEN 1 ELSE 0 END) AS tail_has_final FROM messages WHERE t >= n - greatest(1, n // 5) GROUP BY 1)""", "b14")
SCC_SQL = """ed AS (SELECT run_id, sender AS src, receiver AS dst, count(*) AS cnt, min(t) AS ft FROM messages GROUP BY 1, 2, 3),
nodes AS (SELECT run_id, src AS node FROM ed UNION SELECT run_id, dst FROM ed),
r0 AS (SELECT run_id, node AS a, node AS b FROM nodes UNION SELECT run_id, src, dst FROM ed),
r1 AS (SELECT DISTINCT x.run_id, x.a, y.b FROM r0 x JOIN r0 y ON x.run_id = y.run_id AND x.b = y.a),
r2 AS (SELECT DISTINCT x.run_id, x.a, y.b FROM r1 x JOIN r1 y ON x.run_id = y.run_id AND x.b = y.a),
r3 AS (SELECT DISTINCT x.run_id, x.a, y.b FROM r2 x JOIN r2 y ON x.run_id = y.run_id AND x.b = y.a),
r4 AS (SELECT DISTINCT x.run_id, x.a, y.b FROM r3 x JOIN r3 y ON x.run_id = y.run_id AND x.b = y.a),
members AS (SELECT x.run_id, x.a AS node, min(x.b) AS comp FROM r4 x JOIN r4 y ON x.run_id = y.run_id AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
scc AS (SELECT run_id, max(k) AS g_largest_scc, max(k) / sum(k) AS g_scc_share FROM (SELECT run_id, comp, count(*) AS k FROM members GROUP BY 1, 2) GROUP BY 1)"""
GRAPH_COLS = "g_nodes g_edges g_density g_self_loops g_reciprocity g_two_cycles g_triangles g_max_out_deg g_mean_out_deg g_max_in_deg g_largest_scc g_scc_share g_n_pairs g_max_pair g_top_pair_share g_pingpong g_pingpong_share"
BLOCKS["a15_graph"] = (GRAPH_COLS, G.graph_block, f"""
{SCC_SQL},
q15 AS (SELECT run_id, {cnt('src <> dst')} AS ge, coalesce(sum(cnt) FILTER (WHERE src = dst), 0) AS sl, count(*) AS np, max(cnt) AS mp, sum(cnt) AS n FROM ed GROUP BY 1),
q15n AS (SELECT run_id, count(*) AS gn FROM nodes GROUP BY 1),
q15o AS (SELECT run_id, max(d) AS mo FROM (SELECT run_id, src, count(*) AS d FROM ed WHERE src <> dst GROUP BY 1, 2) GROUP BY 1),
q15i AS (SELECT run_id, max(d) AS mi FROM (SELECT run_id, dst, count(*) AS d FROM ed WHERE src <> dst GROUP BY 1, 2) GROUP BY 1),
q15r AS (SELECT x.run_id, {cnt('x.src <> x.dst')} AS rc, max(least(x.cnt, y.cnt)) AS pp FROM ed x JOIN ed y ON x.run_id = y.run_id AND x.src = y.dst AND x.dst = y.src GROUP BY 1),
q15t AS (SELECT x.run_id, count(*) / 3.0 AS tr FROM ed x JOIN ed y ON x.run_id = y.run_id AND x.dst = y.src JOIN ed z ON z.run_id = y.run_id AND z.src = y.dst AND z.dst = x.src
  WHERE x.src <> x.dst AND y.src <> y.dst AND z.src <> z.dst AND x.src <> y.dst GROUP BY 1),
b15 AS (SELECT q15.run_id, gn AS g_nodes, ge AS g_edges, {S('ge', 'gn * (gn - 1)')} AS g_density, sl AS g_self_loops, {S('rc', 'ge')} AS g_reciprocity,
  coalesce(rc, 0) // 2 AS g_two_cycles, coalesce(tr, 0) AS g_triangles, coalesce(mo, 0) AS g_max_out_deg, {S('ge', 'gn')} AS g_mean_out_deg, coalesce(mi, 0) AS g_max_in_deg,
  g_largest_scc, g_scc_share, np AS g_n_pairs, mp AS g_max_pair, mp / n AS g_top_pair_share, coalesce(pp, 0) AS g_pingpong, coalesce(pp, 0) * 2 / n AS g_pingpong_share
  FROM q15 JOIN q15n USING (run_id) JOIN scc USING (run_id) LEFT JOIN q15o USING (run_id) LEFT JOIN q15i USING (run_id) LEFT JOIN q15r USING (run_id) LEFT JOIN q15t USING (run_id))""", "b15")

for name, (cols, fn, sql, cte) in BLOCKS.items():
    register(name, "run_id:l " + ",".join(cols.split()) + ":d", fn, f"WITH {sql}, answer AS (SELECT * FROM {cte})")

register("a10_reply_delays", "run_id:l reply_delay_mean,reply_delay_max:d", R.handoffs,
         f"WITH {BLOCKS['a9_handoffs'][2]}, answer AS (SELECT * FROM b9)")
ALL_COLS = [c for v in BLOCKS.values() for c in v[0].split()]
BASE_SQL = ", ".join(v[2] for v in BLOCKS.values()) + ", base AS (SELECT * FROM b1 " + " ".join(
    f"JOIN {v[3]} USING (run_id)" for k, v in BLOCKS.items() if v[3] != "b1") + ")"
register("a0_run_block", "run_id:l " + ",".join(ALL_COLS) + ":d", R.run_block,
         f"WITH {BASE_SQL}, answer AS (SELECT * FROM base)")
NORMAL_SQL = ", ".join(
    f"{S(a, f'greatest({b}, {lo})' if lo else b)} AS {name}" for name, a, b, lo in R.NORMALISED)
register("a17_normalised", "run_id:l " + ",".join(x[0] for x in R.NORMALISED) + ":d",
         lambda tr: R.normalised(R.run_block(tr)),
         f"WITH {BASE_SQL}, answer AS (SELECT run_id, {NORMAL_SQL} FROM base)")
P8_COLS = BLOCKS["a9_handoffs"][0].split() + GRAPH_COLS.split()
register("p8_drop_block", "run_id:l " + ",".join(P8_COLS) + ":d", lambda tr: R.run_block(tr).drop(
    *[c for c in ALL_COLS if c not in P8_COLS]), f"WITH {BASE_SQL}, answer AS (SELECT * FROM base)")

register("a16_scc_members", "run_id:l node,comp:s", lambda tr: G.scc_members(M.pair_edges(tr.messages), G.run_nodes(tr)),
         f"WITH {SCC_SQL}, answer AS (SELECT * FROM members)")
register("a16_largest_scc", "run_id:l g_largest_scc,g_scc_share:d", G.largest_scc,
         f"WITH {SCC_SQL}, answer AS (SELECT * FROM scc)")
# waits give a sparse graph with several components
register("a16_wait_scc", "run_id:l node,comp:s", lambda tr: G.scc_members(
    M.pair_edges(tr.messages.filter("type = 'status'")), G.run_nodes(tr)),
    "WITH " + SCC_SQL.replace("FROM messages GROUP", "FROM messages WHERE type = 'status' GROUP").replace(
        "SELECT run_id, src AS node FROM ed UNION SELECT run_id, dst FROM ed",
        "SELECT run_id, sender AS node FROM messages UNION SELECT run_id, receiver FROM messages")
    + ", answer AS (SELECT * FROM members)")

# ---- joins ----
register("j1_first_replies", "run_id,t:l sender,receiver,intent:s reply_t:l", M.first_replies,
         f"WITH {REPLY_SQL}, answer AS (SELECT * FROM reply)")
register("j2_undelivered", "run_id,t:l sender,receiver,intent:s", M.undelivered,
         f"WITH {REPLY_SQL}, answer AS (SELECT * FROM undel)")
register("j3_delivered", "run_id,t:l sender,receiver,intent:s", M.delivered_assignments, f"""WITH {REPLY_SQL},
  answer AS (SELECT * FROM asg a WHERE EXISTS (SELECT 1 FROM messages m WHERE m.run_id = a.run_id AND m.sender = a.receiver AND m.intent = a.intent AND m.t > a.t)
  OR EXISTS (SELECT 1 FROM dkeys d WHERE d.run_id = a.run_id AND d.agent = a.receiver AND d.intent = a.intent))""")
register("j4_reciprocal_pairs", "run_id:l a,b:s cnt_ab,cnt_ba:l", lambda tr: M.reciprocal_pairs(M.pair_edges(tr.messages)),
         f"WITH {SCC_SQL}, answer AS (SELECT x.run_id, x.src AS a, x.dst AS b, x.cnt AS cnt_ab, y.cnt AS cnt_ba FROM ed x JOIN ed y "
         "ON x.run_id = y.run_id AND x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst)")
register("j5_triangles", "run_id:l triangles:d", lambda tr: M.triangles(M.pair_edges(tr.messages)),
         f"WITH {BLOCKS['a15_graph'][2]}, answer AS (SELECT run_id, tr AS triangles FROM q15t)")

# ---- windows ----
register("w1_repeat_streaks", "run_id,t,streak,sender_streak:l", R.streaks, f"WITH {STREAK_SQL}, answer AS (SELECT * FROM st)")


def _turn_repeats(tr):
    from tracewright.functions.text import normalise
    from tracewright.plans.scan import framed, running
    c = tr.spark.read.parquet(f"{tr.sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("t"), "role", normalise(F.col("text")).alias("norm"))
    c = framed(c, ["run_id"], 1, 0, lambda w: {"p": F.lag("norm").over(w)})
    s = running(c, ["run_id"], ["t"], {"s": ("max", F.when(F.col("p").isNull() | (F.col("p") != F.col("norm")), F.col("t")))})
    return s.groupBy("run_id").agg(F.max(F.col("t") - F.col("s") + 1).alias("longest"))


register("w1_turn_repeats", "run_id,longest:l", _turn_repeats, """WITH c AS (SELECT conv_id AS run_id, turn AS t, """
         + __import__("tracewright.catalog.base", fromlist=["sql_norm"]).sql_norm("text") + """ AS norm FROM conversations),
  d AS (SELECT *, lag(norm) OVER (PARTITION BY run_id ORDER BY t) AS p FROM c),
  e AS (SELECT *, sum(CASE WHEN p = norm THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY t) AS g FROM d),
  answer AS (SELECT run_id, max(k) AS longest FROM (SELECT run_id, g, count(*) AS k FROM e GROUP BY 1, 2) GROUP BY 1)""")
register("w2_longest_runs", "run_id,status_len,status_start,repeat_len,repeat_start:l", R.longest_runs, f"""WITH {STREAK_SQL},
  s AS (SELECT run_id, status_run AS status_len, t - status_run + 1 AS status_start, row_number() OVER (PARTITION BY run_id ORDER BY status_run DESC, t) AS k FROM st WHERE status_run > 0),
  r AS (SELECT run_id, streak AS repeat_len, t - streak + 1 AS repeat_start, row_number() OVER (PARTITION BY run_id ORDER BY streak DESC, t) AS k FROM st),
  answer AS (SELECT * FROM runs LEFT JOIN (SELECT * FROM s WHERE k = 1) USING (run_id) LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (run_id))""")
register("w3_state_changes", "run_id,t:l key,value,prev_value:s flip,alt_flip:b", R.state_changes,
         f"WITH {CHANGES_SQL}, answer AS (SELECT * FROM changes)")
register("w14_cross_writers", "run_id,t:l key,agent,prev_agent:s override_by_other,value_changed:b",
         lambda tr: R.state_changes(tr).filter("cross_writer").select(
             "run_id", "t", "key", "agent", "prev_agent", (F.col("op") == "override").alias("override_by_other"),
             F.col("flip").alias("value_changed")),
         f"WITH {CHANGES_SQL}, answer AS (SELECT *, op = 'override' AS override_by_other, flip AS value_changed FROM changes WHERE cross_writer)")
POSITIONS_SQL = f"""{STREAK_SQL}, {CHANGES_SQL},
pk AS (SELECT *, lag(intent) OVER (PARTITION BY run_id ORDER BY t) AS pi FROM messages),
p1 AS (SELECT run_id, max(n) AS n, min(t) FILTER (WHERE is_assign) AS pos_first_assign, min(t) FILTER (WHERE is_delivery) AS pos_first_delivery,
  max(t) FILTER (WHERE is_assign) AS pos_last_assign, max(t) FILTER (WHERE is_delivery) AS pos_last_delivery,
  min(t) FILTER (WHERE type = 'inform' AND intent = pi AND len(refs) = 0) AS pos_first_ack FROM pk GROUP BY 1),
p2 AS (SELECT run_id, min(t - 1) FILTER (WHERE zero_run = 2) AS pos_goal_zero_run, min(t - 1) FILTER (WHERE status_run = 2 AND t > 1) AS pos_first_status_run FROM st GROUP BY 1),
p3 AS (SELECT run_id, arg_min(t - streak + 1, -streak * 1000000 + t) AS pos_streak_start FROM st WHERE streak >= 2 GROUP BY 1),
p4 AS (SELECT run_id, min(t) AS pos_first_state_write, min(t) FILTER (WHERE op = 'override') AS pos_first_override, min(t) FILTER (WHERE flip) AS pos_first_conflict_flip FROM changes GROUP BY 1),
positions AS (SELECT p1.run_id, {', '.join(f"{S(p, 'greatest(n - 1, 1)')} AS {p}" for p in R.POSITIONS)} FROM p1 LEFT JOIN p2 USING (run_id) LEFT JOIN p3 USING (run_id) LEFT JOIN p4 USING (run_id))"""
register("w19_positions", "run_id:l " + ",".join(R.POSITIONS) + ":d", R.positions,
         f"WITH {POSITIONS_SQL}, answer AS (SELECT * FROM positions)")
