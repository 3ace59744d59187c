"""Wait graph, episode and task-graph queries."""

from pyspark.sql import functions as F

from tracewright.catalog.base import register, sql_ratio
from tracewright.catalog.runblocks import CHANGES_SQL, cnt
from tracewright.catalog.scans import EVENT_LOG_SQL, WAITS_SQL
from tracewright.operators import waits as W

S = sql_ratio


def outs(cols, exprs):
    return ", ".join(f"coalesce({e}, 0) AS {c}" for c, e in zip(cols, exprs, strict=True))


A21_SQL = f"""{WAITS_SQL},
we AS (SELECT run_id, count(*) AS e, count(DISTINCT (waiter, awaited)) AS ue FROM waits GROUP BY 1),
wp AS (SELECT DISTINCT x.run_id, x.waiter AS a, x.awaited AS b FROM waits x JOIN waits y ON x.run_id = y.run_id AND x.waiter = y.awaited AND x.awaited = y.waiter WHERE x.waiter < x.awaited),
ws AS (SELECT p.run_id, count(*) AS same FROM wp p WHERE EXISTS (SELECT 1 FROM waits x JOIN waits y ON x.run_id = y.run_id AND x.task = y.task WHERE x.run_id = p.run_id AND x.waiter = p.a
  AND x.awaited = p.b AND y.waiter = p.b AND y.awaited = p.a) GROUP BY 1),
wx AS (SELECT p.run_id, p.a, p.b, count(*) AS c, min(t) AS lo, max(t) AS hi, greatest(min(t) FILTER (WHERE waiter = a), min(t) FILTER (WHERE waiter = b)) AS onset
  FROM wp p JOIN waits w ON w.run_id = p.run_id AND least(waiter, awaited) = a AND greatest(waiter, awaited) = b GROUP BY 1, 2, 3),
wy AS (SELECT *, (SELECT count(*) FROM waits w WHERE w.run_id = wx.run_id AND least(waiter, awaited) = a AND greatest(waiter, awaited) = b AND w.t > onset) AS again,
  row_number() OVER (PARTITION BY run_id ORDER BY c DESC, a DESC, b DESC) AS k FROM wx),
wz AS (SELECT run_id, count(*) AS rp, min(onset) AS onset, max(c) AS mx, max(CASE WHEN k = 1 THEN again END) AS again, max(CASE WHEN k = 1 THEN hi - lo END) AS span FROM wy GROUP BY 1),
wa AS (SELECT run_id, count(DISTINCT x) AS ag FROM (SELECT run_id, a AS x FROM wp UNION ALL SELECT run_id, b FROM wp) GROUP BY 1),
a21 AS (SELECT r.run_id, {outs(W.WAIT_COLS, ['e', 'ue', 'rp', 'CASE WHEN rp > 0 THEN 1 ELSE 0 END', S('e', 'n'), 'same', 'CASE WHEN same > 0 THEN 1 ELSE 0 END',
    S('onset', 'greatest(n - 1, 1)'), 'mx', 'again', S('span', 'greatest(n - 1, 1)'), 'ag'])}
  FROM runs r LEFT JOIN we USING (run_id) LEFT JOIN wz USING (run_id) LEFT JOIN ws USING (run_id) LEFT JOIN wa USING (run_id))"""
register("a21_wait_block", "run_id:l " + ",".join(W.WAIT_COLS) + ":d", W.wait_block, f"WITH {A21_SQL}, answer AS (SELECT * FROM a21)")

EP_SQL = f"""e0 AS (SELECT *, lag(t) OVER w AS pt, lag(sender) OVER w AS ps FROM messages WHERE norm <> '' WINDOW w AS (PARTITION BY run_id, norm ORDER BY t)),
e1 AS (SELECT *, sum(CASE WHEN t - pt <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, norm ORDER BY t ROWS UNBOUNDED PRECEDING) AS g,
  CASE WHEN t - pt <= 6 THEN t - pt END AS gap, CASE WHEN t - pt <= 6 AND ps = sender THEN 0 ELSE 1 END AS ov FROM e0),
e2 AS (SELECT run_id, norm AS sig, g, max(n) AS n, min(t) AS start_turn, max(t) AS end_turn, count(*) AS length, max(gap) AS max_gap, avg(gap) AS mean_gap,
  count(DISTINCT sender) AS n_distinct_agents, sum(ov) AS n_trajectory_segments,
  {cnt("type IN ('handoff', 'inform')")} AS n_deliver_msgs, arg_min(receiver, t) AS to_agent
  FROM e1 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
fi AS (SELECT run_id, intent, min(t) AS t FROM messages WHERE intent <> '' GROUP BY 1, 2),
e3 AS (SELECT *, (SELECT count(*) FROM artifacts a WHERE a.run_id = e2.run_id AND a.t BETWEEN start_turn AND end_turn) AS n_artifacts_during,
  (SELECT count(*) FROM state a WHERE a.run_id = e2.run_id AND a.t BETWEEN start_turn AND end_turn) AS n_state_during,
  (SELECT count(*) FROM fi a WHERE a.run_id = e2.run_id AND a.t BETWEEN start_turn AND end_turn) AS n_new_intent_during FROM e2),
ep AS (SELECT *, end_turn - start_turn AS span, max_gap = 1 AS consecutive, max_gap <> 1 AS interleaved, n_distinct_agents >= 2 AS is_cycle, n_distinct_agents = 2 AS is_2cycle,
  n_distinct_agents = 3 AS is_3cycle, n_distinct_agents = 1 AS same_agent, n_artifacts_during = 0 AND n_state_during = 0 AS no_progress,
  CASE WHEN n_artifacts_during = 0 AND n_state_during = 0 THEN end_turn - start_turn ELSE 0 END AS no_progress_span FROM e3)"""
register("w15_episodes", "run_id:l sig:s start_turn,end_turn,length,span:l consecutive,interleaved:b max_gap:l mean_gap:d "
         "n_distinct_agents,n_trajectory_segments:l is_cycle,is_2cycle,is_3cycle,same_agent:b n_artifacts_during,n_state_during,"
         "n_new_intent_during,n_deliver_msgs:l no_progress:b no_progress_span:l to_agent:s", W.all_episodes, f"WITH {EP_SQL}, answer AS (SELECT * FROM ep)")


def _short(c):
    """A coarser signature: only the event word; gives many more episodes."""
    return F.split_part(c, F.lit(" "), F.lit(1))


register("w15_word_episodes", "run_id:l sig:s start_turn,end_turn,length,n_artifacts_during,n_state_during,n_new_intent_during,n_trajectory_segments:l",
         lambda tr: W.episodes(tr, _short),
         "WITH " + EP_SQL.replace("e0 AS (SELECT *, lag", "mw AS (SELECT * REPLACE (split_part(text, ' ', 1) AS norm) FROM messages), e0 AS (SELECT *, lag").replace(
             "FROM messages WHERE norm", "FROM mw WHERE norm") + ", answer AS (SELECT * FROM ep)")
register("w15_episode_segments", "run_id:l sig:s start_turn,segment:l agent:s", W.episode_segments,
         f"""WITH {EP_SQL}, answer AS (SELECT run_id, sig, start_turn, row_number() OVER (PARTITION BY run_id, sig, start_turn ORDER BY t) AS segment, agent
  FROM (SELECT e1.run_id, e1.norm AS sig, e2.start_turn, e1.t, e1.sender AS agent FROM e1 JOIN e2 ON e2.run_id = e1.run_id AND e2.sig = e1.norm AND e2.g = e1.g WHERE e1.ov = 1))""")
register("j7_inside_episodes", "run_id,start_turn,end_turn,n_artifacts_during,n_state_during,n_new_intent_during:l", W.all_episodes,
         f"WITH {EP_SQL}, answer AS (SELECT * FROM ep)")
EPX_SQL = f"""{EP_SQL},
es AS (SELECT run_id, count(*) AS k, max(length) AS len, arg_min(span, -length * 1000000 + start_turn) AS span, sum(length) AS tot, arg_min(start_turn, -length * 1000000 + start_turn) AS st,
  max(n_distinct_agents) AS mda, {cnt('is_cycle')} AS cyc, {cnt('interleaved')} AS il, {cnt('no_progress')} AS np, max(no_progress_span) AS nps, min(start_turn) AS fst, max(end_turn) AS lst,
  {cnt('n_artifacts_during > 0 OR n_state_during > 0 OR n_deliver_msgs > 0')} AS prog, max(max_gap) AS gap, max(CAST(same_agent AS INT)) AS same, max(CAST(is_2cycle AS INT)) AS c2,
  max(CAST(is_3cycle AS INT)) AS c3, max(CAST(n_artifacts_during > 0 AS INT)) AS art, max(CAST(n_state_during > 0 AS INT)) AS stt, max(CAST(n_new_intent_during > 0 AS INT)) AS ni,
  max(CAST(n_new_intent_during = 0 AS INT)) AS noni, max(CAST(n_artifacts_during > 0 OR n_deliver_msgs > 0 AS INT)) AS res FROM ep GROUP BY 1),
ej AS (SELECT r.run_id, r.n, coalesce(k, 0) AS k, es.* EXCLUDE (run_id, k), greatest(r.n - 1, 1) AS fin FROM runs r LEFT JOIN es USING (run_id)),
a22 AS (SELECT run_id, {outs(W.EPISODE_COLS, ['k', 'CASE WHEN k > 0 THEN 1 ELSE 0 END', 'len', S('span', 'fin'), S('tot', 'n'), 'mda', 'CASE WHEN cyc > 0 THEN 1 ELSE 0 END', 'cyc', 'il', S('il', 'k'),
    'np', S('np', 'k'), S('nps', 'fin'), S('prog', 'k'), f"CASE WHEN k > 0 THEN {S('fst', 'fin')} ELSE -1 END", f"CASE WHEN k > 0 THEN {S('lst', 'fin')} ELSE -1 END"])} FROM ej),
a22p AS (SELECT run_id, {outs(W.EPISODE_PROFILE, ['k', 'len', 'span', S('tot', 'n'), 'gap', 'same', 'c2', 'c3', 'CASE WHEN cyc > 0 THEN 1 ELSE 0 END', 'art', 'stt', 'ni', 'CASE WHEN np > 0 THEN 1 ELSE 0 END',
    'nps', f"CASE WHEN k > 0 THEN {S('st', 'fin')} ELSE -1 END", 'noni', 'CASE WHEN il > 0 THEN 1 ELSE 0 END', 'res'])} FROM ej)"""
register("a22_episode_block", "run_id:l " + ",".join(W.EPISODE_COLS) + ":d", W.episode_block, f"WITH {EPX_SQL}, answer AS (SELECT * FROM a22)")
register("a22_episode_profile", "run_id:l " + ",".join(W.EPISODE_PROFILE) + ":d", W.episode_profile, f"WITH {EPX_SQL}, answer AS (SELECT * FROM a22p)")

TG_SQL = f"""{EVENT_LOG_SQL}, {WAITS_SQL},
ac AS (SELECT run_id, id, count(*) AS copies FROM artifacts GROUP BY 1, 2),
rf AS (SELECT run_id, nullif(lower(trim(intent)), '') AS task, unnest(refs) AS id, t, sender FROM messages WHERE type = 'handoff'),
rt AS (SELECT run_id, id, min(task) AS t1 FROM rf WHERE task IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT task) = 1),
atk AS (SELECT a.run_id, a.t, a.id, a.maker, copies, coalesce(nullif(lower(trim(subtask)), ''), CASE WHEN copies = 1 THEN t1 END) AS task
  FROM artifacts a JOIN ac USING (run_id, id) LEFT JOIN rt USING (run_id, id)),
g0 AS (SELECT rf.run_id, rf.t, any_value(rf.sender) AS sender, any_value(rf.task) AS task, count(*) AS k, count(atk.id) AS hits, count(atk.maker) AS makers,
  list_distinct(list(atk.task) FILTER (WHERE atk.task IS NOT NULL)) AS tasks, list_distinct(list(atk.maker)) AS mk FROM rf LEFT JOIN atk ON atk.run_id = rf.run_id AND atk.id = rf.id AND atk.copies = 1 GROUP BY 1, 2),
g1 AS (SELECT run_id, t, CASE WHEN hits = k THEN coalesce(tasks, []) ELSE [] END AS tasks, coalesce(task, CASE WHEN hits = k AND len(tasks) = 1 THEN tasks[1] END) AS task,
  CASE WHEN hits = k AND makers = k AND len(mk) = 1 THEN mk[1] ELSE sender END AS actor FROM g0),
dl AS (SELECT run_id, task, t, actor, min(seq) AS seq FROM (
  SELECT g1.run_id, g1.task, g1.t, g1.actor, e.seq FROM g1 JOIN elog e ON e.run_id = g1.run_id AND e.kind = 'message' AND e.t = g1.t WHERE g1.task IS NOT NULL AND (len(tasks) = 0 OR tasks = [g1.task])
  UNION ALL SELECT atk.run_id, atk.task, atk.t, atk.maker, e.seq FROM atk JOIN elog e ON e.run_id = atk.run_id AND e.kind = 'artifact' AND e.t = atk.t AND e.src = atk.id WHERE atk.task IS NOT NULL) GROUP BY 1, 2, 3, 4),
ta0 AS (SELECT m.run_id, m.t, e.seq, nullif(lower(trim(intent)), '') AS task, receiver AS assignee FROM messages m JOIN elog e ON e.run_id = m.run_id AND e.t = m.t AND e.kind = 'message' WHERE is_assign),
ta1 AS (SELECT a.*, (SELECT min(seq) FROM dl WHERE dl.run_id = a.run_id AND dl.task = a.task AND dl.seq > a.seq) AS result_seq FROM ta0 a WHERE task IS NOT NULL),
ta2 AS (SELECT a.*, d.t AS result_t, d.actor AS result_actor FROM ta1 a LEFT JOIN dl d ON d.run_id = a.run_id AND d.task = a.task AND d.seq = a.result_seq),
ta AS (SELECT *, coalesce(lag(seq) OVER w IS NOT NULL AND (lag(result_seq) OVER w IS NULL OR lag(result_seq) OVER w > seq), false) AS again_before_result FROM ta2
  WINDOW w AS (PARTITION BY run_id, task ORDER BY seq)),
mt AS (SELECT m.run_id, e.seq, sender, m.type, nullif(lower(trim(intent)), '') AS task FROM messages m JOIN elog e ON e.run_id = m.run_id AND e.t = m.t AND e.kind = 'message'),
tb AS (SELECT ta.*, EXISTS (SELECT 1 FROM mt WHERE mt.run_id = ta.run_id AND sender = assignee AND mt.task = ta.task AND mt.type IN ('inform', 'status', 'state_update', 'final')
    AND mt.seq > ta.seq AND mt.seq < coalesce(result_seq, 1000000000)) AS response,
  EXISTS (SELECT 1 FROM mt WHERE mt.run_id = ta.run_id AND sender = assignee AND mt.task <> ta.task AND mt.type <> 'system' AND mt.seq > ta.seq AND mt.seq < coalesce(result_seq, 1000000000)) AS other_activity FROM ta),
rw AS (SELECT w.run_id, w.t, w.awaited AS actor, w.task, (SELECT min(d.t) FROM dl d WHERE d.run_id = w.run_id AND d.task = w.task AND d.actor = w.awaited AND d.seq > e.seq) AS delivery_t
  FROM waits w JOIN elog e ON e.run_id = w.run_id AND e.t = w.t AND e.kind = 'message' WHERE w.task IS NOT NULL)"""
register("j9_artifact_tasks", "run_id,t:l id,task:s", W.artifact_tasks, f"WITH {TG_SQL}, answer AS (SELECT * FROM atk)")
register("j9_task_deliveries", "run_id:l task:s t,seq:l actor:s", W.task_deliveries, f"WITH {TG_SQL}, answer AS (SELECT * FROM dl)")
register("m3_close_all", "run_id,t,seq:l task,assignee:s result_seq,result_t:l result_actor:s again_before_result:b", W.task_assignments,
         f"WITH {TG_SQL}, answer AS (SELECT * FROM ta)")
register("j10_resolved_waits", "run_id,t:l actor,task:s delivery_t:l", W.resolved_waits, f"WITH {TG_SQL}, answer AS (SELECT * FROM rw)")
A23_SQL = f"""{TG_SQL}, {CHANGES_SQL},
en AS (SELECT run_id, min(t) AS t0, max(t) AS t1, greatest(max(t) - min(t), 1) AS span FROM elog GROUP BY 1),
t9 AS (SELECT run_id, count(*) AS m, list(result_t - t ORDER BY result_t - t) AS ds FROM tb WHERE result_t IS NOT NULL GROUP BY 1),
oe AS (SELECT run_id, seq, t, sum(d) AS d FROM (SELECT run_id, seq, t, 1 AS d FROM ta UNION ALL SELECT run_id, result_seq, result_t, -1 FROM ta WHERE result_seq IS NOT NULL) GROUP BY 1, 2, 3),
oo AS (SELECT *, sum(d) OVER w AS open, lead(t) OVER (PARTITION BY run_id ORDER BY seq) AS nt FROM oe WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
ox AS (SELECT run_id, max(open) AS peak, sum(open * (coalesce(nt, t1) - t)) AS area FROM oo JOIN en USING (run_id) GROUP BY 1),
tp AS (SELECT run_id, count(*) AS k, {cnt('result_seq IS NULL')} AS u, {cnt('result_seq IS NULL AND response')} AS ur, {cnt('response')} AS r, {cnt('result_seq IS NULL AND other_activity')} AS uo,
  avg(result_t - t) AS dm, max(result_t - t) AS dx, max(greatest(coalesce(result_t, t1) - t, 0)) AS age, {cnt('again_before_result')} AS rep, {cnt('result_actor <> assignee')} AS oth,
  count(result_seq) AS d FROM tb JOIN en USING (run_id) GROUP BY 1),
tw AS (SELECT run_id, count(*) AS w, count(delivery_t) AS wd, avg(delivery_t - t) AS wm FROM rw GROUP BY 1),
tm AS (SELECT run_id, {cnt('c > 1')} AS mk FROM (SELECT run_id, lower(key), count(DISTINCT agent) AS c FROM state GROUP BY 1, 2) GROUP BY 1),
tc AS (SELECT run_id, count(*) AS cw, {cnt("op = 'override'")} AS co, {cnt('flip')} AS cv FROM changes WHERE cross_writer GROUP BY 1),
a23 AS (SELECT r.run_id, {outs(W.TASK_COLS, ['k', 'u', S('u', 'k'), 'ur', S('ur', 'r'), 'uo', S('uo', 'k'), 'dm', 'ds[CAST(ceil(0.9 * m) AS BIGINT)]', S('dx', 'span'), 'peak', S('area', 'k * span'),
    S('age', 'span'), 'rep', S('rep', 'k'), 'oth', S('oth', 'd'), 'w', S('wd', 'w'), S('wm', 'span'), 'mk', 'cw', 'co', 'cv'])}
  FROM runs r LEFT JOIN en USING (run_id) LEFT JOIN tp USING (run_id) LEFT JOIN t9 USING (run_id) LEFT JOIN ox USING (run_id) LEFT JOIN tw USING (run_id) LEFT JOIN tm USING (run_id) LEFT JOIN tc USING (run_id))"""
register("a23_task_block", "run_id:l " + ",".join(W.TASK_COLS) + ":d", W.task_block, f"WITH {A23_SQL}, answer AS (SELECT * FROM a23)")
