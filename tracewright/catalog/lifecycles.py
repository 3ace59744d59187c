"""Event matching, lifecycle, deadlock, temporal and audit queries."""

from pyspark.sql import functions as F

from tracewright.catalog.base import register, sql_ratio
from tracewright.catalog.runblocks import SCC_SQL, cnt
from tracewright.operators import lifecycles as L

S = sql_ratio


def pair_sql(p: str, src: str, keys: str) -> str:
    return f"""{p}1 AS (SELECT *, sum(delta) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {src}),
{p}2 AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY {keys} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fl FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN delta = 1 THEN s - fl WHEN s + 1 - fl > 0 THEN s + 1 - fl END AS level FROM {p}2),
{p} AS (SELECT *, CASE WHEN level IS NOT NULL AND delta = 1 THEN lead(t) OVER w END AS close_t,
  CASE WHEN level IS NOT NULL AND delta = 1 THEN lead(sender) OVER w END AS close_sender FROM {p}3 WINDOW w AS (PARTITION BY {keys}, level ORDER BY t))"""


MATCH_SQL = f"""he AS (SELECT run_id, t, n, sender, receiver, intent, CASE WHEN is_assign THEN 1 ELSE -1 END AS delta FROM messages WHERE is_assign OR is_delivery),
hk AS (SELECT * FROM he WHERE intent <> ''),
{pair_sql('pk', 'hk', 'run_id, intent')},
agent_pops AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY t) AS k FROM (
  SELECT run_id, sender AS agent, t FROM pk WHERE delta = -1 AND level IS NULL UNION ALL SELECT run_id, sender, t FROM he WHERE delta = -1 AND intent = '')),
assigned AS (SELECT run_id, t, n, sender, receiver, intent, close_t, close_sender FROM pk WHERE delta = 1
  UNION ALL SELECT run_id, t, n, sender, receiver, intent, NULL, NULL FROM he WHERE delta = 1 AND intent = ''),
choices AS (SELECT p.run_id, p.agent, p.k, list(a.t ORDER BY a.t DESC) FILTER (WHERE a.t IS NOT NULL) AS ts FROM agent_pops p LEFT JOIN assigned a
  ON a.run_id = p.run_id AND a.receiver = p.agent AND a.t < p.t AND (a.close_t IS NULL OR a.close_t > p.t) GROUP BY ALL),
replay AS (SELECT DISTINCT run_id, agent, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM agent_pops
  UNION ALL SELECT r.run_id, r.agent, c.k, list_append(r.taken, [x FOR x IN c.ts IF NOT list_contains(r.taken, x)][1]) FROM replay r JOIN choices c ON c.run_id = r.run_id AND c.agent = r.agent AND c.k = r.k + 1),
takes AS (SELECT r.run_id, r.taken[r.k] AS t, p.t AS pop_t FROM replay r JOIN agent_pops p USING (run_id, agent, k) WHERE r.taken[r.k] IS NOT NULL),
matched AS (SELECT a.run_id, a.t, n, sender, receiver, intent, coalesce(close_t, pop_t) AS refs_t, CASE WHEN close_t IS NOT NULL THEN close_sender WHEN pop_t IS NOT NULL THEN receiver END AS refs_sender,
  least(close_t, pop_t) AS stop_t FROM assigned a LEFT JOIN takes k ON k.run_id = a.run_id AND k.t = a.t)"""
LC_SQL = f"""{MATCH_SQL},
talk AS (SELECT run_id, t, sender, intent FROM messages WHERE type <> 'handoff'),
acks AS (SELECT m.run_id, m.t, min(x.t) FILTER (WHERE x.sender = m.receiver AND (m.intent = '' OR x.intent = '' OR x.intent = m.intent)) AS ack_t,
  count(*) FILTER (WHERE x.sender = m.receiver) AS n_owner_msgs,
  count(*) FILTER (WHERE x.sender <> m.receiver AND m.intent <> '' AND x.intent <> '' AND x.intent <> m.intent) AS n_other_msgs
  FROM matched m LEFT JOIN talk x ON x.run_id = m.run_id AND x.t > m.t AND x.t < coalesce(m.stop_t, m.n) GROUP BY 1, 2),
arts AS (SELECT m.run_id, m.t, min(a.t) FILTER (WHERE a.maker = m.receiver) AS to_t, min(a.t) FILTER (WHERE a.maker = m.sender) AS from_t
  FROM matched m JOIN artifacts a ON a.run_id = m.run_id AND a.subtask = m.intent AND m.intent <> '' AND a.t > m.t GROUP BY 1, 2),
lc0 AS (SELECT m.*, ack_t, ack_t IS NOT NULL AS acked, n_owner_msgs, n_other_msgs, refs_t IS NOT NULL OR to_t IS NOT NULL OR from_t IS NOT NULL AS delivered,
  coalesce(refs_t, to_t, from_t) AS deliver_t, CASE WHEN refs_t IS NOT NULL THEN 'refs' WHEN to_t IS NOT NULL OR from_t IS NOT NULL THEN 'artifact' END AS deliver_kind,
  CASE WHEN refs_t IS NOT NULL THEN refs_sender WHEN to_t IS NOT NULL THEN receiver WHEN from_t IS NOT NULL THEN sender END AS deliver_sender,
  to_t IS NOT NULL OR from_t IS NOT NULL AS has_artifact, least(to_t, from_t) AS art_t
  FROM matched m LEFT JOIN acks USING (run_id, t) LEFT JOIN arts USING (run_id, t)),
lc1 AS (SELECT *, delivered AND (intent <> '' OR deliver_sender = receiver) AS owner_delivered FROM lc0),
lcg AS (SELECT run_id, intent, count(DISTINCT receiver) AS owners, min(t) AS first_t, count(*) FILTER (WHERE delivered) AS nd,
  count(DISTINCT deliver_sender) FILTER (WHERE delivered) AS ds FROM lc1 WHERE intent <> '' GROUP BY 1, 2),
lcp AS (SELECT run_id, t, lag(receiver) OVER w AS prev_owner, lag(t) OVER w AS prev_t, lag(delivered) OVER w AS prev_delivered
  FROM lc1 WHERE intent <> '' WINDOW w AS (PARTITION BY run_id, intent ORDER BY t)),
lc AS (SELECT l.*, coalesce(owners > 1, false) AS reassigned, coalesce(owners > 1, false) AND delivered AS recovered,
  coalesce(owners > 1 AND l.t = first_t, false) AND owner_delivered AS result_after_reassign,
  coalesce(delivered AND nd > 1 AND ds > 1, false) AS dup_delivery, prev_owner, prev_t, prev_delivered, greatest(n - 1, 1) AS fin,
  deliver_t - l.t AS lat
  FROM lc1 l LEFT JOIN lcg ON l.run_id = lcg.run_id AND l.intent = lcg.intent LEFT JOIN lcp ON l.run_id = lcp.run_id AND l.t = lcp.t)"""

register("m1_match_newest", "run_id,t:l sender,receiver,intent:s deliver_t:l", L.match_newest,
         f"WITH {MATCH_SQL}, answer AS (SELECT *, close_t AS deliver_t FROM pk WHERE delta = 1)")
register("m2_lifecycles", "run_id,t:l sender,receiver,intent:s acked:b ack_t:l delivered:b deliver_t:l deliver_kind,deliver_sender:s "
         "owner_delivered,reassigned:b n_owner_msgs,n_other_msgs:l recovered,has_artifact:b art_t:l prev_owner:s "
         "result_after_reassign,dup_delivery:b", L.lifecycles, f"WITH {LC_SQL}, answer AS (SELECT * FROM lc)")
register("m4_acknowledgements", "run_id,t,ack_t:l", L.acknowledgements, f"WITH {LC_SQL}, answer AS (SELECT * FROM lc)")
register("m4_owner_activity", "run_id,t,n_owner_msgs,n_other_msgs:l", L.activity_counts, f"WITH {LC_SQL}, answer AS (SELECT * FROM lc)")
register("m5_reassignments", "run_id,t:l intent,receiver,prev_owner:s latency:l recovered,dup_delivery:b",
         lambda tr: L.lifecycles(tr).filter("prev_t is not null").select(
             "*", (F.col("t") - F.col("prev_t")).alias("latency")),
         f"WITH {LC_SQL}, answer AS (SELECT *, t - prev_t AS latency FROM lc WHERE prev_t IS NOT NULL)")
register("j6_next_artifacts", "run_id,t,art_to_t,art_from_t:l", lambda tr: L.next_artifacts(tr).filter(
    "art_to_t is not null or art_from_t is not null"),
    f"WITH {LC_SQL}, answer AS (SELECT run_id, t, to_t AS art_to_t, from_t AS art_from_t FROM arts WHERE to_t IS NOT NULL OR from_t IS NOT NULL)")

A18_SQL = f"""{LC_SQL},
lx AS (SELECT *, sum(CASE WHEN delivered THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM lc),
chain AS (SELECT run_id, max(c) AS ch FROM (SELECT run_id, g, count(*) FILTER (WHERE NOT delivered) AS c FROM lx GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT run_id, count(*) AS ag FROM agents GROUP BY 1),
l1 AS (SELECT run_id, max(n) AS n, max(fin) AS fin, count(*) AS k, {cnt('delivered')} AS d, {cnt('NOT delivered')} AS u, {cnt('NOT acked')} AS ua,
  {cnt('acked AND NOT delivered')} AS an, {cnt('NOT delivered AND t >= 0.8 * fin')} AS u20, {cnt('NOT delivered AND t < 0.5 * fin')} AS uh,
  min(t) FILTER (WHERE NOT delivered) AS uf, avg(t) FILTER (WHERE NOT delivered) AS um, avg(ack_t - t) AS am, max(ack_t - t) AS ax, avg(lat) AS dm, max(lat) AS dx,
  quantile_cont(lat, 0.9) AS p90, {cnt('lat > 0.25 * fin')} AS late, {cnt('reassigned')} AS re, {cnt('result_after_reassign')} AS rar, {cnt('recovered')} AS rec,
  {cnt('dup_delivery')} AS dup, {cnt('NOT delivered AND n_owner_msgs > 0')} AS sil, {cnt('NOT delivered AND n_other_msgs > 0')} AS silo, max(deliver_t) AS ld,
  {cnt("intent = ''")} AS orphan, count(DISTINCT intent) FILTER (WHERE intent <> '') AS ni, count(DISTINCT intent) FILTER (WHERE reassigned) AS mi,
  count(DISTINCT intent) FILTER (WHERE dup_delivery) AS di FROM lc GROUP BY 1),
a18 AS (SELECT r.run_id, {', '.join(f"coalesce({e}, 0) AS {c}" for c, e in zip(L.LIFECYCLE_COLS, [
    'k', 'd', 'u', 'ua', 'an', S('u', 'k'), S('u', 'l1.n'), S('u', 'ag'), S('u', 'ni'), 'u20', S('u20', 'k'), 'uh', S('uf', 'fin'), S('um', 'fin'),
    S('k - ua', 'k'), 'am', 'ax', S('am', 'l1.n'), 'dm', 'dx', 'p90', S('dm', 'l1.n'), 'late', S('late', 'k'), 're', S('re', 'k'), 'mi', S('re', 'k'), 'rar', 'rec',
    S('rec', 're'), 'di', S('dup', 'k'), 'sil', S('sil', 'k'), 'silo', 'ch', 'CASE WHEN ld IS NULL THEN 0 ELSE greatest(l1.n - 1 - ld, 0) / fin END',
    S('d', 'k'), S('orphan', 'k')]))} FROM runs r LEFT JOIN l1 USING (run_id) LEFT JOIN chain USING (run_id) LEFT JOIN ag USING (run_id))"""
register("a18_lifecycle_block", "run_id:l " + ",".join(L.LIFECYCLE_COLS) + ":d", L.lifecycle_block,
         f"WITH {A18_SQL}, answer AS (SELECT * FROM a18)")
register("w17_unresolved_chain", "run_id,longest:l", lambda tr: L.lifecycle_block(tr).select(
    "run_id", F.col("lc_longest_unresolved_chain").alias("longest")),
    f"WITH {A18_SQL}, answer AS (SELECT run_id, lc_longest_unresolved_chain AS longest FROM a18)")

SNR_SQL = """st AS (SELECT run_id, t, n, coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY t), n) AS nx FROM messages WHERE type = 'status'),
snr0 AS (SELECT *, NOT EXISTS (SELECT 1 FROM messages d WHERE d.run_id = st.run_id AND d.is_delivery AND d.t >= st.t AND d.t < st.nx) AS no_result FROM st),
snr1 AS (SELECT *, sum(CASE WHEN no_result THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM snr0),
snr AS (SELECT *, sum(CASE WHEN no_result THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM snr1)"""
register("w16_status_without_result", "run_id,t:l no_result:b chain:l", L.status_without_result, f"WITH {SNR_SQL}, answer AS (SELECT * FROM snr)")
A19_SQL = f"""{LC_SQL}, {SNR_SQL}, {SCC_SQL.replace('FROM messages GROUP', 'FROM lc GROUP').replace(
    'SELECT run_id, src AS node FROM ed UNION SELECT run_id, dst FROM ed', 'SELECT run_id, sender AS node FROM messages UNION SELECT run_id, receiver FROM messages')},
open AS (SELECT * FROM lc WHERE NOT delivered),
mut AS (SELECT x.run_id, least(x.sender, x.receiver) AS a, greatest(x.sender, x.receiver) AS b, max(x.t) AS lt FROM lc x WHERE x.sender <> x.receiver
  AND EXISTS (SELECT 1 FROM lc y WHERE y.run_id = x.run_id AND y.sender = x.receiver AND y.receiver = x.sender) GROUP BY 1, 2, 3),
mutu AS (SELECT DISTINCT x.run_id, least(x.sender, x.receiver) AS a, greatest(x.sender, x.receiver) AS b FROM open x WHERE x.sender <> x.receiver
  AND EXISTS (SELECT 1 FROM open y WHERE y.run_id = x.run_id AND y.sender = x.receiver AND y.receiver = x.sender)),
bigc AS (SELECT run_id, node, comp FROM members m WHERE (SELECT count(*) FROM members k WHERE k.run_id = m.run_id AND k.comp = m.comp) > 1),
d1 AS (SELECT run_id, count(*) AS mp, min(lt) AS fm FROM mut GROUP BY 1), d2 AS (SELECT run_id, count(*) AS mu FROM mutu GROUP BY 1),
d3 AS (SELECT o.run_id, count(*) AS ins FROM open o JOIN bigc x ON x.run_id = o.run_id AND x.node = o.sender JOIN bigc y ON y.run_id = o.run_id AND y.node = o.receiver
  WHERE x.comp = y.comp GROUP BY 1),
d4 AS (SELECT o.run_id, count(*) AS blind FROM open o JOIN mutu m ON m.run_id = o.run_id AND m.a = least(o.sender, o.receiver) AND m.b = greatest(o.sender, o.receiver)
  WHERE o.intent = '' GROUP BY 1),
d5 AS (SELECT run_id, {cnt('no_result')} AS sn, count(*) AS s, max(chain) AS ch FROM snr GROUP BY 1),
d6 AS (SELECT run_id, {cnt('NOT delivered')} AS u FROM lc GROUP BY 1), d7 AS (SELECT run_id, count(*) AS ag FROM nodes GROUP BY 1),
a19 AS (SELECT r.run_id, {', '.join(f"coalesce({e}, 0) AS {c}" for c, e in zip(L.DEADLOCK_COLS, [
    'mp', S('mp', 'greatest(ag, 1)'), 'mu', S('fm', 'greatest(r.n - 1, 1)'), 'greatest(0, (r.n - 1 - fm) / greatest(r.n - 1, 1)) * CASE WHEN fm IS NULL THEN 0 ELSE 1 END',
    'sn', S('sn', 's'), S('sn', 'r.n'), 'ins', S('ins', 'u'), 'ch', 'blind']))} FROM runs r LEFT JOIN d1 USING (run_id) LEFT JOIN d2 USING (run_id) LEFT JOIN d3 USING (run_id)
  LEFT JOIN d4 USING (run_id) LEFT JOIN d5 USING (run_id) LEFT JOIN d6 USING (run_id) LEFT JOIN d7 USING (run_id))"""
register("a19_deadlock_block", "run_id:l " + ",".join(L.DEADLOCK_COLS) + ":d", L.deadlock_block, f"WITH {A19_SQL}, answer AS (SELECT * FROM a19)")

A20_SQL = f"""{LC_SQL},
said AS (SELECT run_id, sender, max(t) AS last_said FROM messages GROUP BY 1, 2), la AS (SELECT run_id, max(t) AS last_art FROM artifacts GROUP BY 1),
oth AS (SELECT l.run_id, l.t, count(a.t) AS other_arts FROM lc l LEFT JOIN artifacts a ON a.run_id = l.run_id AND a.maker = l.receiver AND a.t > l.t AND a.subtask <> l.intent
  WHERE NOT delivered GROUP BY 1, 2),
x AS (SELECT lc.*, coalesce(last_said, -1) AS last_said, last_art, other_arts, lc.t - prev_t AS rl,
  (SELECT count(*) FROM lc y WHERE y.run_id = lc.run_id AND y.t <= lc.t AND (NOT y.delivered OR y.deliver_t > lc.t)) AS open_now
  FROM lc LEFT JOIN said ON said.run_id = lc.run_id AND said.sender = lc.receiver LEFT JOIN la ON la.run_id = lc.run_id
  LEFT JOIN oth ON oth.run_id = lc.run_id AND oth.t = lc.t),
res AS (SELECT run_id, sender AS agent, intent, t FROM messages WHERE is_delivery AND intent <> '' UNION ALL SELECT run_id, maker, subtask, t FROM artifacts WHERE subtask <> ''),
rk AS (SELECT run_id, intent, receiver, t, row_number() OVER (PARTITION BY run_id, intent ORDER BY t) AS k FROM lc WHERE intent <> ''),
lr AS (SELECT f.run_id, f.intent, f.receiver AS owner, f.t AS first_t, s.t AS second_t, max(res.t) AS last_result_t FROM rk f
  JOIN rk s ON s.run_id = f.run_id AND s.intent = f.intent AND f.k = 1 AND s.k = 2
  JOIN res ON res.run_id = f.run_id AND res.agent = f.receiver AND res.intent = f.intent GROUP BY ALL HAVING max(res.t) > s.t),
x1 AS (SELECT run_id, max(n) AS n, max(fin) AS fin, count(*) AS k, {cnt('NOT delivered')} AS u, {cnt('delivered')} AS d, max(fin - t) FILTER (WHERE NOT delivered) AS amax,
  avg(fin - t) FILTER (WHERE NOT delivered) AS amean, quantile_cont(fin - t, 0.9) FILTER (WHERE NOT delivered) AS ap90,
  {', '.join(f"{cnt(f'NOT delivered AND fin - t > {q} * fin')} AS age{i}" for i, q in ((10, 0.1), (25, 0.25), (50, 0.5)))},
  {', '.join(f"{cnt(f't <= {q} * fin AND (NOT delivered OR deliver_t > {q} * fin)')} AS b{i}" for i, q in ((25, 0.25), (50, 0.5), (75, 0.75), (100, 1.0)))},
  max(open_now) AS peak, avg(n_owner_msgs) FILTER (WHERE NOT delivered) AS om, max(n_owner_msgs) FILTER (WHERE NOT delivered) AS ox,
  {cnt('NOT delivered AND t <= 0.8 * fin')} AS early, {cnt('NOT delivered AND t <= 0.8 * fin AND last_said > 0.8 * fin')} AS earlya,
  avg(n_owner_msgs / (fin - t)) FILTER (WHERE NOT delivered AND fin - t >= 1) AS pt, max(other_arts) AS oth, {cnt('NOT delivered AND n_owner_msgs > 0')} AS act,
  arg_min(last_said, t) FILTER (WHERE NOT delivered) AS os, avg(rl) AS rl, count(rl) AS nre, max(CASE WHEN rl IS NOT NULL AND t > 0.5 * fin THEN 1 ELSE 0 END) AS re50,
  {cnt('rl > 0.25 * fin AND NOT prev_delivered')} AS lre, max(last_art) AS la, {cnt('NOT delivered AND t > last_art')} AS aa FROM x GROUP BY 1),
x2 AS (SELECT DISTINCT run_id, 1 AS oo FROM lr),
a20 AS (SELECT r.run_id, {', '.join(f"coalesce({e}, 0) AS {c}" for c, e in zip(L.TEMPORAL_COLS, [
    S('amax', 'fin'), S('amean', 'fin'), S('ap90', 'fin'), S('age10', 'u'), S('age25', 'u'), S('age50', 'u'), S('peak', 'k'), S('b25', 'k'), S('b50', 'k'), S('b75', 'k'),
    S('b100', 'k'), f"({S('b100', 'k')} - {S('b25', 'k')}) / 0.75", 'CASE WHEN b75 > 0 AND b100 >= b75 THEN 1 ELSE 0 END', S('b100 - b75', 'b75'), S('d', 'k'), S('om', 'x1.n'), S('ox', 'x1.n'),
    S('earlya', 'early'), 'pt', S('oth', 'x1.n'), 'CASE WHEN oth > 0 THEN 1 ELSE 0 END', S('act', 'u'), 'CASE WHEN u > 0 AND os <= 0.5 * fin THEN 1 ELSE 0 END', S('rl', 'fin'), 're50',
    S('lre', 'nre'), 'oo', f"CASE WHEN la IS NULL THEN 0 ELSE {S('aa', 'u')} END", 'CASE WHEN os >= 0 THEN greatest(0, fin - os) / fin ELSE 0 END']))}
  FROM runs r LEFT JOIN x1 USING (run_id) LEFT JOIN x2 USING (run_id))"""
register("a20_temporal_block", "run_id:l " + ",".join(L.TEMPORAL_COLS) + ":d", L.temporal_block, f"WITH {A20_SQL}, answer AS (SELECT * FROM a20)")
register("j16_other_artifacts", "run_id,t,other_arts:l", L.other_artifacts_after, f"WITH {A20_SQL}, answer AS (SELECT * FROM oth)")
register("j17_late_results", "run_id:l intent,owner:s first_t,second_t,last_result_t:l", L.late_results, f"WITH {A20_SQL}, answer AS (SELECT * FROM lr)")
register("w12_backlog", "run_id,t,delta,open:l", L.backlog, f"""WITH {LC_SQL},
  e AS (SELECT run_id, t, delta, sum(delta) AS step FROM (SELECT run_id, t, 1 AS delta FROM lc UNION ALL SELECT run_id, deliver_t, -1 FROM lc WHERE delivered) GROUP BY 1, 2, 3),
  answer AS (SELECT run_id, t, delta, sum(step) OVER (PARTITION BY run_id ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS open FROM e)""")


def _area(tr):
    """Area under the open counter and its peak per run."""
    from tracewright.plans.scan import running
    b = L.backlog(tr).groupBy("run_id", "t").agg(F.max_by("open", "delta").alias("open"), F.max("open").alias("top"))
    b = running(b, ["run_id"], ["t"], {"nxt": ("min", "t", False)}, reverse=True)
    return b.groupBy("run_id").agg(F.max("top").alias("peak"), F.sum(F.col("open") * F.coalesce(
        F.col("nxt") - F.col("t"), F.lit(0))).alias("area"))


register("w12_open_area", "run_id,peak,area:l", _area, f"""WITH {LC_SQL},
  e AS (SELECT run_id, t, 1 AS delta FROM lc UNION ALL SELECT run_id, deliver_t, -1 FROM lc WHERE delivered),
  o AS (SELECT run_id, t, sum(delta) OVER (PARTITION BY run_id ORDER BY t, delta) AS open, sum(delta) OVER (PARTITION BY run_id ORDER BY t) AS after FROM e),
  q AS (SELECT run_id, t, max(open) AS top, any_value(after) AS after FROM o GROUP BY 1, 2),
  z AS (SELECT *, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS nxt FROM q),
  answer AS (SELECT run_id, greatest(max(top), max(after)) AS peak, coalesce(sum(after * (nxt - t)), 0) AS area FROM z GROUP BY 1)""")
register("a26_percentiles", "run_id:l p50,p90:d", lambda tr: __import__("tracewright.plans.scan", fromlist=["x"]).percentiles(
    L.lifecycles(tr).withColumn("lat", F.col("deliver_t") - F.col("t")), ["run_id"], "lat", {"p50": 0.5, "p90": 0.9}),
    f"WITH {LC_SQL}, answer AS (SELECT run_id, quantile_cont(lat, 0.5) AS p50, quantile_cont(lat, 0.9) AS p90 FROM lc WHERE lat IS NOT NULL GROUP BY 1)")
register("a26_nearest_rank", "run_id:l p90:d", lambda tr: __import__("tracewright.plans.scan", fromlist=["x"]).percentiles(
    L.lifecycles(tr).withColumn("lat", F.col("deliver_t") - F.col("t")), ["run_id"], "lat", {"p90": 0.9}, how="disc"),
    f"""WITH {LC_SQL}, z AS (SELECT run_id, lat, row_number() OVER (PARTITION BY run_id ORDER BY lat) AS k, count(*) OVER (PARTITION BY run_id) AS m FROM lc WHERE lat IS NOT NULL),
  answer AS (SELECT run_id, lat AS p90 FROM z WHERE k = CAST(ceil(0.9 * m) AS BIGINT))""")

REC_SQL = f"""{LC_SQL},
anya AS (SELECT l.run_id, l.t, min(a.t) AS any_t, arg_min(a.maker, a.t) AS artifact_by FROM lc l JOIN artifacts a ON a.run_id = l.run_id AND a.subtask = l.intent AND l.intent <> ''
  AND a.t > l.t GROUP BY 1, 2),
sa AS (SELECT l.run_id, l.t, count(m.t) AS c1, max(m.t) AS l1 FROM lc l LEFT JOIN messages m ON m.run_id = l.run_id AND m.sender = l.receiver AND m.t > l.t GROUP BY 1, 2),
wr AS (SELECT l.run_id, l.t, count(s.t) AS c2 FROM lc l LEFT JOIN state s ON s.run_id = l.run_id AND s.agent = l.receiver AND s.t > l.t GROUP BY 1, 2),
rec0 AS (SELECT lc.*, any_t, artifact_by, c1, l1, c2, has_artifact OR (intent <> '' AND EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = lc.run_id AND a.subtask = lc.intent)) AS artifact_present
  FROM lc LEFT JOIN anya USING (run_id, t) LEFT JOIN sa USING (run_id, t) LEFT JOIN wr USING (run_id, t)),
rec1 AS (SELECT *, greatest(t, ack_t, deliver_t, coalesce(art_t, any_t), l1) AS last_event_turn FROM rec0),
rec AS (SELECT run_id, t AS handoff_turn, n, sender, receiver, intent, acked, ack_t AS ack_turn, ack_t - t AS ack_delay, delivered, deliver_t AS deliver_turn, lat AS deliver_delay,
  deliver_sender, deliver_kind, prev_owner, artifact_present, artifact_by, coalesce(art_t, any_t) AS artifact_turn, coalesce(artifact_by = receiver, false) AS artifact_is_receiver,
  reassigned, delivered AND reassigned AND result_after_reassign AS delivery_after_reassign, recovered,
  owner_delivered OR coalesce(delivered AND deliver_sender = receiver, false) AS owner_delivered, c1 + c2 > 0 AS receiver_active_after, c1 AS n_owner_msgs_after,
  last_event_turn, NOT delivered AND NOT artifact_present AND last_event_turn <= n - 1 AS unresolved_at_end, last_event_turn - t AS lifetime FROM rec1)"""
register("a24_assignment_records", "run_id,handoff_turn:l sender,receiver,intent:s acked:b ack_turn,ack_delay:l delivered:b deliver_turn,deliver_delay:l "
         "deliver_sender,deliver_kind,prev_owner:s artifact_present:b artifact_by:s artifact_turn:l artifact_is_receiver,reassigned,delivery_after_reassign,"
         "recovered,owner_delivered,receiver_active_after:b n_owner_msgs_after,last_event_turn:l unresolved_at_end:b lifetime:l",
         L.assignment_records, f"WITH {REC_SQL}, answer AS (SELECT * FROM rec)")
PROFILE_SQL = f"""{REC_SQL},
pe AS (SELECT run_id, handoff_turn AS t, 1 AS d FROM rec UNION ALL SELECT run_id, last_event_turn, -1 FROM rec WHERE delivered OR artifact_present),
ppk AS (SELECT run_id, greatest(max(o), 0) AS peak FROM (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM pe) GROUP BY 1),
pf AS (SELECT run_id, count(*) AS k, {cnt('unresolved_at_end')} AS u, {cnt('unresolved_at_end AND acked')} AS ua, {cnt('unresolved_at_end AND receiver_active_after')} AS uc,
  {cnt('unresolved_at_end AND reassigned')} AS ur, {cnt('recovered')} AS rc, {cnt('artifact_present AND artifact_is_receiver')} AS idm, {cnt('owner_delivered')} AS rd,
  max(lifetime) FILTER (WHERE unresolved_at_end) AS lo, min(handoff_turn) FILTER (WHERE unresolved_at_end) AS fi, {cnt("deliver_kind = 'refs'")} AS cr,
  {cnt("deliver_kind = 'artifact'")} AS ca, {cnt("prev_owner <> ''")} AS li, {cnt("prev_owner <> '' AND delivered")} AS lid FROM rec GROUP BY 1),
prof AS (SELECT r.run_id, {', '.join(f"coalesce({e}, 0) AS {c}" for c, e in zip(L.PROFILE_COLS, [
    'k', 'u', S('u', 'k'), 'ua', S('ua', 'u'), 'uc', 'ur', 'rc', S('rc', 'k'), 'idm', S('idm', 'k'), 'rd', S('rd', 'k'), 'lo', S('lo', 'greatest(r.n - 1, 1)'), 'coalesce(fi, -1)',
    'CASE WHEN fi IS NULL THEN -1 ELSE fi / greatest(r.n - 1, 1) END', 'CASE WHEN u = 1 THEN 1 ELSE 0 END', 'peak', 'CASE WHEN u > 0 THEN 1 ELSE 0 END', 'CASE WHEN ua > 0 THEN 1 ELSE 0 END',
    'CASE WHEN uc > 0 THEN 1 ELSE 0 END', 'cr', 'ca', S('cr', 'k'), 'li', 'lid', 'r.n']))} FROM runs r LEFT JOIN pf USING (run_id) LEFT JOIN ppk USING (run_id))"""
register("a24_assignment_profile", "run_id:l " + ",".join(L.PROFILE_COLS) + ":d", L.assignment_profile, f"WITH {PROFILE_SQL}, answer AS (SELECT * FROM prof)")
