"""Localisation, evaluation and set-operation queries."""

from pyspark.sql import functions as F

from tracewright.catalog.base import LABELS, register, sql_list, sql_ratio
from tracewright.catalog.lifecycles import A18_SQL, PROFILE_SQL, REC_SQL
from tracewright.catalog.runblocks import BASE_SQL, REPLY_SQL, cnt
from tracewright.catalog.scans import SLICE_SQL, SLICES
from tracewright.catalog.turns import DECAY_SQL
from tracewright.catalog.waits import A21_SQL, EP_SQL
from tracewright.fixed import FAULTS, WEIGHTS
from tracewright.operators import evaluate as E
from tracewright.operators import resample as RS
from tracewright.operators import lifecycles as L
from tracewright.operators import localize as K
from tracewright.operators import runfeatures as R
from tracewright.operators import waits as W

S = sql_ratio


def b(cond):
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


LABS_SQL = f"labs AS (SELECT unnest({sql_list(LABELS)}) AS label)"
PAIR_SQL = f"""{LABS_SQL},
pr AS (SELECT t.run_id, t.n, t.label AS y, t.success AS s, t.fault_turn AS ft, p.label AS yp, p.success AS sp, p.fault_turn AS tp FROM truth t JOIN pred p USING (run_id))"""
AB_SQL = f"""{LABS_SQL},
ab AS (SELECT t.run_id, t.n, t.label AS y, t.success, t.fault_turn AS ft, {sql_list(LABELS)}[1 + ca] AS a, {sql_list(LABELS)}[1 + cb] AS b FROM truth t JOIN
  (SELECT run_id, arg_max(c, wa * 10 - c) AS ca, arg_max(c, wb * 10 - c) AS cb FROM lw GROUP BY 1) USING (run_id))"""


def scores(name, src, keys="", y="y", yp="yp", weight=None):
    k = f"{keys}, " if keys else ""
    c = (lambda cond: f"coalesce(sum({weight}) FILTER (WHERE {cond}), 0)") if weight else (lambda cond: f"count(*) FILTER (WHERE {cond})")
    return f"""{name}0 AS (SELECT {k}l.label, {c(f'{y} = l.label AND {yp} = l.label')} AS tp, {c(f'{y} <> l.label AND {yp} = l.label')} AS fp,
  {c(f'{y} = l.label AND {yp} <> l.label')} AS fn FROM {src}, labs l GROUP BY {k}l.label),
{name} AS (SELECT *, {S('tp', 'tp + fp')} AS precision, {S('tp', 'tp + fn')} AS recall, {S('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS support FROM {name}0)"""


def macro(name, src, keys="", **kw):
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return scores(f"{name}s", src, keys, **kw) + f", {name} AS (SELECT {k}coalesce(avg(f1) FILTER (WHERE support > 0), avg(f1)) AS macro_f1 FROM {name}s{g})"


PEAK_SQL = """peaks AS (SELECT run_id, c, CASE WHEN c = 0 THEN -1 ELSE t END AS t, p FROM (SELECT *, row_number() OVER (PARTITION BY run_id, c ORDER BY p DESC, t) AS k FROM probs) WHERE k = 1)"""


def lidx(x):
    return f"list_position({sql_list(LABELS)}, {x}) - 1"


def at_peak(name, src):
    return f"""{name} AS (SELECT l.run_id, l.label, CASE WHEN l.label = 'clean' THEN -1 ELSE coalesce(k.t, -1) END AS fault_turn, k.p FROM {src} l LEFT JOIN peaks k ON k.run_id = l.run_id AND k.c = {lidx('l.label')})"""


# ---- localisation ----
register("flagship_undelivered", "run_id:l label:s fault_turn,first_undelivered,n_undelivered:l near_fault:b", K.undelivered_near_fault,
         f"WITH {REPLY_SQL}, u AS (SELECT run_id, min(t) AS first_undelivered, count(*) AS n_undelivered FROM undel GROUP BY 1), "
         "answer AS (SELECT *, label <> 'clean' AND abs(first_undelivered - fault_turn) <= 2 AS near_fault FROM u JOIN truth USING (run_id))")
register("k1_grouped_turns", "run_id,t:l best:s", lambda tr: E.turn_truth(tr).select("run_id", "t", F.col("yp").alias("best")),
         f"WITH q AS (SELECT *, row_number() OVER (PARTITION BY run_id, t ORDER BY p DESC, c) AS k FROM probs), answer AS (SELECT run_id, t, {sql_list(LABELS)}[1 + c] AS best FROM q WHERE k = 1)")
register("k2_peak_turns", "run_id,c,t:l p:d", K.peaks, f"WITH {PEAK_SQL}, answer AS (SELECT * FROM peaks)")
register("k3_top_windows", "run_id,c:l top3,gap12:d", K.top_windows, """WITH q AS (SELECT *, row_number() OVER (PARTITION BY run_id, c ORDER BY p DESC, t) AS k FROM probs),
  answer AS (SELECT run_id, c, avg(p) FILTER (WHERE k <= 3) AS top3, coalesce(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 2), 0) AS gap12 FROM q GROUP BY 1, 2)""")
K4_SQL = """k4 AS (SELECT run_id, intent, first_t FROM (SELECT run_id, intent, min(t) AS first_t, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(t)) AS k FROM messages GROUP BY 1, 2) WHERE k = 1)"""
K6_SQL = """k6 AS (SELECT run_id, key, c AS writes, CASE WHEN c >= 2 THEN o END AS first_override FROM (SELECT run_id, key, count(*) AS c, min(t) FILTER (WHERE op = 'override') AS o,
  row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(t)) AS k FROM state GROUP BY 1, 2) WHERE k = 1)"""
K7_SQL = """zt AS (SELECT run_id, t, lead(t, 2) OVER (PARTITION BY run_id ORDER BY t) AS t2 FROM messages WHERE goal_ov = 0),
k7 AS (SELECT run_id, min(t) FILTER (WHERE t2 - t <= 6) AS dense, min(t) AS "any" FROM zt GROUP BY 1)"""
register("k4_common_intent", "run_id:l intent:s first_t:l", K.most_common_intent, f"WITH {K4_SQL}, answer AS (SELECT * FROM k4)")
register("k6_hottest_key", "run_id:l key:s writes,first_override:l", K.hottest_key, f"WITH {K6_SQL}, answer AS (SELECT * FROM k6)")
register("k7_off_goal", "run_id,dense,any:l", lambda tr: K.off_goal_start(tr, 0.3).filter("any is not null"),
         "WITH " + K7_SQL.replace("goal_ov = 0", "goal_ov <= 0.3") + ", answer AS (SELECT * FROM k7)")
RULE_SQL = f"""{REPLY_SQL}, {DECAY_SQL.replace(REPLY_SQL + ', ', '', 1)}, {K4_SQL}, {K6_SQL}, {K7_SQL},
ru1 AS (SELECT run_id, min(t) AS und FROM undel GROUP BY 1), ru2 AS (SELECT run_id, min(t) FILTER (WHERE reply_t IS NULL) AS una, min(t) AS a0 FROM reply GROUP BY 1),
ru3 AS (SELECT run_id, min(t) AS sec FROM (SELECT run_id, t, row_number() OVER (PARTITION BY run_id, intent ORDER BY t) AS k FROM asg) WHERE k = 2 GROUP BY 1),
ru4 AS (SELECT run_id, max(t) AS dup FROM (SELECT run_id, t, count(*) OVER (PARTITION BY run_id, hash) AS c FROM artifacts) WHERE c > 1 GROUP BY 1),
ru5 AS (SELECT run_id, min(t) AS agree FROM messages WHERE type = 'state_update' AND lower(text) LIKE '%gree%' GROUP BY 1),
ru6 AS (SELECT run_id, onset AS lp FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY level DESC, t) AS k FROM decay WHERE level > 0) WHERE k = 1),
ru7 AS (SELECT run_id, t - status_run + 1 AS stt FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY status_run DESC, t) AS k FROM st WHERE status_run > 0) WHERE k = 1),
rules AS (SELECT r.run_id, coalesce(und, una, a0, -1) AS dropped_handoff, coalesce(sec, dup, r.n // 2) AS duplicated_work, coalesce(stt, -1) AS deadlock, coalesce(first_override, agree, -1) AS conflict,
  coalesce(dense, "any", -1) AS goal_drift, coalesce(lp, k4.first_t, -1) AS runaway_loop FROM runs r LEFT JOIN ru1 USING (run_id) LEFT JOIN ru2 USING (run_id) LEFT JOIN ru3 USING (run_id)
  LEFT JOIN ru4 USING (run_id) LEFT JOIN ru5 USING (run_id) LEFT JOIN ru6 USING (run_id) LEFT JOIN ru7 USING (run_id) LEFT JOIN k6 USING (run_id) LEFT JOIN k7 USING (run_id) LEFT JOIN k4 USING (run_id))"""


def by_rule(name, src):
    arms = " ".join(f"WHEN '{c}' THEN {c}" for c in FAULTS)
    return f"{name} AS (SELECT l.run_id, l.label, CASE l.label {arms} ELSE -1 END AS fault_turn FROM {src} l JOIN rules USING (run_id))"


register("k5_rule_turns", "run_id," + ",".join(FAULTS) + ":l", K.rule_turns, f"WITH {RULE_SQL}, answer AS (SELECT * FROM rules)")
register("k5_rule_localiser", "run_id:l label:s fault_turn:l", lambda tr: K.rule_localiser(tr, tr.pred),
         f"WITH {RULE_SQL}, {by_rule('answer', 'pred')}")
#: A map chosen by hand; ``k8_source_map`` chooses one on the other folds.
BY_HAND = {"dropped_handoff": "peak", "duplicated_work": "rule", "deadlock": "peak", "conflict": "rule", "goal_drift": "peak", "runaway_loop": "rule"}
register("k8_hybrid_by_class", "run_id:l label:s fault_turn:l", lambda tr: K.hybrid_by_class(tr, tr.pred, BY_HAND),
         f"WITH {RULE_SQL}, {PEAK_SQL}, {by_rule('br', 'pred')}, {at_peak('bp', 'pred')}, answer AS (SELECT br.run_id, br.label, CASE WHEN br.label IN ("
         + ", ".join(f"'{c}'" for c, s in BY_HAND.items() if s == "rule") + ") THEN br.fault_turn ELSE bp.fault_turn END AS fault_turn FROM br JOIN bp USING (run_id))")
register("k9_confident_peak", "run_id:l label:s fault_turn:l", lambda tr: K.confident_peak(tr, tr.pred, 0.26),
         f"WITH {RULE_SQL}, {PEAK_SQL}, {by_rule('br', 'pred')}, {at_peak('bp', 'pred')}, answer AS (SELECT br.run_id, br.label, "
         "CASE WHEN br.label <> 'clean' AND bp.p >= 0.26 THEN bp.fault_turn ELSE br.fault_turn END AS fault_turn FROM br JOIN bp USING (run_id))")
register("j13_predicted_peak", "run_id:l label:s fault_turn:l p:d", lambda tr: K.predicted_peak(tr, tr.pred), f"WITH {PEAK_SQL}, {at_peak('answer', 'pred')}")


def a25_sql():
    per = []
    for i, c in enumerate(FAULTS):
        for s in K.PER_CLASS:
            per.append(f"max(CASE WHEN c = {i + 1} THEN {s} END) AS p_{c}_{s}")
    return f"""q25 AS (SELECT *, row_number() OVER (PARTITION BY run_id, c ORDER BY p DESC, t) AS k, count(*) OVER (PARTITION BY run_id, c) AS n FROM probs),
c25 AS (SELECT run_id, c, max(n) AS n, max(p) AS amax, avg(p) FILTER (WHERE k <= 3) AS atop3, max(t) FILTER (WHERE k = 1) / max(n) AS pos_max, coalesce(min(t) FILTER (WHERE p >= 0.5) / max(n), 1.0) AS pos_first_hi,
  count(*) FILTER (WHERE p >= 0.5) / max(n) AS n_hi, avg(p) AS area, coalesce(max(p) FILTER (WHERE k = 1) - max(p) FILTER (WHERE k = 2), 0) AS gap12 FROM q25 GROUP BY 1, 2),
m25 AS (SELECT run_id, sum(area) AS mass, list(amax ORDER BY amax DESC) FILTER (WHERE c > 0) AS best FROM c25 GROUP BY 1),
e25 AS (SELECT run_id, -sum((area / mass) * ln(area / mass + 1e-12)) AS ent FROM c25 JOIN m25 USING (run_id) GROUP BY 1),
g25 AS (SELECT run_id, {', '.join(per)}, count(*) FILTER (WHERE c > 0 AND amax >= 0.5) AS g_n_strong_classes, coalesce(min(pos_first_hi) FILTER (WHERE c > 0 AND amax >= 0.5), 1) AS g_earliest_strong_pos,
  max(amax) FILTER (WHERE c = 0) AS g_bg_max, max(area) FILTER (WHERE c = 0) AS g_bg_mean, max(pos_max) FILTER (WHERE c = 0) AS g_bg_peak_pos FROM c25 GROUP BY 1),
a25 AS (SELECT g25.*, best[1] AS g_strongest_prob, best[1] - best[2] AS g_strongest_gap, ent AS g_probs_entropy, best[1] - best[6] AS g_argmax_prob_spread FROM g25 JOIN m25 USING (run_id) JOIN e25 USING (run_id))"""


register("a25_probability_block", "run_id:l " + ",".join(K.AGGREGATE_COLS) + ":d", K.probability_block, f"WITH {a25_sql()}, answer AS (SELECT * FROM a25)")

# ---- joins of truth and predictions ----
register("j12_truth_prediction", "run_id:l y,yp:s s,sp,ft,tp:l", E.pairs, f"WITH {PAIR_SQL}, answer AS (SELECT * FROM pr)")
register("j12_coverage", "rows,missing_pred,unknown_pred:l", lambda tr: E.coverage(tr, tr.pred.filter("run_id % 11 <> 0").unionByName(
    tr.pred.filter("run_id % 10 = 0").withColumn("run_id", F.col("run_id") + 1_000_000))),
    "WITH p AS (SELECT run_id FROM pred WHERE run_id % 11 <> 0 UNION ALL SELECT run_id + 1000000 FROM pred WHERE run_id % 10 = 0), answer AS (SELECT count(*) AS rows, "
    "count(*) FILTER (WHERE p.run_id IS NULL) AS missing_pred, count(*) FILTER (WHERE t.run_id IS NULL) AS unknown_pred FROM truth t FULL JOIN p ON p.run_id = t.run_id)")

# ---- evaluation ----
register("e1_confusion", "y:s " + ",".join(LABELS) + ":l", lambda tr: E.confusion(E.pairs(tr)),
         f"WITH {PAIR_SQL}, answer AS (SELECT y, {', '.join(f'''count(*) FILTER (WHERE yp = '{c}') AS {c}''' for c in LABELS)} FROM pr GROUP BY y)")
register("e2_class_scores", "label:s tp,fp,fn,support:l precision,recall,f1:d", lambda tr: E.class_scores(E.pairs(tr)),
         f"WITH {PAIR_SQL}, {scores('sc', 'pr')}, answer AS (SELECT * FROM sc)")
register("e3_macro_f1", "macro_f1:d", lambda tr: E.macro_f1(E.pairs(tr)), f"WITH {PAIR_SQL}, {macro('answer', 'pr')}")
BIN_SQL = S("2 * count(*) FILTER (WHERE s = 1 AND sp = 1)", "2 * count(*) FILTER (WHERE s = 1 AND sp = 1) + count(*) FILTER (WHERE s <> sp)")
register("e4_binary_f1", "success_f1:d", lambda tr: E.binary_f1(E.pairs(tr)), f"WITH {PAIR_SQL}, answer AS (SELECT {BIN_SQL} AS success_f1 FROM pr)")
HIT = "avg(CASE WHEN y = yp AND tp >= 0 AND abs(tp - ft) <= {} THEN 1.0 ELSE 0.0 END) FILTER (WHERE y <> 'clean')"
register("e5_hit_at_k", "hit_0,hit_2,hit_5:d", lambda tr: E.hit_at(E.pairs(tr), [0, 2, 5]),
         f"WITH {PAIR_SQL}, answer AS (SELECT {', '.join(f'{HIT.format(k)} AS hit_{k}' for k in (0, 2, 5))} FROM pr)")
register("e6_group_f1", "topo_type:s macro_f1:d", lambda tr: E.macro_f1(E.pairs(tr).join(tr.topology, "run_id"), ["topo_type"]),
         f"WITH {PAIR_SQL}, pt AS (SELECT * FROM pr JOIN topology USING (run_id)), {macro('answer', 'pt', 'topo_type')}")
COMP_SQL = f"""{PAIR_SQL}, {SLICE_SQL}, prr AS (SELECT pr.* FROM pr JOIN slices USING (run_id) WHERE robust), {macro('mf', 'pr')}, {macro('mr', 'prr')},
mb AS (SELECT {BIN_SQL} AS success_f1, coalesce({HIT.format(2)}, 0) AS fault_turn_hit2 FROM pr),
comp AS (SELECT mf.macro_f1, mr.macro_f1 AS robustness_f1, success_f1, fault_turn_hit2, {WEIGHTS['macro_f1']} * mf.macro_f1 + {WEIGHTS['robustness_f1']} * mr.macro_f1
  + {WEIGHTS['success_f1']} * success_f1 + {WEIGHTS['fault_turn_hit2']} * fault_turn_hit2 AS composite FROM mf, mr, mb)"""
register("e7_composite", "macro_f1,robustness_f1,success_f1,fault_turn_hit2,composite:d", lambda tr: E.composite(tr, E.pairs(tr)),
         f"WITH {COMP_SQL}, answer AS (SELECT * FROM comp)")
register("e8_top_confusions", "y,yp:s n:l share:d", lambda tr: E.top_confusions(E.pairs(tr), 10),
         f"WITH {PAIR_SQL}, answer AS (SELECT y, yp, count(*) AS n, count(*) / (SELECT count(*) FROM pr q WHERE q.y = pr.y) AS share FROM pr WHERE y <> yp GROUP BY 1, 2 ORDER BY n DESC, y, yp LIMIT 10)")
register("e9_localisation_report", "y:s n:l hit_2,hit_5,hit_10,exact:d returned_none,too_early,too_late:l hit_2_short,hit_2_long,median_abs_err:d",
         lambda tr: E.localisation_report(tr, tr.truth.select("run_id", "n", F.col("label").alias("y"), F.col("fault_turn").alias("ft")).join(
             K.rule_localiser(tr, tr.truth).select("run_id", F.col("fault_turn").alias("tp")), "run_id")),
         f"""WITH {RULE_SQL}, {by_rule('lo', 'truth')}, z AS (SELECT t.label AS y, t.n, abs(lo.fault_turn - t.fault_turn) AS ae, lo.fault_turn AS tp, t.fault_turn AS ft,
  t.n <= (SELECT quantile_cont(n, 0.5) FROM runs) AS sh FROM truth t JOIN lo USING (run_id) WHERE t.label <> 'clean'),
  answer AS (SELECT y, count(*) AS n, avg({b('ae <= 2')}) AS hit_2, avg({b('ae <= 5')}) AS hit_5, avg({b('ae <= 10')}) AS hit_10, avg({b('ae = 0')}) AS exact, {cnt('tp < 0')} AS returned_none,
  {cnt('tp < ft')} AS too_early, {cnt('tp > ft')} AS too_late, coalesce(avg({b('ae <= 2')}) FILTER (WHERE sh), 0) AS hit_2_short, coalesce(avg({b('ae <= 2')}) FILTER (WHERE NOT sh), 0) AS hit_2_long,
  quantile_cont(ae, 0.5) AS median_abs_err FROM z GROUP BY y)""")
register("e10_hit_decomposition", "grp:s n:l a,b,c,oracle_class:d", E.hit_decomposition,
         f"""WITH {PAIR_SQL}, {PEAK_SQL}, {at_peak('pk', 'pred')}, {at_peak('ok', 'truth')}, z AS (SELECT pr.y, pr.yp, pr.ft, pk.fault_turn AS tp, ok.fault_turn AS tq FROM pr JOIN pk USING (run_id)
  JOIN ok USING (run_id) WHERE y <> 'clean'), zz AS (SELECT 'ALL' AS grp, * FROM z UNION ALL SELECT y, * FROM z),
  y2 AS (SELECT grp, count(*) AS n, avg({b('y = yp')}) AS a, avg({b('y = yp AND tp >= 0 AND abs(tp - ft) <= 2')}) AS b, avg({b('tq >= 0 AND abs(tq - ft) <= 2')}) AS oracle_class FROM zz GROUP BY 1),
  answer AS (SELECT *, {S('b', 'a')} AS c FROM y2)""")
NAMES = [s for s in SLICES if s not in ("compliance",)]
SL_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS slice, run_id FROM slices WHERE {s}" for s in NAMES)
register("e11_slice_scores", "slice:s n:l macro_f1:d", lambda tr: E.slice_scores(tr, E.pairs(tr), NAMES, 30),
         f"""WITH {PAIR_SQL}, {SLICE_SQL}, sr AS ({SL_ROWS}), px AS (SELECT * FROM pr JOIN sr USING (run_id)), {macro('ms', 'px', 'slice')},
  answer AS (SELECT slice, n, CASE WHEN n >= 30 THEN macro_f1 END AS macro_f1 FROM (SELECT slice, count(*) AS n FROM px GROUP BY 1) JOIN ms USING (slice))""")
register("e12_label_shares", "label:s true_share,pred_share,distance:d", E.label_shares,
         f"""WITH a AS (SELECT label, count(*) / (SELECT count(*) FROM truth) AS true_share FROM truth GROUP BY 1), c AS (SELECT label, count(*) / (SELECT count(*) FROM pred) AS pred_share FROM pred GROUP BY 1),
  d AS (SELECT coalesce(a.label, c.label) AS label, coalesce(true_share, 0) AS true_share, coalesce(pred_share, 0) AS pred_share FROM a FULL JOIN c ON a.label = c.label),
  answer AS (SELECT *, 0.5 * sum(abs(true_share - pred_share)) OVER () AS distance FROM d)""")
register("e13_change_table", "a,b:s n,fixed,broke,still_wrong:l", lambda tr: E.change_table(E.model_labels(tr)),
         f"WITH {AB_SQL}, answer AS (SELECT a, b, count(*) AS n, {cnt('b = y AND a <> y')} AS fixed, {cnt('a = y AND b <> y')} AS broke, {cnt('a <> y AND b <> y')} AS still_wrong FROM ab WHERE a <> b GROUP BY 1, 2)")


def _folded(tr):
    from tracewright.operators.resample import stratified_folds
    return E.model_labels(tr).join(stratified_folds(tr.truth, 3, 42).select("run_id", "fold"), "run_id")


FOLD_SQL = "folds AS (SELECT run_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42_' || run_id), run_id) - 1) % 3 AS fold FROM truth)"
FAB_SQL = f"{AB_SQL}, {FOLD_SQL}, fab AS (SELECT ab.*, fold FROM ab JOIN folds USING (run_id)), {macro('ma', 'fab', 'fold', yp='a')}, {macro('mb2', 'fab', 'fold', yp='b')}, fd AS (SELECT fold, ma.macro_f1 AS f1_a, mb2.macro_f1 AS f1_b, mb2.macro_f1 - ma.macro_f1 AS delta FROM ma JOIN mb2 USING (fold))"
def _sources(tr):
    return K.named_sources(tr, tr.pred), RS.stratified_folds(tr.truth, 3, 42), 3


MAP_SQL = f"""{RULE_SQL}, {PEAK_SQL}, {FOLD_SQL}, {by_rule('br', 'pred')}, {at_peak('bp', 'pred')},
  src AS (SELECT 'peak' AS source, 0 AS place, run_id, label, fault_turn FROM bp UNION ALL SELECT 'rule', 1, run_id, label, fault_turn FROM br),
  smap AS (SELECT g AS fold, s.label, source, count(*) FILTER (WHERE t.label = s.label AND abs(s.fault_turn - t.fault_turn) <= 2) AS hits, count(*) AS runs
    FROM src s JOIN truth t USING (run_id) JOIN folds f USING (run_id), (SELECT unnest(range(3)) AS g) WHERE f.fold <> g AND t.label <> 'clean' AND s.label <> 'clean' GROUP BY g, s.label, source, place
    QUALIFY row_number() OVER (PARTITION BY g, s.label ORDER BY hits DESC, place) = 1)"""
register("k8_source_map", "fold:l label,source:s hits,runs:l", lambda tr: K.source_map(tr, *_sources(tr)), f"WITH {MAP_SQL}, answer AS (SELECT * FROM smap)")
register("k8_hybrid_by_fold", "run_id:l label:s fold:l source:s fault_turn:l", lambda tr: K.hybrid_by_fold(tr, *_sources(tr)),
         f"""WITH {MAP_SQL}, answer AS (SELECT s.run_id, s.label, f.fold, CASE WHEN s.label = 'clean' THEN 'none' ELSE s.source END AS source, CASE WHEN s.label = 'clean' THEN -1 ELSE s.fault_turn END AS fault_turn
  FROM src s JOIN folds f USING (run_id) LEFT JOIN smap m ON m.fold = f.fold AND m.label = s.label WHERE s.source = coalesce(m.source, 'peak'))""")
register("e14_fold_deltas", "fold:l f1_a,f1_b,delta:d win:b", lambda tr: E.by_group_delta(_folded(tr), "fold").withColumn("win", F.col("delta") > 0),
         f"WITH {FAB_SQL}, answer AS (SELECT *, delta > 0 AS win FROM fd)")


def _groups(tr):
    return E.pairs(tr).select("run_id", E.error_group(F.col("y"), F.col("yp")).alias("grp"))


GRP = "CASE WHEN y = yp THEN y || ' correct' ELSE y || ' -> ' || yp END"
METRICS = ["n_assign", "n_unresolved", "unresolved_share", "recovered_share", "longest_unresolved_rel", "max_simultaneous_unresolved", "n_closed_by_refs"]
LONGP = " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM prof" for m in METRICS)
register("e15_group_profile", "grp,metric:s n:l mean,median,p90,share_positive:d", lambda tr: E.group_profile(L.assignment_profile(tr), _groups(tr), METRICS),
         f"""WITH {PAIR_SQL}, {PROFILE_SQL}, lg AS ({LONGP}), answer AS (SELECT {GRP} AS grp, metric, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.9) AS p90, avg({b('value > 0')}) AS share_positive FROM lg JOIN pr USING (run_id) GROUP BY 1, 2)""")


def _broken(tr):
    p = tr.pred.withColumn("label", F.when(F.col("run_id") % 13 == 0, "unknown").otherwise(F.col("label"))).withColumn(
        "success", F.when(F.col("run_id") % 17 == 0, 2).otherwise(F.col("success"))).withColumn("fault_turn", F.when(
            F.col("run_id") % 19 == 0, F.lit("x")).otherwise(F.col("fault_turn").cast("string")))
    p = p.filter("run_id % 11 <> 0")
    return p.unionByName(p.filter("run_id % 10 = 0")).unionByName(p.filter("run_id % 23 = 0").withColumn("run_id", F.col("run_id") + 1_000_000))


BROKEN_SQL = """b0 AS (SELECT run_id, CASE WHEN run_id % 13 = 0 THEN 'unknown' ELSE label END AS label, CASE WHEN run_id % 17 = 0 THEN 2 ELSE success END AS success,
  CASE WHEN run_id % 19 = 0 THEN 'x' ELSE CAST(fault_turn AS VARCHAR) END AS fault_turn FROM pred WHERE run_id % 11 <> 0),
broken AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE run_id % 10 = 0 UNION ALL SELECT run_id + 1000000, label, success, fault_turn FROM b0 WHERE run_id % 23 = 0)"""
register("e16_format_check", "run_id:l violation:s", lambda tr: E.format_check(_broken(tr), tr.runs), f"""WITH {BROKEN_SQL}, answer AS (
  SELECT run_id, 'duplicate_id' AS violation FROM broken GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT DISTINCT run_id, 'unknown_id' FROM broken WHERE run_id NOT IN (SELECT run_id FROM runs) UNION ALL SELECT run_id, 'missing_id' FROM runs WHERE run_id NOT IN (SELECT run_id FROM broken)
  UNION ALL SELECT run_id, 'unknown_label' FROM broken WHERE label NOT IN (SELECT unnest({sql_list(LABELS)})) UNION ALL SELECT run_id, 'bad_success' FROM broken WHERE success NOT IN (0, 1)
  UNION ALL SELECT run_id, 'bad_turn' FROM broken WHERE try_cast(fault_turn AS BIGINT) IS NULL)""")
register("e17_consistency", "rows,clean_with_turn,fault_without_turn,turn_outside_run:l", lambda tr: E.consistency(tr, tr.pred),
         f"WITH answer AS (SELECT count(*) AS rows, {cnt(chr(39).join(['label = ', 'clean', ' AND fault_turn <> -1']))} AS clean_with_turn, {cnt(chr(39).join(['label <> ', 'clean', ' AND fault_turn < 0']))} AS fault_without_turn, "
         f"{cnt('fault_turn >= n')} AS turn_outside_run FROM pred JOIN runs USING (run_id))")
register("e18_complementarity", "a_misses,b_hits_on_misses:l agreement,oracle_macro:d", lambda tr: E.complementarity(E.model_labels(tr)),
         f"""WITH {AB_SQL}, oo AS (SELECT *, CASE WHEN a = y THEN a ELSE b END AS o FROM ab), {macro('mo', 'oo', yp='o')},
  answer AS (SELECT {cnt('a <> y')} AS a_misses, {cnt('a <> y AND b = y')} AS b_hits_on_misses, avg({b('a = b')}) AS agreement, (SELECT macro_f1 FROM mo) AS oracle_macro FROM ab)""")
OFF_SQL = f"{PEAK_SQL}, {at_peak('pk', 'pred')}, off AS (SELECT pk.run_id, pk.fault_turn - t.fault_turn AS off FROM pk JOIN truth t USING (run_id) WHERE pk.label <> 'clean')"
register("e19_offset_report", "median,mean,exact,within_2,within_5,after_fault:d", E.offset_report, f"WITH {OFF_SQL}, answer AS (SELECT quantile_cont(off, 0.5) AS median, avg(off) AS mean, "
         f"avg({b('off = 0')}) AS exact, avg({b('abs(off) <= 2')}) AS within_2, avg({b('abs(off) <= 5')}) AS within_5, avg({b('off > 2')}) AS after_fault FROM off)")
register("e19_offset_histogram", "off,n:l", E.offset_histogram, f"WITH {OFF_SQL}, answer AS (SELECT greatest(-20, least(20, off)) AS off, count(*) AS n FROM off GROUP BY 1)")
TT_SQL = f"""{LABS_SQL}, tq AS (SELECT *, row_number() OVER (PARTITION BY run_id, t ORDER BY p DESC, c) AS k FROM probs),
tt AS (SELECT q.run_id, q.t, CASE WHEN label <> 'clean' AND abs(q.t - fault_turn) <= 2 THEN label ELSE 'clean' END AS y, {sql_list(LABELS)}[1 + q.c] AS yp FROM tq q JOIN truth USING (run_id) WHERE k = 1)"""
register("e20_turn_scores", "label:s tp,fp,fn,support:l precision,recall,f1:d", lambda tr: E.class_scores(E.turn_truth(tr)),
         f"WITH {TT_SQL}, {scores('sc', 'tt')}, answer AS (SELECT * FROM sc)")
register("e21_candidate_bounds", "label:s faulty,covered:l first_hit_0,first_hit_1,first_hit_2,best_hit_0,best_hit_1,best_hit_2:d", E.candidate_bounds,
         f"""WITH {REC_SQL}, z AS (SELECT r.run_id, t.label, abs(min(handoff_turn) - max(fault_turn)) AS f, min(abs(handoff_turn - fault_turn)) AS o FROM rec r JOIN truth t USING (run_id)
  WHERE unresolved_at_end AND label <> 'clean' GROUP BY 1, 2), q AS (SELECT label, count(*) AS covered, {', '.join(f'avg({b(f"{v} <= {k}")}) AS {n}_hit_{k}' for v, n in (('f', 'first'), ('o', 'best')) for k in (0, 1, 2))} FROM z GROUP BY 1),
  answer AS (SELECT label, faulty, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['covered'] + [f'{n}_hit_{k}' for n in ('first', 'best') for k in (0, 1, 2)])}
  FROM (SELECT label, count(*) AS faulty FROM truth WHERE label <> 'clean' GROUP BY 1) LEFT JOIN q USING (label))""")
register("e22_episode_classes", "episode_class:s " + ",".join(LABELS) + ":l", E.episode_classes,
         f"""WITH {EP_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY length DESC, start_turn) AS k FROM ep),
  y2 AS (SELECT t.run_id, t.label, CASE WHEN z.run_id IS NULL THEN 'no episode' WHEN n_artifacts_during > 0 OR n_new_intent_during > 0 THEN 'with new result' WHEN length >= 7 THEN 'no progress, long'
  ELSE 'no progress, short' END AS episode_class FROM truth t LEFT JOIN z ON z.run_id = t.run_id AND z.k = 1),
  answer AS (SELECT episode_class, {', '.join(f"count(*) FILTER (WHERE label = '{c}') AS {c}" for c in LABELS)} FROM y2 GROUP BY 1)""")


def _signature_block(tr):
    return R.join_blocks(tr.once("run_block", R.run_block), L.lifecycle_block(tr).select("run_id", "lc_n_unresolved"), W.wait_block(tr).select(
        "run_id", "wg_has_recip_pair", "wg_has_same_subtask_recip_pair"))


FAM_ON = {f: " OR ".join(f"round({c}, 9) {op} {x}" for c, op, x in t) for f, t in E.FAMILIES.items()}
register("e23_signature_families", "grp:s n:l " + ",".join(f"rate_{f}" for f in E.FAMILIES) + ",two_plus,three_plus:d", lambda tr: E.signature_families(_signature_block(tr), _groups(tr)),
         f"""WITH {PAIR_SQL}, {BASE_SQL}, l18 AS (WITH RECURSIVE {A18_SQL} SELECT run_id, lc_n_unresolved FROM a18), w21 AS (WITH {A21_SQL} SELECT * FROM a21),
  z AS (SELECT {GRP} AS grp, {', '.join(f'CASE WHEN {c} THEN 1.0 ELSE 0.0 END AS {f}' for f, c in FAM_ON.items())} FROM base JOIN l18 USING (run_id) JOIN w21 USING (run_id) JOIN pr USING (run_id)),
  zz AS (SELECT *, {' + '.join(E.FAMILIES)} AS k FROM (SELECT * FROM z UNION ALL SELECT * REPLACE ('ALL' AS grp) FROM z)),
  answer AS (SELECT grp, count(*) AS n, {', '.join(f'avg({f}) AS rate_{f}' for f in E.FAMILIES)}, avg({b('k >= 2')}) AS two_plus, avg({b('k >= 3')}) AS three_plus FROM zz GROUP BY 1)""")
register("e24_success_breakdown", "grp:s n:l base_rate,predicted_rate:d errors:l", lambda tr: E.success_breakdown(tr, L.lifecycle_block(tr).select(
    "run_id", (F.col("lc_recovered") > 0).alias("recovered"))),
    f"""WITH {PAIR_SQL}, {A18_SQL}, z AS (SELECT 'label=' || y AS grp, s, sp FROM pr UNION ALL SELECT CASE WHEN lc_recovered > 0 THEN 'recovery observed' ELSE 'no recovery' END, s, sp FROM pr JOIN a18 USING (run_id)),
  answer AS (SELECT grp, count(*) AS n, avg(s) AS base_rate, avg(sp) AS predicted_rate, {cnt('s <> sp')} AS errors FROM z GROUP BY 1)""")
register("e2_label_quality", "label:s tp,fp,fn,support:l precision,recall,f1:d", lambda tr: E.class_scores(tr.spark.read.parquet(f"{tr.sf_dir}/labels.parquet").select(
    F.col("quality").cast("string").alias("y"), F.col("toxic").cast("string").alias("yp")), labels=["0", "1"]),
    f"WITH labs AS (SELECT unnest(['0', '1']) AS label), q AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS yp FROM labels), {scores('sc', 'q')}, answer AS (SELECT * FROM sc)")
register("f15_offset_decision", "run_id:l label:s", lambda tr: tr.label_probs.withColumn("score", F.round(F.log(F.greatest("pa", F.lit(1e-15))) + F.when(F.col("c") == 3, 0.25).when(
    F.col("c") == 0, -0.1).otherwise(0.0), 9)).groupBy("run_id").agg(K.label_name(K.argmax("score", "c")).alias("label")),
    f"""WITH z AS (SELECT run_id, c, round(ln(greatest(pa, 1e-15)) + CASE c WHEN 3 THEN 0.25 WHEN 0 THEN -0.1 ELSE 0.0 END, 9) AS s FROM label_probs),
  answer AS (SELECT run_id, {sql_list(LABELS)}[1 + c] AS label FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, c) AS k FROM z) WHERE k = 1)""")

# ---- set operations ----
register("u2_word_sets", "run_id,t,shared,only_goal,either:l", lambda tr: __import__("tracewright.operators.sets", fromlist=["x"]).goal_word_sets(tr),
         "SELECT run_id, t, len(list_intersect(goal_words, words)) AS shared, len(goal_words) - len(list_intersect(goal_words, words)) AS only_goal, "
         "len(list_distinct(list_concat(goal_words, words))) AS \"either\" FROM messages")
register("u3_id_differences", "run_id:l side:s", lambda tr: __import__("tracewright.operators.sets", fromlist=["x"]).id_differences(_broken(tr), tr.runs),
         f"WITH {BROKEN_SQL}, answer AS (SELECT DISTINCT run_id, 'only_left' AS side FROM broken WHERE run_id NOT IN (SELECT run_id FROM runs) UNION ALL SELECT run_id, 'only_right' FROM runs "
         "WHERE run_id NOT IN (SELECT run_id FROM broken) UNION ALL SELECT run_id, 'duplicate' FROM broken GROUP BY 1 HAVING count(*) > 1)")
