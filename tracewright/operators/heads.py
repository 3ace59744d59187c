"""Model heads on Spark ML: label, success and window heads, out-of-fold stacking and the full job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import FAULTS, LABELS, RADIUS
from tracewright.operators import lifecycles as L
from tracewright.operators import runfeatures as R
from tracewright.operators.evaluate import class_scores, composite, macro_f1
from tracewright.operators.localize import AGGREGATE_COLS, argmax, label_index, label_name, rule_localiser, window_aggregates
from tracewright.operators.resample import seeded, stratified_folds
from tracewright.operators.textfit import TextFit
from tracewright.operators.turns import CAUSAL_COLS, WINDOW_COLS, causal_turns, turn_windows
from tracewright.operators.waits import wait_block
from tracewright.operators.wordweights import WordWeights
from tracewright.plans.gather import gather
from tracewright.session import released, shared, written
from tracewright.sources.traces import Traces

# Training weights of background and fault windows.
BACKGROUND_WEIGHT = 0.25
FAULT_WEIGHT = 0.125

Predict = Callable[[DataFrame], DataFrame]


# ---- inputs ---------------------------------------------------------------------
def foundation(tr: Traces) -> DataFrame:
    """Run-level columns of the label head, built once."""
    def build(t: Traces) -> DataFrame:
        base = t.once("run_block", R.run_block)
        more = (R.positions, L.lifecycle_block, L.deadlock_block, L.temporal_block, wait_block)
        return R.join_blocks(base, R.normalised(base), *[t.once(f"block_{b.__name__}", b) for b in more])
    return tr.once("foundation", build)


def success_columns(df: DataFrame) -> list[str]:
    """The success head sees the run block, its ratios and positions, not the lifecycle blocks."""
    return [c for c in df.columns if c != "run_id" and not c.startswith(("lc_", "dl_", "ua_", "bd_", "ra_", "rt_", "ld_", "wg_"))]


def window_targets(tr: Traces) -> DataFrame:
    """Class of every turn: the run's fault inside two turns of its begin, else background."""
    t = tr.truth.select("run_id", "label", "fault_turn")
    near = (F.col("label") != "clean") & (F.abs(F.col("t") - F.col("fault_turn")) <= RADIUS)
    return tr.plain_messages.select("run_id", "t").join(t, "run_id").select(
        "run_id", "t", F.when(near, F.col("label")).otherwise("background").alias("target"),
        F.when(near, FAULT_WEIGHT).otherwise(BACKGROUND_WEIGHT).alias("weight"))


def windows(tr: Traces) -> DataFrame:
    """Window columns with target index (0 = background) and weight, built once."""
    def build(t: Traces) -> DataFrame:
        y = window_targets(t).withColumn("y", F.coalesce(F.nullif(label_index(F.col("target")), F.lit(-1)), F.lit(0)).cast("double"))
        return turn_windows(t).join(y.select("run_id", "t", "y", "weight"), ["run_id", "t"])
    return tr.once("windows", build)


def _assembled(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    if "features" in df.columns:  # a table of vectors: see fit_rows
        return df.select(*keep, "features")
    clean = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(clean).select(*keep, "features")


def fit_rows(df: DataFrame, cols: list[str], keep: list[str], name: str) -> DataFrame:
    """Rows with the vector of ``cols``, written once: each fit and each prediction is a filter of this table.

    Without it every fit joins wide rows with the runs it may see, writes them again, and its predictions stay a plan of joins.
    """
    return written(_assembled(df, cols, keep), name)


def _train(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    # a fit passes over its input several times: written once, read many times
    return _assembled(df, cols, keep) if "features" in df.columns else fit_rows(df, cols, keep, "train")


def _long(scored: DataFrame, keys: list[str], more: int = 0) -> DataFrame:
    p = vector_to_array("probability")
    p = F.concat(p, F.array_repeat(F.lit(0.0), more)) if more > 0 else p
    return scored.select(*keys, F.posexplode(p).alias("c", "p")).withColumn("c", F.col("c").cast("long"))


# ---- heads ------------------------------------------------------------------------
def fit_forest(train: DataFrame, cols: list[str], keys: list[str], y: str = "y", weight: str | None = None, trees: int = 100, depth: int = 8,
               classes: int | None = None) -> Predict:
    """Random forest; returns a function from rows to (keys, c, p). ``classes`` pads classes the fit never saw."""
    keep = [*keys, y] + ([weight] if weight else [])
    rf = RandomForestClassifier(labelCol=y, numTrees=trees, maxDepth=depth, seed=42, subsamplingRate=0.9)
    if weight:
        rf = rf.setWeightCol(weight)
    model = rf.fit(_train(train, cols, keep))

    def predict(rows: DataFrame) -> DataFrame:
        return _long(model.transform(_assembled(rows, cols, keys)), keys, (classes or 0) - model.numClasses)

    def cells(rows: DataFrame) -> list:
        """(label, predicted class, rows): the largest probability wins, the lowest class on ties."""
        p = vector_to_array("probability")
        scored = model.transform(_assembled(rows, cols, ["label"])).select("label", (F.array_position(p, F.array_max(p)) - 1).alias("c"))
        return [tuple(r) for r in scored.groupBy("label", "c").count().collect()]

    predict.model, predict.cells = model, cells  # type: ignore[attr-defined]
    return predict


def fit_boosted(train: DataFrame, cols: list[str], keys: list[str], y: str = "y", rounds: int = 50, depth: int = 5) -> Predict:
    """Gradient-boosted binary head."""
    model = _boosted(_train(train, cols, [*keys, y]), y, rounds, depth)
    return lambda rows: _long(model.transform(_assembled(rows, cols, keys)), keys)


def _boosted(rows: DataFrame, y: str, rounds: int, depth: int) -> GBTClassificationModel:
    return GBTClassifier(labelCol=y, maxIter=rounds, maxDepth=depth, seed=42, stepSize=0.1).fit(rows)


def label_rows(tr: Traces, features: DataFrame) -> DataFrame:
    return features.join(tr.truth.select("run_id", "label", label_index(F.col("label")).cast("double").alias("y"), F.col("success").cast("double").alias("success")), "run_id")


def out_of_fold(rows: DataFrame, folds: DataFrame, k: int, fit: Callable[[DataFrame], Predict]) -> DataFrame:
    """Predictions for every row from a model that never saw its run. One fit per fold uses the whole cluster."""
    x = written(rows.join(folds.select("run_id", F.col("fold").alias("held")).hint("merge"), "run_id", "left"), "dealt")
    parts = []
    for i in range(k):
        mine = F.col("held").eqNullSafe(F.lit(i))
        predict = fit(x.filter(~mine).drop("held"))
        parts.append(predict(x.filter(mine).drop("held")))
    return reduce(DataFrame.unionByName, parts)


def window_rows(tr: Traces, folds: DataFrame) -> DataFrame:
    """Vectors of the window columns with target and weight, written once with the columns of ``folds`` (a row for each run)."""
    marks = [c for c in folds.columns if c != "run_id"]
    return fit_rows(windows(tr).join(folds.hint("merge"), "run_id"), WINDOW_COLS, ["run_id", "t", "y", "weight", *marks], "window_rows")


def fit_windows(rows: DataFrame, trees: int, depth: int) -> Predict:
    return fit_forest(rows, WINDOW_COLS, ["run_id", "t"], weight="weight", trees=trees, depth=depth, classes=len(LABELS))


def window_stack(tr: Traces, rows: DataFrame, fold: str, inner: int, trees: int, depth: int) -> DataFrame:
    """51 window columns. ``fold`` of ``window_rows`` has the inner fold of the runs to fit on and -1 for the others.

    The fit runs are answered out of fold, the others by a model on all fit runs.
    """
    f = F.col(fold)
    parts = [fit_windows(rows.filter((f >= 0) & (f != i)), trees, depth)(rows.filter(f == i)) for i in range(inner)]
    parts.append(fit_windows(rows.filter(f >= 0), trees, depth)(rows.filter(f == -1)))
    return window_aggregates(reduce(DataFrame.unionByName, parts), tr.runs.select("run_id", "n"))


def inner_folds(truth: DataFrame, fit_ids: DataFrame, other_ids: DataFrame, k: int, seed: int, name: str) -> DataFrame:
    """(run_id, name): folds of the runs to fit on, -1 for the others."""
    mine = stratified_folds(truth.join(fit_ids.select("run_id"), "run_id", "left_semi"), k, seed).select("run_id", F.col("fold").alias(name))
    return written(mine, name).unionByName(written(other_ids.select("run_id", F.lit(-1).cast("long").alias(name)), name))


def stacked_label_probabilities(tr: Traces, outer: int = 3, inner: int = 3, trees: int = 100, depth: int = 8, seed: int = 42) -> DataFrame:
    """Label probabilities of every run, out of fold, with window columns that are out of fold too."""
    base = foundation(tr)
    folds = tr.once(f"folds{outer}_{seed}", lambda t: stratified_folds(t.truth, outer, seed))
    cols = [c for c in base.columns if c != "run_id"] + AGGREGATE_COLS
    marks = [inner_folds(tr.truth, folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i), inner, seed + 1 + i, f"inner_{i}") for i in range(outer)]
    rows = window_rows(tr, gather(folds.select("run_id"), *marks))
    parts = []
    for i in range(outer):
        agg = shared(window_stack(tr, rows, f"inner_{i}", inner, trees, depth), "stacked_windows")
        x = label_rows(tr, base.join(agg, "run_id")).join(folds.select("run_id", "fold"), "run_id")
        x = fit_rows(x, cols, ["run_id", "y", "fold"], "stacked")
        predict = fit_forest(x.filter(F.col("fold") != i), cols, ["run_id"], trees=trees, depth=depth, classes=len(LABELS))
        parts.append(predict(x.filter(F.col("fold") == i)))
    return reduce(DataFrame.unionByName, parts)


def wide_probabilities(p: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [f"lp_{c}" for c in LABELS]
    return p.groupBy("run_id").agg(*[F.coalesce(F.max(F.when(F.col("c") == i, F.col("p"))), F.lit(0.0)).alias(n) for i, n in enumerate(names)]), names


def decisions(p: DataFrame) -> DataFrame:
    return p.groupBy("run_id").agg(label_name(argmax("p", "c")).alias("label"))


def shipped_job(tr: Traces, train_ids: DataFrame, test_ids: DataFrame, trees: int = 100, depth: int = 8, inner: int = 3, rounds: int = 50) -> DataFrame:
    """Train on one set of runs and answer for the other: label, success and fault turn.

    Window head (inner cross-fit) -> window columns -> label head; label probabilities
    out of fold -> success head; the turn is the window peak of the predicted class.
    """
    base = foundation(tr)
    cols = [c for c in base.columns if c != "run_id"] + AGGREGATE_COLS
    # made anew for each call: another split or setting is another table
    rows = window_rows(tr, inner_folds(tr.truth, train_ids, test_ids, inner, 7, "inner"))
    agg = shared(window_stack(tr, rows, "inner", inner, trees, depth), "shipped_windows")
    x = shared(label_rows(tr, base.join(agg, "run_id")), "shipped_rows")
    train, test = x.join(train_ids.select("run_id"), "run_id", "left_semi"), x.join(test_ids.select("run_id"), "run_id", "left_semi")

    def fit(rows: DataFrame) -> Predict:
        return fit_forest(rows, cols, ["run_id"], trees=trees, depth=depth, classes=len(LABELS))

    p_test = fit(train)(test)
    folds = stratified_folds(train.select("run_id", "label"), inner, 42)
    p_train = out_of_fold(train, folds, inner, fit)
    wide, names = wide_probabilities(p_train.unionByName(p_test))
    s_cols = success_columns(base) + names
    xs = x.join(shared(wide, "label_oof"), "run_id")
    success = fit_boosted(xs.join(train_ids.select("run_id"), "run_id", "left_semi"), s_cols, ["run_id"], y="success", rounds=rounds)(
        xs.join(test_ids.select("run_id"), "run_id", "left_semi"))
    head = fit_windows(rows.filter("inner >= 0"), trees, depth)
    best = head(rows.filter("inner = -1")).groupBy("run_id", "c").agg(argmax("p", "t").alias("peak"))
    d = decisions(p_test).withColumn("c", label_index(F.col("label"))).join(best, ["run_id", "c"], "left")
    s = success.groupBy("run_id").agg(argmax("p", "c").alias("success"))
    turn = F.when(F.col("label") == "clean", F.lit(-1)).otherwise(F.coalesce("peak", F.lit(-1)))
    return d.join(s, "run_id").select("run_id", "label", "success", turn.cast("long").alias("fault_turn"))


def two_stage(train: DataFrame, test: DataFrame, cols: list[str], threshold: float, trees: int = 100, depth: int = 8, rounds: int = 50) -> DataFrame:
    """Fault-or-not head first, then the kind of fault among the fault classes."""
    gate = fit_boosted(train.withColumn("g", F.when(F.col("y") > 0, 1.0).otherwise(0.0)), cols, ["run_id"], y="g", rounds=rounds)(test)
    kind = fit_forest(train.filter("y > 0").withColumn("k", F.col("y") - 1), cols, ["run_id"], y="k", trees=trees, depth=depth)(test)
    g = gate.filter("c = 1").select("run_id", F.col("p").alias("fault"))
    k = kind.groupBy("run_id").agg((argmax("p", "c") + 1).alias("kind"))
    return g.join(k, "run_id").select("run_id", "fault", F.when(F.col("fault") >= threshold, label_name(F.col("kind"))).otherwise("clean").alias("label"))


def turn_ranker(tr: Traces, folds: DataFrame, k: int, rounds: int = 20, depth: int = 4, classes: list[str] = FAULTS) -> DataFrame:
    """Best turn per (run, class): one binary model per class on the causal turn table, out of fold.

    The turn table becomes vectors once, with the fold of its run and the class whose fault begins there; the models of a
    fold answer its turns in one pass.
    """
    y = tr.truth.select("run_id", "label", "fault_turn").join(folds.select("run_id", "fold"), "run_id").hint("merge")
    x = tr.once("causal_turns", causal_turns).join(y, "run_id")
    begins = F.when(F.col("t") == F.col("fault_turn"), F.col("label")).alias("begins")
    x = fit_rows(x.select("*", begins), CAUSAL_COLS, ["run_id", "t", "fold", "begins"], "ranker_rows")
    outs = []
    for i in range(k):
        rest, scored = x.filter(F.col("fold") != i), x.filter(F.col("fold") == i).select("run_id", "t", "features")
        for n, c in enumerate(classes):
            target = F.when(F.col("begins") == c, 1.0).otherwise(0.0).alias("y")
            model = _boosted(rest.select(target, "features"), "y", rounds, depth)
            scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"v{n}").transform(scored)
        scored = scored.select("run_id", "t", *[F.get(vector_to_array(f"v{n}"), 1).alias(f"p{n}") for n in range(len(classes))])
        best = scored.groupBy("run_id").agg(*[F.struct(argmax(f"p{n}", "t").alias("t"), F.max(f"p{n}").alias("p"), F.lit(c).alias("label")).alias(f"b{n}")
                                              for n, c in enumerate(classes)])
        best = best.select("run_id", F.explode(F.array(*[f"b{n}" for n in range(len(classes))])).alias("b")).select("run_id", "b.*")
        outs.append(written(best, "ranked_turns"))
    return reduce(DataFrame.unionByName, outs)


def text_classifier(weights: WordWeights, labels: DataFrame, rounds: int = 50, passes: int = 4) -> DataFrame:
    """Multinomial logistic regression on sparse text vectors; (key, c, p). labels: key, y.

    A part of the documents after the other is fitted on and answered: a vector of probabilities is all that is kept of a document.
    """
    fit = TextFit(weights, labels, rounds=rounds, passes=passes)
    out = [written(fit.answers(turn), "text_vectors") for turn in range(passes)]
    released(fit.state)
    return reduce(DataFrame.unionByName, [t.select(weights.key, F.posexplode("probability").alias("c", "p")).withColumn("c", F.col("c").cast("long")) for t in out])


def transfer_scores(tr: Traces, flags: DataFrame, names: list[str], cols: list[str], trees: int, depth: int) -> DataFrame:
    """For each slice: fit outside it and score inside it; the score of a two-fold fit within the slice; and what transfer costs.

    ``penalty`` is the reference score less the transferred one. Slices without runs on either side give no row, those with too few runs for two folds no reference.
    """
    some = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in names]))
    inside = flags.join(tr.truth.select("run_id", "label"), "run_id").select("run_id", "label", F.explode(some).alias("slice"))
    folds = stratified_folds(inside, 2, 42, within=["slice"])
    at = {s: F.col(f"fold{n}") for n, s in enumerate(names)}
    folds = folds.groupBy("run_id").agg(*[F.max(F.when(F.col("slice") == s, F.col("fold"))).alias(f"fold{n}") for n, s in enumerate(names)])
    x = label_rows(tr, foundation(tr)).join(folds.hint("merge"), "run_id", "left")
    x = fit_rows(x, cols, ["run_id", "label", "y", *folds.columns[1:]], "transfer_rows")
    sizes = x.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum((f == i).cast("int")), F.lit(0)).alias(f"{s}_{i}") for s, f in at.items() for i in range(2)]).first()

    def fit(rows: DataFrame) -> Predict:
        return fit_forest(rows, cols, ["run_id"], trees=trees, depth=depth, classes=len(LABELS))

    cells = []
    for s, f in at.items():
        n = [sizes[f"{s}_{i}"] for i in range(2)]
        if not 0 < sum(n) < sizes["n"]:
            continue
        held = x.filter(f.isNotNull())
        cells += [(s, "macro_f1", *r) for r in fit(x.filter(f.isNull())).cells(held)]
        if all(n):
            for i in range(2):
                cells += [(s, "reference", *r) for r in fit(held.filter(f != i)).cells(held.filter(f == i))]
    p = scored_cells(tr, cells, ["slice", "kind"])
    p = p.groupBy("slice").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(a) for k, c, a in (
        ("macro_f1", "n", "n"), ("macro_f1", "macro_f1", "macro_f1"), ("reference", "macro_f1", "reference"))])
    return p.withColumn("penalty", F.col("reference") - F.col("macro_f1"))


def scored_cells(tr: Traces, cells: list[tuple], keys: list[str]) -> DataFrame:
    """Macro F1 and rows for each value of ``keys`` from counts (*keys, label, predicted class, rows)."""
    d = tr.spark.createDataFrame(cells, ", ".join(f"{k} string" for k in keys) + ", y string, c long, n long")
    scores = macro_f1(d.withColumn("yp", label_name(F.col("c"))), keys, weight=F.col("n"))
    return scores.join(d.groupBy(*keys).agg(F.sum("n").alias("n")), keys)


def ablation(tr: Traces, blocks: dict[str, list[str]], k: int, trees: int, depth: int) -> DataFrame:
    """Out-of-fold macro F1 with every block dropped in turn (and with nothing dropped)."""
    folds = stratified_folds(tr.truth, k, 42).select("run_id", "fold")
    every = [c for c in foundation(tr).columns if c != "run_id"]
    x = fit_rows(label_rows(tr, foundation(tr)).join(folds.hint("merge"), "run_id"), every, ["run_id", "label", "y", "fold"], "ablation_rows")
    cells = []
    for name, drop in {"nothing": [], **blocks}.items():
        left = [i for i, c in enumerate(every) if c not in set(drop)]
        rows = VectorSlicer(inputCol="all", outputCol="features", indices=left).transform(x.withColumnRenamed("features", "all")).drop("all")
        for i in range(k):
            predict = fit_forest(rows.filter(F.col("fold") != i), every, ["run_id"], trees=trees, depth=depth)
            cells += [(name, *r) for r in predict.cells(rows.filter(F.col("fold") == i))]
    return scored_cells(tr, cells, ["dropped"])


def importance_by_group(tr: Traces, groups: dict[str, list[str]], trees: int, depth: int) -> DataFrame:
    """Forest importances summed over feature groups (the importance vector has one number per column)."""
    cols = [c for v in groups.values() for c in v]
    model = fit_forest(label_rows(tr, foundation(tr)), cols, ["run_id"], trees=trees, depth=depth).model  # type: ignore[attr-defined]
    imp = [float(x) for x in model.featureImportances.toArray()]
    owner = {c: g for g, v in groups.items() for c in v}
    rows = [(owner[c], c, x) for c, x in zip(cols, imp)]
    t = tr.spark.createDataFrame(rows, "grp string, feature string, importance double")
    return t.groupBy("grp").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))


def local_evaluation(tr: Traces, folds: int = 3, limit: int = 0, seed: int = 42, trees: int = 100, depth: int = 8, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Local scores in one call: sample, features, folds, label and success out of fold, turns by rule, metrics.

    ``limit`` takes so many runs by md5, all if 0. Returns the four scores with the composite (one row), and per-class scores.
    """
    runs = tr.truth.select("run_id", "label")
    if limit:
        runs = shared(runs.orderBy(seeded(seed, "run_id"), "run_id").limit(limit), "sampled")
    base = tr.once("run_block", R.run_block)
    cols = [c for c in base.columns if c != "run_id"]
    x = shared(label_rows(tr, base).join(runs.select("run_id"), "run_id", "left_semi"), "local_rows")
    parts = stratified_folds(runs, folds, seed)
    labels = decisions(out_of_fold(x, parts, folds, lambda r: fit_forest(r, cols, ["run_id"], trees=trees, depth=depth, classes=len(LABELS))))
    success = out_of_fold(x, parts, folds, lambda r: fit_boosted(r, cols, ["run_id"], y="success", rounds=rounds)).groupBy("run_id").agg(argmax("p", "c").alias("sp"))
    turns = rule_localiser(tr, shared(labels, "local_labels")).select("run_id", F.col("label").alias("yp"), F.col("fault_turn").alias("tp"))
    own = tr.truth.select("run_id", F.col("label").alias("y"), F.col("success").alias("s"), F.col("fault_turn").alias("ft"))
    answers = shared(turns.join(success, "run_id").join(own, "run_id"), "local_answers")
    return composite(tr, answers), class_scores(answers)


def probability_rows_ok(p: DataFrame, classes: int) -> DataFrame:
    """Per run: number of predictions and whether they are a distribution."""
    ok: Column = (F.abs(F.sum("p") - 1) < 1e-6) & (F.min("p") >= 0)
    return p.groupBy("run_id").agg(F.count(F.lit(1)).alias("classes"), ok.alias("valid")).withColumn("complete", F.col("classes") == classes)
