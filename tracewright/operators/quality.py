"""Telemetry-loss views, degradation probes, leakage and invariance checks, table audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.fixed import KEYWORDS
from tracewright.functions.numbers import count_where
from tracewright.functions.text import md5_int
from tracewright.operators.resample import seeded
from tracewright.operators.sets import row_differences
from tracewright.plans.scan import ranked
from tracewright.sources.traces import Traces


def _one() -> Column:
    return F.count(F.lit(1))


# Share of runs (per mille) hit by each kind of telemetry loss.
LOSS = {"intent": 120, "refs": 80, "subtask": 100, "text": 150}


def loss_flags(tr: Traces, seed: int) -> DataFrame:
    r = tr.goals.select("run_id")
    out = r.select("run_id", *[(md5_int(F.concat_ws("_", F.lit(str(seed)), F.lit(k), F.col("run_id").cast("string"))) % 1000 < p).alias(f"lose_{k}")
                               for k, p in LOSS.items()])
    return out.filter(" or ".join(f"lose_{k}" for k in LOSS))


def half_of_messages(tr: Traces, runs: DataFrame, salt: str, seed: int) -> DataFrame:
    """Half of each run's messages (rounded down): those with the smallest md5, ranked in md5-prefix chunks."""
    m = tr.messages.select("run_id", "t", "n").join(runs.select("run_id"), "run_id", "left_semi").withColumn("h", seeded(f"{seed}_{salt}", "run_id", "t"))
    r = ranked(m, ["run_id"], ["h", "t"], "r", chunk=F.conv(F.substring("h", 1, 3), 16, 10).cast("long"))
    return r.filter(F.col("r") < F.floor(F.col("n") / 2)).select("run_id", "t", F.lit(True).alias(f"pick_{salt}"))


def lossy_messages(tr: Traces, seed: int) -> DataFrame:
    """One corrupted view per affected run: blank intents, half of the refs cut, half of the texts clipped to 12-30 characters."""
    f = loss_flags(tr, seed)
    m = tr.messages.select("run_id", "t", "sender", "receiver", "type", "intent", "text", "tool", "refs").join(f, "run_id")
    for kind in ("refs", "text"):
        m = m.join(half_of_messages(tr, f.filter(f"lose_{kind}"), kind, seed), ["run_id", "t"], "left")
    clip = (md5_int(F.concat_ws("_", F.lit(f"{seed}_clip"), F.col("run_id").cast("string"), F.col("t").cast("string"))) % 19 + 12).cast("int")
    return m.select(
        F.concat(F.col("run_id").cast("string"), F.lit("_v")).alias("view_id"), F.col("run_id").alias("parent_id"), "t", "sender", "receiver", "type",
        F.when(F.col("lose_intent"), "").otherwise(F.col("intent")).alias("intent"),
        F.when(F.coalesce("pick_text", F.lit(False)), F.substring(F.col("text"), F.lit(1), clip)).otherwise(F.col("text")).alias("text"), "tool",
        F.when(F.coalesce("pick_refs", F.lit(False)), F.array().cast("array<string>")).otherwise(F.col("refs")).alias("refs"))


def lossy_artifacts(tr: Traces, seed: int) -> DataFrame:
    f = loss_flags(tr, seed).select("run_id", "lose_subtask")
    a = tr.artifacts.join(f, "run_id")
    return a.select(F.concat(F.col("run_id").cast("string"), F.lit("_v")).alias("view_id"), F.col("run_id").alias("parent_id"), "t", "id", "by", "type",
                    F.when(F.col("lose_subtask"), "").otherwise(F.col("subtask")).alias("subtask"), "hash", "status")


def with_views(tr: Traces, seed: int) -> DataFrame:
    """Original messages followed by the corrupted views, with the parent run of each."""
    cols = ["view_id", "parent_id", "t", "sender", "receiver", "type", "intent", "text", "tool", "refs"]
    own = tr.messages.select(F.col("run_id").cast("string").alias("view_id"), F.col("run_id").alias("parent_id"), *cols[2:])
    return own.unionByName(lossy_messages(tr, seed).select(*cols))


def allowed_changes(tr: Traces, seed: int) -> DataFrame:
    """How many message rows of the views differ from their parent, per column; only three columns may differ."""
    v = lossy_messages(tr, seed)
    o = tr.messages.select(F.col("run_id").alias("parent_id"), "t", *[F.col(c).alias(f"o_{c}") for c in ("sender", "receiver", "type", "intent", "text", "tool", "refs")])
    j = v.join(o, ["parent_id", "t"], "left")
    cols = ("sender", "receiver", "type", "intent", "text", "tool", "refs")
    g = j.agg(*[count_where(~F.col(c).eqNullSafe(F.col(f"o_{c}"))).alias(c) for c in cols])
    return g.unpivot([], list(cols), "column", "changed").withColumn("allowed", F.col("column").isin("intent", "text", "refs"))


def probe_messages(tr: Traces, kind: str) -> DataFrame:
    """Messages rewritten for a degradation probe: mask, keywords, intents or refs."""
    m = tr.messages
    text = F.col("text")
    if kind == "mask":
        return m.withColumn("text", F.concat(F.lit("item "), F.col("t").cast("string")))
    if kind == "keywords":
        t = F.lower(text)
        for w in KEYWORDS["drift"]:
            t = F.replace(t, F.lit(w), F.lit(" "))
        return m.withColumn("text", t)
    if kind == "intents":
        return m.withColumn("intent", F.lit(""))
    return m.withColumn("refs", F.array().cast("array<string>"))


# ---- invariance ---------------------------------------------------------------
def same_result(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """One row: rows on each side and rows that only one side has (doubles rounded)."""
    def tidy(df: DataFrame) -> DataFrame:
        return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    a, b = tidy(a), tidy(b)
    d = row_differences(a, b)
    return a.agg(_one().alias("rows")).select("rows", b.select(_one()).scalar().alias("rows_again"), d.select(_one()).scalar().alias("differing"))


def like(tr: Traces, messages: DataFrame | None = None, artifacts: DataFrame | None = None, state: DataFrame | None = None,
         agents: DataFrame | None = None, truth: DataFrame | None = None) -> Traces:
    """The same traces with some tables replaced."""
    out = Traces.of_messages(messages if messages is not None else tr.plain_messages, tr.goals, artifacts if artifacts is not None else tr.artifacts,
                             state if state is not None else tr.state, agents if agents is not None else tr.agents)
    if truth is not None:
        out.__dict__["truth"] = truth
    return out


def leak_probe(tr: Traces, block: Callable[[Traces], DataFrame]) -> DataFrame:
    """Scramble the targets and rebuild the block: nothing may change."""
    t = tr.truth.withColumn("label", F.lit("clean")).withColumn("success", 1 - F.col("success")).withColumn("fault_turn", F.lit(-1).cast("long"))
    return same_result(block(tr), block(like(tr, truth=t)))


def renamed(tr: Traces) -> Traces:
    """The traces with every agent renamed, also inside texts."""
    def new(c: str) -> Column:
        return F.regexp_replace(F.col(c), r"\ba([0-9]+)\b", "a9$1")

    m = tr.plain_messages.withColumns({c: new(c) for c in ("sender", "receiver", "text")})
    return like(tr, m, tr.artifacts.withColumn("by", new("by")), tr.state.withColumn("agent", new("agent")), tr.agents.withColumn("agent", new("agent")))


def rename_probe(tr: Traces, block: Callable[[Traces], DataFrame]) -> DataFrame:
    """Rename every agent and rebuild the block: nothing may change."""
    return same_result(block(tr), block(renamed(tr)))


def future_probe(tr: Traces, table: Callable[[Traces], DataFrame], cut: int) -> DataFrame:
    """Drop everything after turn ``cut``: rows up to it may not change."""
    keep = F.col("t") <= cut
    short = like(tr, tr.plain_messages.filter(keep), tr.artifacts.filter(keep), tr.state.filter(keep))
    return same_result(table(tr).filter(keep), table(short))


class _Watched(Traces):
    """Traces that note whether a block asks for the targets, directly or through a table made of them."""

    asked = False

    @property
    def truth(self) -> DataFrame:
        self.asked = True
        return self._own_truth

    def once(self, name: str, build) -> DataFrame:
        before, self.asked = self.asked, self._of_targets.get(name, False)
        out = super().once(name, build)
        self._of_targets[name] = self.asked
        self.asked |= before
        return out


def watched(tr: Traces, truth: DataFrame | None = None) -> _Watched:
    """The traces with these or the given targets, watched; blocks share their tables."""
    out = like(tr)
    out.__dict__.pop("truth", None)
    out.__class__ = _Watched
    out._own_truth, out._of_targets = truth if truth is not None else tr.truth, {}
    return out


def reads_targets(out: _Watched, block: Callable[[Traces], DataFrame]) -> tuple[bool, DataFrame]:
    """Whether a block's plan is made from the targets, and the block."""
    out.asked, had = False, set(out.__dict__)
    got = block(out)
    if out.asked:  # properties made from the targets must ask for them again
        for name in set(out.__dict__) - had:
            del out.__dict__[name]
    return out.asked, got


def _report(rows: list[tuple[str, bool, DataFrame]]) -> DataFrame:
    outs = [d.select(F.lit(name).alias("block"), F.lit(flagged).alias("flagged"), "rows", "differing") for name, flagged, d in rows]
    out = outs[0]
    for d in outs[1:]:
        out = out.unionByName(d)
    return out


def leak_report(tr: Traces, blocks: dict[str, Callable[[Traces], DataFrame]]) -> DataFrame:
    """``(block, flagged, rows, differing)``: blocks made from the targets are flagged and compared under scrambled ones.

    A block whose plan never asks for the targets cannot depend on them: none of its rows needs to be compared.
    """
    t = tr.truth.withColumn("label", F.lit("clean")).withColumn("success", 1 - F.col("success")).withColumn("fault_turn", F.lit(-1).cast("long"))
    other, rows = watched(tr, t), []
    for name, block in blocks.items():
        asked, again = reads_targets(other, block)
        zero = F.lit(0).cast("long")
        found = same_result(block(tr), again) if asked else tr.spark.range(1).select(zero.alias("rows"), zero.alias("differing"))
        rows.append((name, asked, found))
    return _report(rows)


def rename_report(tr: Traces, blocks: dict[str, Callable[[Traces], DataFrame]]) -> DataFrame:
    """As ``rename_probe`` for many blocks, which share the renamed tables; flagged are those that differ."""
    other = renamed(tr)
    rows = [(name, False, same_result(block(tr), block(other))) for name, block in blocks.items()]
    return _report(rows).withColumn("flagged", F.col("differing") > 0)


def future_report(tr: Traces, tables: dict[str, Callable[[Traces], DataFrame]], cuts: list[int]) -> DataFrame:
    """``(table, cut, rows, differing)``: for every cut, the rows up to it when nothing later is known, against the table's own.

    All cuts are checked in one build: each run is copied once per cut, with its events up to the cut, and a copy's rows must
    be the run's. Run ids are whole numbers; copies get ids far beyond them.
    """
    far = 10**12

    def copied(df: DataFrame) -> DataFrame:
        x = df.select("*", F.explode(F.array(*map(F.lit, range(len(cuts))))).alias("__k"))
        if "t" in df.columns:
            x = x.filter(F.col("t") <= F.array(*map(F.lit, cuts))[F.col("__k")])
        return x.withColumn("run_id", F.col("run_id") + (F.col("__k") + 1) * F.lit(far)).drop("__k")

    short = Traces.of_messages(copied(tr.plain_messages), copied(tr.goals), copied(tr.artifacts), copied(tr.state), copied(tr.agents))
    outs = []
    for name, table in tables.items():
        own, again = table(tr), table(short)
        cut = F.array(*map(F.lit, cuts))
        own = own.select("*", F.explode(F.array(*map(F.lit, range(len(cuts))))).alias("__k")).filter(F.col("t") <= cut[F.col("__k")])
        again = again.withColumn("__k", (F.floor(F.col("run_id") / far) - 1).cast("int")).withColumn("run_id", F.pmod("run_id", F.lit(far)))
        tidy = lambda df: df.select("__k", *[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c != "__k"])
        apart = row_differences(tidy(own), tidy(again)).groupBy("__k").agg(_one().alias("differing"))
        rows = own.groupBy("__k").agg(_one().alias("rows")).join(apart, "__k", "left")
        outs.append(rows.select(F.lit(name).alias("table"), cut[F.col("__k")].alias("cut"), "rows", F.coalesce("differing", F.lit(0)).alias("differing")))
    out = outs[0]
    for d in outs[1:]:
        out = out.unionByName(d)
    return out


# ---- table audits ---------------------------------------------------------------
def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and order-free content print of a table."""
    row = md5_int(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))
    return df.agg(_one().alias("rows"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("print"))


def contract_check(tr: Traces) -> DataFrame:
    """Dense turns, targets in range and clean exactly when there is no turn."""
    m = tr.plain_messages.groupBy("run_id").agg(_one().alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_distinct("t").alias("k"))
    j = tr.truth.select("run_id", "label", "success", "fault_turn").join(m, "run_id", "left")
    clean = F.col("label") == "clean"
    return j.agg(_one().alias("runs"), count_where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("k") != F.col("n"))).alias("gaps"),
                 count_where(clean != (F.col("fault_turn") == -1)).alias("label_turn_mismatch"), count_where(~F.col("success").isin(0, 1)).alias("bad_success"),
                 count_where(F.col("fault_turn") >= F.col("n")).alias("turn_outside"))


def column_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing or non-finite values, range and constancy of every feature column."""
    long = df.select("run_id", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(["run_id"], cols, "feature", "v")
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    return long.groupBy("feature").agg(_one().alias("n"), count_where(bad).alias("bad"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                       (F.min("v") == F.max("v")).alias("constant"))


