"""Ordered computations that never hold a whole group in one task.

A plain window partitioned by run puts the run into one task, and one run may
hold a third of all rows. The functions here cut every group into chunks of
consecutive positions, work inside the chunks, and carry one summary row per
chunk forward. Results are the same as those of the plain window.

What is scanned has a row for each event, so it asks to be merged where it is
joined: Spark's estimates of such plans can be small enough for a broadcast,
which would collect all events on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import chunk_turns

FIRST = Window.unboundedPreceding

_AGG = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def chunk_of(df: DataFrame, pos: str | Column) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(chunk_turns(df.sparkSession))).cast("long")


def _total(kind: str, value: Column, order: list[str], reverse: bool) -> Column:
    if kind != "last":
        return _AGG[kind](value)
    rank = F.when(value.isNotNull(), F.struct(*order))
    return (F.min_by if reverse else F.max_by)(value, rank)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Iterable[str],
    order: list[str],
    aggs: dict[str, tuple],
    reverse: bool = False,
    pos: str | Column | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Running aggregates over ``keys`` ordered by ``order``.

    ``aggs`` maps an output name to ``(kind, column)`` or ``(kind, column,
    inclusive)``; kinds are sum, min, max and last (latest non-null value).
    ``reverse`` scans from the end. Two levels: inside a chunk, then over one
    summary row per chunk. Only groups with more than one chunk get a carry.
    """
    keys = list(keys)
    specs = {o: (a[0], F.col(a[1]) if isinstance(a[1], str) else a[1], a[2] if len(a) > 2 else True)
             for o, a in aggs.items()}
    c = chunk if chunk is not None else chunk_of(df, pos if pos is not None else order[0])
    vals = {o: f"__v_{o}" for o in specs}
    d = df.select("*", c.alias("__c"), *[v.alias(vals[o]) for o, (_, v, _i) in specs.items()])
    ordering = [F.col(x).desc() if reverse else F.col(x).asc() for x in order]
    w = Window.partitionBy(*keys, "__c").orderBy(*ordering)
    local = d.select(
        "*",
        *[_AGG[k](F.col(vals[o])).over(w.rowsBetween(FIRST, 0 if inc else -1)).alias(f"__l_{o}")
          for o, (k, _v, inc) in specs.items()],
    )
    totals = d.groupBy(*keys, "__c").agg(
        *[_total(k, F.col(vals[o]), order, reverse).alias(f"__t_{o}") for o, (k, _v, _i) in specs.items()])
    wc = Window.partitionBy(*keys).orderBy(F.col("__c").desc() if reverse else F.col("__c").asc()).rowsBetween(FIRST, -1)
    carry = totals.select(
        *keys, "__c",
        *[_AGG[k](F.col(f"__t_{o}")).over(wc).alias(f"__k_{o}") for o, (k, _v, _i) in specs.items()],
    ).filter(_any_not_null([f"__k_{o}" for o in specs]))
    # where positions are sparse a chunk is hardly more than a row: the carries are no small table, and both sides are dealt alike
    joined = local.join(carry.hint("merge"), [*keys, "__c"], "left")
    return joined.select(
        *df.columns,
        *[_combine(k, F.col(f"__l_{o}"), F.col(f"__k_{o}")).alias(o) for o, (k, _v, _i) in specs.items()],
    ).hint("merge")


def _any_not_null(cols: list[str]) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNotNull()
    return cond


def framed(
    df: DataFrame,
    keys: Iterable[str],
    before: int,
    after: int,
    exprs: Callable[[Window], dict[str, Column]],
    pos: str = "t",
) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` positions away.

    Rows near a chunk border are copied into the neighbouring chunk, so one
    shuffle on (keys, chunk) is enough and no task holds more than a chunk plus
    its halo. ``exprs`` gets the window (ordered by ``pos``) and returns columns.
    """
    keys = list(keys)
    size = chunk_turns(df.sparkSession)
    own = F.floor(F.col(pos) / size).cast("long")
    inside = F.pmod(F.col(pos).cast("long"), F.lit(size))
    steps = [own]
    # how many whole chunks the halo can reach (more than one only for tiny chunks in tests)
    for j in range(1, before // size + 2):
        steps.append(F.when(inside + before >= size * j, own + j))
    for j in range(1, after // size + 2):
        steps.append(F.when(inside - after < -size * (j - 1), own - j))
    d = df.withColumn("__c", F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())))
    w = Window.partitionBy(*keys, "__c").orderBy(pos)
    out = exprs(w)
    return (
        d.select("*", *[e.alias(n) for n, e in out.items()])
        .filter(F.col("__c") == F.floor(F.col(pos) / size))
        .drop("__c")
    )


def lookup(
    points: DataFrame,
    events: DataFrame,
    keys: Iterable[str],
    aggs: dict[str, tuple],
    direction: str = "prev",
    inclusive: bool = False,
    pos: str = "t",
    event_pos: str | None = None,
    tie: str | None = None,
) -> DataFrame:
    """For every point, aggregates over the events before (or after) it.

    An as-of join without a join: points and events are laid on one line per
    key and scanned once, so a key with many points and many events costs
    their sum and not their product. ``direction`` is "prev" or "next";
    ``inclusive`` says whether an event at the point's own position counts.
    ``tie`` is an event column that orders events at equal positions.
    """
    keys = list(keys)
    reverse = direction == "next"
    point_side = 1 if inclusive != reverse else 0
    pcols = [c for c in points.columns if c not in keys]
    p = points.select(
        *keys, F.col(pos).cast("double").alias("__pos"), F.lit(point_side).alias("__s"),
        F.struct(*[F.col(c) for c in pcols]).alias("__p"))
    e = events.select(
        *keys, F.col(event_pos or pos).cast("double").alias("__pos"), F.lit(1 - point_side).alias("__s"),
        *([F.col(tie).cast("long").alias("__tie")] if tie else []),
        *[(F.col(a[1]) if isinstance(a[1], str) else a[1]).alias(f"__e_{o}") for o, a in aggs.items()])
    line = p.unionByName(e, allowMissingColumns=True)
    order = ["__pos", "__s"] + (["__tie"] if tie else [])
    scanned = running(line, keys, order, {o: (a[0], f"__e_{o}", True) for o, a in aggs.items()},
                      reverse=reverse, pos="__pos")
    return scanned.filter(F.col("__p").isNotNull()).select(*keys, "__p.*", *aggs.keys())


def percentiles(df: DataFrame, keys: Iterable[str], value: str, qs: dict[str, float],
                how: str = "cont") -> DataFrame:
    """Exact percentiles per group from counts of distinct values.

    Equal values are counted before the shuffle, and the cumulative count is a
    chunked scan over coarse logarithmic value buckets, so neither a hot group
    nor a global group ends up in one task. ``how`` is "cont" (linear between
    neighbours) or "disc" (nearest rank, ceil(q*n)).
    """
    keys = list(keys)
    extra = [] if keys else [F.lit(0).alias("__g")]
    ks = keys or ["__g"]
    counts = (df.filter(F.col(value).isNotNull())
              .select(*keys, *extra, F.col(value).cast("double").alias("__x"))
              .groupBy(*ks, "__x").agg(F.count(F.lit(1)).alias("__n")))
    bucket = F.floor(F.signum("__x") * F.log1p(F.abs("__x")) * 1024).cast("long")
    cum = running(counts, ks, ["__x"], {"__upto": ("sum", "__n")}, chunk=bucket)
    total = counts.groupBy(*ks).agg(F.sum("__n").alias("__total"))
    ranked = cum.join(total, ks)
    outs, picks = [], []
    for name, q in qs.items():
        if how == "disc":
            need = F.greatest(F.ceil(F.lit(q) * F.col("__total")), F.lit(1))
            picks.append(F.min(F.when(F.col("__upto") >= need, F.col("__x"))).alias(name))
            outs.append(F.col(name))
            continue
        at = F.lit(q) * (F.col("__total") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [
            F.min(F.when(F.col("__upto") > lo, F.col("__x"))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__upto") > hi, F.col("__x"))).alias(f"__hi_{name}"),
            F.max(at - lo).alias(f"__fr_{name}"),
        ]
        outs.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
                     * F.col(f"__fr_{name}")).alias(name))
    return ranked.groupBy(*ks).agg(*picks).select(*keys, *outs)


def ranked(df: DataFrame, keys: Iterable[str], order: list[str], name: str, chunk: Column) -> DataFrame:
    """0-based dense position inside a group whose order column is not dense."""
    out = running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, chunk=chunk)
    return out.withColumn(name, F.col(name) - 1)


def bracket_levels(df: DataFrame, keys: Iterable[str], delta: str, pos: str = "t") -> DataFrame:
    """Stack depth of open (+1) and close (-1) events; a close on an empty stack is ignored.

    Adds ``level``: for an open the depth it creates, for a close the depth it
    removes, null for an ignored close. An open and the close that pops it have
    the same level and are neighbours among the events of that level. Needs the
    running sum and the running minimum of that sum, both carried across chunks.
    """
    keys = list(keys)
    d = df.withColumn("__c", chunk_of(df, pos))
    w = Window.partitionBy(*keys, "__c").orderBy(pos)
    d = d.withColumn("__s", F.sum(delta).over(w.rowsBetween(FIRST, 0)))
    d = d.withColumn("__m", F.min("__s").over(w.rowsBetween(FIRST, -1)))
    wc = Window.partitionBy(*keys).orderBy("__c").rowsBetween(FIRST, -1)
    tot = d.groupBy(*keys, "__c").agg(F.sum(delta).alias("__tot"), F.min("__s").alias("__low"))
    tot = tot.withColumn("__s0", F.sum("__tot").over(wc)).withColumn("__low", F.coalesce("__s0", F.lit(0)) + F.col("__low"))
    tot = tot.withColumn("__m0", F.min("__low").over(wc)).filter(F.col("__s0").isNotNull()).select(
        *keys, "__c", "__s0", "__m0")
    j = d.join(tot.hint("merge"), [*keys, "__c"], "left")
    s0 = F.coalesce("__s0", F.lit(0))
    s = s0 + F.col("__s")
    before = s - F.col(delta)
    floor = F.least(F.lit(0), F.col("__m0"), s0 + F.col("__m"))
    depth = before - floor
    level = F.when(F.col(delta) > 0, depth + 1).when(depth > 0, depth)
    return j.select(*df.columns, level.cast("long").alias("level")).hint("merge")


def chain_lengths(df: DataFrame, keys: Iterable[str], cond: Column, name: str, pos: str = "t") -> DataFrame:
    """How many rows in a row (in ``pos`` order, positions may have gaps) ``cond`` has held."""
    one = F.lit(1).cast("long")
    idx = running(df.withColumn("__cond", cond), keys, [pos], {"__i": ("sum", one)}, pos=pos)
    out = running(idx, keys, [pos], {"__b": ("max", F.when(~F.col("__cond"), F.col("__i")))}, pos=pos)
    return out.select(*df.columns, (F.col("__i") - F.coalesce("__b", F.lit(0))).alias(name))
