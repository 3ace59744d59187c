"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Matches of a pattern are found with their places: splitting a text at the
pattern gives the stretches between the matches, and running sums of lengths
give each match's first and last code point. The values found, and less certain
candidates (long mixed tokens), are then counted over the whole corpus by
distinct repositories and owners. A value that one owner alone has looks live;
one that several have is a copied example. Live-looking candidates become spans
of the kind ``owned``; the base kinds stay whatever their frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import written


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Group that holds the value, and its least length.
    group: int
    least: int


BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", "AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 and more are the maximal runs that are long enough
    Kind("hex", "[0-9a-f]{16,}", 0, 16),
)
CANDIDATE = Kind("owned", "[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = (*BASE, CANDIDATE)
#: Distinct owners from which on a value counts as a copied example.
COPIED_OWNERS = 2


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<gap, match>>: each match with the length of the stretch before it."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x))
    return F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())


def _spans(rows: DataFrame) -> DataFrame:
    """``(rid, owner, repo, kind, start, end, value)`` of all matches that are long enough; candidates mix letters and digits."""
    each = rows.select("rid", "owner", "repo", F.explode(F.array(*[
        F.struct(F.lit(i).alias("kind"), F.col(f"m{i}").alias("found")) for i in range(len(KINDS))])).alias("k"))
    each = each.filter(F.size("k.found") > 0).select("rid", "owner", "repo", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("nth", "f"))
    before = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    match = F.col("f.match")
    end = F.sum(F.col("f.gap") + F.length(match)).over(before)
    value = F.when(F.col("kind") == 0, F.regexp_extract(match, KINDS[0].pattern, KINDS[0].group)).otherwise(match)
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    out = each.select("rid", "owner", "repo", "kind", (end - F.length(match)).alias("start"), end.alias("end"), value.alias("value"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return out.filter((F.length("value") >= least) & ((F.col("kind") < len(BASE)) | mixed))


def _written_spans(array: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None,
         copied: int = COPIED_OWNERS) -> DataFrame:
    """One row per input row: ``(id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied)``.

    * A span is ``kind:start:end`` in code points, end exclusive, in order of start, then of kind. base_sha256 hashes the
      spans of the base kinds; ``spans`` has those of the kind ``owned`` too: candidates that overlap no base span and
      whose value only one owner has.
    * n_live, n_copied: spans whose value fewer than ``copied`` owners have, and the others, base spans included.
    * owner, repo: columns; a null owner or repository is one of its own. By default ``source`` is the owner and source
      with ``lang`` the repository, as ``documents`` names no repositories.
    * Null texts are empty; repeated rows each give a row and one owner's copies count once. Other columns are ignored.

    Values are counted by (value, owner, repo) before they are counted by value, so a key that a third of all documents
    hold is summed up where it is read. Rows carry their spans only, never the text.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.struct("source", "lang") if repo is None else repo
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.lit(0), owner).alias("owner"),
                       F.xxhash64(F.lit(1), repo).alias("repo"), *[_found(text, k).alias(f"m{i}") for i, k in enumerate(KINDS)])
    rows = written(rows, "matches")
    spans = written(_spans(rows).withColumn("hash", F.sha2("value", 256)).drop("value"), "spans")
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    known = written(by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")), "ownership")
    spans = spans.join(known.hint("merge"), "hash")
    order = Window.partitionBy("rid").orderBy("start", "kind")
    base = F.col("kind") < len(BASE)
    ends = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(ends, F.lit(0)) <= F.col("start")) & (F.coalesce(starts, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("free", free).filter(base | (F.col("free") & (F.col("owners") < copied)))
    place = F.struct("start", "kind", "end")
    each = spans.groupBy("rid").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        F.sort_array(F.collect_list(F.when(base, place))).alias("base"), F.sort_array(F.collect_list(place)).alias("spans"),
        F.count_if(F.col("owners") < copied).alias("n_live"), F.count_if(F.col("owners") >= copied).alias("n_copied"))
    each = each.select("rid", *[f"n_{k.name}" for k in BASE], "n_live", "n_copied", _written_spans(F.col("base")).alias("base"), _written_spans(F.col("spans")).alias("spans"))
    out = rows.select("rid", "id").join(each.hint("merge"), "rid", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*[f"n_{k.name}" for k in BASE], "n_live", "n_copied")]
    return out.select(F.col("id").alias(id_col), *counts[:-2], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"), *counts[-2:])
