"""Side-by-side gathering of one-row-per-run blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def gather(base: DataFrame, *blocks: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run of ``base`` with the columns of all blocks (one row per run each).

    The blocks are stacked and folded by one aggregation, so N blocks cost one
    shuffle instead of N joins. Absent values are null. The whole step is one SQL
    statement: the plan below it is large, and each further call would analyse
    all of it again.
    """
    spark = base.sparkSession
    tables = [base, *blocks]
    dtypes = [[(c, d) for c, d in t.dtypes if c != key] for t in tables]
    types = {c: d for cols in dtypes for c, d in cols}
    views, parts = [], []
    for i, (t, cols) in enumerate(zip(tables, dtypes)):
        view = f"gather_{uuid.uuid4().hex}"
        t.createOrReplaceTempView(view)
        views.append(view)
        own = dict(cols)
        parts.append(f"SELECT {key}, {1 if i == 0 else 0} AS in_base, " + ", ".join(
            f"`{c}`" if own.get(c) == d else f"CAST({'`' + c + '`' if c in own else 'NULL'} AS {d}) AS `{c}`" for c, d in types.items())
            .rstrip(", ") + f" FROM {view}")
    if not types:
        parts = [p.replace(" AS in_base,  FROM", " AS in_base FROM") for p in parts]
    folded = ", ".join([key, *[f"max(`{c}`) AS `{c}`" for c in types]])
    out = spark.sql(f"SELECT {folded} FROM ({' UNION ALL '.join(parts)}) GROUP BY {key} HAVING max(in_base) = 1")
    for v in views:
        spark.catalog.dropTempView(v)
    return out
