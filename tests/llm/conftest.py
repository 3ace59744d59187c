import pytest

#: Columns that clash with names the operators use themselves.
EXTRA = {"id": 1, "row": "x", "k1": 2, "fp": 3, "spans": "s", "rid": 4, "words": "w", "tokens": 5, "p": 6}


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (id, text) as a table with further columns of clashing names."""

    def make(rows, id_col="doc_id", text_col="text", extra=True, **more):
        names = [id_col, text_col, *more]
        kinds = [f"{id_col} bigint", f"{text_col} string", *(f"{k} {v}" for k, v in more.items())]
        clash = {k: v for k, v in EXTRA.items() if extra and k not in names}
        kinds += [f"`{k}` {'string' if isinstance(v, str) else 'int'}" for k, v in clash.items()]
        return spark.createDataFrame([(*r, *clash.values()) for r in rows], ", ".join(kinds)).repartition(3)

    return make


@pytest.fixture(scope="session")
def long_text():
    """400 000 different words on many lines."""
    return "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(10_000))
