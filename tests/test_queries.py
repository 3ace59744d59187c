"""Every query with checking SQL equals DuckDB on the same tables, with runs cut into many chunks."""

import pytest
from harness import compare, connect

from tracewright.catalog import all_queries, base

SF = "/root/testdata/sf0.001"
MODELS = {"l5_", "l6_", "l7_", "l8_", "l9_", "l10_two", "l12_", "l16_", "l17_", "l18_", "l20_probe_scores", "l21_", "t10_"}
NAMES = [n for n in all_queries() if base.oracle(n) and not any(n.startswith(m) for m in MODELS)]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(name, spark, con, SF, allow_empty=True) is None


def test_entry_points_agree():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", ["l7_learns_rule", "l12_text_contract"])
def test_models_learn_and_answer(spark, con, name):
    assert compare(name, spark, con, SF) is None
